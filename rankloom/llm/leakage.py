"""Evaluation texts leaking into training text: template windows, hash-joined, checked by alignment and slots.

Texts become templates: mark-up, escapes, look-alike letters, case, accents and punctuation go; numbers, the units behind
them and names (runs of two or more capitalised words that the items never write small) become typed placeholders, so a
question with other parameters keeps its template. Windows of ``WINDOW`` template words of the items' passages, once with
names and once without, form a hash index; the windows of every document are joined with it inside the tasks. ``HITS`` hits
of one item on neighbouring diagonals make a candidate; where enough words can be met, slots aside, its region is aligned
word by word (local alignment, +1 for a word, -1 for a change, a loss or a word put in between). A document holds an item
if the aligned stretch has ``LEAST`` words of the passage in its order. A slot counts as a word if it holds the same value;
another value costs nothing as long as equal values are replaced by equal values (slot consistency), and the item is then
reported as re-parameterised.

The items are a stated, small query set; they are indexed in blocks of ``BLOCK`` items, which bounds what a task holds,
and all documents are probed against every block. Probing is row-local, nothing is shuffled.

Passage: an item without its opening line, where other items share that line, and without a closing line that asks.

Defined results: null and empty documents hold nothing; equal documents are all reported; an item whose passage is shorter
than ``LEAST`` words can't be found; repeated items are reported under each id; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, HITS, LEAST = 4, 3, 15
#: Least share of the aligned stretch that must be words of the passage.
DENSITY = 0.72
BLOCK = 5_000
_BAND, _REACH = 6, 40
#: Bytes of the marks that an index keeps of the words of its passages.
_SPAN = int(LEAST / DENSITY)
_MARKS = 16_000_000

_LOOKALIKE = str.maketrans("асеорхуіјѕһԁԛԝАВЕКМНОРСТХУІЈЅαοντυρικ", "aceopxyijshdqwABEKMHOPCTXYIJSaovtupik")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->", re.S)
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([ntr\"'/\\])")
_TOKEN = re.compile(r"\d[\d.,]*\d|\d|[^\W\d_]+(?:['’][^\W\d_]+)*")
_ASCII_TOKEN = re.compile(r"[0-9][0-9.,]*[0-9]|[0-9]|[A-Za-z]+(?:'[A-Za-z]+)*")
_TO_FOLD = re.compile(r"[\x00-\x08\x0e-\x1f\x80-\U0010ffff]")
_INVISIBLE = re.compile(r"[­​-‏⁠-⁤﻿\x00-\x08\x0e-\x1f]")
_BROKEN = re.compile(r"(?<=\w)-\s*\r?\n\s*(?=[a-z])")
NUMBER, UNIT, NAME = 1, 2, 3


class _Folded(dict):
    """Character -> what stands for it, found out once for each."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFKD", "" if _INVISIBLE.match(c) else c).translate(_LOOKALIKE)
        out = self[code] = "".join(x for x in plain if not unicodedata.combining(x))
        return out


_FOLDED = _Folded({ord("’"): "'", ord("_"): " ", ord("*"): ""})


def fold(text: str) -> str:
    """Mark-up, escapes, look-alikes and accents undone; case is kept."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " " if m[3] in "ntr" else m[3], text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m[0][1:2] in "biuBIUe/" or m[0][1:5].lower() in ("span", "stro", "mark") else " ", text)
    ascii_only = text.isascii()
    text = text.replace("_", " ").replace("*", "")
    if not ascii_only:
        text = _TO_FOLD.sub(lambda m: _FOLDED[ord(m[0])], text)
    return _BROKEN.sub("", text) if "-" in text and "\n" in text else text


def tokens(text: str) -> list[str]:
    """The words and numbers of a text, their case kept."""
    text = fold(text)
    return (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text)


def passages(items: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(item, passage) without opening lines that items share and closing questions."""
    opening = Counter(re.sub(r"\s+", " ", t.split("\n", 1)[0]).strip() for _, t in items if "\n" in t)
    out = []
    for i, t in items:
        lines = t.strip().split("\n")
        if len(lines) > 1 and opening[re.sub(r"\s+", " ", lines[0]).strip()] > 1:
            lines = lines[1:]
        if len(lines) > 1 and lines[-1].rstrip().endswith("?"):
            lines = lines[:-1]
        out.append((i, "\n".join(lines)))
    return out


class _Codes(dict):
    """Word -> 4 x its code + 2 if it may be part of a name + 1 if it is a number; code 0: no word of the passages."""

    def __init__(self, vocabulary: dict[str, int], small: set[str]) -> None:
        super().__init__()
        self.vocabulary, self.small = vocabulary, small

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        low = word.casefold()
        named = word[0].isupper() and not word.isupper() and low not in self.small
        out = self[word] = self.vocabulary.get(low, 0) * 4 + 2 * named + word[0].isdigit()
        return out


class Text:
    """A text as arrays: codes of its words, its template without names and its template."""

    def __init__(self, words: list[str], known: _Codes) -> None:
        info = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.words, self.exact = words, info >> 2
        number, capital = (info & 1).astype(bool), (info & 2).astype(bool)
        unit = np.zeros(len(words), bool)
        unit[1:] = number[:-1] & ~number[1:]
        beside = np.zeros(len(words), bool)
        beside[1:] |= capital[:-1]
        beside[:-1] |= capital[1:]
        self.plain = np.where(number, NUMBER, np.where(unit, UNIT, self.exact))
        self.named = capital & beside & ~number & ~unit
        self.shape = np.where(self.named, NAME, self.plain)

    def windows(self, bare: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, keys) of the windows in which every word is known: without names, with names, and of bare values.

        A window goes on until it has ``WINDOW`` template words of which all but one are no slots, so that one full of
        slots still says something.
        """
        n = len(self.words)
        if n < WINDOW:
            return
        power = _power(n)
        for codes, only in ((self.plain, None), (self.shape, self.named), (self.exact, None))[: 3 if bare else 2]:
            if only is not None and not only.any():
                continue
            unknown = codes == 0
            fits = ~unknown[: n - WINDOW + 1]
            for k in range(1, WINDOW):
                fits &= ~unknown[k : n - WINDOW + 1 + k]
            at = fits.nonzero()[0]  # most windows end here: one of their first words is unknown
            literal = _running(codes > NAME)
            end = np.maximum(literal.searchsorted(literal[at] + (WINDOW - 1)), at + WINDOW)
            at, end = at[end <= n], end[end <= n]
            gone = _running(unknown)
            fits = gone[end] == gone[at]
            if only is not None:
                names = _running(only)
                fits &= names[end] > names[at]
            at, end = at[fits], end[fits]
            if len(at):
                total = _running(codes.astype(np.uint64) * _MIX * power[0][:n])
                yield at, (total[end] - total[at]) * power[1][at]


def _running(x: np.ndarray) -> np.ndarray:
    """The sums of the entries before each place, and of all."""
    out = np.zeros(len(x) + 1, np.uint64 if x.dtype == np.uint64 else np.int64)
    x.cumsum(out=out[1:])
    return out


_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse, modulo 2^64, n of them or more."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(4096, 2 * n)
        # whole numbers throughout: a plain 1 beside them would make them floats, which lose the hash
        table = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
        _POWERS[:] = [(table[0], table[1])]
    return _POWERS[0]


class Index:
    """The template windows of some passages."""

    def __init__(self, block: list[tuple[int, str]]) -> None:
        self.items = [i for i, _ in block]
        raw = [tokens(t) for _, t in block]
        vocabulary = {w: k + 4 for k, w in enumerate(sorted({w.casefold() for x in raw for w in x}))}
        self.known = _Codes(vocabulary, {w for x in raw for w in x if w[0].islower()})
        self.texts = [Text(w, self.known) for w in raw]
        keys: dict[int, set[tuple[int, int]]] = defaultdict(set)
        self.bare = False  # is there a passage of hardly anything but slots? It is looked for by its values.
        for n, t in enumerate(self.texts):
            kinds = list(t.windows(False))
            if not any(len(at) >= HITS for at, _ in kinds) and len(t.words) >= LEAST:
                kinds, self.bare = list(t.windows(True)), True
            for at, found in kinds:
                for pos, key in zip(at.tolist(), found.tolist()):
                    keys[key].add((n, pos))
        self.keys = np.array(sorted(keys), np.uint64)
        postings = [sorted(keys[k]) for k in self.keys.tolist()]
        self.size = np.array([len(x) for x in postings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.posted = np.array([x for found in postings for x in found], np.int64).reshape(-1, 2)  # item number, place
        self._words = len(vocabulary) + 4
        self._marks: dict[int, np.ndarray] = {}

    def _has(self, n: int) -> np.ndarray:
        """A mark for every word that passage ``n`` has; of at most ``_MARKS`` bytes in all."""
        out = self._marks.get(n)
        if out is None:
            if (len(self._marks) + 1) * self._words > _MARKS:
                self._marks.clear()
            out = self._marks[n] = np.zeros(self._words, bool)
            out[self.texts[n].exact] = True
        return out

    def _enough(self, n: int, first: int, last: int, diagonals: np.ndarray, text: Text) -> bool:
        """Can a stretch around the hits have LEAST words of the passage? Counts words equal on a diagonal of the hits.

        A necessary condition: losses and insertions move the alignment to a neighbouring diagonal, which counts too, and
        slots filled otherwise take no part. Before that, words that the passage has anywhere are counted.
        """
        item = self.texts[n]
        low, high = max(0, first - _REACH), min(len(text.words), last + WINDOW + _REACH)
        has = self._has(n)[text.exact[low:high]]
        if np.count_nonzero(has) < LEAST or not _dense(has[has | (text.shape[low:high] > NAME)]):
            return False
        met, slot = np.zeros(high - low, bool), np.zeros(high - low, bool)
        for diagonal in {d + j for d in set(diagonals.tolist()) for j in (-2, -1, 0, 1, 2)}:
            # document position p stands against passage position p - diagonal
            a, b = max(low, diagonal), min(high, len(item.words) + diagonal)
            if a < b:
                there = slice(a - diagonal, b - diagonal)
                met[a - low : b - low] |= text.exact[a:b] == item.exact[there]
                slot[a - low : b - low] |= (text.shape[a:b] == item.shape[there]) & (item.shape[there] <= NAME)
        return _dense(met[met | ~slot])

    def candidates(self, text: Text) -> list[tuple[int, int, int]]:
        """(item number, first and last word of the region to align) where enough words are covered by hits."""
        if not len(self.keys):
            return []
        places, numbers = [], []
        for at, keys in text.windows(self.bare):
            found = self.keys.searchsorted(keys)
            found[found == len(self.keys)] = 0
            hit = (self.keys[found] == keys).nonzero()[0]
            places.append(at[hit])
            numbers.append(found[hit])
        if sum(map(len, places)) < 1:
            return []
        place, number = np.concatenate(places), np.concatenate(numbers)
        size = self.size[number]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        posted = self.posted[np.repeat(self.start[number], size) + inside]
        at = np.repeat(place, size)
        # item number, diagonal and place in one number: hits in order, each once
        hits = np.unique(posted[:, 0] << 49 | (at - posted[:, 1] + (1 << 23)) << 24 | at)
        item, diagonal, at = hits >> 49, (hits >> 24 & (1 << 25) - 1) - (1 << 23), hits & (1 << 24) - 1
        cuts = np.flatnonzero((item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > _BAND)) + 1
        out = []
        met = at.tolist()
        for a, b in _spans(cuts, len(hits)):
            n, near = int(item[a]), met[a:b]
            first, last = min(near), max(near)
            if last - first <= _REACH:
                parts = ((first, last),)
            else:
                order = np.sort(at[a:b])
                parts = [(int(order[c]), int(order[d - 1])) for c, d in _spans(np.flatnonzero(order[1:] - order[:-1] > _REACH) + 1, b - a)]
            for first, last in parts:
                if self._enough(n, first, last, diagonal[a:b], text):
                    out.append((n, first, last + WINDOW))
        return out


def _spans(cuts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts of at least ``HITS`` entries between cuts."""
    ends = np.concatenate([[0], cuts, [n]])
    long = np.flatnonzero(ends[1:] - ends[:-1] >= HITS)
    return zip(ends[long].tolist(), ends[long + 1].tolist())


def _dense(met: np.ndarray) -> bool:
    """Are LEAST words met somewhere within the span that DENSITY allows?"""
    at = met.nonzero()[0]
    return len(at) >= LEAST and bool((at[LEAST - 1 :] - at[: 1 - LEAST]).min() <= _SPAN)


def align(item: Text, text: Text, first: int, last: int) -> tuple[int, bool]:
    """(words of the passage on the best aligned stretch, were slots filled otherwise) of a region of a document."""
    exact, shape, width = text.exact[first:last], text.shape[first:last], last - first
    same = (item.exact[:, None] == exact) & (exact > 0)
    slot = (item.shape[:, None] == shape) & (shape <= NAME) & (shape > 0)
    gain = np.where(same, 1, np.where(slot, 0, -1))
    step = np.arange(width + 1)
    rows = np.zeros((len(item.words) + 1, width + 1), np.int64)
    for i in range(len(item.words)):
        row = np.maximum(rows[i] - 1, 0)
        row[1:] = np.maximum(row[1:], rows[i, :-1] + gain[i])
        rows[i + 1] = np.maximum.accumulate(row + step) - step  # words put in between cost one each
    i, j = divmod(int(rows.argmax()), width + 1)
    equal, slots, steps, drawn_otherwise = 0, {}, 0, 0
    while i and j and rows[i, j] > 0:
        if rows[i, j] == rows[i - 1, j - 1] + gain[i - 1, j - 1]:
            equal += int(same[i - 1, j - 1])
            if slot[i - 1, j - 1] and not same[i - 1, j - 1]:
                slots.setdefault(item.words[i - 1].casefold(), set()).add(text.words[first + j - 1].casefold())
                drawn_otherwise += 1
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
        steps += 1
    consistent = all(len(v) == 1 for v in slots.values())
    if equal < DENSITY * (steps - drawn_otherwise * consistent):
        equal = min(equal, LEAST - 1)
    return equal, bool(slots) and consistent


def held(text: str | None, index: Index) -> list[tuple[int, int, bool]]:
    """(item, words of its passage, re-parameterised) for every item of an index that a text holds."""
    if not text:
        return []
    words = tokens(text)
    if len(words) < LEAST:
        return []
    document = Text(words, index.known)
    out: dict[int, tuple[int, bool]] = {}
    for n, low, high in index.candidates(document):
        found = align(index.texts[n], document, max(0, low - _REACH), min(len(words), high + _REACH))
        if found[0] >= LEAST and found > out.get(n, (0, False)):
            out[n] = found
    return [(index.items[n], *found) for n, found in out.items()]


_BUILT: dict[str, Index] = {}


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, words, reparameterised) for every document that holds an item."""
    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long"), F.col(item_text)).orderBy(item_id).collect()
    known = passages([(r[0], r[1]) for r in rows])
    docs = documents.where(F.length(text) > 0).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, words int, reparameterised boolean"
    out = None
    for k in range(0, max(1, len(known)), BLOCK):
        shared = documents.sparkSession.sparkContext.broadcast(known[k : k + BLOCK])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            if token not in _BUILT:
                _BUILT.clear()
                _BUILT[token] = Index(shared.value)
            index = _BUILT[token]
            for batch in batches:
                found = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for h in held(t, index)]
                cols = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["doc_id", "item_id", "words", "reparameterised"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
