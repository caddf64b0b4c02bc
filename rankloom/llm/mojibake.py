"""Garbled text from a wrong character encoding: a hidden Markov model labels characters, labels are inverted.

States: one *clean* state and one for each way of spoiling text. Most are encoding pairs (UTF-8 bytes read as another
charset). The others stand for what extraction from files does: codes shifted by a font's glyph numbers, a filler after
every character (two-byte text read as one-byte text), characters replaced by a substitute, ligatures turned into one
odd glyph, and glyphs lost without a trace or to a blank. A state explains one character or a short unit of characters
(the bytes of one UTF-8 sequence, a character and its filler) and emits what the unit was before: its emission is
the clean model's probability of the *restored* character after the restored one before it. The clean model is a table
of letter pairs, counted over the words of all titles. The best path (Viterbi) labels every unit; each labelled span is
replaced by its state's inverse, which the units carry already.

Lost glyphs leave nothing to emit, so there the lexicon speaks: a gap is a unit of the lost state if filling it turns a
rare word into a common one of the corpus, and the filled letters occur nowhere else in the text, since a font that
lost a glyph lost it everywhere.

Words and their counts come from one aggregation over all rows, and all of them count. A task holds the words with
``CONTRAST`` occurrences and more, which alone can prove a loss; the others as nine bytes each, a hash and their number.
Gaps are looked up among all those words by bit sets, one for each length, place and letter.

Defined results: null, empty and blank texts are clean; a spoilt text whose characters can't be had back has a null
``restored``; equal texts get equal results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.plans.session import discard, stored

#: How many times more often the filled word must occur than the one with the gap.
CONTRAST = 20

# Charsets that UTF-8 is wrongly read in; ligatures that fonts draw as one glyph; usual punctuation.
CHARSETS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp1253", "cp866")
LIGATURES = ("ffi", "ffl", "th", "ti", "st", "ff", "fi", "fl", "tt", "ct", "ft")
PUNCTUATION = set(" .,:;-–—!?()[]/&'’‘“”\"„«»¿¡…+%#*=<>_|@$§°·")
SHIFT = 29
_FILLERS = " \x00�"
_SUBSTITUTE = "�"
_GLYPHS = "ƟƠơʦ"
_UTF7 = re.compile(r"\+[A-Za-z0-9+/]{3,}-")
_LOW_BYTES = {"\x13": "–", "\x14": "—", "\x18": "‘", "\x19": "’", "\x1c": "“", "\x1d": "”"}

ENTER, LEAVE, STAY = math.log(1e-2), math.log(0.3), math.log(0.7)
#: States that spoil a whole text are not entered for a few characters.
ENTER_WHOLE = math.log(1e-9)
GO_ON = math.log(0.998)
FLOOR, MARK, NEVER = math.log(1e-7), math.log(3e-3), math.log(1e-12)


def _tangled(word: str) -> bool:
    """Is a word UTF-8 bytes read in a charset?"""
    return _TWO.search(word) is not None and any(_sequences(word))


def _pure(word: str, known: set[str]) -> bool:
    """Is a tangled word none after all, because what it would stand for occurs nowhere?"""
    return not any(char.lower() in known for *_, char in _sequences(word))


def letter_pairs(words: Iterable[tuple[str, int]]) -> Counter[tuple[str, str]]:
    """How often letters follow each other in words, a blank before and behind each; a word of one letter follows nothing."""
    pairs: Counter = Counter()
    for word, n in words:
        if len(word) == 1:
            pairs["", word] += n
        elif not word.isdigit():
            for a, b in zip(" " + word, word + " "):
                pairs[a, b] += n
    return pairs


class CleanModel:
    """Letter pairs and words of clean text.

    ``counts`` has all words, or the frequent ones; then ``rest`` has the sorted hashes and the numbers of the others,
    ``pairs`` the letter pairs of all, ``total`` the number of all occurrences. Spoilt text must not teach the model:
    words that are tangled are left out.
    """

    def __init__(self, counts: dict[str, int], rest: tuple[np.ndarray, np.ndarray] | None = None, pairs: Counter[tuple[str, str]] | None = None, total: int = 0, tangled: dict[str, int] | None = None) -> None:
        if pairs is None:
            tangled = {w: n for w, n in counts.items() if _tangled(w)}
            counts = {w: n for w, n in counts.items() if w not in tangled}
            pairs, total = letter_pairs(counts.items()), sum(counts.values())
        known = {b for _, b in pairs} | PUNCTUATION
        pure = {w: n for w, n in (tangled or {}).items() if _pure(w, known)}
        self.counts, self.rest = {**counts, **pure}, rest
        #: A word below this count is rare: one in 20,000 words.
        self.rare = max(5, (total + sum(pure.values())) // 20_000)
        self._filled: dict[str, list[tuple[str, str]]] = {}
        self._emitted: dict[tuple[str, str], float] = {}
        self._looked: dict[str, int] = {}
        pairs = Counter(pairs)
        pairs.update(letter_pairs(pure.items()))
        follow: Counter = Counter()
        singles: Counter = Counter()
        for (a, b), n in pairs.items():
            singles[b] += n
            if a:
                follow[a] += n
        self.pairs = {k: math.log(n / (follow[k[0]] + 50)) for k, n in pairs.items() if n > 1 and k[0]}
        everything = sum(singles.values()) or 1
        self.singles = {b: math.log(n / everything) - 3 for b, n in singles.items() if n > 1}
        self._gaps: dict[int, tuple[list[str], dict[tuple[int, str], int]]] | None = None

    def count(self, word: str) -> int:
        """How often a word occurs, whether it is held as a word or as a hash."""
        n = self.counts.get(word)
        if n is not None or self.rest is None:
            return n or 0
        found = self._looked.get(word)
        if found is None:
            hashes, numbers = self.rest
            h = _hash(word)
            at = int(np.searchsorted(hashes, h))
            if len(self._looked) > 200_000:
                self._looked.clear()
            found = self._looked[word] = int(numbers[at]) if at < len(hashes) and hashes[at] == h else 0
        return found

    def emit(self, before: str, char: str) -> float:
        """Log probability of ``char`` after ``before`` in clean text."""
        found = self._emitted.get((before, char))
        if found is None:
            found = self._emitted[before, char] = self._emit(before, char)
            if len(self._emitted) > 300_000:
                self._emitted.clear()
        return found

    def _emit(self, before: str, char: str) -> float:
        b = char.lower()
        if b.isalpha():
            a = before.lower()
            a = a if a.isalpha() else " "
            found = self.pairs.get((a, b))
            return found if found is not None else max(FLOOR, self.singles.get(b, FLOOR))
        if char.isdigit():
            return MARK
        return max(MARK, self.pairs.get((before.lower(), " "), MARK)) if char == " " else MARK if char in PUNCTUATION else FLOOR

    def filled(self, word: str) -> list[tuple[str, str]]:
        """(ligature, word it fills up to) where that word is far more frequent, the most frequent first."""
        found = self._filled.get(word)
        if found is None:
            least = max(CONTRAST, 100 if len(word) < 4 else 0) * max(1, self.count(word))
            options = {(x, word[:k] + x + word[k:]) for x in LIGATURES for k in range(len(word) + 1)}
            found = self._filled[word] = sorted(((x, w) for x, w in options if self.counts.get(w, 0) >= max(least, self.rare) and len(w) > 3), key=lambda o: (-self.counts[o[1]], o))
            if len(self._filled) > 200_000:
                self._filled.clear()
        return found

    @property
    def gaps(self) -> dict[int, tuple[list[str], dict[tuple[int, str], int]]]:
        """Length -> (words that can prove a gap, the most frequent first; place and letter -> bit set of these words)."""
        if self._gaps is None:
            self._gaps = {}
            for word in sorted((w for w, n in self.counts.items() if len(w) > 3 and n > CONTRAST and w.isalpha()), key=lambda w: (-self.counts[w], w)):
                self._gaps.setdefault(len(word), ([], {}))[0].append(word)
            for words, having in self._gaps.values():
                bits: dict[tuple[int, str], bytearray] = {}
                for n, word in enumerate(words):
                    for at in enumerate(word):
                        if at not in bits:
                            bits[at] = bytearray(len(words) // 8 + 1)
                        bits[at][n >> 3] |= 1 << (n & 7)
                having.update((at, int.from_bytes(x, "little")) for at, x in bits.items())
        return self._gaps

    def gapped(self, key: str) -> Iterator[str]:
        """The words that leave ``key`` when all places of some of their letters become blanks, the most frequent first."""
        words, having = self.gaps.get(len(key), ([], {}))
        left, kept = (1 << len(words)) - 1, set()
        for at in enumerate(key):
            if at[1] != " ":
                left &= having.get(at, 0)
                kept.add(at[1])
                if not left:
                    return
        if len(key) - key.count(" ") < 2:
            return
        while left:
            low = left & -left
            word = words[low.bit_length() - 1]
            if not any(a == " " and b in kept for a, b in zip(key, word)):
                yield word
            left ^= low


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


_BYTES: dict[str, dict[str, int]] = {}
for _name in CHARSETS:
    _BYTES[_name] = {}
    for _b in range(128, 256):
        try:
            _c = bytes([_b]).decode(_name)
        except UnicodeDecodeError:
            _c = chr(_b)
        _BYTES[_name].setdefault(_c, _b)
    for _b in range(128, 160):  # readers pass undefined codes on as control characters
        _BYTES[_name].setdefault(chr(_b), _b)
    if _name == "cp1252":
        _BYTES[_name].setdefault("\xa0", 160)


def _sequence(text: str, i: int, table: dict[str, int]) -> tuple[int, str] | None:
    """The UTF-8 sequence that starts at ``i`` when read back through a charset, as (characters used, character)."""
    lead = text[i]
    for first in dict.fromkeys((lead, lead.upper(), lead.lower())):
        b = table.get(first, 0)
        n = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if not n or i + n > len(text):
            continue
        rest = [table.get(c) or (160 if c == " " and first == lead else 0) for c in text[i + 1 : i + n]]
        if all(0x80 <= r <= 0xBF for r in rest) and not (n == 2 and rest == [160] and text[i + 1] == " "):
            try:
                char = bytes([b, *rest]).decode()
            except UnicodeDecodeError:
                continue
            return n, char if first == lead else char.lower() if lead.islower() else char.upper()
    return None


def _sequences(text: str) -> Iterator[tuple[int, str, int, str]]:
    """Every UTF-8 sequence in any charset as (place, charset, characters used, character)."""
    for m in _TWO.finditer(text):
        i = m.start()
        for name in CHARSETS:
            found = _sequence(text, i, _BYTES[name])
            if found:
                yield i, name, *found


_TWO = re.compile(r"[^\x00-\x7f](?=[^\x00-\x7f])")


def lost_places(text: str, model: CleanModel) -> dict[int, tuple[int, str]]:
    """Where glyphs were lost: start of a word -> (characters it takes now, the word it was)."""
    low = text.lower()
    out: dict[int, tuple[int, str]] = {}
    small = str.upper if text.isupper() else str  # a glyph that is lost is lost in the case of the text
    count = model.count
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\W\d_]+", low)]
    # ligatures that vanished: the word is rare, the filled word is common, and the ligature occurs nowhere
    gone = [x for x in LIGATURES if small(x) not in text]
    end = len(low) if words and words[-1][0] + len(words[-1][1]) == len(low) else -1
    for at, word in words:
        if len(word) < 2 or at + len(word) == end or count(word) > 3 * model.rare or low.startswith(("...", "…"), at + len(word)):
            continue
        was = next((w for x, w in model.filled(word) if x in gone), None)
        if was:
            out[at] = (len(word), was)
    # letters that became blanks
    letters = {c for c in text if c.isalpha()}
    covered = -1
    longest = max(model.gaps, default=0)
    ends = [j for j in range(4, len(low) + 1) if j == len(low) or not low[j].isalpha() and (low[j - 1] != " " or low[j].isspace())] if longest else []
    for m in _STARTS.finditer(low):
        i = m.start()
        if i < covered:
            continue
        reach = min(_LETTERS.match(low, i).end(), i + longest)
        for j in reversed(ends[bisect_left(ends, i + 4) : bisect_right(ends, reach)]):
            piece = low[i:j]
            if " " not in piece:
                break  # nor has a shorter one
            for key in (piece, " " + piece[1:]) if text[i].isupper() else (piece,):
                word = next((w for w in model.gapped(key) if _fits(piece, key, w, letters, small, count)), None)
                if word:
                    break
            if word:
                out[i] = (j - i, word)
                covered = j
                break
    return out


_LETTERS = re.compile(r"(?:[^\W\d_]| )*")
_STARTS = re.compile(r"(?<!\w)\w|(?<=\s)\s(?=\w)|^\s(?=\w)")


def _fits(piece: str, key: str, word: str, letters: set[str], small, count) -> bool:
    """Can ``piece`` be ``word`` with glyphs lost that the text has nowhere?"""
    if key != piece and word[0] != piece[0]:
        return False
    if any(small(b) in letters for a, b in zip(piece, word) if a == " "):
        return False
    if len(piece.replace(" ", "")) < 3 and piece.strip() != piece:
        return False
    return any(max(1, count(p)) * CONTRAST < count(word) for p in piece.split() if p.isalpha())


def label(text: str, model: CleanModel, lost: dict[int, tuple[int, str]] | None = None) -> list[tuple[int, int, str, str | None]]:
    """The best path as spans (start, end, state, restored) of all units that are not clean."""
    n = len(text)
    lost = lost or {}
    read: dict[int, list[tuple[str, int, str]]] = defaultdict(list)
    for i, *unit in _sequences(text):
        read[i].append(tuple(unit))
    tokens = text.split()
    fillers = (" \x00" if sum(len(t) == 1 for t in tokens) > 0.6 * len(tokens) and len(tokens) > 3 else "\x00") + (_SUBSTITUTE if text.count(_SUBSTITUTE) > 0.3 * n else "")
    shifted = not re.search("[a-z]", text)
    best: list[dict[str, tuple[float, str, tuple]]] = [{} for _ in range(n + 1)]  # state -> (score, restored char, came from)
    best[0]["clean"] = (0.0, " ", ())

    for i in range(n):
        c = text[i]
        after = text[i + 1] if i + 1 < n else ""
        units: list[tuple[str, int, str | None]] = read.get(i, [])[:]
        if shifted:
            if 3 <= ord(c) < 0x60:
                units.append(("shifted", 1, chr(ord(c) + SHIFT)))
            if not ("A" <= c <= "Z") and c >= " ":
                units.append(("shifted", 1, c))
        if fillers:
            if after and after in fillers and (c not in _FILLERS or c == " "):
                units.append(("filled", 2, _LOW_BYTES.get(c, c)))
            if c in fillers:
                units.append(("filled", 1, " " if c == " " else ""))
        asked = c == "?" and after and (after.isalpha() or re.match(r"\?+[^\W\d_]", text[i:]) is not None)
        if c == _SUBSTITUTE or asked:
            units.append(("replaced", 1, None))
        if ord(c) < 32 and c not in "\t\n\r" or c in _GLYPHS:
            units.append(("ligature", 1, None))
        if c == "+" and (m := _UTF7.match(text, i)):
            try:
                units.append(("utf_7", len(m[0]), m[0].encode().decode("utf-7")))
            except UnicodeDecodeError:
                pass
        if i in lost:
            units.append(("lost", *lost[i]))
        here = best[i]
        for state, (score, before, _) in here.items():
            gain = NEVER if asked or c in _GLYPHS else model.emit(before, c)
            total = score + gain + (GO_ON if state == "clean" else LEAVE)
            held = best[i + 1].get("clean")
            if held is None or total > held[0]:
                best[i + 1]["clean"] = (total, c, (i, state, "clean", c))
            for to, size, char in units:
                move = STAY if to == state else ENTER_WHOLE if to in ("filled", "shifted") else ENTER
                if to in ("replaced", "ligature"):
                    gain = -5.0
                elif to == "lost":
                    gain = -3.0
                elif to == "filled" and size == 1:
                    gain = -1.0
                elif to == "shifted" and char == " ":
                    gain = -2.0
                elif to == "utf_7":
                    gain = sum(model.emit(a, b) for a, b in zip(before + char, char)) if char.isprintable() else NEVER
                else:
                    gain = model.emit(before, char)
                    if gain == FLOOR:  # a sign may be a letter spoilt twice
                        gain = NEVER if not char or char.isalpha() or ord(char[0]) > 0x2500 else -9.0
                total = score + move + gain
                held = best[i + size].get(to)
                if held is None or total > held[0]:
                    best[i + size][to] = (total, char[-1] if char else "x", (i, state, to, char))
    state = max(best[n], key=lambda s: best[n][s][0])
    units_back: list[tuple[int, int, str, str | None]] = []
    at = n
    while at:
        i, before, to, char = best[at][state][2]
        units_back.append((i, at, to, char))
        at, state = i, before
    return [u for u in reversed(units_back)]


def _fill(text: str, units: list[tuple[int, int, str, str | None]], model: CleanModel) -> str | None:
    """The text with every span inverted; None where a replaced character or ligature can't be guessed."""
    raw: list[str | None] = []
    for i, j, state, char in units:
        piece = text[i:j] if state == "clean" else char
        if state == "lost" and text[i:j].strip() and text[i:j].lstrip()[0].isupper():
            piece = char[0].upper() + char[1:]
        raw.append(piece)
    joined = "".join("�" if p is None else p for p in raw)
    if any(s == "filled" for *_, s, _ in units):
        joined = re.sub(" {2,}", " ", joined).strip()
    if "�" not in joined:
        return joined

    def guess(m: re.Match) -> str:
        word, low = m[0], m[0].lower()
        if low.count("�") > 2:
            return word
        options = [low]
        for _ in range(low.count("�")):
            options = [o.replace("�", x, 1) for o in options for x in (*LIGATURES, *_ACCENTED)]
        count, found = max((model.count(o), o) for o in options)
        if not count:
            return word
        return found.upper() if word.isupper() and len(word) > 1 else found[0].upper() + found[1:] if word[0].isupper() else found

    filled = re.sub(r"[^\W\d_]*�[\w�]*", guess, joined)
    filled = re.sub(r"(?<=\w)�(?=s\b)", "’", filled)
    filled = re.sub(r"(?<!\S)�(?=\w)([^�]*\w)�(?!\w)", r"“\1”", filled)
    return None if "�" in filled else filled


_ACCENTED = tuple("äöüßéèêàâçñáíóúîôûùëïãõåøšžłęąćś’“”–-")
_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�Ɵ]|\?[^\W\d_?]|\?\?+[^\W\d_]|\+[A-Za-z0-9+/]{3,}-")
_SINGLES = re.compile(r"(?:(?<!\S)\S\s+){4}")


def examine(text: str | None, model: CleanModel, depth: int = 0) -> tuple[str, str | None] | None:
    """(states found, restored text) of a spoilt text; None for a clean one.

    The model only runs where a unit of another state than the clean one exists at all.
    """
    if not text or not text.strip():
        return None
    lost: dict[int, tuple[int, str]] = {}
    possible = bool(_ODD.search(text) or _SINGLES.search(text)) or next(_sequences(text), None) is not None
    blanks = "  " in text
    if not possible or blanks:
        words = re.findall(r"[^\W\d_]+", text.lower())
        rare = sum(model.count(w) < model.rare for w in words)
        if rare or blanks:
            possible = possible or rare > len(words) / 2 and not re.search("[a-z]", text)
            lost = lost_places(text, model)
            possible = possible or bool(lost)
    if not possible:
        return None
    units = label(text, model, lost)
    states = sorted({s for *_, s, _ in units if s != "clean"})
    if not states:
        return None
    restored = _fill(text, units, model)
    if restored == text:
        return None
    # spoilt more than once; every round that reads bytes back makes the text shorter, so it ends
    again = examine(restored, model, depth + 1) if restored and (depth < 3 or len(restored) < len(text)) and "lost" not in states else None
    return (",".join(states), again[1] if again else restored)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``texts`` (one column, text)."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    return texts.where("text is not null").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letter pairs of the words of each batch that aren't tangled."""
    for batch in batches:
        pairs = letter_pairs((w, n) for w, n in zip(*(c.to_pylist() for c in batch.columns)) if not _tangled(w))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in pairs], pa.string()), pa.array([k[1] for k in pairs], pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["a", "b", "n"])


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, word, n, tangled) of every word; one that occurs less than ``CONTRAST`` times and isn't tangled is left as its hash."""
    for batch in batches:
        rows = []
        for w, n in zip(*(c.to_pylist() for c in batch.columns)):
            spoilt = _tangled(w)
            rows.append((None, w, n, spoilt) if spoilt or n >= CONTRAST else (_hash(w), None, n, False))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=["hash", "word", "n", "tangled"])


def lexicon(texts: DataFrame) -> tuple:
    """The arguments of :class:`CleanModel` for all words of ``texts`` (one column, text)."""
    counts = stored(word_counts(texts))
    pairs = counts.mapInArrow(_letters_of, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    words = counts.mapInArrow(_words_of, "hash long, word string, n long, tangled boolean").toArrow()
    discard(counts)
    hashed = pc.is_valid(words["hash"])
    few, many = words.filter(hashed), words.filter(pc.invert(hashed))
    order = np.argsort(few["hash"].to_numpy())
    rest = few["hash"].to_numpy()[order], few["n"].to_numpy()[order].astype(np.uint8)
    frequent: dict[str, int] = {}
    tangled: dict[str, int] = {}
    for w, n, spoilt in zip(*(many[c].to_pylist() for c in ("word", "n", "tangled"))):
        (tangled if spoilt else frequent)[w] = n
    return frequent, rest, Counter({(r["a"], r["b"]): r["n"] for r in pairs}), sum(frequent.values()) + int(rest[1].sum(dtype=np.int64)), tangled


def repair(rows: DataFrame, model_texts: DataFrame) -> DataFrame:
    """(src_table, row_id, states, restored) of the spoilt rows among ``rows`` (src_table, row_id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon(model_texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            src, ids, states, restored = [], [], [], []
            for s, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = examine(text, model)
                if found:
                    src.append(s)
                    ids.append(i)
                    states.append(found[0])
                    restored.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(ids, pa.int64()), pa.array(states, pa.string()), pa.array(restored, pa.string())], names=["src_table", "row_id", "states", "restored"])

    return rows.select("src_table", F.col("row_id").cast("long"), "text").mapInArrow(run, "src_table string, row_id long, states string, restored string")


_MODELS: dict[int, CleanModel] = {}


def _model(shared) -> CleanModel:
    """The clean model of a broadcast lexicon, built once for each worker."""
    if id(shared) not in _MODELS:
        _MODELS.clear()
        _MODELS[id(shared)] = CleanModel(*shared.value)
    return _MODELS[id(shared)]
