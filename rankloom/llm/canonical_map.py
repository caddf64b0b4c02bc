"""Mapping free-entered values to a canonical list: a prefix-filter set-similarity join.

A typed name becomes a set of tokens: its words, each read as the reference words it may stand for (the word itself, a
word it abbreviates, a word one or two slips of the keyboard away), and its identifiers. The same order by global rarity is laid
over the tokens of both sides; only the rare prefix of each set is joined, which loses no pair at or above the
threshold. Length and positional filters thin the candidates, Jaccard is then verified exactly and the best is kept.

Jaccard counts a word in full if one of its readings is a word of the title, and by ``SOFT`` if it may be that word or its
abbreviation with a slip; at most half of a title's words may be met so. A name that is as near to several titles by such
words is no match. A lost or an extra word is none either: on the list, titles differ by single words (Journal of Peer
Review, Journal of Peer Review Research).

A word that all titles with another word of the name have goes without saying and is added to the name.

Identifiers are the rarest tokens of all and always belong to the prefix. A candidate that shares one is accepted
whatever its words say, which is how placeholder names ("n/a") are resolved.

The reference list is fixed and small (``MAX_REFERENCE`` rows are allowed); its words are known to every task. The
typed names are reduced to their distinct (name, identifiers) before the join and joined back at the end.

Defined results: a null name has no row; an empty, blank or placeholder name without a known identifier is
``unmatched``; a tie between different entries goes to the one with more shared identifiers, then to the smallest key;
repeated reference rows count once; other columns are ignored; with an empty reference list everything is ``unmatched``.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_REFERENCE = 100_000
#: Least Jaccard similarity of a name's words with a title's words where no identifier helps.
THRESHOLD = 0.95
#: What a word counts that may be a title's word with a slip, but has other readings or none.
SOFT = 0.9
UNMATCHED = "unmatched"
#: A word goes without saying beside another one that at least so many titles have, all of them with it.
IMPLIED_BY = 5

# Words that name no journal, and marks of an edition, part or volume of one.
FILLER = {"of", "on", "in", "for", "the", "and", "de", "für", "fur", "fuer", "et", "und", "y", "a", "an"}
MARKS = {"print", "online", "vol", "volume", "official", "organ", "new", "series", "section", "issn", "ed"}

_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)?|[a-ik-pr-y]")  # j, q and z stand for words
_ISSN = re.compile(r"(?<!\d)(\d{4})[\s\-‐‑‒–—−]?(\d{3}[\dXx])(?!\d)")
_RUN = re.compile(r"(?<!\d)(?:\d{7}[\dXx]){2,}(?![\dXx])")


def identifiers(*fields: str | None) -> list[str]:
    """The ISSN tokens of some fields, each once."""
    out = {}
    for text in fields:
        cut = _RUN.sub(lambda m: " ; ".join(m[0][k : k + 8] for k in range(0, len(m[0]), 8)), text or "")
        out.update(dict.fromkeys(f"{a}-{b.upper()}" for a, b in _ISSN.findall(cut)))
    return list(out)


def words(name: str) -> list[str]:
    """The words of a name that can tell journals apart, lower case, a trailing point kept as mark of a cut word."""
    text = unicodedata.normalize("NFKC", name).lower().replace("&", " and ")
    text = re.sub(r"\[[^\]]*\]|\([^)]*\)", " ", text)  # acronyms, places, media
    found = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?\.?|\d+\w*", text)
    plain = [w for w in found if w.rstrip(".") not in FILLER | MARKS]
    return [w for w in plain if not _ORDINAL.fullmatch(w)]


def slips(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, changes and swaps of neighbours that turn ``a`` into ``b``; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


class Vocabulary:
    """Reads a typed word as the reference words it may stand for."""

    def __init__(self, frequency: dict[str, int]) -> None:
        self.frequency = frequency
        self.ordered = sorted(frequency)
        self._read: dict[str, tuple[str, ...]] = {}

    def read(self, word: str) -> tuple[str, ...]:
        found = self._read.get(word)
        if found is None:
            found = self._read[word] = self._look(word)
            if len(self._read) > 200_000:
                self._read.clear()
        return found

    def readings(self, name: str) -> list[tuple[str, ...]]:
        """The readings of the words of a name, equal ones once; no name begins with a filler."""
        out: dict[tuple[str, ...], tuple[str, ...]] = {}
        for k, word in enumerate(words(name)):
            found = tuple(o for o in self.read(word) if k or o != NOTHING)
            if found:
                out.setdefault(tuple(o for o in found if o[:1] not in (NOTHING, AS_TYPED)), found)
        return list(out.values())

    def _look(self, word: str) -> tuple[str, ...]:
        stem, dotted = word.rstrip("."), word.endswith(".")
        if stem in self.frequency:
            return (stem,)
        begun = [w for w in self.ordered if len(w) > len(stem) and w.startswith(stem) and (dotted or len(stem) > 1 or stem in "jqz")]
        maybe: tuple[str, ...] = ()
        if len(stem) <= 4 and not dotted and any(slips(stem, f, 1) <= 1 for f in FILLER if 1 < len(f) >= len(stem) - 1):
            if len(stem) < 3 or not begun:
                return ()
            maybe = (NOTHING,)
        by = [(d, w) for w in self.ordered if len(stem) > 2 and len(w) > 2 and (d := slips(stem, w, 2 if len(stem) > 4 else 1)) <= 2]
        near = [w for d, w in by if d == min(by)[0] and d <= (2 if len(stem) > 4 else 1)]
        cut = begun if dotted or not near or len(stem) > 2 else []
        if dotted or not near:
            cut = cut + [w for w in self.ordered if dotted and len(stem) > 3 and len(w) > len(stem) and any(slips(stem, w[: len(stem) + d], 1) <= 1 for d in (-1, 0, 1))]
            if len(stem) > 2 and not re.search("[aeiou]", stem):  # written without vowels
                letters = re.compile(".*".join(stem[:1] + stem[1:]))
                cut += [w for w in self.ordered if letters.match(w)]
        return (*(tuple(dict.fromkeys(near + cut)) or (stem,)), *maybe, AS_TYPED + word)


#: Among the readings of a word: it may be a filler with a slip; and the word as typed, for :func:`slipped`.
NOTHING, AS_TYPED = "", "~"


@functools.lru_cache(maxsize=200_000)
def slipped(word: str, title: str) -> bool:
    """May a typed word be a word of a title, or an abbreviation of it, with a slip?"""
    stem = word.rstrip(".")
    if len(stem) > 1 and (word.endswith(".") or len(stem) < 6) and any(slips(stem, title[:n], 1) <= 1 for n in (len(stem) - 1, len(stem), len(stem) + 1) if 1 < n <= len(title)):
        return True
    return len(title) > 7 and slips(stem, title, 3) <= 3


def verified(readings: list[tuple[str, ...]], title: set[str]) -> float:
    """The Jaccard similarity of a name, each word read as the one that suits, with a title's words."""
    left = set(title)
    open_ = []
    for options in sorted(readings, key=len):
        for w in options:
            if w in left:
                left.discard(w)
                break
        else:
            open_.append(options)
    met, soft, missed = len(title) - len(left), 0, 0
    for options in open_:
        near = next((w for w in sorted(left) if options[-1][:1] == AS_TYPED and slipped(options[-1][1:], w)), None)
        if near and 2 * (soft + 1) <= len(title):
            left.discard(near)
            soft += 1
        else:
            missed += NOTHING not in options
    return (met + SOFT * soft) / max(1, len(title) + missed)


def implied(titles: Collection[frozenset[str]]) -> dict[str, set[str]]:
    """The words that every title with a given word has as well, such as proceedings beside conference."""
    out: dict[str, set[str]] = {}
    number: Counter[str] = Counter()
    for title in titles:
        for w in title:
            out[w] = out[w] & title if w in out else set(title)
        number.update(title)
    return {w: also - {w} for w, also in out.items() if number[w] >= IMPLIED_BY and len(also) > 1}


def map_to_list(df: DataFrame, row_id: str, name: str, id_fields: list[str], reference: DataFrame, key: str, title: str, reference_ids: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """One row (row_id, key, score) per row with a name that isn't exactly the title of one single key."""
    listed = reference.select(F.col(key).alias("key"), F.col(title).alias("title"), F.array(*[F.col(c).cast("string") for c in reference_ids]).alias("ids")).limit(MAX_REFERENCE + 1).collect()
    if len(listed) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} rows")
    sets: dict[tuple[str, frozenset[str]], set[str]] = {}
    exact: dict[str, set[str]] = {}
    for r in listed:
        sets.setdefault((r["key"], frozenset(w.rstrip(".") for w in words(r["title"] or ""))), set()).update(identifiers(*r["ids"]))
        if r["title"] is not None:
            exact.setdefault(r["title"], set()).add(r["key"])
    frequency = Counter(w for _, tokens in sets for w in tokens)
    vocabulary = Vocabulary(dict(frequency))
    also = implied({tokens for _, tokens in sets})
    spark = df.sparkSession
    rank = lambda t: (frequency.get(t, 0), t)

    def prefix(size: int, soft: int) -> int:
        # a pair at the threshold shares so many words as read; at most half of a title's words are met with a slip
        shared = max((threshold - SOFT / 2) * size, threshold * size - SOFT * soft)
        return size - max(1, math.ceil(shared - 1e-9)) + 1 if size else 0

    # reference side: each token of the prefix with its position, identifiers at position -1
    rows = []
    for n, ((k, tokens), ids) in enumerate(sorted(sets.items(), key=lambda x: (x[0][0], sorted(x[0][1])))):
        order = sorted(tokens, key=rank)
        rows += [(t, n, k, p, order) for p, t in enumerate(order[: prefix(len(order), len(order))])] + [(t, n, k, -1, order) for t in sorted(ids)]
    right = spark.createDataFrame(rows, "token string, entry int, key string, right_pos int, title_words array<string>")
    singles = spark.createDataFrame([(t,) for t, keys in exact.items() if len(keys) == 1], "name string")

    typed = df.where(F.col(name).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), F.col(name).alias("name"), *[F.col(c).cast("string").alias(f"id{n}") for n, c in enumerate(id_fields)])
    typed = typed.join(singles, "name", "left_anti")
    fields = ["name", *[f"id{n}" for n in range(len(id_fields))]]
    distinct = typed.groupBy(*fields).count().withColumn("set_id", F.xxhash64(*fields)).drop("count")

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in fields]
            for set_id, text, *ids in zip(batch.column("set_id").to_pylist(), *columns):
                readings = vocabulary.readings(text)
                said = {w for options in readings for w in options if w[:1] not in (NOTHING, AS_TYPED)}
                unsaid = {x for options in readings if len(options) == 1 for x in also.get(options[0], ()) if x not in said}
                readings += [(x,) for x in sorted(unsaid)]
                order = sorted({w for options in readings for w in options if w[:1] not in (NOTHING, AS_TYPED)}, key=rank)
                # with several readings of a word the set is larger than the name: every token joins that any choice puts in the prefix
                sure = max(1, sum(NOTHING not in options for options in readings))
                soft = sum(options[-1][:1] == AS_TYPED for options in readings)
                keep = order[: max(0, prefix(sure, soft) + len(order) - sure)] if readings else []
                out += [(set_id, t, p, [list(o) for o in readings]) for p, t in enumerate(keep)] + [(set_id, t, -1, [list(o) for o in readings]) for t in identifiers(*ids)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string()))))], names=["set_id", "token", "left_pos", "readings"])

    left = distinct.mapInArrow(tokens_of, "set_id long, token string, left_pos int, readings array<array<string>>")
    n, m = F.size("readings"), F.size("title_words")
    sure = F.size(F.filter("readings", lambda o: ~F.array_contains(o, NOTHING)))
    length = (n >= threshold * m - 1e-9) & (m >= threshold * sure - 1e-9)
    places = (F.least(n - F.col("left_pos"), m - F.col("right_pos")) >= threshold / (1 + threshold) * (n + m) - 1e-9)
    slack = F.aggregate("readings", F.lit(0), lambda a, o: a + F.size(o) - 1)  # positions are exact only where every word has one reading
    candidates = left.join(right, "token").where((F.col("left_pos") < 0) | length & ((slack > 0) | places))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[int, int], float] = {}  # a pair comes once for each token it shares
            scores = []
            for row, pair in enumerate(zip(batch.column("set_id").to_pylist(), batch.column("title").to_pylist())):
                if pair not in known:
                    known[pair] = verified([tuple(o) for o in batch.column("readings")[row].as_py()], set(batch.column("title_words")[row].as_py()))
                scores.append(known[pair])
            shared = [int(p < 0) for p in batch.column("left_pos").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), batch.column("key"), batch.column("title"), pa.array(scores, pa.float64()), pa.array(shared, pa.int32())], names=["set_id", "key", "title", "score", "shared"])

    pairs = candidates.select("set_id", "key", F.xxhash64("title_words").alias("title"), "readings", "title_words", "left_pos").mapInArrow(verify, "set_id long, key string, title long, score double, shared int")
    scored = pairs.groupBy("set_id", "key").agg(F.max("score").alias("score"), F.max_by("title", "score").alias("title"), F.sum("shared").alias("shared")).where((F.col("shared") > 0) | (F.col("score") >= threshold - 1e-9))
    equal = scored.groupBy("set_id", (-F.least("shared", F.lit(1))).alias("a"), (-F.col("score")).alias("b")).agg(F.min(F.struct((-F.col("shared")).alias("c"), "key")).alias("first"), (F.min("title") != F.max("title")).alias("several"))
    best = equal.groupBy("set_id").agg(F.min(F.struct("a", "b", F.col("first.c").alias("c"), F.col("first.key").alias("key"), "several")).alias("best"))
    best = best.where((F.col("best.a") < 0) | (F.col("best.b") <= -1) | ~F.col("best.several"))  # as near to several titles by slips alone: no match
    mapped = typed.withColumn("set_id", F.xxhash64(*fields)).join(best, "set_id", "left")
    return mapped.select("row_id", F.coalesce("best.key", F.lit(UNMATCHED)).alias("key"), F.coalesce(-F.col("best.b"), F.lit(0.0)).alias("score"))
