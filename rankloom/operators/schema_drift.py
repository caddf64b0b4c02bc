"""Schemas that drift between files: tagged-union inference, change report and one consistent table.

Each JSON payload is walked once. Every path below ``entry`` keeps the *set of type tags* seen at it (string, number,
boolean, null for leaves; object, array for containers): a tagged union, so that conflicting types stay alternatives
instead of collapsing to text. The unions of lines fuse to the union of a file, those of files to the union of all, and
both fusions are set unions, hence associative: they run as partial aggregates before any shuffle.

Changes come from comparing each file's union with that of the file before it in its feed. A leaf that is gone and a new
leaf are one *renamed* leaf when they carry the same kind of value inside one top-level field; among several candidates
the one with most common values (a bottom-k sketch of the values per leaf), the same last key and the most similar key
wins. :func:`typed_values` splits conflicting values into typed branches with one canonical number beside them.

Defined results: a payload that is null, blank, broken or has no ``entry`` adds nothing, but its file still takes part in
the order of its feed; lines sent twice change nothing; two files of one instant are ordered by ``file_id``; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRING, NUMBER, BOOLEAN, NULL, OBJECT, ARRAY = 1, 2, 4, 8, 16, 32
TAGS = {STRING: "string", NUMBER: "number", BOOLEAN: "boolean", NULL: "null", OBJECT: "object", ARRAY: "array"}
LEAF, TYPED, CONTAINER = STRING | NUMBER | BOOLEAN | NULL, STRING | NUMBER | BOOLEAN, OBJECT | ARRAY
#: Size of the sketch of a leaf's values; it only estimates how many values two leaves share.
SKETCH = 64

_NUMBER = re.compile(r"\s*[-+]?\d+(?:[.,]\d+)?\s*$")


def entries(payload: str | None, root: str = "entry") -> list[Any]:
    """What lies at the first key ``root``, whatever wraps it, as a list of zero or one value."""
    try:
        level = [json.loads(payload)] if payload else []
    except ValueError:
        return []
    while level:
        below = []
        for x in level:
            if isinstance(x, dict):
                if root in x:
                    return [x[root]]
                below += x.values()
            elif isinstance(x, list):
                below += x
        level = below
    return []


def as_number(value: Any) -> float | None:
    """The canonical number of a JSON number or of a number written as text (comma or point)."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    return float(value.strip().replace(",", ".")) if isinstance(value, str) and _NUMBER.match(value) else None


def _kind(value: Any) -> str:
    if isinstance(value, bool) or value in ("true", "false"):
        return "b"
    n = as_number(value)
    if n is None:
        return "t"
    return "y" if n.is_integer() and 1800 <= n <= 2100 and re.match(r"\s*\d{4}(?:\.0)?\s*$", str(value)) else "n"


def _walk(value: Any, path: str, into: dict[str, list]) -> None:
    """Fuse the union of ``value`` into ``into``: path -> [tags, kinds, sketch of values]."""
    at = into.get(path)
    if at is None:
        at = into[path] = [0, set(), set()]
    if isinstance(value, dict):
        at[0] |= OBJECT
        for k, v in value.items():
            _walk(v, f"{path}.{k}", into)
    elif isinstance(value, list):
        at[0] |= ARRAY
        for v in value:
            if isinstance(v, dict):
                for k, w in v.items():
                    _walk(w, f"{path}.{k}", into)
            else:
                _walk(v, path, into)
    elif value is None:
        at[0] |= NULL
    else:
        at[0] |= BOOLEAN if isinstance(value, bool) else STRING if isinstance(value, str) else NUMBER
        at[1].add(_kind(value))
        n = as_number(value)
        at[2].add(xxhash.xxh64_intdigest(str(value if n is None else n)) >> 1)
        if len(at[2]) > 4 * SKETCH:
            at[2] = set(sorted(at[2])[:SKETCH])


_PATHS = "file_id long, path string, tags int, kinds array<string>, sketch array<long>"


def line_unions(df: DataFrame) -> DataFrame:
    """Tagged unions per file and path, fused over the lines of each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files: dict[int, dict[str, list]] = {}
            for f, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in entries(payload):
                    _walk(x, "entry", files.setdefault(f, {}))
            rows = [(f, p, t, sorted(k), sorted(s)[:SKETCH]) for f, paths in files.items() for p, (t, k, s) in paths.items()]
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file_id", "path", "tags", "kinds", "sketch"])

    return df.select("file_id", "payload").mapInArrow(run, _PATHS)


def file_unions(df: DataFrame) -> DataFrame:
    """One row per file and path: its tags, value kinds and value sketch."""
    return (
        line_unions(df)
        .groupBy("file_id", "path")
        .agg(
            F.bit_or("tags").alias("tags"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"),
            F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sketch")))), 1, SKETCH).alias("sketch"),
        )
    )


def fused_union(df: DataFrame) -> DataFrame:
    """The union over all files: every path with its alternatives and the number of files that have each."""
    tags = F.explode(F.array_compact(F.array(*[F.when(F.col("tags").bitwiseAND(bit) != 0, F.lit(name)) for bit, name in TAGS.items()])))
    return file_unions(df).select("path", tags.alias("alternative")).groupBy(F.col("path").alias("field_path"), "alternative").agg(F.count("*").alias("n_files"))


def _words(key: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", key)}


def _affinity(a: dict, b: dict) -> float | None:
    """How well leaf ``b`` takes over the meaning of leaf ``a``; None where it can't."""
    if a["kinds"] and b["kinds"] and not set(a["kinds"]) & set(b["kinds"]):
        return None
    pa_, pb = a["path"].split("."), b["path"].split(".")
    same_key, wa, wb = pa_[-1] == pb[-1], _words(pa_[-1]), _words(pb[-1])
    alike = len(wa & wb) / max(1, min(len(wa), len(wb)))
    shared = len(set(a["sketch"]) & set(b["sketch"])) / max(1, min(len(a["sketch"]), len(b["sketch"])))
    if len(pa_) == 2 or len(pb) == 2:  # directly below the root every field is a family of its own
        if pa_[:-1] != pb[:-1] or not (alike >= 0.5 or shared >= 0.3):
            return None
    elif pa_[:2] != pb[:2]:
        return None
    return 4 * same_key + 3 * shared + alike + (pa_[:-1] == pb[:-1])


def compare(before: list[dict], after: list[dict]) -> list[tuple[str, str, str]]:
    """The changes between two unions as (field_path, change_kind, new_path)."""
    old, new = ({x["path"]: x for x in side} for side in (before, after))
    leaf = lambda side: {p for p, x in side.items() if x["tags"] & LEAF}
    gone, come = leaf(old) - leaf(new), leaf(new) - leaf(old)
    out: list[tuple[str, str, str]] = []
    scored = sorted(((-s, p, q) for p in gone for q in come if (s := _affinity(old[p], new[q])) is not None))
    for _, p, q in scored:
        if p in gone and q in come:
            gone.discard(p)
            come.discard(q)
            out.append((p, "renamed", q))
    out += [(p, "removed", "") for p in gone] + [(p, "added", "") for p in come]
    for p in old.keys() & new.keys():
        a, b = old[p]["tags"], new[p]["tags"]
        if a & LEAF and b & LEAF and a & TYPED != b & TYPED or a & CONTAINER and b & CONTAINER and a & CONTAINER != b & CONTAINER:
            out.append((p, "retyped", ""))
    return sorted(out)


def drift(df: DataFrame) -> DataFrame:
    """Every change between successive files of a feed: file_id, field_path, change_kind, new_path.

    The order of a feed comes from a window over one narrow row per file. Unions then meet by file id, each under its
    own id and under that of the file after it, so the large rows shuffle on a key that no feed can make hot.
    """
    order = Window.partitionBy("feed").orderBy("snapshot_at", "file_id")
    files = df.groupBy("file_id").agg(F.min("feed").alias("feed"), F.min("snapshot_at").alias("snapshot_at"))
    files = files.select("file_id", F.lead("file_id").over(order).alias("next_id"), F.lag("file_id").over(order).alias("previous_id"))
    unions = file_unions(df).groupBy("file_id").agg(F.collect_list(F.struct("path", "tags", "kinds", "sketch")).alias("paths"))
    known = files.join(unions, "file_id", "left")
    pairs = (
        known.where("previous_id is not null").select("file_id", "paths", F.lit(True).alias("later"))
        .unionByName(known.where("next_id is not null").select(F.col("next_id").alias("file_id"), "paths", F.lit(False).alias("later")))
        .groupBy("file_id").agg(F.first(F.when(F.col("later"), F.col("paths")), True).alias("after"), F.first(F.when(~F.col("later"), F.col("paths")), True).alias("before"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *c) for f, a, b in zip(*(batch.column(n).to_pylist() for n in ("file_id", "before", "after"))) for c in compare(a or [], b or [])]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 3))], names=["file_id", "field_path", "change_kind", "new_path"])

    return pairs.mapInArrow(run, "file_id long, field_path string, change_kind string, new_path string")


#: Where each metric lives below ``entry``, and a word that marks neighbours which are not the metric itself.
METRICS = {"SJR": ("SJRList", None), "SNIP": ("SNIPList", None), "CiteScore": ("citeScoreYearInfoList", None), "CiteScoreTracker": ("citeScoreYearInfoList", "tracker")}

_VALUE = "file_id long, line_no int, serial_id string, serial_title string, metric string, metric_year int, value double, type_tag string, value_string string, value_number double"


def _points(value: Any) -> Iterator[dict]:
    """The innermost objects below ``value``: one for each year of a metric."""
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict):
            inner = [v for v in x.values() if isinstance(v, (dict, list))]
            if inner:
                for v in inner:
                    yield from _points(v)
            else:
                yield x


def typed_values(df: DataFrame) -> DataFrame:
    """One table of serial, year and metric over all files: typed branches and the canonical ``value``.

    ``type_tag`` names the branch a value came in; ``value_string`` and ``value_number`` hold it as it came and are null
    in the other branch; ``value`` is the number either means. A null metric keeps its row with tag ``null``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f, line, payload in zip(*(c.to_pylist() for c in batch.columns)):
                for found in entries(payload):
                    for e in found if isinstance(found, list) else [found]:
                        if not isinstance(e, dict):
                            continue
                        serial, title = e.get("source-id"), e.get("dc:title")
                        for metric, (home, mark) in METRICS.items():
                            for point in _points(e.get(home)):
                                years = [v for k, v in point.items() if "year" in _words(k) or _kind(v) == "y"]
                                values = [(k, v) for k, v in point.items() if not ("year" in _words(k) or _kind(v) == "y") and (("tracker" in _words(k)) == (mark == "tracker"))]
                                year = as_number(years[0]) if years else None
                                for _, v in values[:1]:
                                    tag = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
                                    rows.append((f, line, None if serial is None else str(serial), None if title is None else str(title), metric, None if year is None else int(year), as_number(v), tag, v if tag == "string" else None, float(v) if tag == "number" else None))
            cols = list(zip(*rows)) or [()] * 10
            s, d = pa.string(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), s, s, s, pa.int32(), d, s, s, d))], names=[x.split()[0] for x in _VALUE.split(", ")])

    return df.select("file_id", "line_no", "payload").mapInArrow(run, _VALUE)
