"""Variant spellings of organisation names: reading, then an exact radius join in a partitioned metric space.

1. Every different spelling is *read*: case, accents, blanks and legal forms go, abbreviations and slips in the common
   words of the trade ("Univ. Pr.", "Publihsing") become those words, turned-round names are turned back. What remains is
   a *kind* (the sorted common words) and a *core* (the words that name the house). Where a spelling can be read in more
   than one way (after a comma stands a place, or the turned-round beginning) it has several readings.
2. Readings of one kind whose cores lie within ``RADIUS`` edits are linked. The metric is Levenshtein's. Cores are
   assigned to the nearest of some pivots; a core is copied into each further cell whose pivot is at most 2 x radius
   farther than its own, which by the triangle inequality loses no pair. In a cell the join runs over rings of equal
   distance to the pivot, as two cores within the radius lie in the same ring or in neighbouring ones.
3. Links, acronyms and shortened names give a graph of spellings; its components are the organisations.

Defined results: null and blank spellings name nothing; spellings that differ only in blanks or case are variants; a
shortened name or acronym that fits several organisations is linked to none; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.components import components
from rankloom.plans.session import checkpoint

#: Edits allowed between two cores: two per seven letters of the shorter (a swap of neighbours counts two and is always
#: allowed), RADIUS at most.
RADIUS = 4
#: Pivots: one per CELL cores, MAX_PIVOTS at most; more names then make larger cells, no fewer pairs.
CELL, MAX_PIVOTS = 64, 512

# Common words of publishers' names with their usual abbreviations, legal forms and link words.
TRADE = {
    "university": ("univ", "uni"), "press": ("pr",), "academic": ("acad",), "publishers": ("publ", "publrs", "pub", "publs"), "publishing": (), "publications": (),
    "scientific": ("sci",), "medical": ("med",), "media": (), "society": ("soc",), "association": ("assoc", "assn"), "institute": ("inst",), "international": ("int", "intl"),
    "royal": ("roy",), "research": ("res",), "verlag": ("vlg",), "editions": ("eds",), "editorial": ("ed", "edit"), "hijos": (), "academy": (), "college": (), "books": (), "group": (),
}
LEGAL = {"ltd", "limited", "inc", "llc", "gmbh", "co", "kg", "company", "corp", "corporation", "sa", "bv", "ag", "plc", "sarl", "srl", "nv"}
LINK = {"of", "for", "the", "and", "e", "y", "und", "et", "de", "in", "on"}

_ABBREVIATED = {a: w for w, short in TRADE.items() for a in short} | {w: w for w in TRADE}
_ABBREVIATED |= {"publishing": "publishers", "publications": "publishers"}  # "Publ." stands for each of them
_TAIL = re.compile(r"\s*(?:[–—-]\s*journals? division|\(publisher\))\s*$", re.I)
_ACRONYM = re.compile(r"[A-ZÀ-Þ]{2,7}")


def plain(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("Ø", "O").replace("Ł", "L"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def edits(a: str, b: str) -> int:
    """Levenshtein's distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def _tokens(part: str) -> list[str]:
    part = re.sub(r"\bu\.\s*p\.?(?=\W|$)|\bup\b", "university press", part)
    part = re.sub(r"\bs\.\s*a\.|\bb\.\s*v\.", lambda m: m[0].replace(".", "").replace(" ", ""), part)
    return re.findall(r"\w+", part)


def trade_word(token: str) -> str | None:
    """The common word a token stands for, with up to a quarter of its letters wrong."""
    if token in _ABBREVIATED:
        return _ABBREVIATED[token]
    if len(token) < 4:
        return None
    best = min(((edits(token, w), w) for w in TRADE if abs(len(w) - len(token)) <= 2), default=(9, ""))
    return _ABBREVIATED[best[1]] if best[0] <= max(1 + (len(best[1]) == 5), len(best[1]) // 4 + 1) and best[0] < len(token) / 2 and (len(best[1]) > 5 or sorted(token)[0] == sorted(best[1])[0] or best[0] == 1) else None


def read_words(tokens: list[str]) -> tuple[str, str]:
    """(kind, core) of the words of a name in their natural order."""
    kind, core = [], []
    for t in tokens:
        if t in LEGAL or t in LINK or t == "gk" or len(t) > 5 and edits(t, "company") <= 2 or 3 < len(t) < 6 and (edits(t, "gmbh") <= 1 or sorted(t) == sorted("gmbh")):
            continue
        if len(t) < 5 and t not in _ABBREVIATED and any(len(w) > 1 and edits(t, w) <= 1 for w in LINK):
            continue
        w = trade_word(t)
        if w:
            kind.append(w)
        else:
            core.append(t)
    if len(core) >= 2 and set(kind) <= {"publishers"}:
        kind = []  # two partners: "A & B", "A & B Publishing"
        core.sort()
    return " ".join(sorted(set(kind))), " ".join(core)


def readings(name: str) -> list[tuple[str, str]]:
    """The ways to read a spelling as (kind, core); the kind of a bare acronym is ``#``."""
    text = name.strip()
    while (cut := _TAIL.sub("", text)) != text:
        text = cut
    m = re.fullmatch(r"([^()]+?)\s*\(([^()]+)\)", text)
    if m and _ACRONYM.fullmatch(m[1]):
        return [("#", plain(m[1])), *readings(m[2])]
    if m and _ACRONYM.fullmatch(m[2]):
        return [("#", plain(m[2])), *readings(m[1])]
    if _ACRONYM.fullmatch(text) and len(text) <= 5:
        return [("#", plain(text))] + ([("", plain(text))] if len(text) > 4 else [])
    text = plain(text)
    parts = [x for x in (_tokens(p) for p in text.split(",")) if x and not set(x) <= LEGAL | LINK]
    if not parts:
        return []
    if len(parts) == 1:
        return [read_words(parts[0])]
    turned = [t for p in reversed(parts) for t in p]
    out = [read_words(turned)]
    dropped = read_words([t for p in parts[:-1] for t in p])
    if len(parts[-1]) == 1 and dropped[1] and (dropped[0] or " " in dropped[1]):
        out.append(dropped)  # a place behind the comma
    return list(dict.fromkeys(out))


def initials(name: str) -> str:
    """The acronym of a spelling in its natural order: the first letters of its words but link words and legal forms."""
    text = plain(_TAIL.sub("", name))
    return "" if re.search("[,(]", text) else "".join(t[0] for t in _tokens(text) if t not in LEGAL | LINK)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, name_id in zip(batch.column("name").to_pylist(), batch.column("name_id").to_pylist()):
            found = readings(name)
            rows += [(name_id, kind, core, len(found)) for kind, core in found if core]
            if len(found) == 1 and found[0][0] != "#" and len(short := initials(name)) > 2:
                rows.append((name_id, "@", short, 0))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32()))], names=["name_id", "kind", "core", "ways"])


def allowed(a, b):
    """Edits allowed between two cores as a column."""
    return F.least(F.lit(RADIUS), F.greatest(F.lit(1), F.floor(F.least(F.length(a), F.length(b)) / 3.5), F.when(F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")), 2).otherwise(0)).cast("int"))


def radius_join(forms: DataFrame) -> DataFrame:
    """Pairs (form_a, form_b) of one kind whose cores lie within the radius; ``forms`` has form, kind, core."""
    n = forms.count()
    pivots = [r["core"] for r in forms.groupBy("core").count().orderBy(F.xxhash64("core"), "core").limit(max(1, min(MAX_PIVOTS, n // CELL + 1))).collect()]
    if not n:
        return forms.select(F.col("form").alias("form_a"), F.col("form").alias("form_b"))
    far = F.transform(F.array(*map(F.lit, pivots)), lambda p, i: F.struct(F.levenshtein(F.col("core"), p).alias("d"), i.alias("cell")))
    placed = forms.withColumn("far", far).withColumn("nearest", F.array_min("far"))
    cells = placed.select("form", "kind", "core", F.col("nearest.cell").alias("own"), F.explode(F.filter("far", lambda x: x["d"] <= F.col("nearest.d") + 2 * RADIUS)).alias("at"))
    rings = cells.select("form", "kind", "core", "own", F.col("at.cell").alias("cell"), (F.col("at.d") / (RADIUS + 1)).cast("int").alias("ring"))
    a = rings.where("own = cell").select(F.col("form").alias("form_a"), F.col("core").alias("core_a"), "kind", "cell", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("ring"))
    b = rings.select(F.col("form").alias("form_b"), F.col("core").alias("core_b"), "kind", "cell", "ring")
    near = (F.abs(F.length("core_a") - F.length("core_b")) <= RADIUS) & (F.levenshtein("core_a", "core_b", RADIUS) >= 0) & (F.levenshtein("core_a", "core_b", RADIUS) <= allowed("core_a", "core_b"))
    return a.join(b, ["kind", "cell", "ring"]).where((F.col("form_a") != F.col("form_b")) & near).select("form_a", "form_b").distinct()


def link_names(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, org) for every different non-blank string in ``columns``; variants of one organisation share ``org``.

    The rows are reduced to different spellings by a partial aggregate before anything else happens.
    """
    names = df.select(F.explode(F.array(*columns)).alias("name")).where(F.length(F.trim("name")) > 0).groupBy("name").agg(F.count("*").alias("uses")).withColumn("name_id", F.xxhash64("name"))
    names = checkpoint(names)
    read = names.select("name", "name_id").mapInArrow(_read, "name_id long, kind string, core string, ways int")
    read = checkpoint(read.withColumn("form", F.xxhash64("kind", "core")))
    acronyms = read.where("kind in ('#', '@')")
    short = read.where("kind = '@'").select("name_id", F.col("core").alias("short"))
    read, marks = read.where("kind <> '@'"), acronyms.where("kind = '#'")
    forms = read.groupBy("form").agg(F.first("kind").alias("kind"), F.first("core").alias("core"), F.min("ways").alias("ways"))
    # A reading that only ever arises as one of several counts once another spelling supports it by itself.
    sure = read.where("ways = 1 or kind = '#'").select("form").distinct()
    pairs = radius_join(forms.where("kind <> '#'")).join(sure.withColumnRenamed("form", "form_b"), "form_b", "left_semi")
    lone = read.where("ways = 1").select("name_id", "form").unionByName(read.where("ways > 1 and kind <> '#'").select("name_id", "form").join(sure, "form", "left_semi").select("name_id", "form"))
    several = read.where("ways > 1 and kind <> '#'").select("name_id", "form").join(pairs.select(F.col("form_a").alias("form"), "form_b"), "form").select("name_id", F.col("form_b").alias("form"))
    expanded = read.where("ways > 1 and kind = '#'").select("name_id").join(read.where("kind <> '#'"), "name_id").select("name_id", "form")
    ties = lone.unionByName(several).unionByName(expanded).distinct()
    edges = ties.select(F.col("name_id").alias("a"), F.col("form").alias("b")).unionByName(pairs.join(sure.withColumnRenamed("form", "form_a"), "form_a", "left_semi").select(F.col("form_a").alias("a"), F.col("form_b").alias("b")))
    first = components(edges)
    org = first.withColumnRenamed("node", "name_id").join(names.select("name_id", "name"), "name_id").select("name_id", "name", "component")
    org = checkpoint(org)
    # acronyms and shortened names: linked where exactly one organisation fits
    stated = marks.where("ways > 1").join(org, "name_id").select(F.col("core").alias("short"), "component")
    usual = short.join(org, "name_id").groupBy("short", "component").agg(F.count("*").alias("n")).where("n > 1").select("short", "component")
    meanings = stated.unionByName(usual).distinct()
    bare = read.where("kind = '#' and ways = 1").select("name_id", F.col("core").alias("short"))
    known = meanings.join(bare.select("name_id", "short"), "short").select("name_id", "component", "short")
    own = bare.join(org, "name_id").select("name_id", F.col("component").alias("self"))
    single = known.join(own, "name_id").where("component <> self").groupBy("name_id", "self").agg(F.min("component").alias("component"), F.max("component").alias("other")).where("component = other").select(F.col("self").alias("a"), F.col("component").alias("b"))
    cut = read.where("kind = '' and ways = 1 and instr(core, ' ') = 0").select("name_id", "core").join(org, "name_id").select(F.col("component").alias("self"), F.col("core").alias("short")).distinct()
    whole = read.where("kind not in ('', '#') and ways = 1").join(org, "name_id").select(F.col("core").alias("short"), "component").distinct()
    shortened = cut.join(whole, "short").where("component <> self").groupBy("self").agg(F.min("component").alias("component"), F.max("component").alias("other")).where("component = other").select(F.col("self").alias("a"), F.col("component").alias("b"))
    merged = components(single.unionByName(shortened))
    return org.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("name", F.coalesce("top", "component").alias("org"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """All pairs name_a < name_b of spellings of one organisation."""
    a, b = linked.select(F.col("name").alias("name_a"), "org"), linked.select(F.col("name").alias("name_b"), "org")
    return a.join(b, "org").where("name_a < name_b").select("name_a", "name_b")
