"""Several values packed in one field: one row per value, position kept.

A quote-aware finite-state tokenizer walks each string once. Its states are *outside*, *inside a quote* (which quote
character, escapes honoured) and the *nesting depth* of brackets; delimiters count only outside quotes and brackets.
The characters between two delimiters become one value with its ordinal.

What a comma means cannot be read off the comma alone in author lists ("Family, Given" against "A B, C D"), so the
tokenizer emits segments with the delimiter that ended them, and :func:`author_values` joins the segments again that a
comma split inside one name.

Defined results: null, empty, blank and bracket-only fields give no row; a field that holds one value gives one row
(callers ask for ``min_values=2`` where only packed fields count); repeated values are kept, each with its position;
an unterminated quote ends with the string and its content is a value; extra columns of the input do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = {"[": "]", "{": "}"}, {"]", "}"}
_HARD = frozenset(";|\n\r\t·•/")
_STOP = re.compile(r"[\\\"'\[\]{};,|\n\r\t·•/]|\s(?:[aA][nN][dD]|und|et|y|e|&)\s")
_WORDS = re.compile(r"\s([aA][nN][dD]|und|et|y|e|&)\s")
#: Signs with which a text needs more than being cut at its delimiters (an apostrophe behind a letter is none), and these.
_NESTING = re.compile(r"[\\\"\[\]{}]|(?<!\w)'")
_CUTS = re.compile(r"([;,|\n\r\t·•/]|\s(?:[aA][nN][dD]|und|et|y|e|&)(?=\s))")
#: A list of quoted values without escapes, in brackets or not.
_QUOTED_LIST = re.compile(r"""(?:"[^"\\]*"\s*(?:[,;]\s*"[^"\\]*"\s*)*|\[\s*(?:"[^"\\]*"\s*(?:[,;]\s*"[^"\\]*"\s*)*|'[^'\\]*'\s*(?:[,;]\s*'[^'\\]*'\s*)*)?\])""")
_QUOTED_VALUES = {q: re.compile(f"{q}([^{q}]*){q}") for q in "\"'"}
_UNQUOTED = {q: re.compile(rf"[^\\{q}]+|\\") for q in "\"'"}
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def tokenize(text: str, words: bool = True) -> list[tuple[str, str, bool]]:
    """Segments of ``text`` as (value, delimiter that ended it, was it quoted).

    ``words``: the conjunctions "and", "und", "et", "y", "e" and "&" between blanks delimit too. A quote opens only at
    the start of a segment, so the apostrophe of a name is a letter. A backslash inside a quote escapes one character
    or a \\uXXXX code; a doubled quote inside a quote is one.
    """
    if words and not _NESTING.search(text) and (segs := _cut(text)) is not None:
        return segs
    out: list[tuple[str, str, bool]] = []
    buf: list[str] = []
    quoted, depth, i, n = False, 0, 0, len(text)

    def emit(by: str) -> None:
        nonlocal quoted
        value = "".join(buf)
        out.append((value if quoted else value.strip(), by, quoted))
        buf.clear()
        quoted = False

    while i < n:
        m = _STOP.search(text, i)
        if m is None:
            buf.append(text[i:])
            break
        j, c = m.start(), text[m.start()]
        if j > i:
            buf.append(text[i:j])
        i = j + 1
        at_start = not "".join(buf).strip()
        if c in "\"'" and not quoted and at_start and (c == '"' or _closes(text, i, c)):
            buf.clear()
            i = _quote(text, i, c, buf)
            quoted = True
        elif c in _OPEN and at_start:
            depth += 1
        elif c in _CLOSE and depth:
            depth -= 1
        elif c == "," or c in _HARD:
            emit("\n" if c == "\r" else c)
        elif c.isspace():
            w = _WORDS.match(text, j)
            if w and words and not at_start:
                emit(w[1].lower())
                i = w.end() - 1  # the blank may open the next conjunction
            elif w and words and out:
                i = w.end() - 1  # ", and": the comma has delimited already
            else:
                buf.append(c)
        elif not quoted or c.strip():
            buf.append(c)
    if any(x.strip() for x in buf) or quoted:
        emit("")
    return out


def _cut(text: str) -> list[tuple[str, str, bool]] | None:
    """:func:`tokenize` for a text without quotes, brackets and escapes; None where it begins with a conjunction."""
    out: list[tuple[str, str, bool]] = []
    parts = _CUTS.split(text)
    for k in range(1, len(parts), 2):
        value, by = parts[k - 1].strip(), parts[k]
        if len(by) == 1:
            out.append((value, "\n" if by == "\r" else by, False))
        elif value:
            out.append((value, by[1:].lower(), False))
        elif not out:
            return None
    value = parts[-1].strip()
    if value:
        out.append((value, "", False))
    return out


def _closes(text: str, i: int, q: str) -> bool:
    """Does the single quote before ``i`` have its partner before a delimiter or the end?"""
    return bool(re.compile(r"(?:\\.|[^\\'])*'\s*(?:[,;|\]]|$)").match(text, i)) if q == "'" else True


def _quote(text: str, i: int, q: str, buf: list[str]) -> int:
    """Read the quoted run that begins at ``i`` into ``buf``; the position after its closing quote."""
    n = len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n:
            e = text[i + 1]
            if e == "u" and re.match(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                code = int(text[i + 2 : i + 6], 16)
                i += 6
                if 0xD800 <= code < 0xDC00 and re.match(r"\\u[dD][c-fC-F][0-9a-fA-F]{2}", text[i : i + 6]):
                    code = 0x10000 + ((code - 0xD800) << 10) + int(text[i + 2 : i + 6], 16) - 0xDC00
                    i += 6
                buf.append("�" if 0xD800 <= code < 0xE000 else chr(code))  # half a pair is no character
            elif e == "x" and re.match(r"[0-9a-fA-F]{2}", text[i + 2 : i + 4]):
                buf.append(chr(int(text[i + 2 : i + 4], 16)))
                i += 4
            else:
                buf.append(_ESCAPE.get(e, e))
                i += 2
        elif c == q:
            if q == '"' and text[i + 1 : i + 2] == q:
                buf.append(q)
                i += 2
            else:
                return i + 1
        else:
            run = _UNQUOTED[q].match(text, i)
            buf.append(run[0])
            i = run.end()
    return n


_INITIALS = re.compile(r"(?:[^\W\d_]\.?[\s\-.]*){1,3}$")
_PARTICLES = frozenset("de la le du del della di da dos van von der den ter zu el al bin ibn".split())
_PARTICLE = re.compile(rf"^(?:(?:{'|'.join(sorted(_PARTICLES))})\s+)+", re.I)
_ETAL = re.compile(r"[\s,]*(?:\bet\.? al\b\.?|\band others\b|\bu\. ?a\.(?=\s*$)|…|\.\.\.)\s*$", re.I)
_ETAL_ALONE = re.compile(r"et\.? al\.?|al\.?", re.I)
_LISTED = ("[", '"')
_GROUP = re.compile(r"\b(?:group|consortium|committee|council|network|society|association|institute|team)\b.*\b(?:on|of|for|in)\b", re.I)
_SUFFIX = re.compile(r"(?:jr|sr|ii|iii|iv|phd|md)\.?$", re.I)


def _kind(segment: str) -> str:
    """i: initials; s: one word, perhaps with particles; g: a word and initials; f: a whole name."""
    x = segment.strip()
    parts = x.split()
    if len(parts) > 1 and (parts[0].lower() in _PARTICLES or not parts[0].isascii()):
        x = _PARTICLE.sub("", x, count=1)
        parts = x.split()
    if (x.isupper() or len(x) == 1) and _INITIALS.fullmatch(x):
        return "i"
    if len(parts) < 2:
        return "s"
    rest = " ".join(parts[1:])
    return "g" if rest.isupper() and _INITIALS.fullmatch(rest) else "f"


def author_values(text: str) -> list[str]:
    """The names of an author list in their order. Surname and given names parted by a comma are one name."""
    text = text.strip()
    if text[:1] in _LISTED and _QUOTED_LIST.fullmatch(text):
        return [v for v in map(str.strip, _QUOTED_VALUES["'" if text[1:].lstrip()[:1] == "'" and text[0] == "[" else '"'].findall(text)) if v and not (len(v) < 8 and _ETAL_ALONE.fullmatch(v))]
    if text[-1:] in ".…lLsSſ":  # else it can't end so
        text = _ETAL.sub("", text)
    segs = _whole_bodies(tokenize(text))
    if any(q for _, _, q in segs):
        return [v for v in (x.strip() for x, _, _ in segs) if v and not (len(v) < 8 and _ETAL_ALONE.fullmatch(v))]
    out: list[str] = []
    group: list[str] = []
    for value, by, _ in segs:
        if value:
            group.append(value)
        if by != ",":
            out += _join_commas(group)
            group = []
    out += _join_commas(group)
    return [v for v in out if v.strip(" .,;") and not (len(v) < 8 and re.fullmatch(r"(?:et\.? )?al\.?|others", v, re.I))]


def _whole_bodies(segs: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    """Join the parts of a corporate author again ("Group on A and B") that a conjunction split."""
    out: list[tuple[str, str, bool]] = []
    for value, by, quoted in segs:
        if out and out[-1][1].isalpha() and not out[-1][2] and _GROUP.search(out[-1][0]):
            value = f"{out[-1][0]} {out[-1][1]} {value}"
            out.pop()
        out.append((value, by, quoted))
    return out


def _join_commas(group: list[str]) -> list[str]:
    out: list[str] = []
    i, n = 0, len(group)
    while i < n:
        a, b = group[i], group[i + 1] if i + 1 < n else ""
        if _SUFFIX.match(a) and out:
            out[-1] += f", {a}"
            i += 1
        elif b and (_kind(a) == "s" and _kind(b) in "isg" or n == 2 and _kind(a) != "i" and _kind(b) == "i"):
            out.append(f"{a}, {b}")
            i += 2
        else:
            out.append(a)
            i += 1
    return out


_ISSN = re.compile(r"(?<!\d)(\d{4})[\s\-‐‑‒–—−]?(\d{3}[\dXx])(?!\d)")
_ISSN_RUN = re.compile(r"(?<!\d)(?:\d{7}[\dXx]){2,}(?![\dXx])")


def issn_values(text: str) -> list[str]:
    """The ISSNs of a field as NNNN-NNNC in their order; runs without any delimiter are cut every eight characters."""
    out: list[str] = []
    text = _ISSN_RUN.sub(lambda m: " ; ".join(m[0][k : k + 8] for k in range(0, len(m[0]), 8)), text)
    for value, _, _ in tokenize(text, words=True):
        out += [f"{m[1]}-{m[2].upper()}" for m in _ISSN.finditer(value)]
    return out


KINDS: dict[str, Callable[[str], list[str]]] = {"authors": author_values, "issn": issn_values}


def split_packed(df: DataFrame, row_id: str, field: str, kind: str, min_values: int = 1) -> DataFrame:
    """One row (row_id, pos, item) per value of ``field``, for the fields that hold ``min_values`` or more.

    Row-local: one pass in Arrow batches, no shuffle, two columns read. ``kind`` names the grammar in ``KINDS``.
    """
    split = KINDS[kind]
    schema = pa.schema([("row_id", pa.int64()), ("pos", pa.int64()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, items = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = split(text)
                if len(values) >= min_values:
                    ids += [i] * len(values)
                    pos += range(1, len(values) + 1)
                    items += values
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int64()), pa.array(items, pa.string())], schema=schema)

    used = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(field).cast("string").alias("text"))
    return used.where(F.length(F.trim("text")) > 0).mapInArrow(run, "row_id long, pos long, item string")
