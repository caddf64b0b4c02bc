"""Scalar functions as Column expressions: identifiers, titles, numbers, flags, years, rank values.

All are null-safe, none is a Python UDF. Blank text counts as null unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Trimmed text, null where blank."""
    t = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(t != "", t)


def compact(c: Column) -> Column:
    """Lower case with runs of white space as one blank."""
    return F.lower(F.regexp_replace(text(c), r"\s+", " "))


def norm_doi(c: Column) -> Column:
    """Lower-case bare DOI found in any writing of it (resolver address, ``doi:`` prefix, percent codes); null without one."""
    raw = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    found = F.regexp_extract(F.regexp_replace(F.lower(raw), r"\s", ""), r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1)
    bare = F.regexp_replace(found, r"[ .;,)]+$", "")
    return F.when(bare != "", bare)


def doi_from_url(c: Column) -> Column:
    """DOI of a resolver address; null for any other address."""
    return F.when(F.lower(c).rlike(r"^https?://(dx\.)?doi\.org/"), norm_doi(c))


def norm_issn(c: Column) -> Column:
    """NNNN-NNNC of a text with exactly one ISSN's characters; seven digits are padded on the left."""
    chars = F.regexp_replace(F.upper(c), "[^0-9X]", "")
    full = F.when(F.length(chars) == 7, F.concat(F.lit("0"), chars)).otherwise(chars)
    return F.when(full.rlike("^[0-9]{7}[0-9X]$"), F.concat_ws("-", F.substring(full, 1, 4), F.substring(full, 5, 4)))


def issn_is_valid(c: Column) -> Column:
    """Does the check character of a normalised ISSN hold (weights 8 to 2, modulo 11)?"""
    chars = F.replace(c, F.lit("-"), F.lit(""))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(6)), F.lit(0), lambda a, i: a + F.substring(chars, i + 1, F.lit(1)).try_cast("int") * (8 - i))
    want = F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11))
    have = F.when(F.substring(chars, 8, 1) == "X", 10).otherwise(F.substring(chars, 8, 1).try_cast("int"))
    return want == have


def norm_title(c: Column) -> Column:
    """Lower case, "&" as "and", bracketed parts and punctuation gone, blanks collapsed; null where nothing is left."""
    t = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, r"\([^)]*\)", " ")
    t = F.regexp_replace(F.replace(t, F.lit("_"), F.lit(" ")), r"[^\p{L}\p{N}\s]", " ")
    return text(F.regexp_replace(t, r"\s+", " "))


def to_int(c: Column) -> Column:
    """Integer of a number or numeric text, truncated; null for anything else."""
    return F.regexp_replace(text(c), ",", "").try_cast("double").try_cast("bigint")


def to_double(c: Column) -> Column:
    """Number of numeric text, grouping commas allowed."""
    return F.regexp_replace(text(c), ",", "").try_cast("double")


def to_bool(c: Column) -> Column:
    """Flag of 1/true/yes/y/open and 0/false/no/n/closed in any case; other values are null."""
    t = F.lower(text(c))
    return F.when(t.isin("1", "true", "yes", "y", "open"), True).when(t.isin("0", "false", "no", "n", "closed"), False)


def year_of(c: Column, low: int = 1800, high: int = 2100) -> Column:
    """First four-digit number of a date text within the bounds."""
    y = F.regexp_extract(text(c), r"(?:^|[^0-9])((?:1[89]|20|21)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")
    return F.when(y.between(low, high), y)


def scopus_id(c: Column) -> Column:
    """Digits of ``SCOPUS_ID:digits`` or of an all-digit id."""
    d = F.regexp_extract(c, r"^(?:SCOPUS_ID:)?([0-9]+)$", 1)
    return F.when(d != "", d)


def rank_number(c: Column) -> Column:
    """Number of a rank value of mixed meaning: numbers as they are, letters by quality, Q1..Q4 as 4..1."""
    t = F.upper(text(c))
    known = F.when(t == "A*", 4.0).when(t == "A", 3.0).when(t == "B", 2.0).when(t == "C", 1.0).when(t == "Q1", 4.0).when(t == "Q2", 3.0).when(t == "Q3", 2.0).when(t == "Q4", 1.0)
    return F.coalesce(known, to_double(c))


def shorten(c: Column, most: int = 120) -> Column:
    """Text of at most ``most`` characters, cut texts marked by three points."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def register_functions(spark: SparkSession) -> None:
    """SQL functions norm_doi, norm_issn, norm_title for ``spark.sql``; each expands to a built-in expression."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION norm_issn(x STRING) RETURNS STRING RETURN CASE WHEN regexp_replace(upper(x), '[^0-9X]', '') RLIKE '^[0-9]{7}[0-9X]$' THEN concat_ws('-', substring(regexp_replace(upper(x), '[^0-9X]', ''), 1, 4), substring(regexp_replace(upper(x), '[^0-9X]', ''), 5, 4)) END")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION norm_doi(x STRING) RETURNS STRING RETURN nullif(regexp_extract(lower(x), '(10\\.[0-9]{4,9}/[^\\s\"<>]+[^\\s\"<>.;,)])', 1), '')")
