"""Venue matching cascade: identifier exact, title exact, fuzzy title; ambiguity is rejected, never guessed.

The index of a reference list has one row for each unambiguous key. Identifiers and titles are equi-joins; the titles left
over meet every reference title whose length allows ``THRESHOLD - LEAD`` (an equi-join on the lengths), which loses no match
and no runner-up.

Defined results: a key that leads to several venues is dropped; the first identifier that hits decides; a fuzzy match needs
``THRESHOLD`` and ``LEAD`` over the runner-up; rows without any key are unmatched with score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scalars import norm_issn, norm_title

THRESHOLD, LEAD = 0.92, 0.02


def key_index(reference: DataFrame, venue: str, keys: list[str], normalise) -> DataFrame:
    """(key, venue) of the keys that lead to one venue only."""
    exploded = reference.select(F.col(venue).alias("venue"), F.explode(F.array(*[normalise(F.col(k)) for k in keys])).alias("key")).where("key is not null")
    return exploded.groupBy("key").agg(F.min("venue").alias("venue"), F.countDistinct("venue").alias("venues")).where("venues = 1").select("key", "venue")


def similarity(a, b):
    """1 - edits / length of the longer text."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def match_venues(rows: DataFrame, row_id: str, title: str, issns: list[str], reference: DataFrame, venue: str, ref_title: str, ref_issns: list[str]) -> DataFrame:
    """(row_id, venue, method, score) for every row; method is issn, title, fuzzy or none."""
    issn_index = key_index(reference, venue, ref_issns, norm_issn)
    title_index = key_index(reference, venue, [ref_title], norm_title)
    base = rows.select(F.col(row_id).alias("row_id"), norm_title(F.col(title)).alias("title_key"), F.array(*[norm_issn(F.col(c)) for c in issns]).alias("issns"))
    by_issn = base.select("row_id", F.posexplode("issns").alias("pos", "key")).join(issn_index, "key").groupBy("row_id").agg(F.min_by("venue", "pos").alias("issn_venue"))
    distinct = base.where("title_key is not null").select("title_key").distinct()
    by_title = distinct.join(title_index.withColumnRenamed("key", "title_key").withColumnRenamed("venue", "title_venue"), "title_key")
    rest = distinct.join(by_title, "title_key", "left_anti")
    length, low = F.length("title_key"), THRESHOLD - LEAD - 1e-9
    left = rest.select("title_key", F.explode(F.sequence(F.ceil(length * low).cast("int"), F.floor(length / low).cast("int"))).alias("length"))
    right = title_index.select(F.col("key"), F.col("venue").alias("fuzzy_venue"), F.length("key").alias("length"))
    scored = left.join(right, "length").withColumn("score", similarity(F.col("title_key"), F.col("key"))).where(F.col("score") >= low)
    best = scored.groupBy("title_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "fuzzy_venue"))).alias("all"))
    second = F.coalesce(-F.try_element_at("all", F.lit(2))["s"], F.lit(0.0))
    by_fuzzy = best.select("title_key", F.col("all")[0]["fuzzy_venue"].alias("fuzzy_venue"), (-F.col("all")[0]["s"]).alias("fuzzy_score"), second.alias("second")).where((F.col("fuzzy_score") >= THRESHOLD) & (F.col("fuzzy_score") - F.col("second") >= LEAD))
    joined = base.join(by_issn, "row_id", "left").join(by_title, "title_key", "left").join(by_fuzzy, "title_key", "left")
    method = F.when(F.col("issn_venue").isNotNull(), "issn").when(F.col("title_venue").isNotNull(), "title").when(F.col("fuzzy_venue").isNotNull(), "fuzzy").otherwise("none")
    score = F.when(method.isin("issn", "title"), 1.0).when(method == "fuzzy", F.col("fuzzy_score")).otherwise(0.0)
    return joined.select("row_id", F.coalesce("issn_venue", "title_venue", "fuzzy_venue").alias("venue"), method.alias("method"), score.alias("score"))
