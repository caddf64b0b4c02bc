"""Similarity of ranked lists: Jaccard, overlap at k and extrapolated rank-biased overlap, for all pairs of lists.

A list is the ranked identifiers of one (query, source). Pairs come from an equi-join on the identifier, so lists of any
length work and pairs without a common identifier cost nothing; their zero rows come from the list dimension.

Defined results: null and blank identifiers take no place; of an identifier repeated in a list the best place counts;
two empty lists are equal (1.0), an empty and a filled one share nothing (0.0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked_lists(df: DataFrame, query: str, source: str, identifier: str, order: list[str]) -> DataFrame:
    """(query, source, identifier, pos): first places of each identifier, numbered without gaps."""
    used = df.where(F.trim(F.coalesce(F.col(identifier), F.lit(""))) != "").select(F.col(query).alias("query"), F.col(source).alias("source"), F.col(identifier).alias("identifier"), F.struct(*order).alias("at"))
    first = used.groupBy("query", "source", "identifier").agg(F.min("at").alias("at"))
    return first.select("query", "source", "identifier", F.row_number().over(Window.partitionBy("query", "source").orderBy("at", "identifier")).alias("pos"))


def pairwise(lists: DataFrame, k: int = 10, p: float = 0.9) -> DataFrame:
    """(query, source_a, source_b, n_a, n_b, n_common, jaccard, overlap_at_k, rbo) of all source pairs of a query."""
    sizes = lists.groupBy("query", "source").agg(F.count("*").alias("n"))
    a, b = (sizes.select("query", F.col("source").alias(f"source_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = a.join(b, "query").where("source_a < source_b")
    la, lb = (lists.select("query", "identifier", F.col("source").alias(f"source_{x}"), F.col("pos").alias(f"pos_{x}")) for x in "ab")
    common = la.join(lb, ["query", "identifier"]).where("source_a < source_b").select("query", "source_a", "source_b", F.greatest("pos_a", "pos_b").alias("depth"), F.when((F.col("pos_a") <= k) & (F.col("pos_b") <= k), 1).alias("top"))
    # agreement at depth d = (common identifiers with both places <= d) / d; an identifier met at depth m adds to every d >= m
    summed = common.groupBy("query", "source_a", "source_b").agg(F.count("*").alias("n_common"), F.count("top").alias("n_top"), F.collect_list("depth").alias("depths"))
    joined = pairs.join(summed, ["query", "source_a", "source_b"], "left")
    last = F.least("n_a", "n_b")
    depths = F.coalesce(F.col("depths"), F.array().cast("array<int>"))
    terms = F.aggregate(F.sequence(F.lit(1), last.cast("int")), F.lit(0.0), lambda s, d: s + (1 - p) * F.size(F.filter(depths, lambda m: m <= d)) / d * F.pow(F.lit(p), d - 1))
    tail = F.size(F.filter(depths, lambda m: m <= last)) / last * F.pow(F.lit(p), last)
    shared = F.coalesce("n_common", F.lit(0))
    return joined.select(
        "query", "source_a", "source_b", "n_a", "n_b", shared.alias("n_common"),
        (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("jaccard"),
        (F.coalesce("n_top", F.lit(0)) / F.least(last, F.lit(k))).alias("overlap_at_k"),
        (terms + tail).alias("rbo"),
    )


def membership(df: DataFrame, identifier: str, source: str, sources: list[str]) -> DataFrame:
    """How many identifiers each combination of sources shares: one flag column per source and ``n``."""
    flags = df.where(F.col(identifier).isNotNull()).groupBy(identifier).agg(*[F.max((F.col(source) == s).cast("int")).alias(s) for s in sources])
    return flags.groupBy(*sources).agg(F.count("*").alias("n"))
