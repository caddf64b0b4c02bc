"""Measures of ranked result lists by platform and overall: recency, completeness, distributions, concentration,
correlation, citation quality, and shifts between the top of the lists and the rest.

Input is a frame as :func:`frame` makes it. Output is long: metric, scope (a platform or ``overall``), further keys, value,
n. One aggregate with grouping sets serves all scopes; medians and percentiles are exact. Nulls never count as values, a
measure without any value is null, an empty frame gives only the overall row of plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.scalars import compact, norm_doi, text

AS_OF = 2024
KS = (10, 20, 50)
#: Citation counts of a platform are suspicious at this share of zeros, if old records have this share of zeros too.
ZERO_RATE, OLD_ZERO_RATE = 0.85, 0.30


def frame(records: DataFrame) -> DataFrame:
    """The columns the measures need, from raw search records with a JSON payload."""
    path = lambda p: F.get_json_object("extra", p)
    publisher = F.coalesce(text(path("$.openalex.primary_location.source.publisher")), text(path("$.openalex.host_venue.publisher")), text(path("$.core.publisher")))
    journal = F.coalesce(text(path("$.openalex.primary_location.source.display_name")), text(path("$.openalex.host_venue.display_name")), text(path("$.semanticscholar.journal.name")), text(path("$.core.journal")))
    return records.select(
        "record_id", "platform", "query_id", F.col("result_rank").alias("rank"), norm_doi(F.col("doi")).alias("doi"), text(F.col("title")).alias("title"), "raw_id",
        F.when(F.col("pub_year").between(1800, AS_OF + 1), F.col("pub_year")).alias("year"), compact(F.col("lang_code")).alias("language"), "is_oa",
        F.col("cited_by_count").alias("citations"), publisher.alias("publisher"), journal.alias("journal"),
    )


def by_scope(df: DataFrame, *measures: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """One aggregate per platform and overall (and per further column)."""
    grouped = df.groupingSets([[F.col("platform"), *map(F.col, also)], [*map(F.col, also)]], F.col("platform"), *map(F.col, also))
    return grouped.agg(F.grouping("platform").alias("g"), *measures).withColumn("scope", F.when(F.col("g") == 1, "overall").otherwise(F.col("platform"))).drop("g", "platform")


def recency(df: DataFrame, as_of: int = AS_OF) -> DataFrame:
    """Median year and age, and the shares of records at most 2, 5 and 10 and over 10 years old."""
    age = F.lit(as_of) - F.col("year")
    share = lambda c: F.avg(c.cast("int"))
    return by_scope(df, F.count("year").alias("n"), F.median("year").alias("median_year"), F.median(age).alias("median_age"), share(age <= 2).alias("share_2"), share(age <= 5).alias("share_5"), share(age <= 10).alias("share_10"), share(age > 10).alias("share_old"))


FIELDS = ("doi", "title", "year", "language", "is_oa", "publisher", "citations", "journal")


def completeness(df: DataFrame) -> DataFrame:
    """Share of records that have each field."""
    shares = by_scope(df, F.count("*").alias("n"), *[(F.count(f) / F.count("*")).alias(f) for f in FIELDS])
    return shares.unpivot(["scope", "n"], list(FIELDS), "field", "value")


def distribution(df: DataFrame, label: Column) -> DataFrame:
    """(scope, label, n, share): how a label spreads over the records that have one."""
    counts = by_scope(df.withColumn("label", label).where("label is not null"), F.count("*").alias("n"), also=("label",))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("scope")))


def concentration(df: DataFrame, label: Column) -> DataFrame:
    """Herfindahl-Hirschman index, number of labels and largest share, from a two-level aggregate."""
    d = distribution(df, label)
    return d.groupBy("scope").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.count("*").alias("labels"), F.max("share").alias("top_share"), F.sum("n").alias("n"))


def spearman(df: DataFrame, x: str, y: str, least: int = 2) -> DataFrame:
    """Rank correlation by platform with average ranks for ties; null where a side is constant or points are few."""
    used = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("platform", x, y)

    def mean_rank(c: str) -> Column:
        same = F.count("*").over(Window.partitionBy("platform", c))
        return F.rank().over(Window.partitionBy("platform").orderBy(c)) + (same - 1) / 2

    ranked = used.select("platform", mean_rank(x).alias("rx"), mean_rank(y).alias("ry"))
    out = ranked.groupBy("platform").agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return out.select("platform", "n", F.when(F.col("n") >= least, F.try_divide("c", F.col("sx") * F.col("sy"))).alias("rho"))


def citation_quality(df: DataFrame, as_of: int = AS_OF) -> DataFrame:
    """Zero rates and a label (missing, suspicious, ok) of each platform's citation counts."""
    old = F.col("year") <= as_of - 3
    q = df.groupBy("platform").agg(F.count("*").alias("n"), F.count("citations").alias("known"), F.avg((F.col("citations") == 0).cast("int")).alias("zero_rate"), (F.count_if(old & (F.col("citations") == 0)) / F.count("*")).alias("old_zero_rate"))
    label = F.when(F.col("known") == 0, "missing").when((F.col("zero_rate") >= ZERO_RATE) & (F.col("old_zero_rate") > OLD_ZERO_RATE), "suspicious").otherwise("ok")
    return q.withColumn("quality", label)


def ranked(df: DataFrame) -> DataFrame:
    """The records with a rank, numbered by (rank, doi, title, raw id, record id) within platform and query."""
    order = [F.col("rank"), F.coalesce("doi", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("raw_id", F.lit("")), F.col("record_id")]
    return df.where("rank is not null").withColumn("pos", F.row_number().over(Window.partitionBy("platform", "query_id").orderBy(*order)))


def minimum_count(k: Column, n: Column) -> Column:
    """Least number of values for a reliable measure of the first k of n."""
    return F.when(n <= 0, 0).otherwise(F.least(n, F.greatest(F.lit(10), F.ceil(F.greatest(k, F.lit(1)) * 0.3)))).cast("bigint")


def reliability(available: Column, n: Column, missing: Column) -> Column:
    """high, medium or low by the number of values and the share of missing ones."""
    high = (available >= F.greatest(F.lit(30), F.ceil(n * 0.6))) & (missing <= 0.2)
    medium = (available >= F.greatest(F.lit(10), F.ceil(n * 0.3))) & (missing <= 0.5)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def _at_k(df: DataFrame) -> DataFrame:
    return ranked(df).withColumn("k", F.explode(F.array(*map(F.lit, KS)))).withColumn("top", F.col("pos") <= F.col("k"))


def oa_top_k(df: DataFrame) -> DataFrame:
    """Open-access share of the first k results of all queries against all results, gated by the number of values."""
    rows = _at_k(df).groupBy("platform", "k").agg(F.count_if("top").alias("n_top"), F.count_if(F.col("top") & F.col("is_oa").isNotNull()).alias("available"), F.avg(F.when(F.col("top"), F.col("is_oa").cast("int"))).alias("top_share"), F.avg(F.col("is_oa").cast("int")).alias("overall_share"))
    missing = 1 - F.col("available") / F.col("n_top")
    enough = F.col("available") >= minimum_count(F.col("k"), F.col("n_top"))
    return rows.select("platform", "k", "n_top", "available", "top_share", "overall_share", F.when(enough, F.col("top_share") - F.col("overall_share")).alias("delta"), reliability(F.col("available"), F.col("n_top"), missing).alias("reliability"))


def citations_top_k(df: DataFrame) -> DataFrame:
    """Median citations of the first k results against the rest."""
    rows = _at_k(df).groupBy("platform", "k").agg(F.median(F.when(F.col("top"), F.col("citations"))).alias("median_top"), F.median(F.when(~F.col("top"), F.col("citations"))).alias("median_rest"), F.count_if(F.col("top") & F.col("citations").isNotNull()).alias("n_top"), F.count_if(~F.col("top") & F.col("citations").isNotNull()).alias("n_rest"))
    return rows.withColumn("delta", F.col("median_top") - F.col("median_rest"))


def journals_top_k(df: DataFrame) -> DataFrame:
    """Different journals in the first k results, absolute and for each result."""
    rows = _at_k(df).where("top").groupBy("platform", "k").agg(F.count("*").alias("n_top"), F.countDistinct(F.lower("journal")).alias("journals"))
    return rows.withColumn("diversity", F.col("journals") / F.col("n_top"))


def divergence_top_k(df: DataFrame, label: Column) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of a label's distribution in the first k results from that in all results."""
    rows = _at_k(df).withColumn("label", label).where("label is not null").groupBy("platform", "k", "label").agg(F.count_if("top").alias("n_top"), F.count("*").alias("n"))
    w = Window.partitionBy("platform", "k")
    p, q = F.col("n_top") / F.sum("n_top").over(w), F.col("n") / F.sum("n").over(w)
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return rows.select("platform", "k", p.alias("p"), q.alias("q")).groupBy("platform", "k").agg((F.sum(part(F.col("p"))) / 2 + F.sum(part(F.col("q"))) / 2).alias("js"))


def winsorized(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """Mean and maximum by platform before and after capping at the exact q-quantile."""
    caps = df.groupBy("platform").agg(F.percentile(value, q).alias("cap"))
    capped = df.join(caps, "platform").where(F.col(value).isNotNull())
    return capped.groupBy("platform").agg(F.max("cap").alias("cap"), F.avg(value).alias("mean"), F.avg(F.least(F.col(value).cast("double"), "cap")).alias("mean_capped"), F.count_if(F.col(value) > F.col("cap")).alias("n_capped"))
