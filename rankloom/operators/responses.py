"""Analysis of language-model answers: JSON recovery, item rows, model summaries, stability, divergence, pair deltas.

Answers parse as strict JSON, as the JSON of a fenced block, or as the outermost braces of the text, in this order; what
does not parse is ``failed``. Items keep their position. All steps are Column expressions over VARIANT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIDENCE = {"strict": 1.0, "fenced": 0.8, "embedded": 0.6, "failed": 0.0}


def parsed(df: DataFrame, answer: str = "output_text") -> DataFrame:
    """``df`` with parse_method, parse_confidence and the payload (VARIANT)."""
    strict = F.when(F.col(answer).rlike(r"^\s*[\[{][\s\S]*[\]}]\s*$"), F.try_parse_json(answer))
    fenced = F.try_parse_json(F.nullif(F.regexp_extract(answer, r"```(?:json)?\s*([\[{][\s\S]*?[\]}])\s*```", 1), F.lit("")))
    embedded = F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(\{[\s\S]*\})", 1), F.lit("")))
    out = df.withColumns({"p1": strict, "p2": fenced, "p3": embedded})
    method = F.when(F.col("p1").isNotNull(), "strict").when(F.col("p2").isNotNull(), "fenced").when(F.col("p3").isNotNull(), "embedded").otherwise("failed")
    out = out.withColumn("parse_method", method).withColumn("payload", F.coalesce("p1", "p2", "p3")).drop("p1", "p2", "p3")
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return out.withColumn("parse_confidence", confidence[F.col("parse_method")])


def items(df: DataFrame) -> DataFrame:
    """One row per recommended article with its claimed rank, title, DOI, year and journal."""
    from rankloom.functions.scalars import norm_doi, to_int

    articles = F.try_variant_get("payload", "$.articles", "array<variant>")
    rows = df.select("resp_id", "query_id", "model", "repeat_index", F.posexplode(articles).alias("at", "item"))
    get = lambda name, kind="string": F.try_variant_get("item", f"$.{name}", kind)
    return rows.select("resp_id", "query_id", "model", "repeat_index", (F.col("at") + 1).alias("pos"), F.coalesce(F.nullif(to_int(get("rank")), F.lit(0)), F.col("at") + 1).alias("rank"), get("title").alias("title"), norm_doi(get("doi")).alias("doi"), to_int(get("year")).alias("year"), get("journal").alias("journal"))


def model_summary(df: DataFrame) -> DataFrame:
    """Calls, failures, latency and token figures of every model."""
    return df.groupBy("model").agg(F.count("*").alias("calls"), F.avg((~F.col("success")).cast("int")).alias("failure_rate"), F.avg("latency_ms").alias("mean_latency"), F.median("latency_ms").alias("median_latency"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.countDistinct("query_id").alias("queries"))


def repeat_stability(answers: DataFrame, identifier: str) -> DataFrame:
    """(model, query_id, pairs, mean_jaccard) over the pairs of repeats of one model and query.

    Sets are never collected: sizes and common members come from counts, pairs from the repeat dimension.
    """
    members = answers.where(F.col(identifier).isNotNull()).select("model", "query_id", "repeat_index", F.col(identifier).alias("item")).distinct()
    sizes = members.groupBy("model", "query_id", "repeat_index").agg(F.count("*").alias("n"))
    a, b = sizes.selectExpr("model", "query_id", "repeat_index ra", "n na"), sizes.selectExpr("model", "query_id", "repeat_index rb", "n nb")
    ma, mb = members.selectExpr("model", "query_id", "item", "repeat_index ra"), members.selectExpr("model", "query_id", "item", "repeat_index rb")
    common = ma.join(mb, ["model", "query_id", "item"]).where("ra < rb").groupBy("model", "query_id", "ra", "rb").agg(F.count("*").alias("nc"))
    pairs = a.join(b, ["model", "query_id"]).where("ra < rb").join(common, ["model", "query_id", "ra", "rb"], "left")
    shared = F.coalesce("nc", F.lit(0))
    return pairs.groupBy("model", "query_id").agg(F.count("*").alias("pairs"), F.avg(shared / (F.col("na") + F.col("nb") - shared)).alias("mean_jaccard"))


def model_divergence(answers: DataFrame, identifier: str) -> DataFrame:
    """(model_a, model_b, queries, mean_jaccard) over the queries both models answered."""
    members = answers.where(F.col(identifier).isNotNull()).select("model", "query_id", F.col(identifier).alias("item")).distinct()
    sizes = members.groupBy("model", "query_id").agg(F.count("*").alias("n"))
    a, b = sizes.selectExpr("model model_a", "query_id", "n na"), sizes.selectExpr("model model_b", "query_id", "n nb")
    ma, mb = members.selectExpr("model model_a", "query_id", "item"), members.selectExpr("model model_b", "query_id", "item")
    common = ma.join(mb, ["query_id", "item"]).where("model_a < model_b").groupBy("model_a", "model_b", "query_id").agg(F.count("*").alias("nc"))
    pairs = a.join(b, "query_id").where("model_a < model_b").join(common, ["model_a", "model_b", "query_id"], "left")
    shared = F.coalesce("nc", F.lit(0))
    return pairs.groupBy("model_a", "model_b").agg(F.count("*").alias("queries"), F.avg(shared / (F.col("na") + F.col("nb") - shared)).alias("mean_jaccard"))
