"""The queries of the llm problems (pN) and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.canonical_map import map_to_list
from rankloom.llm.corpus_tokens import encode_corpus
from rankloom.llm.leakage import find_leaks
from rankloom.llm.linkage import link
from rankloom.llm.mojibake import repair
from rankloom.llm.name_variants import link_names, variant_pairs
from rankloom.llm.pii import detect, redact
from rankloom.llm.response_defects import judge, one_each
from rankloom.plans.session import table


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one work from different platforms, each with a confidence."""
    return link(table(spark, sf_dir, "search_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one work from different platforms."""
    return p2_matches(spark, sf_dir).select("record_id_a", "record_id_b")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, mangled = table(spark, sf_dir, "search_records"), table(spark, sf_dir, "scopus_mangled_title")
    first = records.select(F.lit("search_records").alias("src_table"), F.col("record_id").alias("row_id"), F.col("title").alias("text"))
    return first.unionByName(mangled.select(F.lit("scopus_mangled_title").alias("src_table"), F.col("title_id").alias("row_id"), F.col("title").alias("text")))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with a spoilt title, how it was spoilt, and the title as it was written where it can be had."""
    titles = _titles(spark, sf_dir)
    return repair(titles, titles.select("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with a spoilt title."""
    return p3_restored(spark, sf_dir).select("src_table", "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The successful answers that are no proper answers, with their type of defect."""
    pairs = table(spark, sf_dir, "provider_responses").where("success")
    return one_each(judge(pairs)).withColumnRenamed("row_id", "resp_id")


def p4_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect of every answer with its posterior; an answer may have several."""
    return judge(table(spark, sf_dir, "provider_responses").where("success")).withColumnRenamed("row_id", "resp_id")


def _publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.col("extra")
    paths = {"source_publisher": "$.openalex.primary_location.source.publisher", "host_publisher": "$.openalex.host_venue.publisher", "core_publisher": "$.core.publisher"}
    return table(spark, sf_dir, "search_records").select(*[F.get_json_object(extra, path).alias(name) for name, path in paths.items()])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of publisher spellings that name one organisation."""
    publishers = _publishers(spark, sf_dir)
    return variant_pairs(link_names(publishers, publishers.columns))


def p5_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every publisher spelling with its organisation."""
    publishers = _publishers(spark, sf_dir)
    return link_names(publishers, publishers.columns)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal meant by each typed journal name, or ``unmatched``."""
    names, journals = table(spark, sf_dir, "scopus_entries"), table(spark, sf_dir, "ranking_entries")
    found = map_to_list(names, "entry_id", "prism_publicationname", ["prism_issn", "prism_eissn"], journals, "venue_key", "title", ["issn_print", "issn_online", "issn_l"])
    return found.select(found["row_id"].alias("entry_id"), found["key"].alias("venue_key"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by the public byte-level vocabulary."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold passages of evaluation items."""
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with the number of the passage's words and whether its numbers and units were exchanged."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal detail of every document with its type."""
    return detect(table(spark, sf_dir, "documents"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders, and with surrogates under a key of this run's own."""
    return redact(table(spark, sf_dir, "documents"), key=b"key of the example query")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_matches": p2_matches, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p4_defects": p4_defects, "p5_found": p5_found, "p5_orgs": p5_orgs, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_redacted": p10_redacted}
ORACLES: dict[str, str] = {}
