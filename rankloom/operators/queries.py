"""The queries of the general data problems (pN) in the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.packed_fields import split_packed
from rankloom.operators.schema_drift import drift, fused_union, typed_values
from rankloom.plans.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change between successive files of a feed."""
    return drift(table(spark, sf_dir, "serial_title_files"))


def p1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path over all files with the alternative types it takes."""
    return fused_union(table(spark, sf_dir, "serial_title_files"))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of serial, year and metric values over all files."""
    return typed_values(table(spark, sf_dir, "serial_title_files"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the packed author lists and ISSN fields that hold two or more."""
    authors = split_packed(table(spark, sf_dir, "search_records"), "record_id", "authors", "authors", min_values=2)
    issns = split_packed(table(spark, sf_dir, "scopus_entries"), "entry_id", "prism_issn", "issn", min_values=2)
    out = authors.select(F.lit("search_records").alias("src_table"), "*")
    return out.unionByName(issns.select(F.lit("scopus_entries").alias("src_table"), "*"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_union": p1_union, "p1_values": p1_values, "p7_found": p7_found}
