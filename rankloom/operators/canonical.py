"""Canonical records: one row per search hit with the same columns whatever platform it came from, and provenance.

Every column is a cascade of candidates; the provenance columns say which candidate won (``raw`` or ``payload``). The
payload is read by path expressions, so only the named fields are parsed and no row leaves the JVM.

Defined results: blank text is missing; a year outside 1800 to 2100 is missing; a flag or number that can't be read is
missing; a record without any id gets ``title#rank``; an explicit zero of citations is zero, an absent field is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scalars import compact, doi_from_url, norm_doi, norm_issn, text, to_bool, to_int


def _path(path: str) -> Column:
    return F.get_json_object("extra", path)


def _first(*candidates: Column) -> Column:
    return F.coalesce(*map(text, candidates))


def issn_candidates() -> Column:
    """All ISSNs of the payload in order of trust, each once, normalised."""
    listed = [F.from_json(_path(p), "array<string>") for p in ("$.openalex.primary_location.source.issn", "$.openalex.host_venue.issn", "$.semanticscholar.publicationVenue.issn", "$.core.identifiers.issn", "$.core.identifiers.eissn")]
    single = [_path(p) for p in ("$.scopus.raw['prism:issn']", "$.scopus.raw['prism:eIssn']", "$.semanticscholar.journal.issn")]
    every = F.concat(F.array(*single[:2]), *[F.coalesce(x, F.array().cast("array<string>")) for x in listed], F.array(single[2]))
    return F.array_distinct(F.array_compact(F.transform(every, norm_issn)))


def canonical(records: DataFrame) -> DataFrame:
    """The canonical rows of raw search records."""
    year = F.when(F.col("pub_year").between(1800, 2100), F.col("pub_year"))
    issns = issn_candidates()
    citations = F.coalesce(F.col("cited_by_count").cast("bigint"), to_int(_path("$.openalex.cited_by_count")), to_int(_path("$.semanticscholar.citationCount")), to_int(_path("$.core.citationCount")), to_int(_path("$.scopus.raw['citedby-count']")))
    is_oa = F.coalesce(F.col("is_oa"), to_bool(_path("$.openalex.open_access.is_oa")), to_bool(_path("$.semanticscholar.isOpenAccess")))
    doi = F.coalesce(norm_doi(F.col("doi")), doi_from_url(F.col("url")))
    return records.select(
        "record_id",
        F.coalesce(text(F.col("raw_id")), norm_doi(F.col("doi")), text(F.col("url")), F.concat_ws("#", F.coalesce(text(F.col("title")), F.lit("record")), F.coalesce(F.col("result_rank").cast("string"), F.lit("na")))).alias("id"),
        F.coalesce(compact(F.col("platform")), F.lit("unknown")).alias("platform"),
        "query_id", F.col("result_rank").alias("rank"), text(F.col("title")).alias("title"), doi.alias("doi"), year.alias("year"), compact(F.col("lang_code")).alias("language"),
        is_oa.alias("is_oa"), citations.alias("citations"),
        _first(_path("$.openalex.primary_location.source.publisher"), _path("$.openalex.host_venue.publisher"), _path("$.semanticscholar.journal.publisher"), _path("$.core.publisher"), _path("$.scopus.raw.publishername")).alias("publisher"),
        _first(_path("$.openalex.primary_location.source.display_name"), _path("$.openalex.host_venue.display_name"), _path("$.semanticscholar.journal.name"), _path("$.core.journal"), _path("$.scopus.raw['prism:publicationName']")).alias("journal_title"),
        issns.alias("issn_list"), F.try_element_at(issns, F.lit(1)).alias("issn"), F.try_element_at(issns, F.lit(2)).alias("eissn"),
        F.when(F.col("is_oa").isNotNull(), "raw").when(is_oa.isNotNull(), "payload").otherwise("missing").alias("is_oa_provenance"),
        F.when(F.col("cited_by_count").isNotNull(), "raw").when(citations.isNotNull(), "payload").otherwise("missing").alias("citations_provenance"),
    )


def merge_missing(records: DataFrame, extra: DataFrame, key: str, fields: list[str], overwrite: tuple[str, ...] = ()) -> DataFrame:
    """Fill ``fields`` of ``records`` from ``extra`` (one row per key) where blank; fields in ``overwrite`` take its value."""
    side = extra.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = records.join(side, key, "left")
    pick = lambda f: F.coalesce(F.col(f"_{f}"), F.col(f)) if f in overwrite else F.coalesce(F.when(F.trim(F.col(f).cast("string")) != "", F.col(f)), F.col(f"_{f}"))
    return joined.withColumns({f: pick(f) for f in fields}).drop(*[f"_{f}" for f in fields])


def coverage(raw: DataFrame, clean: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(platform, field, before, after): share of rows with a value before and after canonicalisation."""
    count = lambda df, k, name: df.groupBy("platform").agg(*[F.avg(F.when(F.trim(F.col(c[k]).cast("string")) != "", 1).otherwise(0)).alias(f) for f, c in fields.items()]).unpivot("platform", list(fields), "field", name)
    return count(raw, 0, "before").join(count(clean, 1, "after"), ["platform", "field"], "full")
