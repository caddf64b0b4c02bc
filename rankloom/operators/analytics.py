"""Queries of the ranked-list analytics over the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import scalars as S
from rankloom.operators import bias, canonical, matching, responses, similarity
from rankloom.plans.session import table
from rankloom.streaming import logs

_R9 = lambda c: F.round(F.col(c).cast("double"), 9).alias(c)


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places, counts as bigint: what both engines agree on."""
    return df.select(*[_R9(c) if t in ("double", "float") or t.startswith("decimal") else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes])


def _frame(spark: SparkSession, d: str) -> DataFrame:
    return bias.frame(table(spark, d, "search_records"))


def f_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """DOIs in one writing, DOIs out of resolver addresses, and ids of search hits."""
    r = table(spark, d, "search_records")
    return r.select("record_id", S.norm_doi(F.col("doi")).alias("doi_norm"), S.compact(F.col("source")).alias("source_norm"), S.compact(F.col("lang_code")).alias("lang_norm"))


def f_issn(spark: SparkSession, d: str) -> DataFrame:
    """ISSNs of the reference list in one writing with the outcome of their check."""
    r = table(spark, d, "ranking_entries")
    return r.select("venue_key", "issn_print", S.norm_issn(F.col("issn_print")).alias("issn_norm"), S.issn_is_valid(S.norm_issn(F.col("issn_print"))).alias("valid")).distinct()


def f_coercions(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, flags, years and ids out of mixed text forms."""
    e = table(spark, d, "scopus_entries")
    return e.select("entry_id", S.to_int(F.col("citedby_count")).alias("citations"), S.to_bool(F.col("openaccessflag")).alias("is_oa"), S.year_of(F.col("prism_coverdate")).cast("bigint").alias("pub_year"), S.scopus_id(F.col("dc_identifier")).alias("scopus_id"))


def f_rank_value(spark: SparkSession, d: str) -> DataFrame:
    """Rank values of mixed meaning as text and number."""
    r = table(spark, d, "ranking_entries")
    return r.select("venue_key", "source_id", F.col("rank_year").cast("bigint").alias("rank_year"), "rank_value", S.rank_number(F.col("rank_value")).alias("rank_number")).distinct()


def a1_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard, overlap at 10 and rank-biased overlap of every pair of platforms for every query."""
    lists = similarity.ranked_lists(_frame(spark, d), "query_id", "platform", "doi", ["rank", "record_id"])
    return _rounded(similarity.pairwise(lists, k=10))


def a1_overlap_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean similarity of every pair of platforms over all queries."""
    p = similarity.pairwise(similarity.ranked_lists(_frame(spark, d), "query_id", "platform", "doi", ["rank", "record_id"]), k=10)
    return _rounded(p.groupBy("source_a", "source_b").agg(F.count("*").alias("queries"), F.avg("jaccard").alias("jaccard"), F.avg("overlap_at_k").alias("overlap_at_k"), F.avg("rbo").alias("rbo")))


def a5_recency(spark: SparkSession, d: str) -> DataFrame:
    """Recency by platform and overall."""
    return _rounded(bias.recency(_frame(spark, d)))


def a6_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Share of records that have each field, by platform and overall."""
    return _rounded(bias.completeness(_frame(spark, d)))


def a7_language(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of languages by platform and overall."""
    return _rounded(bias.distribution(_frame(spark, d), F.col("language")))


def a10_publisher_hhi(spark: SparkSession, d: str) -> DataFrame:
    """Concentration of publishers by platform and overall."""
    return _rounded(bias.concentration(_frame(spark, d), F.lower("publisher")))


def a11_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of result rank and citations by platform."""
    return _rounded(bias.spearman(_frame(spark, d), "rank", "citations"))


def a14_citation_quality(spark: SparkSession, d: str) -> DataFrame:
    """Zero rates and quality label of the citation counts by platform."""
    return _rounded(bias.citation_quality(_frame(spark, d)))


def a27_years(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of years with open-access share, by platform and overall."""
    return _rounded(bias.by_scope(_frame(spark, d).where("year is not null"), F.count("*").alias("n"), F.avg(F.col("is_oa").cast("int")).alias("oa_share"), also=("year",)))


def a32_winsorized(spark: SparkSession, d: str) -> DataFrame:
    """Citations by platform before and after capping at the 99th percentile."""
    return _rounded(bias.winsorized(_frame(spark, d), "citations"))


def w1_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The deterministic order of every result list."""
    return bias.ranked(_frame(spark, d)).select("platform", "query_id", "record_id", F.col("pos").cast("bigint").alias("pos"))


def w3_oa_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Open-access share of the top of the lists against all, with gate and reliability."""
    return _rounded(bias.oa_top_k(_frame(spark, d)))


def w5_citations_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Median citations of the top of the lists against the rest."""
    return _rounded(bias.citations_top_k(_frame(spark, d)))


def w6_journals_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Diversity of journals in the top of the lists."""
    return _rounded(bias.journals_top_k(_frame(spark, d)))


def w7_language_shift(spark: SparkSession, d: str) -> DataFrame:
    """Jensen-Shannon divergence of the languages in the top of the lists from all."""
    return _rounded(bias.divergence_top_k(_frame(spark, d), F.col("language")))


def o7_membership(spark: SparkSession, d: str) -> DataFrame:
    """How many DOIs each combination of platforms shares."""
    return similarity.membership(_frame(spark, d), "doi", "platform", ["core", "openalex", "scopus", "semanticscholar"]).select(*[F.col(c).cast("bigint").alias(c) for c in ("core", "openalex", "scopus", "semanticscholar", "n")])


def j1_issn_index(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of the reference list that lead to one venue only."""
    return matching.key_index(table(spark, d, "ranking_entries"), "venue_key", ["issn_l", "issn_print", "issn_online"], S.norm_issn)


def j2_match_methods(spark: SparkSession, d: str) -> DataFrame:
    """How many Scopus entries match the reference list by each method of the cascade."""
    m = matching.match_venues(table(spark, d, "scopus_entries"), "entry_id", "prism_publicationname", ["prism_issn", "prism_eissn"], table(spark, d, "ranking_entries"), "venue_key", "title", ["issn_l", "issn_print", "issn_online"])
    return m.groupBy("method").agg(F.count("*").alias("n"), F.countDistinct("venue").alias("venues"))


def j2_match_exact(spark: SparkSession, d: str) -> DataFrame:
    """Venue of every Scopus entry by identifier, else by exact title."""
    m = matching.match_venues(table(spark, d, "scopus_entries"), "entry_id", "prism_publicationname", ["prism_issn", "prism_eissn"], table(spark, d, "ranking_entries"), "venue_key", "title", ["issn_l", "issn_print", "issn_online"])
    return m.where("method in ('issn', 'title')").select("row_id", "venue", "method")


def a34_model_summary(spark: SparkSession, d: str) -> DataFrame:
    """Calls, failures, latency and tokens of every model."""
    return _rounded(responses.model_summary(table(spark, d, "provider_responses")))


def a47_parse_robustness(spark: SparkSession, d: str) -> DataFrame:
    """How the answers to requests for JSON parse, by model."""
    asked = table(spark, d, "provider_responses").where("success and prompt_text like '%articles`%'")
    return responses.parsed(asked).groupBy("model", "parse_method").agg(F.count("*").alias("n"))


def o9_items(spark: SparkSession, d: str) -> DataFrame:
    """One row per article recommended in JSON."""
    return _rounded(responses.items(responses.parsed(table(spark, d, "provider_responses").where("success"))))


def a46_stability(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the articles recommended in repeats, by model and query."""
    rows = responses.items(responses.parsed(table(spark, d, "provider_responses").where("success")))
    return _rounded(responses.repeat_stability(rows.withColumn("title", S.norm_title(F.col("title"))), "title"))


def a45_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the articles that two models recommend, over their common queries."""
    rows = responses.items(responses.parsed(table(spark, d, "provider_responses").where("success")))
    return _rounded(responses.model_divergence(rows.withColumn("title", S.norm_title(F.col("title"))), "title"))


def c1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every search hit as one canonical row with provenance (lists as text)."""
    rows = canonical.canonical(table(spark, d, "search_records"))
    return _rounded(rows.withColumn("issn_list", F.array_join("issn_list", ";")))


def c2_missingness(spark: SparkSession, d: str) -> DataFrame:
    """Share of missing values by platform and canonical field."""
    rows = canonical.canonical(table(spark, d, "search_records"))
    fields = ["doi", "year", "language", "is_oa", "citations", "publisher", "journal_title", "issn"]
    return _rounded(rows.groupBy("platform").agg(*[(1 - F.count(f) / F.count("*")).alias(f) for f in fields]).unpivot("platform", fields, "field", "missing"))


def t2_events_daily(spark: SparkSession, d: str) -> DataFrame:
    """Events and their total value by day and type: the batch side of the windowed stream."""
    return _rounded(logs.per_window(table(spark, d, "events")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        f_identifiers, f_issn, f_coercions, f_rank_value, a1_pairwise, a1_overlap_mean, a5_recency, a6_completeness, a7_language, a10_publisher_hhi, a11_spearman, a14_citation_quality, a27_years, a32_winsorized,
        w1_ranked, w3_oa_top_k, w5_citations_top_k, w6_journals_top_k, w7_language_shift, o7_membership, j1_issn_index, j2_match_methods, j2_match_exact, a34_model_summary, a47_parse_robustness, o9_items, a46_stability, a45_divergence, c1_canonical, c2_missingness, t2_events_daily,
    )
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

_DOI = r"nullif(regexp_replace(regexp_extract(regexp_replace(lower(url_decode(replace({0},'+','%2B'))),'\s','','g'),'(10\.[0-9]{{4,9}}/[^\s\"<>]+)',1),'[ .;,)]+$',''),'')"
_TRIM = r"nullif(regexp_replace({0},'^\s+|\s+$','','g'),'')"
_COMPACT = r"lower(regexp_replace(nullif(regexp_replace({0},'^\s+|\s+$','','g'),''),'\s+',' ','g'))"
_ISSN0 = "regexp_replace(upper({0}),'[^0-9X]','','g')"
_ISSN1 = f"case when length({_ISSN0})=7 then '0'||{_ISSN0} else {_ISSN0} end"
_ISSN = f"case when regexp_matches({_ISSN1},'^[0-9]{{{{7}}}}[0-9X]$') then substr({_ISSN1},1,4)||'-'||substr({_ISSN1},5,4) end"
_TITLE = r"nullif(trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(lower({0}),'&',' and '),'\([^)]*\)',' ','g'),'_',' '),'[^\p{{L}}\p{{N}}\s]',' ','g'),'\s+',' ','g')),'')"
_J = "json_extract_string(extra,'{0}')"
_FRAME = (
    "frame as (select record_id, platform, query_id, result_rank as rank, " + _DOI.format("doi") + " as doi, " + _TRIM.format("title") + " as title, raw_id, "
    "case when pub_year between 1800 and 2025 then pub_year end as year, " + _COMPACT.format("lang_code") + " as language, is_oa, cited_by_count as citations, "
    "coalesce(" + ", ".join(_TRIM.format(_J.format(p)) for p in ("$.openalex.primary_location.source.publisher", "$.openalex.host_venue.publisher", "$.core.publisher")) + ") as publisher, "
    "coalesce(" + ", ".join(_TRIM.format(_J.format(p)) for p in ("$.openalex.primary_location.source.display_name", "$.openalex.host_venue.display_name", "$.semanticscholar.journal.name", "$.core.journal")) + ") as journal from search_records)"
)
_SCOPED = "scoped as (select 'overall' as scope, * from frame union all select platform as scope, * from frame)"
_LISTS = "lists as (select query_id as query, platform as source, doi, row_number() over (partition by query_id, platform order by min(rank) nulls first, arg_min_key) as pos from (select query_id, platform, doi, rank, min(struct_pack(r := coalesce(rank,-1), i := record_id)) over (partition by query_id, platform, doi) as arg_min_key from frame where doi is not null) group by query_id, platform, doi, arg_min_key)"
_PAIRS = f"""with {_FRAME}, {_LISTS},
sizes as (select query, source, count(*) as n from lists group by all),
pairs as (select a.query, a.source as source_a, b.source as source_b, a.n as n_a, b.n as n_b, least(a.n,b.n) as d from sizes a join sizes b on a.query=b.query and a.source<b.source),
common as (select a.query, a.source as source_a, b.source as source_b, greatest(a.pos,b.pos) as depth, (a.pos<=10 and b.pos<=10)::int as top from lists a join lists b on a.query=b.query and a.doi=b.doi and a.source<b.source),
depths as (select p.*, unnest(range(1,d+1)) as x from pairs p),
agree as (select p.query, p.source_a, p.source_b, p.n_a, p.n_b, p.d, p.x, count(c.depth) as o from depths p left join common c on c.query=p.query and c.source_a=p.source_a and c.source_b=p.source_b and c.depth<=p.x group by all),
rb as (select query, source_a, source_b, sum(0.1::double*o/x*pow(0.9::double,x-1)) + max(case when x=d then o::double/d*pow(0.9::double,d) end) as rbo from agree group by all),
tot as (select p.query, p.source_a, p.source_b, p.n_a, p.n_b, p.d, count(c.depth) as n_common, coalesce(sum(c.top),0) as n_top from pairs p left join common c on c.query=p.query and c.source_a=p.source_a and c.source_b=p.source_b group by all),
result as (select t.query, t.source_a, t.source_b, t.n_a, t.n_b, n_common, n_common::double/(n_a+n_b-n_common) as jaccard, n_top::double/least(d,10) as overlap_at_k, rbo from tot t join rb on rb.query=t.query and rb.source_a=t.source_a and rb.source_b=t.source_b)"""
_RANKED = "ranked as (select *, row_number() over (partition by platform, query_id order by rank, coalesce(doi,''), coalesce(title,''), coalesce(raw_id,''), record_id) as pos from frame where rank is not null), topk as (select r.*, k, pos<=k as top from ranked r, (values (10),(20),(50)) as ks(k))"
_INT = r"try_cast(trunc(try_cast(regexp_replace(regexp_replace({0},'^\s+|\s+$','','g'),',','','g') as double)) as bigint)"

_FLAG = "case when lower({0}) in ('1','true','yes','y','open') then true when lower({0}) in ('0','false','no','n','closed') then false end"
_LIST = "coalesce(case when json_type(extra,'{0}')='ARRAY' then from_json(json_extract(extra,'{0}'),'[\"VARCHAR\"]') end, []::varchar[])"
_FIRST = lambda *paths: "coalesce(" + ", ".join(_TRIM.format(_J.format(p)) for p in paths) + ")"
_LISTED = ("$.openalex.primary_location.source.issn", "$.openalex.host_venue.issn", "$.semanticscholar.publicationVenue.issn", "$.core.identifiers.issn", "$.core.identifiers.eissn")
_CANON = (
    "with raw as (select *, list_transform([" + _J.format('$.scopus.raw."prism:issn"') + ", " + _J.format('$.scopus.raw."prism:eIssn"') + "] || " + " || ".join(_LIST.format(p) for p in _LISTED) + " || [" + _J.format("$.semanticscholar.journal.issn") + "], lambda x: " + _ISSN.format("x") + ") as cands from search_records), "
    "one as (select *, list_filter(cands, lambda x, i: x is not null and list_position(cands, x)=i) as issns, "
    + _FLAG.format(_J.format("$.openalex.open_access.is_oa")) + " as oa1, " + _FLAG.format(_J.format("$.semanticscholar.isOpenAccess")) + " as oa2, "
    "coalesce(cited_by_count::bigint, " + ", ".join(_INT.format(_J.format(p)) for p in ("$.openalex.cited_by_count", "$.semanticscholar.citationCount", "$.core.citationCount", '$.scopus.raw."citedby-count"')) + ") as cites from raw), "
    "canon as (select record_id, coalesce(" + _TRIM.format("raw_id") + ", " + _DOI.format("doi") + ", " + _TRIM.format("url") + ", coalesce(" + _TRIM.format("title") + ",'record')||'#'||coalesce(result_rank::varchar,'na')) as id, "
    "coalesce(" + _COMPACT.format("platform") + ",'unknown') as platform, query_id, result_rank::bigint as rank, " + _TRIM.format("title") + " as title, "
    "coalesce(" + _DOI.format("doi") + ", case when regexp_matches(lower(url),'^https?://(dx\\.)?doi\\.org/') then " + _DOI.format("url") + " end) as doi, "
    "case when pub_year between 1800 and 2100 then pub_year::bigint end as year, " + _COMPACT.format("lang_code") + " as language, coalesce(is_oa, oa1, oa2) as is_oa, cites as citations, "
    + _FIRST("$.openalex.primary_location.source.publisher", "$.openalex.host_venue.publisher", "$.semanticscholar.journal.publisher", "$.core.publisher", "$.scopus.raw.publishername") + " as publisher, "
    + _FIRST("$.openalex.primary_location.source.display_name", "$.openalex.host_venue.display_name", "$.semanticscholar.journal.name", "$.core.journal", '$.scopus.raw."prism:publicationName"') + " as journal_title, issns, "
    "case when is_oa is not null then 'raw' when coalesce(oa1,oa2) is not null then 'payload' else 'missing' end as is_oa_provenance, case when cited_by_count is not null then 'raw' when cites is not null then 'payload' else 'missing' end as citations_provenance from one)"
)

ORACLES: dict[str, str] = {
    "f_identifiers": f"select record_id, {_DOI.format('doi')} as doi_norm, {_COMPACT.format('source')} as source_norm, {_COMPACT.format('lang_code')} as lang_norm from search_records",
    "f_issn": f"""with n as (select distinct venue_key, issn_print, {_ISSN.format('issn_print')} as issn_norm from ranking_entries), c as (select *, replace(issn_norm,'-','') as s from n)
select venue_key, issn_print, issn_norm, case when s is not null then ((11-(8*substr(s,1,1)::int+7*substr(s,2,1)::int+6*substr(s,3,1)::int+5*substr(s,4,1)::int+4*substr(s,5,1)::int+3*substr(s,6,1)::int+2*substr(s,7,1)::int)%11)%11) = case when substr(s,8,1)='X' then 10 else substr(s,8,1)::int end end as valid from c""",
    "f_coercions": rf"""select entry_id, {_INT.format('citedby_count')} as citations, case when lower(trim(openaccessflag)) in ('1','true','yes','y','open') then true when lower(trim(openaccessflag)) in ('0','false','no','n','closed') then false end as is_oa,
try_cast(nullif(regexp_extract(prism_coverdate,'(?:^|[^0-9])((?:1[89]|20|21)[0-9]{{2}})(?:[^0-9]|$)',1),'') as bigint) as pub_year, nullif(regexp_extract(dc_identifier,'^(?:SCOPUS_ID:)?([0-9]+)$',1),'') as scopus_id from scopus_entries""",
    "f_rank_value": r"""with t as (select distinct venue_key, source_id, rank_year::bigint as rank_year, rank_value, nullif(upper(regexp_replace(rank_value,'^\s+|\s+$','','g')),'') as t from ranking_entries)
select venue_key, source_id, rank_year, rank_value, case t when 'A*' then 4.0::double when 'A' then 3 when 'B' then 2 when 'C' then 1 when 'Q1' then 4 when 'Q2' then 3 when 'Q3' then 2 when 'Q4' then 1 else try_cast(replace(t,',','') as double) end as rank_number from t""",
    "a1_pairwise": _PAIRS + " select query, source_a, source_b, n_a, n_b, n_common, round(jaccard,9) as jaccard, round(overlap_at_k,9) as overlap_at_k, round(rbo,9) as rbo from result",
    "a1_overlap_mean": _PAIRS + " select source_a, source_b, count(*) as queries, round(avg(jaccard),9) as jaccard, round(avg(overlap_at_k),9) as overlap_at_k, round(avg(rbo),9) as rbo from result group by all",
    "a5_recency": f"with {_FRAME}, {_SCOPED} select scope, count(year) as n, round(median(year)::double,9) as median_year, round(median(2024-year)::double,9) as median_age, round(avg((2024-year<=2)::int),9) as share_2, round(avg((2024-year<=5)::int),9) as share_5, round(avg((2024-year<=10)::int),9) as share_10, round(avg((2024-year>10)::int),9) as share_old from scoped group by scope",
    "a6_completeness": f"with {_FRAME}, {_SCOPED}, s as (select scope, count(*) as n, " + ", ".join(f"round(count({f})::double/count(*),9) as {f}" for f in bias.FIELDS) + " from scoped group by scope) " + " union all ".join(f"select scope, n, '{f}' as field, {f} as value from s" for f in bias.FIELDS),
    "a7_language": f"with {_FRAME}, {_SCOPED} select scope, language as label, count(*) as n, round(count(*)::double/sum(count(*)) over (partition by scope),9) as share from scoped where language is not null group by scope, language",
    "a10_publisher_hhi": f"with {_FRAME}, {_SCOPED}, c as (select scope, lower(publisher) as label, count(*) as n, count(*)::double/sum(count(*)) over (partition by scope) as share from scoped where publisher is not null group by scope, lower(publisher)) select scope, round(sum(share*share),9) as hhi, count(*) as labels, round(max(share),9) as top_share, sum(n)::bigint as n from c group by scope",
    "a11_spearman": f"with {_FRAME}, u as (select platform, rank() over (partition by platform order by rank) + (count(*) over (partition by platform, rank)-1)/2.0::double as rx, rank() over (partition by platform order by citations) + (count(*) over (partition by platform, citations)-1)/2.0::double as ry from frame where rank is not null and citations is not null) select platform, count(*) as n, round(covar_pop(rx,ry)/nullif(stddev_pop(rx)*stddev_pop(ry),0),9) as rho from u group by platform",
    "a14_citation_quality": f"with {_FRAME}, q as (select platform, count(*) as n, count(citations) as known, avg((citations=0)::int) as zero_rate, count(*) filter (where year<=2021 and citations=0)::double/count(*) as old_zero_rate from frame group by platform) select platform, n, known, round(zero_rate,9) as zero_rate, round(old_zero_rate,9) as old_zero_rate, case when known=0 then 'missing' when zero_rate>=0.85 and old_zero_rate>0.3 then 'suspicious' else 'ok' end as quality from q",
    "a27_years": f"with {_FRAME}, {_SCOPED} select scope, year::bigint as year, count(*) as n, round(avg(is_oa::int),9) as oa_share from scoped where year is not null group by scope, year",
    "a32_winsorized": f"with {_FRAME}, c as (select platform, quantile_cont(citations::double,0.99) as cap from frame group by platform) select f.platform, round(max(cap),9) as cap, round(avg(citations),9) as mean, round(avg(least(citations::double,cap)),9) as mean_capped, count(*) filter (where citations>cap) as n_capped from frame f join c on c.platform=f.platform where citations is not null group by f.platform",
    "w1_ranked": f"with {_FRAME}, {_RANKED} select platform, query_id, record_id, pos from ranked",
    "w3_oa_top_k": f"""with {_FRAME}, {_RANKED}, r as (select platform, k, count(*) filter (where top) as n_top, count(*) filter (where top and is_oa is not null) as available, avg(case when top then is_oa::int end) as top_share, avg(is_oa::int) as overall_share from topk group by platform, k)
select platform, k::bigint as k, n_top, available, round(top_share,9) as top_share, round(overall_share,9) as overall_share, round(case when available >= least(n_top, greatest(10, ceil(greatest(k,1)*0.3))) then top_share-overall_share end,9) as delta,
case when available >= greatest(30, ceil(n_top*0.6)) and 1-available::double/n_top <= 0.2 then 'high' when available >= greatest(10, ceil(n_top*0.3)) and 1-available::double/n_top <= 0.5 then 'medium' else 'low' end as reliability from r""",
    "w5_citations_top_k": f"with {_FRAME}, {_RANKED}, r as (select platform, k::bigint as k, median(case when top then citations end)::double as median_top, median(case when not top then citations end)::double as median_rest, count(*) filter (where top and citations is not null) as n_top, count(*) filter (where not top and citations is not null) as n_rest from topk group by platform, k) select *, median_top-median_rest as delta from r",
    "w6_journals_top_k": f"with {_FRAME}, {_RANKED} select platform, k::bigint as k, count(*) as n_top, count(distinct lower(journal)) as journals, round(count(distinct lower(journal))::double/count(*),9) as diversity from topk where top group by platform, k",
    "w7_language_shift": f"""with {_FRAME}, {_RANKED}, c as (select platform, k, language, count(*) filter (where top) as a, count(*) as b from topk where language is not null group by platform, k, language), s as (select platform, k, a::double/sum(a) over (partition by platform, k) as p, b::double/sum(b) over (partition by platform, k) as q from c)
select platform, k::bigint as k, round(sum(case when p>0 then p*log2(p/((p+q)/2)) else 0 end)/2 + sum(case when q>0 then q*log2(q/((p+q)/2)) else 0 end)/2,9) as js from s group by platform, k""",
    "o7_membership": f"with {_FRAME}, m as (select doi, " + ", ".join(f"max((platform='{p}')::int) as {p}" for p in ("core", "openalex", "scopus", "semanticscholar")) + " from frame where doi is not null group by doi) select core::bigint as core, openalex::bigint as openalex, scopus::bigint as scopus, semanticscholar::bigint as semanticscholar, count(*) as n from m group by all",
    "j1_issn_index": f"with k as (select venue_key as venue, unnest([{_ISSN.format('issn_l')}, {_ISSN.format('issn_print')}, {_ISSN.format('issn_online')}]) as key from ranking_entries) select key, min(venue) as venue from k where key is not null group by key having count(distinct venue)=1",
    "c1_canonical": _CANON + " select record_id, id, platform, query_id, rank, title, doi, year, language, is_oa, citations, publisher, journal_title, array_to_string(issns,';') as issn_list, issns[1] as issn, issns[2] as eissn, is_oa_provenance, citations_provenance from canon",
    "c2_missingness": _CANON + " " + " union all ".join(f"select platform, '{f}' as field, round(1-count({f})::double/count(*),9) as missing from (select *, issns[1] as issn from canon) group by platform" for f in ("doi", "year", "language", "is_oa", "citations", "publisher", "journal_title", "issn")),
    "t2_events_daily": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value),9) as total from events group by all",
    "j2_match_exact": f"""with k as (select venue_key as venue, unnest([{_ISSN.format('issn_l')}, {_ISSN.format('issn_print')}, {_ISSN.format('issn_online')}]) as key from ranking_entries), ik as (select key, min(venue) as venue from k where key is not null group by key having count(distinct venue)=1),
tk as (select {_TITLE.format('title')} as key, min(venue_key) as venue from ranking_entries where {_TITLE.format('title')} is not null group by 1 having count(distinct venue_key)=1),
e as (select entry_id, {_TITLE.format('prism_publicationname')} as t, {_ISSN.format('prism_issn')} as i1, {_ISSN.format('prism_eissn')} as i2 from scopus_entries)
select entry_id as row_id, coalesce(a.venue, b.venue, tk.venue) as venue, case when coalesce(a.venue, b.venue) is not null then 'issn' else 'title' end as method from e left join ik a on a.key=i1 left join ik b on b.key=i2 left join tk on tk.key=t where coalesce(a.venue, b.venue, tk.venue) is not null""",
    "a34_model_summary": "select model, count(*) as calls, round(avg((not success)::int),9) as failure_rate, round(avg(latency_ms),9) as mean_latency, round(median(latency_ms)::double,9) as median_latency, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, count(distinct query_id) as queries from provider_responses group by model",
}
