import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rankloom.operators import canonical, responses
from rankloom.sources import files, search
from rankloom.streaming import logs


def pages(query, cursor):
    """Recorded pages: two of three items, one item of the first page again on the second."""
    at = int(cursor or 0)
    found = [{"id": n, "title": f"{query['query_text']} {n}", "doi": None} for n in range(at * 2, at * 2 + 3)]
    return found, None if at == 2 else str(at + 1)


def test_query_list(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,text,category\n1,"a ""b"", c",x\n1,"a ""b"", c",x\n,,\n2,only,\n', encoding="utf-8")
    rows = [tuple(r) for r in files.read_queries(spark, str(path)).collect()]
    assert rows == [("1", 'a "b", c', {"category": "x"})] * 2 + [("2", "only", {})]


def test_json_lines(spark, tmp_path):
    out = str(tmp_path / "rows")
    files.write_json_lines(spark.createDataFrame([(1, None), (2, "é")], "a int, b string"), out)
    back = files.read_json_lines(spark, out, "a int, b string")
    assert sorted(back.collect()) == [(1, None), (2, "é")] and files.read_json_lines(spark, out).where(F.try_variant_get("value", "$.a", "int") == 2).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_ranking_lists(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Title,Rank,ISSN\nJournal of A (Online),A*,12345679\n,B,\n", encoding="utf-8")
    row = files.read_ranking(spark, str(tmp_path / "r.csv"), {"title": "title", "rank_value": "rank", "issn_print": "issn"}).collect()
    assert [(r.venue_key, r.title_norm, r.rank_number) for r in row] == [("1234-5679", "journal of a", 4.0)]
    (tmp_path / "n.tsv").write_text("A Journal\tQ2\n", encoding="utf-8")
    assert files.read_ranking(spark, str(tmp_path / "n.tsv"), {"title": 0, "rank_value": 1}).first().rank_number == 3.0
    with pytest.raises(ValueError):
        files.read_ranking(spark, str(tmp_path / "n.tsv"), {"title": 0})


def test_xlsx(spark, tmp_path):
    path = tmp_path / "r.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Journal</t></si><si><t>Rank</t></si><si><t>A Journal</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>7.5</v></c></row></sheetData></worksheet>')
    assert [(r.title, r.rank_number) for r in files.read_ranking(spark, str(path), {"title": "journal", "rank_value": "rank"}).collect()] == [("A Journal", 7.5)]


def test_snapshot():
    assert files.latest_snapshot(["a/20240101T000000Z.json", "b/20230101T000000Z.json", "z.json"]) == "a/20240101T000000Z.json" and files.latest_snapshot([]) is None


def test_search_source(spark):
    spark.dataSource.register(search.SearchSource)
    queries = json.dumps([{"query_id": "Q1", "query_text": "x"}, {"query_id": "Q2", "query_text": "y"}])
    df = spark.read.format("search").option("platform", "openalex").option("queries", queries).option("transport", "tests.test_sources_and_streams.pages").option("k", 5).load()
    rows = df.orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.raw_id) for r in rows] == [(q, n + 1, str(n)) for q in ("Q1", "Q2") for n in range(5)]


def test_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=7 * n), f"e{n % 3}", float(n), n % 5) for n in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double, k int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = logs.per_window(stream).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("daily").collect()) == sorted(logs.per_window(df).collect())
    u = logs.without_repeats(stream, ["k"], "ts", "1000 days").writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    u.processAllAvailable()
    u.stop()
    assert spark.table("once").count() == logs.without_repeats(df, ["k"], "ts").count() == 5


def test_logs(spark):
    df = spark.createDataFrame([("p", n, n, 200 if n % 2 else 500) for n in range(30)], "platform string, ts int, pos int, status_code int")
    assert logs.last_requests(df, n=5).agg(F.min("ts")).first()[0] == 25
    h = logs.request_health(df).first()
    assert h.error_rate == 0.5 and h.last_error == 500


def test_canonical_rules(spark):
    extra = json.dumps({"openalex": {"host_venue": {"publisher": " ", "issn": ["12345679"]}, "primary_location": {"source": {"publisher": "ACM", "issn": ["1234-5679", "87654321"]}}, "cited_by_count": 0}})
    row = spark.createDataFrame([(1, "openalex", "q", 3, " T ", None, "https://doi.org/10.1234/A", None, 1700, "EN ", None, None, extra)], "record_id long, platform string, query_id string, result_rank int, title string, doi string, url string, raw_id string, pub_year int, lang_code string, cited_by_count int, is_oa boolean, extra string")
    r = canonical.canonical(row).first()
    assert (r.doi, r.year, r.language, r.citations, r.publisher, r.issn, r.eissn, r.citations_provenance) == ("10.1234/a", None, "en", 0, "ACM", "1234-5679", "8765-4321", "payload")
    assert canonical.canonical(row.withColumn("extra", F.lit("broken{"))).first().publisher is None
    filled = canonical.merge_missing(spark.createDataFrame([(1, "", "x")], "k int, a string, b string"), spark.createDataFrame([(1, "new", "y")], "k int, a string, b string"), "k", ["a", "b"])
    assert filled.first()[:] == (1, "new", "x")


def test_response_parsing(spark):
    texts = ['{"articles": [{"title": "A", "rank": 0, "year": "2020"}]}', '```json\n{"articles": []}\n```', 'Sure: {"articles": [{"title": "B"}]} done', "none", None]
    df = spark.createDataFrame([(i, "q", "m", 0, t) for i, t in enumerate(texts)], "resp_id long, query_id string, model string, repeat_index int, output_text string")
    p = responses.parsed(df)
    assert [r.parse_method for r in p.orderBy("resp_id").collect()] == ["strict", "fenced", "embedded", "failed", "failed"]
    assert [(r.title, r.rank, r.year) for r in responses.items(p).orderBy("resp_id").collect()] == [("A", 1, 2020), ("B", 1, None)]
    two = spark.createDataFrame([("m", "q", 0, "a"), ("m", "q", 0, "b"), ("m", "q", 1, "a"), ("n", "q", 0, "z")], "model string, query_id string, repeat_index int, item string")
    assert responses.repeat_stability(two, "item").first().mean_jaccard == 0.5 and responses.model_divergence(two, "item").first().mean_jaccard == 0.0
