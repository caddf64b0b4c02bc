import datetime as dt
import json

from rankloom.operators.schema_drift import drift, entries, fused_union, typed_values

T0 = dt.datetime(2024, 1, 1)


def _df(spark, files):
    rows = [(f, "feed", n, payload, T0 + dt.timedelta(days=day), "x") for f, day, payloads in files for n, payload in enumerate(payloads)]
    return spark.createDataFrame(rows, "file_id long, feed string, line_no int, payload string, snapshot_at timestamp, path string")


def _wrap(e, wrapped=False):
    return json.dumps({"serial-metadata-response": {"entry": [e]}} if wrapped else {"entry": e})


def test_changes(spark):
    a = {"source-id": "1", "openaccess": "0", "old": "gone", "SJRList": {"SJR": [{"@year": "2020", "$": "1.5"}, {"@year": "2021", "$": "1.7"}]}}
    b = {"source-id": "1", "openaccess": False, "SJRList": [{"@year": "2020", "_text": 1.5}, {"@year": "2021", "_text": 1.7}], "fresh": 1}
    df = _df(spark, [(2, 0, [_wrap(a), _wrap(a)]), (1, 1, [_wrap(b, True), "broken{", None, ""]), (3, 2, ["broken"])])
    got = {(r.file_id, r.field_path, r.change_kind, r.new_path) for r in drift(df).collect()}
    assert (1, "entry.SJRList.SJR.@year", "renamed", "entry.SJRList.@year") in got
    assert (1, "entry.SJRList.SJR.$", "renamed", "entry.SJRList._text") in got
    assert (1, "entry.SJRList", "retyped", "") in got and (1, "entry", "retyped", "") in got and (1, "entry.openaccess", "retyped", "") in got
    assert (1, "entry.old", "removed", "") in got and (1, "entry.fresh", "added", "") in got
    assert (3, "entry.fresh", "removed", "") in got and not any(f == 2 for f, *_ in got)


def test_union_and_values(spark):
    e = {"source-id": 7, "dc:title": "T", "citeScoreYearInfoList": {"citeScoreYearInfo": [{"citeScoreCurrentMetric": "2,5", "citeScoreCurrentMetricYear": "2020", "citeScoreTracker": 3}]}, "SJRList": {"SJR": {"year": 2019, "sjrValue": None}}}
    df = _df(spark, [(1, 0, [_wrap(e)])])
    rows = {(r.metric, r.metric_year, r.value, r.type_tag) for r in typed_values(df).collect()}
    assert ("CiteScore", 2020, 2.5, "string") in rows and ("CiteScoreTracker", 2020, 3.0, "number") in rows and ("SJR", 2019, None, "null") in rows
    union = {(r.field_path, r.alternative) for r in fused_union(df).collect()}
    assert ("entry.source-id", "number") in union and ("entry.SJRList.SJR", "object") in union


def test_empty_and_odd(spark):
    df = _df(spark, [(1, 0, [])])
    assert drift(df).count() == 0 and typed_values(df).count() == 0
    assert entries(None) == [] and entries("[]") == [] and entries('{"a": {"entry": 1}}') == [1]
