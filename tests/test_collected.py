"""Counts, documents and figures of landed bodies, by hand."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.sources import collected as C

DAY = dt.datetime(2024, 1, 10)


def raw(spark, schema, *rows):
    return spark.createDataFrame([tuple(json.dumps(x) if isinstance(x, (dict, list)) else x for x in r) for r in rows], schema)


def test_trade_metrics(spark):
    data = {"data": [{"period": "2023", "netWgt": 5.5, "primaryValue": 9}, {"period": 202402, "netWgt": 0, "primaryValue": 7.25}, {"period": "202313", "netWgt": 1, "primaryValue": 1}, {"period": None, "netWgt": 3}, {"period": "2022", "netWgt": None, "primaryValue": 0}]}
    schema = "body string, cmd_code string, metric string, mirror boolean, flow string, entity_name string, geo_scope string"
    rows = C.trade_metrics(raw(spark, schema, (data, "69", None, None, None, None, None), (data, "69", "primaryValue", True, "X", "tiles", "TN"), ("{", "1", None, None, None, None, None))).collect()
    got = sorted((r.entity_name, r.published_at.date(), r.metric_value, r.metric_unit, r.metric_currency or "", r.signal_type, r.geo_scope, r.confidence) for r in rows)
    assert got == [
        ("HS 69", dt.date(2023, 12, 31), 5.5, "kg", "", "import_growth", "global", 0.9), ("tiles", dt.date(2023, 12, 31), 9.0, "value", "USD", "export_growth", "TN", 0.75), ("tiles", dt.date(2024, 2, 28), 7.25, "value", "USD", "export_growth", "TN", 0.75),
    ]


def test_weekly_commits(spark):
    second = lambda days: int((DAY - dt.timedelta(days=days)).replace(tzinfo=dt.timezone.utc).timestamp())
    body = [{"week": second(d), "total": d} for d in (1, 7, 8, 14, 15)] + [{"week": second(3)}]
    schema = "full_name string, now timestamp, since timestamp, body string"
    rows = C.weekly_commits(raw(spark, schema, ("a/b", DAY, None, body), ("c/d", DAY, DAY - dt.timedelta(days=1), body), ("e/f", DAY, None, {})), weeks=2).collect()
    assert sorted((r.entity_name, r.metric_value) for r in rows) == [("a/b", 0.0), ("a/b", 1.0), ("a/b", 7.0), ("a/b", 8.0), ("a/b", 14.0), ("c/d", 0.0), ("c/d", 1.0), ("c/d", 7.0)]


def test_filings(spark):
    dates = ["2024-01-09", "2024-01-09", "bad", "2023-01-01"] + ["2024-01-02"] * 30
    body = {"filings": {"recent": {"filingDate": dates, "form": ["4", "8-K"], "accessionNumber": [f"n{i}" for i in range(34)]}}}
    given = raw(spark, "cik string, company string, cutoff timestamp, body string", ("7", "Co", dt.datetime(2023, 6, 1), body), ("8", "None", None, {}))
    assert sorted((r.published_at.day, r.metric_value) for r in C.filing_counts(given).collect()) == [(2, 30.0), (9, 2.0)]
    found = C.filing_documents(given).collect()
    assert len(found) == 23 and {r.title for r in found} == {"Co filed 4 on 2024-01-09", "Co filed 8-K on 2024-01-09", "Co filed ? on 2024-01-02"} and all(r.metric_value is None for r in found)


def test_concept_facts(spark):
    body = {"label": "Revenue", "units": {"USD": [{"end": "2023-12-31", "val": None}, {"end": "2023-12-31", "val": 5}, {"end": "2023-12-31", "val": 6}, {"end": "x", "val": 1}, {"end": "2019-12-31", "val": 2}], "EUR": [{"end": "2023-12-31", "val": 9}, {"end": "2022-12-31", "val": 4}]}}
    rows = C.concept_facts(raw(spark, "company string, cutoff timestamp, concept string, body string", ("Co", dt.datetime(2020, 1, 1), "Revenues", body), ("No", None, "Revenues", {}))).collect()
    assert sorted((r.published_at.year, r.metric_value, r.metric_unit) for r in rows) == [(2022, 4.0, "Revenue"), (2023, 5.0, "Revenue")]


def test_story_counts(spark):
    body = {"hits": [{"created_at_i": 86_400 * 3 + k} for k in (0, 5, 86_399, 86_400)] + [{"created_at_i": 0}, {"points": 3}]}
    rows = C.story_counts(raw(spark, "keyword string, body string", ("k", body), ("none", {"hits": []}))).collect()
    assert sorted((r.entity_name, r.published_at.date(), r.metric_value, r.is_proxy) for r in rows) == [("k", dt.date(1970, 1, 4), 3.0, True), ("k", dt.date(1970, 1, 5), 1.0, True)]


def test_feed_records(spark):
    items = [("f", "e", f"{k:03d}", "t", "l", "<b>x</b>" * 400, DAY - dt.timedelta(hours=k)) for k in range(80)] + [("f", "e", "none", "t", "l", None, None), ("g", "e", "g", "t", "l", None, DAY)]
    schema = "feed string, entity_name string, id string, title string, link string, summary string, published timestamp"
    rows = C.feed_records(spark.createDataFrame(items, schema), F.lit(DAY - dt.timedelta(hours=60)).cast("timestamp")).collect()
    counts = {r.published_at.day: r.metric_value for r in rows if r.metric_unit}
    shown = [r for r in rows if not r.metric_unit]
    assert counts == {10: 2.0, 9: 24.0, 8: 24.0, 7: 12.0}
    assert len(shown) == 51 and {r.external_id for r in shown if "|f|" in r.external_id} == {f"feed|f|{k:03d}" for k in range(50)} and max(len(r.content or "") for r in shown) <= 600
