"""Connectors on small landed files, and sinks that can be run twice."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.sources import connectors as C


def test_csv(spark, tmp_path):
    head = "observed_at,entity_name,signal_type,value,entity_type,unit,geo_scope,url,is_proxy,confidence,currency,status"
    rows = ["2024-01-01,A,import_growth,5.5,product,t,FR,,true,0.5,EUR,ok", "2024-01-02,A,import_growth,,,,,,,,,missing", "nonsense,A,import_growth,1,,,,,,,,", "2024-01-03,A,import_growth,many,,,,,,,,", "2024-01-03,,x,1,,,,,,,,", "2024-01-03,A,x,1,,,,,,,EURO,", "2024-01-03,A,x,1,,,,,,,,odd"]
    (tmp_path / "a.csv").write_text("\n".join([head, *rows]))
    good, bad = C.csv_observations(spark, str(tmp_path / "a.csv"))
    got = {r["published_at"].day: r for r in good.collect()}
    assert got[1]["metric_value"] == 5.5 and got[1]["is_proxy"] and got[1]["geo_scope"] == "FR" and got[2]["metric_value"] is None and got[2]["status"] == "missing"
    assert sorted(r["reason"] for r in bad.collect()) == ["bad currency", "bad date", "missing name or type", "unknown status", "value is not numeric"]


def test_json(spark):
    one = lambda key, body, **more: spark.createDataFrame([(key, json.dumps(body), *more.values())], ["key", "body", *more])
    macro = C.macro_series(one("GDP", {"observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-02-01", "value": "."}]}).withColumnRenamed("key", "series"), "macro_indicator")
    assert sorted((r["status"], r["metric_value"]) for r in macro.collect()) == [("missing", None), ("ok", 1.5)]
    flows = {"data": [{"period": "2023", "reporterCode": 1, "partnerCode": 2, "cmdCode": "69", "primaryValue": 10.0}, {"period": "202305", "reporterCode": 1, "partnerCode": 2, "cmdCode": "69", "primaryValue": 0.0}, {"period": "202306", "reporterCode": 1, "partnerCode": 2, "cmdCode": "69", "primaryValue": 4.0}]}
    got = C.trade_flows(one("x", flows, mirror=True)).collect()
    assert {(r["published_at"].date(), r["geo_scope"], r["confidence"]) for r in got} == {(dt.date(2023, 12, 31), "2", 0.75), (dt.date(2023, 6, 28), "2", 0.75)}
    filed = {"filings": {"recent": {"filingDate": ["2024-01-01", "2024-01-01", "2024-01-05"], "form": ["4", "4", "8-K"], "accessionNumber": ["a", "b", "c"]}}}
    assert sorted(r["metric_value"] for r in C.filings(one("c", filed).withColumnRenamed("key", "company")).collect()) == [1.0, 2.0]
    hits = {"hits": [{"objectID": str(i), "title": "t", "points": i, "created_at_i": 0, "story_text": "<p>a</p>"} for i in range(15)]}
    assert C.stories(one("k", hits).withColumnRenamed("key", "keyword")).count() == 10
    views = {"items": [{"timestamp": "2024010100", "views": 7}]}
    assert C.page_views(one("A", views).withColumnRenamed("key", "article")).first()["is_proxy"]
    repo = spark.createDataFrame([("a/b", dt.datetime(2024, 1, 1), 5, 2, 1)], ["full_name", "at", "stargazers_count", "forks_count", "open_issues_count"])
    assert {r["signal_type"]: r["metric_value"] for r in C.repository_levels(repo).collect()} == {"github_stars": 5.0, "github_forks": 2.0, "github_issue_velocity": 1.0}


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://x</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><description>&lt;b&gt;bold&lt;/b&gt; text</description></item></channel></rss>")
    r = C.feed(spark, str(tmp_path / "f.xml")).first()
    assert (r["title"], r["external_id"], r["content"], r["published_at"]) == ("A", "http://x", "bold text", dt.datetime(2024, 1, 1, 10))
    assert C.newer_than(C.feed(spark, str(tmp_path / "f.xml")), "2024-01-02").count() == 0


def test_sinks_twice(spark, tmp_path):
    rows = spark.range(10).select((F.col("id") % 5).alias("k"), F.lit("s").alias("source_id"))
    path = str(tmp_path / "t")
    assert [C.append_new(rows, path, ["source_id", "k"], ["source_id"]) for _ in range(2)] == [5, 0]
    old = spark.createDataFrame([("a", 1, 9.0), ("c", 3, 1.0)], "k string, seen int, score double")
    new = spark.createDataFrame([("a", 5, 4.0), ("b", 6, 2.0)], "k string, seen int, score double")
    assert sorted(map(tuple, C.upserted(old, new, "k", ["seen"], ["score"]).collect())) == [("a", 1, 9.0), ("b", 6, 2.0), ("c", 3, 1.0)]


def test_snapshots_children_and_streaks(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = lambda *x: spark.createDataFrame(x, "subject string, score double")
    C.append_snapshot(rows(("a", 1.0)), path, "2024-01-01")
    C.append_snapshot(rows(("a", 2.0)), path, "2024-01-02")
    C.append_snapshot(rows(("a", 2.0)), path, "2024-01-02")
    assert sorted((r["subject"], r["score"]) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("a", 2.0)]
    path = str(tmp_path / "children")
    child = lambda *x: spark.createDataFrame(x, "parent string, risk string")
    C.replace_children(child(*((f"p{i}", r) for i in range(9) for r in "xy")), path, "parent", buckets=2)
    C.replace_children(child(("p1", "z"), ("p9", "x")), path, "parent", buckets=2)
    got = sorted((r["parent"], r["risk"]) for r in spark.read.parquet(path).collect())
    assert got == sorted([("p1", "z"), ("p9", "x"), *((f"p{i}", r) for i in range(9) if i != 1 for r in "xy")])
    runs = [("a", k, k > 2) for k in range(9)] + [("b", k, False) for k in range(3)] + [("c", 0, False), ("c", 1, True)]
    found = C.failure_streaks(spark.createDataFrame(runs, "source_id string, started_at int, failed boolean"))
    assert {tuple(r) for r in found.collect()} == {("a", 6, "error"), ("b", 0, "ok"), ("c", 1, "failing")}


def test_run_accounts(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    runs = [(1, "a", at(1), at(1, 1), None, False), (2, "a", at(2), None, "down", False), *((k, "a", at(k), at(k), "down", False) for k in range(3, 7)), (7, "b", at(1), at(1), "half", False), (8, "b", at(2), at(2), None, True)]
    records = [(1, None, False, 1.0, "ok"), (1, None, None, None, "missing"), (1, None, False, None, None), (1, None, True, 2.0, "ok"), (1, "bad", True, 2.0, "ok"), (7, None, False, 1.0, "ok")]
    df = C.run_accounts(spark.createDataFrame(runs, "run_id int, source_id string, started_at timestamp, finished_at timestamp, error string, is_capped boolean"), spark.createDataFrame(records, "run_id int, reason string, is_duplicate boolean, metric_value double, status string"))
    got = {r["run_id"]: r for r in df.collect()}
    assert [got[1][k] for k in ("fetched", "rejected", "duplicate", "stored", "observations", "duration_ms", "run_status", "failures")] == [5, 1, 1, 3, 2, 60_000, "succeeded", 0]
    assert got[2]["duration_ms"] is None and [got[k]["failures"] for k in range(2, 7)] == [1, 2, 3, 4, 5] and [got[k]["source_status"] for k in (5, 6)] == ["active", "error"]
    assert got[7]["run_status"] == got[8]["run_status"] == "partial" and got[7]["failures"] == 0
