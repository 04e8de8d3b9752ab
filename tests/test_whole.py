"""Queries and operators over whole tables: no rows left out, and no cut where a group is large."""

import datetime
import random
from collections import defaultdict

from tidemark.operators import dedup as D
from tidemark.operators import entities as E
from tidemark.operators import geography as G
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def newest(rates, base, quote, at):
    """The rate by brute force: the newest direct one, else the newest inverse one; the least of a moment."""
    if base == quote:
        return 1.0
    for b, q, turn in ((base, quote, lambda x: x), (quote, base, lambda x: 1 / x)):
        then = [(t, -r) for t, r in rates[b, q] if t <= at]
        if then:
            return turn(-max(then)[1])
    return None


def test_rate_as_of_by_hand(spark):
    r, start = random.Random(7), datetime.datetime(2020, 1, 1)
    moment = lambda: start + datetime.timedelta(hours=6 * r.randrange(80))
    given = [(*r.choice(["AB", "AB", "BA", "AC", "CD"]), moment(), 1.0 + r.randrange(50)) for _ in range(60)]
    needs = [(i, *r.choice(["AB", "BA", "CA", "DC", "AA", "AD"]), moment()) for i in range(300)]
    rates = defaultdict(list)
    for b, q, t, x in given:
        rates[b, q].append((t, x))
    got = G.rate_as_of(spark.createDataFrame(needs, "id int, base string, quote string, as_of timestamp"), spark.createDataFrame(given, "base string, quote string, as_of timestamp, rate double")).collect()
    assert {x["id"]: x["rate"] for x in got} == {i: newest(rates, b, q, t) for i, b, q, t in needs} and len(got) == 300


def test_fx_asof_all_lines(spark):
    orders = {x["o_orderkey"]: x for x in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    rates, want = defaultdict(list), defaultdict(list)
    for x in orders.values():
        rates[x["o_orderpriority"], x["o_orderstatus"]].append((x["o_orderdate"], x["o_totalprice"] / 1000))
    for x in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        o = orders[x["l_orderkey"]]
        pair = (o["o_orderpriority"], o["o_orderstatus"])
        value = newest(rates, *(pair if x["l_linenumber"] % 2 else pair[::-1]), x["l_shipdate"])
        want[x["l_orderkey"] * 10 + x["l_linenumber"]].append(value)
    got = defaultdict(list)
    for x in QUERIES["fx_asof_all"](spark, SF).collect():
        got[x["id"]].append(x["rate"])
    key = lambda v: (v is not None, v)
    assert got.keys() == want.keys()
    for k in want:
        assert len(got[k]) == len(want[k])
        assert all(a is b or abs(a - b) <= 1e-6 for a, b in zip(sorted(got[k], key=key), sorted(want[k], key=key)))


def test_spend_window_all_lines(spark):
    assert QUERIES["spend_window_all"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_topics_of_all_entities(spark, tmp_path):
    """Two names that are linked through a third one, whose id is no multiple of three; and a cluster too large."""
    names = ["red car", "red sun", "old sun", *(f"lone{i}" for i in range(20)), *(f"big w{i}" for i in range(4))]
    rows = [(3 + i if i != 1 else 100, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(x) for x in QUERIES["topic_clusters_all"](spark, str(tmp_path)).collect()}
    assert got == {("100", "100|3|5"), ("26", "26|27|28|29")}
    entities = spark.createDataFrame(rows, "id long, name string")
    found = E.topics(entities, ["the"], most_members=3)
    assert {tuple(x) for x in found.collect()} == {("100", "100|3|5")}


def test_story_labels_of_a_long_chain(spark):
    """Chains of 400, in order and shuffled, and stories that are alone: one label each."""
    order = list(range(400))
    random.Random(2).shuffle(order)
    edges = [(f"a{i:03}", f"a{i + 1:03}") for i in range(399)] + [(f"b{x:03}", f"b{y:03}") for x, y in zip(order, order[1:])]
    names = sorted({v for e in edges for v in e}) + ["c", "d"]
    got = D.story_labels(spark.createDataFrame([(v,) for v in names], "fingerprint string"), spark.createDataFrame(edges, "a string, b string")).collect()
    assert {x["fingerprint"]: x["story"] for x in got} == {v: f"{v[0]}000" if len(v) > 1 else v for v in names}


def test_injection_sweep_reports_base64(spark, tmp_path):
    rows = [(1, "s", "before " + "QUJD" * 120 + "== after"), (2, "s", "QUJD" * 99), (3, "t", "x" * 400 + " " + "y" * 401)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(x) for x in QUERIES["injection_sweep"](spark, str(tmp_path)).select("source", "label", "records", "matches").collect()}
    assert got == {("s", "long_base64", 1, 1), ("t", "long_base64", 1, 2)}
