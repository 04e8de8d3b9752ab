"""Pair joins against plain loops, with keys that hold nearly everything."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from tidemark.operators import dedup, entities, pairs


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_within_and_across(spark, most):
    rng = random.Random(1)
    rows = sorted({("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(60)) for _ in range(120)})
    df = spark.createDataFrame(rows, "k string, id long")
    got = sorted(tuple(r) for r in pairs.within(df, "k", "id", most=most).collect())
    assert got == sorted((a, b) for (j, a), (k, b) in itertools.product(rows, rows) if j == k and a < b)
    few = [("hot", 1000), ("hot", 3), ("k1", 7), ("none", 1)]
    got = sorted(tuple(r) for r in pairs.across(spark.createDataFrame(few, "k string, id long"), df, "k", "id", lambda x, y: x("id") != y("id") + 1, most).collect())
    assert got == sorted((a, b) for (j, a), (k, b) in itertools.product(few, rows) if j == k and a != b and a != b + 1)


def test_cells_are_bounded(spark):
    """A key of 5,000 rows: no cell of two blocks gets more than some twice as many rows as a block is to have."""
    df = spark.range(5000).selectExpr("'k' AS k", "id")
    dealt = pairs._dealt(df, pairs._blocks(df, "k", 100), "k", "id")
    sizes = [r["count"] for r in dealt.groupBy("__block").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 200


def similar(a, b):
    x, y = set(a.split()), set(b.split())
    if a.replace(" ", "") == b.replace(" ", ""):
        return 0.95
    if x == y:
        return 0.9
    return max(round(len(x & y) / len(x | y), 4), 0.6 if len(x & y) == min(len(x), len(y)) else 0.0)


@pytest.mark.parametrize("most", [2, 1000])
def test_look_alikes_with_a_hot_word(spark, most):
    """One word stands in nearly all names, and alone as a name of its own."""
    rng = random.Random(3)
    names = {"hot", "ho t", "hot hot"} | {" ".join(["hot"] * (rng.random() < 0.8) + [f"w{rng.randrange(25)}" for _ in range(rng.randrange(1, 5))]) for _ in range(120)}
    rows = [(i, n, "company" if i % 7 else "person") for i, n in enumerate(sorted(names))]
    found = entities.look_alikes(spark.createDataFrame(rows, "id long, name string, entity_type string"), top=10**6, most=most)
    got = {(r["a"], r["b"]): r["similarity"] for r in found.collect()}
    wanted = {(i, j): s for (i, a, s1), (j, b, s2) in itertools.product(rows, rows) if i != j and s1 == s2 and (s := similar(a, b)) >= 0.6}
    assert got == wanted and len(got) > 200


@pytest.mark.parametrize("least", [1, 2, 3])
def test_cooccurrence(spark, least):
    rng = random.Random(4)
    rows = [(f"r{r}", e) for r in range(12) for e in range(40) if r == 0 or rng.random() < 0.15] + [("r0", 1), (None, 2), ("r1", None)]
    got = {(r["a"], r["b"]): r["runs"] for r in entities.cooccurrence(spark.createDataFrame(rows, "run string, e long"), "run", "e", least, most=5).collect()}
    own = {e: {r for r, x in rows if x == e and r} for e in range(40)}
    wanted = {(a, b): n for a in own for b in own if a < b and (n := len(own[a] & own[b])) >= least}
    assert got == wanted


def test_one_run_with_very_many_entities(spark):
    """A run of 100,000 entities, which alone would give five billion pairs, forms none."""
    hot = spark.range(100_000).selectExpr("'all' AS run", "id AS e")
    few = spark.range(3000).selectExpr("explode(array(concat('a', cast(id % 100 as string)), concat('b', cast(id % 150 as string)), concat('c', cast(id % 300 as string)))) AS run", "id AS e")
    found = entities.cooccurrence(hot.union(few), "run", "e", 3)
    own = {e: {"all", f"a{e % 100}", f"b{e % 150}", f"c{e % 300}"} for e in range(3000)}
    wanted = sum(len(own[a] & own[b]) >= 3 for a in range(3000) for b in range(a % 50, a, 50))  # all others share less
    assert found.count() == wanted


def test_near_pairs_with_a_hot_token(spark):
    rng = random.Random(5)
    sets = sorted({tuple(sorted({"hot"} | {f"t{rng.randrange(30)}" for _ in range(rng.randrange(1, 9))})) for _ in range(150)})
    rows = [(f"f{i:03}", list(s)) for i, s in enumerate(sets)]
    got = {(r["a"], r["b"]): round(r["similarity"], 6) for r in dedup.near_pairs(spark.createDataFrame(rows, "fingerprint string, tokens array<string>"), most=4).collect()}
    wanted = {(f, g): round(len(set(s) & set(t)) / len(set(s) | set(t)), 6) for (f, s), (g, t) in itertools.combinations(rows, 2) if len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.7}
    assert got == wanted and got


def test_small_runs_are_counted_without_their_entities_runs(spark):
    """Where no run is large, what two entities share is counted where it is formed, and the runs of neither are joined to a pair."""
    rows = [(f"r{r}", e) for r in range(20) for e in (r % 3, 3, 4)]
    found = entities.cooccurrence(spark.createDataFrame(rows, "run string, e long"), "run", "e", 3)
    assert "LeftSemi" not in found._jdf.queryExecution().executedPlan().toString()
    assert (3, 4, 20) in [tuple(r) for r in found.collect()]


@pytest.mark.parametrize("small", [0, 3])
def test_runs_of_both_kinds(spark, monkeypatch, small):
    monkeypatch.setattr(entities, "SMALL", small)
    rng = random.Random(8)
    rows = [(f"r{r}", e) for r in range(14) for e in range(20) if r == 0 or rng.random() < (0.1 if r < 9 else 0.5)]
    got = {(r["a"], r["b"]): r["runs"] for r in entities.cooccurrence(spark.createDataFrame(rows, "run string, e long"), "run", "e", 3).collect()}
    own = {e: {r for r, x in rows if x == e} for e in range(20)}
    assert got == {(a, b): n for a in own for b in own if a < b and (n := len(own[a] & own[b])) >= 3}


def test_marks_tell_unlike_sets_apart(spark):
    """Marks differ in no more bits than sets do in tokens, and nearly all pairs that share one token alone differ in too many to be near."""
    rng = random.Random(9)
    sets = [sorted({"hot"} | {f"t{rng.randrange(3000)}" for _ in range(rng.randrange(2, 30))}) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>").select("id", *dedup.marks(F.col("tokens"))).collect()
    own, far = {r["id"]: r[1:] for r in rows}, []
    for (i, s), (j, t) in itertools.combinations(enumerate(sets), 2):
        bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(own[i], own[j]))
        assert bits <= len(set(s) ^ set(t))
        far.append(bits > 0.3 / 1.7 * (len(s) + len(t)))
    assert sum(far) > 0.99 * len(far)
    plan = dedup.near_pairs(spark.createDataFrame([(str(i), s) for i, s in enumerate(sets)], "fingerprint string, tokens array<string>"))._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan


def test_topics_send_nothing_whole_to_all_tasks(spark):
    """Sides that grow with the input aren't broadcast, however small they are here."""
    rows = spark.createDataFrame([(i, f"w{i // 2} v{i // 3}") for i in range(60)], "id long, name string")
    for found in (entities.topics(rows, []), entities.telling_words(rows, [])):
        found.collect()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
