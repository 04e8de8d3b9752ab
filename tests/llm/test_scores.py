"""Language-model scores, whitening and importance resampling against brute force, and cases at the edge."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import EDGES, LONG, frame
from tidemark.llm import importance, log_bilinear, whitening
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = "".join(map(chr, [0x20, *range(9, 14)]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def tokens(text):
    return text.encode().lower().split() + [b""] if text else [b""]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base_of(rows):
    """n_tokens, n_known, train_tokens and base score of each (id, text), in plain loops."""
    seen = Counter()
    for i, t in rows:
        if not is_held(i):
            seen.update(tokens(t))
    n, v = sum(seen.values()), len(seen)
    return [(i, len(w := tokens(t)), sum(seen[x] > 0 for x in w), n, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows]


def close(found, wanted):
    found, wanted = sorted(found, key=str), sorted(wanted, key=str)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("most", [1 << 18, 300])
def test_base_scores(docs, most):
    """With all words sent to the tasks, and with most of them joined."""
    got = log_bilinear.scored(docs, own=100, most=most).collect()
    close([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], base_of([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert all(r["held_out"] == is_held(r["doc_id"]) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_by_definition(spark, docs):
    """Scores equal products of class and word probabilities taken one by one, which add up to one."""
    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    learned = given.filter(~log_bilinear.held_out(F.col("doc_id"))).withColumn("share", F.col("doc_id") % 16)
    counts = log_bilinear.counted(learned)
    words = log_bilinear.known(counts, own=50, rare=16, most=300)
    model = log_bilinear.trained(learned, words)
    all_counts = {bytes(r["word"]): r["n"] for r in counts.collect()}
    assert words.tokens == sum(all_counts.values()) and words.distinct == len(all_counts) and len(words.words) <= 301
    own = {w: i for i, w in enumerate(words.words[: words.own])}
    assert own[b""] == 0 and min(all_counts[w] for w in own if w) >= max(n for w, n in all_counts.items() if w not in own)
    totals = np.ones(16)
    for w, n in all_counts.items():
        if w not in own:
            totals[zlib.crc32(w[-2:]) % 16] += n + 1
    assert totals.tolist() == words.totals.tolist()
    p = {k: v.astype(np.float64) for k, v in model.parts.items()}

    def log10_of(word, second, first):
        s = p["out"] @ (p["first"][first] + p["second"][second]) + p["bias"]
        probabilities = np.exp(s) / np.exp(s).sum()
        if word in own:
            return math.log10(probabilities[own[word]]), own[word]
        k = zlib.crc32(word[-2:]) % 16
        return math.log10(probabilities[words.own + k] * (all_counts.get(word, 0) + 1) / totals[k]), words.own + k

    def score_of(text):
        total, second, first = 0.0, words.classes, words.classes
        for w in tokens(text):
            x, k = log10_of(w, second, first)
            total, second, first = total + x, first, k
        return total

    got = {r["doc_id"]: r["score"] for r in log_bilinear.score(given, counts, words, model).collect()}
    for r in docs.filter("doc_id % 9 = 0").collect():
        assert got[r["doc_id"]] == pytest.approx(score_of(r["text"]), rel=1e-5)
    unknown = [b"unknown" + bytes([i, j]) for i in range(97, 123) for j in range(97, 123)]
    everything = [*all_counts, *(next(w for w in unknown if w not in all_counts and zlib.crc32(w[-2:]) % 16 == k) for k in range(16))]
    assert sum(10 ** log10_of(w, 3, 7)[0] for w in everything) == pytest.approx(1, abs=1e-9)


def test_score_edges(spark):
    rows = [(i, t, lang) for i, t, lang in EDGES] + [(7, "x" * 5000 + " " + "y" * 5000, "en"), (8, None, None)]
    got = log_bilinear.scored(frame(spark, rows), own=5, most=3).collect()
    close([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], base_of([(i, t) for i, t, _ in rows]))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert log_bilinear.scored(frame(spark, [])).count() == 0
    held = next(i for i in range(100) if is_held(i))
    (only,) = log_bilinear.scored(frame(spark, [(held, "nothing to learn from", "en")])).collect()
    assert only["base_score"] == 0 and only["n_known"] == 0 and only["train_tokens"] == 0 and math.isfinite(only["score"])


def test_model_learns_what_follows():
    """On text where a class is mostly told by the one before, the trained model is far better than frequencies."""
    rng = np.random.default_rng(5)
    seen = [0, 1]
    for _ in range(60_000):
        seen.append((3 * seen[-1] + 1) % 7 if rng.random() < 0.8 else int(rng.integers(7)))
    seen = np.array(seen)
    sizes = np.bincount(seen, minlength=7) + 1.0
    model, log_noise = log_bilinear.Model.starting(sizes, 16), np.log(sizes / sizes.sum()).astype(np.float32)
    for k in range(2, 50_000, 256):
        i = np.arange(k, k + 256)
        model.learn(seen[i - 2], seen[i - 1], seen[i], rng.choice(7, 32, p=sizes / sizes.sum()), log_noise)
    one, two, norm = model.normalised()
    i = np.arange(50_300, 60_000)
    mean = (one[seen[i - 1], seen[i]] + two[seen[i - 2], seen[i]] - norm[seen[i - 1], seen[i - 2]]).mean()
    assert mean > log_noise[seen[i]].mean() + 0.5
    every = np.exp(one[:, None] + two[None] - norm[:, :, None]).sum(2)
    assert np.allclose(every, 1, atol=1e-4)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, x string, component int")


def white(rows, components=4):
    """Rows by plain numpy: n, deviations, and what is whitened but for the sign."""
    good = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    lengths = Counter(len(v) for _, v in good)
    length = max(lengths, key=lambda k: (lengths[k], k), default=0)
    xs = [(i, tuple(math.floor(256 * float(np.float32(e))) for e in v)) for i, v in good if len(v) == length]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    k = [j for j in range(length - 1, -1, -1) if values[j] > 1e-12 * values[-1]][:components]
    out = {}
    for i, x in xs:
        w = (np.array(x) - np.array(sums) / n) @ basis[:, k] / np.sqrt(values[k])
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), np.abs(w), values[k] / values.sum()))
    return out


def assert_white(found, wanted):
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], []).append(r)
    assert set(got) == set(wanted)
    for i, own in wanted.items():
        assert len(got[i]) == sum(len(w) for _, _, w, _ in own)
        for n, deviation, w, share in own:
            for c in range(len(w)):
                assert any(r["component"] == c + 1 and r["n"] == n and r["deviation"] == deviation and abs(abs(r["whitened"]) - w[c]) < 1e-8 and abs(r["explained"] - share[c]) < 1e-9 for r in got[i])
    assert all(r["identity_error"] < 1e-6 for r in found)  # 1e-16 times the quotient of the largest and the smallest eigenvalue


def test_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert_white(QUERIES["op12_feast_whitening"](spark, SF).collect(), white([(r["vec_id"], r["embedding"]) for r in table.collect()]))


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    own = [(i, [float(x) for x in rng.standard_normal(3) * [9, 3, 1]]) for i in range(20)]
    rows = own + own[:5] + [(None, [1.0, 2.0, 3.0]), (30, None), (31, [1.0, None, 2.0]), (32, [1.0, float("nan"), 2.0]), (33, [float("inf"), 0.0, 0.0]), (34, []), (35, [1.0, 2.0]), (36, [4e4, -5.0, 0.0])]
    assert_white(whitening.whitened(vectors(spark, [(i, v, 1, 2, "x", 3) for i, v in rows])).collect(), white(rows))
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 0, 0, "", 0)] * 3)).count() == 0  # one different vector
    line = whitening.whitened(vectors(spark, [(i, [i * 1.0, i * 2.0, 0.0], 0, 0, "", 0) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)
    huge = whitening.whitened(vectors(spark, [(1, [3e38, 0.0], 0, 0, "", 0), (2, [1.0, 0.0], 0, 0, "", 0), (3, [0.0, 0.5], 0, 0, "", 0)])).collect()
    assert all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in huge)


@pytest.mark.parametrize("kind", ["plain", "one", "equal", "few", "identity", "zero"])
def test_contour_integration(kind):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((90, 30))
    q, _ = np.linalg.qr(a[:30])
    v = {"plain": a.T @ a, "one": np.outer(a[0], a[0]), "equal": q @ np.diag([5.0, *[3.0] * 9, *[1.0] * 20]) @ q.T, "few": a[:2].T @ a[:2], "identity": 2 * np.eye(30), "zero": np.zeros((30, 30))}[kind]
    values, u = whitening.leading((v + v.T) / 2, 4)
    wanted = np.linalg.eigvalsh(v)[::-1][:4]
    wanted = wanted[wanted > 1e-12 * wanted[0]] if wanted[0] else wanted[:0]
    assert np.allclose(values, wanted, rtol=1e-12) and np.abs(v @ u - values * u).max(initial=0) < 1e-12 * (1 + np.abs(v).max())
    assert np.abs(u.T @ u - np.eye(len(values))).max(initial=0) < 1e-13


LOWER = {i: i + 32 for i in range(65, 91)}


def runs(text):
    words, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127:
            word += c
        elif word:
            words.append(word)
            word = ""
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(rows, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(i, *runs(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in runs(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for i, n, fs in own:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_importance(spark, docs):
    got = QUERIES["op13_importance_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == resampled([(r["doc_id"], r["text"]) for r in docs.collect()], target)


def test_importance_edges(spark, monkeypatch):
    rows = [(i, t) for i, t, _ in EDGES] + [(20 + i, f"{'ab cd ' * 12}e{i % 3}") for i in range(40)] + [(9, "ÀÉ naïve—wörds " * 30), (10, "a"), (11, "a_b"), (None, LONG)]
    given = frame(spark, [(i, t, "en") for i, t in rows])
    monkeypatch.setattr(importance, "STEP", 1000)
    found = importance.importance(given, given, percent=30)
    assert sorted(map(tuple, found.drop("n_words").collect()), key=str) == resampled(rows, [t for _, t in rows], 30)
    assert importance.importance(frame(spark, []), given).count() == 0
    none = importance.importance(given, frame(spark, []), percent=100)
    assert sorted(map(tuple, none.drop("n_words").collect()), key=str) == resampled(rows, [], 100)


def test_coded_buckets():
    for found in ([], [0], [5, 5, 5], [0, 9999], list(range(0, 10_000, 3)), [300, 300, 9000]):
        given = np.array(found, np.uint32)
        assert importance.decoded(importance.coded(given), len(found)).tolist() == found
