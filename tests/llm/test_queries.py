"""Queries with SQL against DuckDB, and the pipeline's stages against what they promise."""

import duckdb
import pytest

import corpus_pipeline
from tests.test_oracle import rows
from tidemark.llm import bag_minhash
from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def near_heads(rows):
    """The least id of each class of near copies, by comparing all texts."""
    sets = {k: set(bag_minhash.as_set(bag_minhash.shingles(t, 5)).tolist()) for k, t in rows}
    head = {k: k for k in sets}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and (common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9) and head[a] != head[b]:
                low, high = sorted((head[a], head[b]))
                head = {k: low if h == high else h for k, h in head.items()}
    return set(head.values())


def test_pipeline(spark, tmp_path):
    """Every stage's rows against brute force or SQL over its own input."""
    docs, inputs = spark.read.parquet(f"{SF}/documents.parquet"), [f"{SF}/documents.parquet"]
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        inputs.append(str(tmp_path / str(k) / "*.parquet"))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
    con = duckdb.connect()
    read = lambda k, what: con.execute(f"SELECT {what} FROM '{inputs[k]}'").fetchall()
    ids = [{i for (i,) in read(k, "doc_id")} for k in range(5)]
    assert ids[1] == {i for i, t in read(0, "doc_id, text") if t and any(map(str.isalpha, t))}
    assert ids[2] == near_heads(read(1, "doc_id, text"))
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{inputs[2]}'")
    want = {(i, kept) for i, kept in con.execute(f"SELECT doc_id, kept FROM ({ORACLE['op1_line_dedup']})").fetchall() if kept.strip(" ")}
    assert set(read(3, "doc_id, text")) == want and all(n == len(t) for n, t in read(3, "n_chars, text"))
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{inputs[3]}'")
    assert ids[4] == {i for (i,) in con.execute(f"SELECT doc_id FROM ({ORACLE['op4_prefix_decontamination']}) WHERE NOT contaminated").fetchall()}
    packed = dict(con.execute(f"SELECT doc_id, sum(n_units) FROM '{inputs[5]}' GROUP BY doc_id").fetchall())
    assert packed == {i: len(t.split()) + 1 for i, t in read(4, "doc_id, text")}
    assert sorted(corpus_pipeline.run(spark, SF).columns) == sorted(docs.columns)


LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(20_000))
NEAR = " ".join(f"shared{i}" for i in range(60))
CASES = [(1, NEAR, "en"), (1, f"{NEAR} more", "en"), (2, None, None), (3, "", "en"), (4, LONG, None), (4, LONG, None), (None, "a text without any id", "en"), (5, "12 34 !", "en"), (6, "ten words that only this one text has for itself", "fr")]


def test_stages_at_the_edge(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, one id for two texts, clashing columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, v string, score double, class_id long, pos int, n long"
    rows = spark.createDataFrame([(i, t, lang, None, None, "v", 0.5, 7, 1, 2) for i, t, lang in CASES], schema)
    for name, given in (("rows", rows), ("none", rows.limit(0))):
        kept = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, given, SF).write.parquet(str(tmp_path / f"{name}{k}"))
            out = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert k == 4 or out.columns == rows.columns
            kept.append(sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) if k < 4 else out.count())
            if name == "rows" and k == 1:
                assert all(r["v"] == "v" and r["class_id"] == 7 and r["n_chars"] is None for r in out.collect())
        if name == "none":
            assert kept == [[], [], [], [], 0]
            continue
        texts = sorted([(i, t) for i, t, _ in CASES if t and any(map(str.isalpha, t))], key=str)
        assert kept[0] == []  or set(kept[0]) <= set(texts)  # nothing may be learned where no language is told apart
        for k in (1, 2, 3):  # each stage by itself, on all cases
            assert len(kept[k]) >= 5
        assert sum(i == 4 for i, _ in kept[1]) == 1 and sum(i == 1 for i, _ in kept[1]) == 1 and (None, "a text without any id") in kept[1]
        assert sum(i == 4 for i, _ in kept[2]) == 2 and len(kept[2]) == len(CASES) and len(kept[3]) == len(CASES)
        assert kept[4] == len(CASES) + 2 * (40_001 // 4096)
