"""The operators against brute force, round trips, held-out accuracy, and cases at the edge."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bag_minhash, bwt, byte_dedup, decontaminate, language_id, line_dedup, packing, quality, simple8b, token_counts, token_ids, transcripts

SF = "/root/testdata/sf0.001"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, kept boolean, v string, pos int"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, 0.5, True, "v", 1) for i, t, lang in rows], SCHEMA)


LONG = " ".join(f"word{i % 977} tail" for i in range(30_000))
LINE = "this line of many words is found in several of the documents"
EDGES = [(1, f"first words here\n{LINE}\n", "en"), (2, None, "en"), (3, "", None), (4, LONG, None), (1, f"first words here\n{LINE}\n", "en"), (None, f"{LINE}\nends differently", "fr"), (5, " \n\n\t ", "en"), (6, "ab\x00c 😀 é", "fr")]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_line_dedup_edges(edges, empty):
    found = line_dedup.dedup_lines(edges, min_chars=30)
    assert set(edges.columns) <= set(found.columns)
    got = sorted(((r["doc_id"], r["text"], r["__kept"]) for r in found.collect()), key=str)
    kept = {k: v for k, _, v in got}
    assert len(got) == len(EDGES) and kept[None] == EDGES[5][1]  # the null id ranks first
    assert kept[1] == "first words here\n" and kept[2] is None and kept[3] == "" and kept[5] == " \n\n\t " and kept[4] == LONG
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_inside_of_lines(spark):
    """A passage inside of other lines, in another layout, and one without spaces; single short sentences stay."""
    passage = "One sentence of it. Another sentence that is longer! And a third, is it? Yes."
    rows = [(1, f"{passage} Own words.", "en"), (2, f"Words before, {passage} Words behind it.", "en"), (3, f"Yes.\none SENTENCE of it.\n\nAnother  sentence that is longer!\nOwn.", "en"), (4, "中" * 60 + "\n", "zh"), (5, "x" + "\n" + "中" * 60, "zh")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows), min_chars=40).collect()}
    assert got[1]["__removed"] is None and got[1]["__kept"] == rows[0][1] and got[4]["__removed"] is None
    assert got[2]["__kept"] == "Words before, One sentence of it. Yes. Words behind it." and got[2]["__units"] == 2
    assert got[3]["__kept"] == "Yes.\nOwn." and got[3]["__units"] == 2
    assert got[5]["__kept"] == "x\n" and [tuple(x) for x in got[5]["__removed"]] == [(2, 62)]


def test_quality_edges(edges, empty):
    got = {r["doc_id"]: r for r in quality.judged(edges).collect()}
    assert got[2]["n_words"] == got[3]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[4]["n_words"] == 60_000 and got[6]["n_words"] == 3
    assert quality.judged(empty).count() == 0


def test_quality_tells_texts_apart(spark, docs, empty):
    """Word salad, and texts under another language's label, are kept by judged() and not by told_apart()."""
    r = random.Random(11)
    real = [(x["doc_id"], x["text"], x["lang"]) for x in docs.filter("n_chars > 600").collect()]
    salad = [(100_000 + i, " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(150)), "en") for i in range(10)]
    swapped = [(200_000 + i, t, "en") for i, (_, t, lang) in enumerate(real) if lang in ("de", "fr")][:10]
    unlabelled = [(300_000 + i, t, None) for i, (_, t, lang) in enumerate(real) if lang == "en"][:10]
    rows = frame(spark, real + salad + swapped + unlabelled)
    loose = {x["doc_id"]: x["kept"] for x in quality.judged(rows).collect()}
    got = {x["doc_id"]: x for x in quality.told_apart(rows).collect()}
    odd = [k for k, _, _ in salad + swapped]
    assert len(got) == len(loose) and sum(loose[k] for k in odd) >= 15
    assert not any(got[k]["kept"] for k in odd)
    assert sum(got[k]["kept"] for k, _, _ in real) >= 0.85 * sum(loose[k] for k, _, _ in real)
    assert all(got[k]["band_lang"] == "en" for k, _, _ in unlabelled)
    assert all(loose[k] or not x["kept"] for k, x in got.items())
    assert quality.told_apart(empty).count() == 0


def test_repeat_words_by_hand():
    r = random.Random(5)
    for _ in range(300):
        words = [r.choice("abc") for _ in range(r.randint(0, 40))] if r.random() < 0.5 else [r.choice("abcdefghij") for _ in range(r.randint(0, 60))]
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality.repeat_words(words) == len(hit)


def test_transcripts(spark):
    raw = transcripts.labelled(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    model = transcripts.fit(raw.filter(~language_id.held_out(F.col("conv_id"))))
    found = transcripts.parse(raw.filter(language_id.held_out(F.col("conv_id"))), model).join(raw.select("conv_id", "block", "states"), ["conv_id", "block"]).collect()
    right = sum(a == b for r in found for a, b in zip(r["found"], r["states"]))
    assert right / sum(len(r["states"]) for r in found) > 0.95
    odd = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 3, "odd", "b: c"), (None, 3, "user", "d")], "conv_id long, turn long, role string, text string")
    rows = transcripts.parse(transcripts.labelled(odd), model).collect()
    assert len(rows) == 3 and all(r["rendered"].endswith("<|end|>\n") for r in rows)
    assert transcripts.parse(transcripts.labelled(odd.limit(0)), model).count() == 0


def test_viterbi_by_enumeration():
    r = np.random.default_rng(8)
    log = lambda *shape: np.log(r.dirichlet(np.ones(shape[-1]), shape[:-1]))
    for n in (1, 2, 4):
        model = transcripts.Model(log(6), log(6, 6), [log(6, k) for k in transcripts.VALUES])
        seen = np.stack([r.integers(0, k, n) for k in transcripts.VALUES], 1)
        score = transcripts.scores(seen, model)
        value = lambda p: model.start[p[0]] + score[0, p[0]] + sum(model.step[a, b] + score[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))  # noqa: B023, E731
        assert tuple(transcripts.viterbi(seen, model)) == max(itertools.product(range(6), repeat=n), key=value)


def test_long_conversation_is_decoded_as_a_whole(spark, monkeypatch):
    """In blocks of four turns, and with many rows of one turn number, as in one piece."""
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    model = transcripts.fit(transcripts.labelled(conversations))
    r = random.Random(9)
    turns = [x["text"] for x in conversations.collect()]
    rows = [(7, k if k < 20 else 20, ("user", "assistant")[k % 2], r.choice(turns) + ("\n" if k % 5 == 0 else "")) for k in range(40)]
    monkeypatch.setattr(transcripts, "TURNS", 4)
    raw = transcripts.labelled(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    texts = {tuple(x["block"]): x["text"] for x in raw.collect()}
    found = {tuple(x["block"]): x["found"] for x in transcripts.parse(raw, model).collect()}
    order = sorted(texts)
    assert len(order) > 8 and found.keys() == texts.keys()
    whole = transcripts.viterbi(transcripts.features("\n".join(texts[k] for k in order).split("\n")), model)
    assert [s for k in order for s in found[k]] == whole.tolist()


def plainly(lines, states):
    """The turns of a whole transcript as (role, text), in a plain loop."""
    turns, role = [], None
    for line, state in zip(lines, states):
        if state % 2 or state // 2 != role:
            role = state // 2
            name = line.split(":")[0].strip("#>*[<|-]\t ") if ":" in line else ""
            known = name.lower() in transcripts.NAMES and re.fullmatch(r"[\s#>*\[<|\]-]*", line.split(":")[0].replace(name, ""))
            rest = line.split(":", 1)[1] if known else line
            turns.append([transcripts.ROLES[role], rest[1:] if known and rest[:1].isspace() else rest])
        else:
            turns[-1][1] += "\n" + line
    return turns


BODIES = ["see http://a.example/x for more", "Example: one of them", "plain words\n\nand a second part: with a colon", "Note: a\n  indented", "User experience: good", "q", "", "  https://b.example/?q=a:b", "System: not at all\nAnswer: neither"]


@pytest.mark.parametrize("turns", [3, 512])
def test_rendered_text_is_whole(spark, monkeypatch, turns):
    """Text of every turn as in a plain loop over the whole transcript, with addresses and words before colons; in blocks
    the texts of a conversation follow on from each other."""
    monkeypatch.setattr(transcripts, "TURNS", turns)
    r = random.Random(11)
    rows = [(c, k, ("system", "user", "assistant")[0 if not k else 1 + k % 2], r.choice(BODIES)) for c in range(12) for k in range(1 + 2 * c)]
    raw = transcripts.labelled(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    model = transcripts.fit(transcripts.labelled(spark.read.parquet(f"{SF}/conversations.parquet")))
    texts, found = defaultdict(dict), defaultdict(dict)
    for x in raw.collect():
        texts[x["conv_id"]][tuple(x["block"])] = x["text"]
    for x in transcripts.parse(raw, model).collect():
        found[x["conv_id"]][tuple(x["block"])] = x
    for c, blocks in texts.items():
        order = sorted(blocks)
        wanted = plainly("\n".join(blocks[k] for k in order).split("\n"), [s for k in order for s in found[c][k]["found"]])
        assert "".join(found[c][k]["rendered"] for k in order) == "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in wanted)
        assert "|".join(found[c][k]["roles"] for k in order if found[c][k]["roles"]) == "|".join(role for role, _ in wanted)
        assert sum(found[c][k]["n_turns"] for k in order) == len(wanted)


def test_only_speakers_names_are_stripped():
    lines = ["User: hi", "see http://a.example/x for more", "Example: kept", "### Assistant: yes", "User: inside of a turn"]
    roles, text = transcripts.render(lines, np.array([3, 2, 3, 5, 4]))
    assert roles == ["user", "user", "assistant"]
    assert text == "<|user|>\nhi\nsee http://a.example/x for more\n<|end|>\n<|user|>\nExample: kept\n<|end|>\n<|assistant|>\nyes\nUser: inside of a turn\n<|end|>\n"


def test_transcripts_of_an_unseen_style(spark):
    """Learned on three ways to mark speakers, held against a fourth whose names are in no table."""
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = transcripts.fit(transcripts.labelled(conversations, transcripts.STYLES[:3]))
    shares = []
    for names in (transcripts.STYLES[3:], (("Note", "Customer", "Agent"),)):
        raw = transcripts.labelled(conversations, names)
        found = transcripts.parse(raw, model).join(raw.select("conv_id", "block", "states"), ["conv_id", "block"]).collect()
        lines = [(a, b) for x in found for a, b in zip(x["found"], x["states"])]
        shares.append((sum(a == b for a, b in lines) / len(lines), sum(a % 2 == b % 2 for a, b in lines) / len(lines)))
    print("unseen style with known names, with unknown names: share of lines with the right state, right begin of turn", shares)
    assert shares[0][0] > 0.9 and shares[1][1] > 0.8


def test_decontamination_edges(spark, edges, empty):
    items = spark.createDataFrame([(1, "LINE of many words"), (2, LINE), (3, None), (4, "..."), (2, LINE)], "item_id long, text string")
    for small in (200_000, 1):  # broadcast, and shuffled
        rows = decontaminate.contamination(edges, items, small=small).collect()
        got = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(EDGES)
        assert got[1]["n_hit"] == 12 and got[1]["n_items"] == 2 and got[1]["items_sha256"] == hashlib.sha256(b"1,2").hexdigest()
        nameless = {r["doc_id"]: r for r in decontaminate.contamination(edges, spark.createDataFrame([(None, LINE), (7, LINE)], "item_id long, text string"), small=small).collect()}
        assert all(nameless[k]["n_hit"] == got[k]["n_hit"] and nameless[k]["n_items"] == (got[k]["n_hit"] > 0) for k in got)  # hits of an item with a null id
        assert got[None]["contaminated"] and not got[4]["contaminated"] and got[2]["n_words"] == 0 and got[4]["n_words"] == 60_000
    assert decontaminate.contamination(empty, items).count() == 0
    assert not decontaminate.contamination(edges, items.limit(0)).filter("contaminated").count()


def test_packing(edges, empty):
    rows = packing.packed(edges, capacities=(64, 128, 1024), shard_pieces=4).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["shard"], r["bin"], r["capacity"]].append((r["offset"], r["n_units"]))
    for (_, _, capacity), parts in bins.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        total = sum(n for _, n in parts)
        assert total <= capacity and capacity == min(c for c in (64, 128, 1024) if c >= total)
    assert sum(r["n_units"] for r in rows if r["doc_id"] == 4) == 60_001
    assert packing.packed(empty).count() == 0


def plain_fill(lengths, capacities, choose):
    """Best fit without any index."""
    bins, placed = [], []
    for k, n in enumerate(lengths):
        open_ = [(c - sum(held), i) for i, (c, held) in enumerate(bins) if c - sum(held) >= n]
        if open_:
            i = min(open_)[1]
        else:
            i = len(bins)
            bins.append((choose(k, n), []))
        placed.append((i, sum(bins[i][1])))
        bins[i][1].append(n)
    return placed, [min(c for c in capacities if c >= sum(held)) for _, held in bins]


def plain_pack(lengths, capacities, overhead):
    def outlook(k, c):
        used = lengths[k]
        for n in lengths[k + 1 :]:
            used += n if used + n <= c else 0
        return used

    def ahead(k, n):
        best = None
        for c in capacities:
            if c >= n:
                used = outlook(k, c)
                each = (min(x for x in capacities if x >= used) + overhead) / used
                best = (each, c) if best is None or (each, c) < best else best
        return best[1]

    plans = [plain_fill(lengths, capacities, ahead)]
    for size in capacities:
        plans.append(plain_fill(lengths, capacities, lambda _, n: min(c for c in capacities if c >= max(n, size))))
    return min(plans, key=lambda p: sum(p[1]) + overhead * len(p[1]))


def least_cost(lengths, capacities, overhead):
    """By trying every way to part the pieces."""
    best = [float("inf")]

    def go(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(min(c for c in capacities if c >= b) + overhead for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacities[-1]:
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def test_packing_against_plain_search():
    r, share = random.Random(6), []
    for _ in range(60):
        lengths = sorted((r.randint(1, 100) for _ in range(r.randint(1, 60))), reverse=True)
        assert packing.pack(lengths, (16, 40, 100), 4) == plain_pack(lengths, (16, 40, 100), 4)
    for _ in range(40):
        lengths = sorted((r.randint(1, 100) for _ in range(r.randint(1, 7))), reverse=True)
        share.append(packing.cost(packing.pack(lengths, (16, 40, 100), 4)[1], 4) / least_cost(lengths, (16, 40, 100), 4))
    assert min(share) >= 1 and sum(share) / len(share) < 1.03 and sum(x == 1 for x in share) > 25
    # two of 60 waste 40 each in bins of 100; a smaller capacity is opened where nothing is left to fill the greater
    assert sorted(packing.pack([60, 60], (64, 100), 1)[1]) == [64, 64]


def test_packing_of_the_table(docs):
    rows = packing.packed(docs, shard_pieces=100).collect()
    shards = defaultdict(list)
    for x in rows:
        shards[x["shard"]].append(x)
    lengths = {x["doc_id"]: len((x["text"] or "").split()) + 1 for x in docs.collect()}
    assert sum(x["n_units"] for x in rows) == sum(lengths.values()) and len(shards) > 1
    for own in shards.values():
        own.sort(key=lambda x: (-x["n_units"], x["doc_id"], x["piece"]))
        placed, sizes = plain_pack([x["n_units"] for x in own], packing.CAPACITIES, packing.OVERHEAD)
        assert [(x["bin"], x["offset"], x["capacity"]) for x in own] == [(b, o, sizes[b]) for b, o in placed]


def test_near_duplicates(docs, edges, empty):
    got = {r["doc_id"]: r["class_id"] for r in bag_minhash.classes(docs).collect()}
    texts = {r["doc_id"]: set(bag_minhash.as_set(bag_minhash.shingles(r["text"], 5)).tolist()) for r in docs.collect()}
    head = {k: k for k in texts}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in texts:
        for b in texts:
            common = len(texts[a] & texts[b])
            if a < b and common >= 0.8 * (len(texts[a]) + len(texts[b]) - common) - 1e-9:
                head[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in texts}
    rows = bag_minhash.classes(edges).collect()
    assert len(rows) == len(EDGES) and len({r["class_id"] for r in rows if r["doc_id"] == 1}) == 1
    assert bag_minhash.classes(empty).count() == 0


@pytest.mark.parametrize("direct", [bag_minhash.DIRECT, 0])
def test_near_duplicates_in_a_chain(spark, monkeypatch, direct):
    """A chain of texts: each is near its neighbours only; with 0, groups get pivots again and again."""
    monkeypatch.setattr(bag_minhash, "DIRECT", direct)
    r = random.Random(3)
    words, rows = [f"w{r.random()}" for _ in range(200)], []
    for i in range(40):
        rows.append((i, " ".join(words), "en"))
        for _ in range(3):
            words[r.randrange(200)] = f"x{r.random()}"
    got = {r["doc_id"]: r["class_id"] for r in bag_minhash.classes(frame(spark, rows)).collect()}
    sets = [set(bag_minhash.as_set(bag_minhash.shingles(t, 5)).tolist()) for _, t, _ in rows]
    head = list(range(40))
    for a in range(40):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = head[a], head[b]
                head = [min(x, y) if h in (x, y) else h for h in head]
    assert got == dict(enumerate(head))


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(3)
    for most in (2, 20):
        a = np.repeat(r.integers(0, 2**63, 40).astype(np.uint64), r.integers(1, most, 40))
        b = np.concatenate([a[r.random(len(a)) < 0.8], r.integers(0, 2**63, 5).astype(np.uint64)])
        x, y = Counter(a.tolist()), Counter(b.tolist())
        s = bag_minhash.signatures([a, b], 4096)
        assert abs((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.04


def test_language(spark, edges, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, PIECES)
    rows = language_id.predict(docs.filter(language_id.held_out(F.col("doc_id"))), model).collect()
    assert sum(r["lang"] == r["__language"]["lang_pred"] for r in rows) / len(rows) > 0.97
    got = {r["doc_id"]: r["__language"] for r in language_id.predict(edges, model).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and 0 < got[4]["score"] <= 1
    assert language_id.predict(empty, model).count() == 0 and language_id.fit(empty, PIECES).languages == []
    assert language_id.predict(edges, language_id.fit(empty, PIECES)).filter("__language.lang_pred != 'und'").count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    model = language_id.Model(["x"], pieces, np.full((7, 1), 0.1))

    def total(text):
        return 1.0 if not text else sum(0.1 * total(text[len(p) :]) for p in pieces if text.startswith(p))

    s = language_id.Scorer(model)
    for word in ("a", "ab", "abab", "babab"):
        assert np.isclose(np.exp(s.forward(word)[0]), total("▁" + word)) and np.isclose(s.forward_many([word])[0, 0], s.forward(word)[0])
    assert s.score(["a", "ab"]) == ("x", 1.0)


def test_token_counts(docs, edges, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, edges):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in df.collect())
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, PIECES).collect()) == want
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_token_ids(docs, edges, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    for df in (docs, edges):
        got = sorted(token_ids.read(token_ids.write(df, WORDS, 2)).collect(), key=lambda r: r["start"])
        start, order = 0, [r["doc_id"] for r in got]
        assert order == sorted(order, key=lambda x: (x is not None, x))
        want = Counter()
        for r in df.collect():
            ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        for r in got:
            assert r["start"] == start
            start += r["n_tokens"]
    assert token_ids.read(token_ids.write(empty, WORDS, 2)).count() == 0


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 119, 121, 1023, 1025, 5000):
        for top in (0, 1, 5, 17, 59, 60, 61, 64):
            v = r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, n).astype(np.uint64)
            v = v >> np.uint64(64 - top) if top else v * np.uint64(0)
            words, offsets = simple8b.encode(v)
            assert (simple8b.decode(words) == v).all()
            for b in range(len(offsets)):
                assert (simple8b.decode_block(words, offsets, b) == v[b * 1024 : (b + 1) * 1024]).all()


def test_bwt_repeats():
    r = random.Random(2)
    for _ in range(200):
        length = r.choice([2, 3, 5, 9, 17])
        texts = [bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 6))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [i <= len(t) - length and seen[t[i : i + length]] > 1 for t in texts for i in range(len(t) + 1)]
        assert bwt.repeats(texts, length).tolist() == want


def byte_oracle(rows, length=200):
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = Counter()
    for k, b in rows:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        edge = np.diff(np.concatenate(([0], covered.astype(int), [0])))
        out[k, len(b), int(covered.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~covered].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("most", [2048, 1])
def test_byte_dedup(docs, edges, empty, most):
    for df in (docs, edges):
        want = byte_oracle([(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()])
        assert Counter(tuple(r)[:5] for r in byte_dedup.dedup_bytes(df, most=most).collect()) == want
    assert byte_dedup.dedup_bytes(empty).count() == 0
