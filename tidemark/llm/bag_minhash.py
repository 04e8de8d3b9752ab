"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its word shingles (`words` words; a shorter text is one shingle).
Weighted Jaccard similarity is the sum of the lesser counts over the sum of the greater.

BagMinHash. For each shingle the weight axis is cut into dyadic blocks, [0,1), [1,2), [2,4), ...
Each block has a Poisson process over time whose rate is its width times the number of slots m; its
points fall on a random slot and a random level inside the block. A text takes the points whose
level is below its count of the shingle, and every slot keeps the earliest. Equal winners have
the probability of the weighted Jaccard similarity, whatever the counts, and large counts cost no
more than a block for each power of two. Points come in the order of time, so a process ends
when it passes the latest slot of the text: about m ln m points a text besides one a shingle.

Bands of `rows` slots are hashed to buckets. At similarity s a pair misses all buckets with
probability (1 - s^rows)^bands: 0.010 at 0.8 and 0.0005 at 0.85 with 32 bands of 9; links that a
pair misses itself are mostly made through a third text.

Linking. Copies of one text are a single vertex throughout. A bucket's members are compared with
one of them, its pivot (the member that shares most buckets with others, so that buckets of the same
texts have the same pivot and are one group). Verified pairs form components. Members that are
then outside their pivot's component, and only they, have to be compared with the rest of the group,
and this is done without forming all pairs. With d(x) the symmetric difference of x and the
pivot, x and y have the symmetric difference |d(x)| + |d(y)| - 2 |d(x) & d(y)|, which a link bounds by
k (|x| + |y|), k = (1 - s) / (1 + s). So a link needs |d(x) & d(y)| >= (a(x) + a(y)) / 2 with
a(x) = |d(x)| - k |x|. A member apart from the pivot has a > k |pivot|, any has a >= -k |pivot|; hence
both share one of the first |d| - t + 1 elements of d in any order that is the same for the whole
group, t being the bound from what is known of the partner. The order is that of rarity in the
group, so that most members share none of them, and a pair also needs as many elements as are left
behind the first it shares. Members are regrouped by such elements; regroups with few pairs are compared outright, the others get a pivot of their own and go
round again. No pair of a bucket that could be a link is left out. All pairs are verified on the
exact multisets; pairs whose lengths rule a link out aren't looked at.

Defined results: a text without words, or null, is in a class with its equals only; rows with the
same text are in one class; the class is named by its least document id (null counts as least);
repeated rows each get a row; further columns are not returned by classes().
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, stored
from .components import components

BANDS, ROWS, WORDS, SIMILARITY = 32, 9, 5, 0.8
CHUNK = 150_000  # shingles that are worked on at once
DIRECT = 512  # pairs a member up to which a group is compared outright; eight times as many in each further round
COPIES = 4096  # members that share one copy of a pivot's multiset

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: 64 well-mixed bits of 64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, words: int) -> np.ndarray:
    """64-bit hashes of all shingles of the text, in order, with repeats."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), _U)
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    out = np.zeros(len(hashes) - n + 1, _U)
    for i in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out + _U(n))


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents' shingles: document, shingle, count; sorted."""
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.concatenate(docs) if docs else np.zeros(0, _U)
    order = np.lexsort((flat, doc))
    doc, flat = doc[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (flat[1:] != flat[:-1])
    first = np.flatnonzero(new)
    return doc[first], flat[first], np.diff(np.append(first, len(flat)))


def signatures(docs: list[np.ndarray], slots: int) -> np.ndarray:
    """documents x slots: for each slot a number that stands for the winning point. Shingles are
    taken CHUNK at a time, so that a very long text needs no more memory than many short ones."""
    owner, shingle, count = counted(docs)
    earliest = np.full(len(docs) * slots, np.inf)
    winner = np.zeros(len(docs) * slots, _U)
    for at in range(0, len(owner), CHUNK):
        _race(owner[at : at + CHUNK], shingle[at : at + CHUNK], count[at : at + CHUNK], slots, earliest, winner)
    return winner.reshape(-1, slots)


def _race(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, slots: int, earliest: np.ndarray, winner: np.ndarray) -> None:
    """Let the points of these shingles compete for the slots of their documents."""
    doc, seed, low, width, most = [], [], [], [], []
    block, bottom = 0, 0
    while len(owner):  # the blocks that begin below the count
        w = max(1, bottom)
        doc.append(owner)
        seed.append(mix(shingle + _U(block * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
        low.append(np.full(len(owner), bottom, float))
        width.append(np.full(len(owner), w, float))
        most.append(count)
        bottom, block = bottom + w, block + 1
        more = count > bottom
        owner, shingle, count = owner[more], shingle[more], count[more]
    doc, seed, low, width, most = map(np.concatenate, (doc, seed, low, width, most))
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        point = mix(seed + _U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        other = mix(point ^ _U(0xD1B54A32D192ED03))
        time = time - np.log(((point >> _U(11)).astype(float) + 0.5) / (1 << 53)) / (width * slots)
        taken = low + width * ((other >> _U(32)).astype(float) / (1 << 32)) < most
        at = doc * slots + ((other & _U(0xFFFFFFFF)) * _U(slots) >> _U(32)).astype(np.int64)
        better = np.flatnonzero(taken & (time < earliest[at]))
        better = better[np.argsort(-time[better], kind="stable")]  # of several for a slot the earliest is put last and stays
        earliest[at[better]], winner[at[better]] = time[better], point[better]
        latest = earliest.reshape(-1, slots).max(1)
        going = time < latest[doc]
        doc, seed, low, width, most, time = (x[going] for x in (doc, seed, low, width, most, time))


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=_U) + _U(1), parts.shape[:2])
    for i in range(parts.shape[2]):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out.view(np.int64)


def as_set(shingle: np.ndarray) -> np.ndarray:
    """The multiset as a set: the k-th occurrence of a shingle is an element of its own, so that
    set overlap is multiset overlap."""
    _, flat, count = counted([shingle])
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return mix(np.repeat(flat, count) + nth.astype(_U) * _U(0xA0761D6478BD642F)).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("v"), text.alias("text"))


def vertices(docs: DataFrame, bands: int, rows: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each different text: vid, v (digest), rep (least id), n (shingles), bands."""
    bounded_batches(docs.sparkSession, mb=4)

    def sign(batches):
        claim("bag_minhash")
        for b in batches:
            texts, sets, start, held = b.column("text").to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                sets.append(shingles(t, words))
                held += len(sets[-1])
                if held >= CHUNK or i + 1 == len(texts):
                    n = np.array([len(s) for s in sets])
                    hashes = band_hashes(signatures(sets, bands * rows), bands)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((n > 0) * bands)), pa.int32()), pa.array(hashes[n > 0].ravel()))
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(start, len(sets)) for k in ("doc_id", "v")), pa.array(n, pa.int64()), lists], names=["doc_id", "v", "n", "bands"])
                    sets, start, held = [], i + 1, 0

    rows_ = _texts(docs, id_col, text_col)
    signed = rows_.mapInArrow(sign, f"doc_id {rows_.schema['doc_id'].dataType.simpleString()}, v binary, n long, bands array<long>")
    distinct = signed.groupBy("v").agg(F.min(F.struct("doc_id")).getField("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    return stored(distinct.withColumn("vid", F.monotonically_increasing_id()), "minhash-vertices")


def element_sets(verts: DataFrame, wanted: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """vid, elements (the multiset as a sorted set) for the vertices in `wanted`, from a text of each."""

    def elements(batches):
        claim("bag_minhash")
        for b in batches:
            lists = [as_set(shingles(t, words)) for t in b.column("text").to_pylist()]
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("vid"), values], names=["vid", "elements"])

    needed = wanted.select("vid").distinct().join(verts.select("vid", "v", "rep"), "vid")
    texts = _texts(docs, id_col, text_col)
    found = texts.join(needed, (texts.v == needed.v) & texts.doc_id.eqNullSafe(needed.rep)).select("vid", "text").dropDuplicates(["vid"])
    return stored(found.mapInArrow(elements, "vid long, elements array<long>"), "minhash-sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """`pairs` (p, vid, copies, ...) with the multisets of both, left (of p) and right (of vid). A
    p with very many partners is copied `copies` times, and its partners are dealt over the copies."""
    copy = F.pmod(F.xxhash64("vid"), F.col("copies")).cast("int")
    wanted = pairs.groupBy("p").agg(F.max("copies").alias("most")).select("p", F.explode(F.sequence(F.lit(0), F.col("most").cast("int") - 1)).alias("copy"))
    left = wanted.join(sets.select(F.col("vid").alias("p"), F.col("elements").alias("left")), "p")
    right = sets.select("vid", F.col("elements").alias("right"))
    return pairs.withColumn("copy", copy).join(right, "vid").join(left, ["p", "copy"])


def _near(m: Column, n: Column, similarity: float) -> Column:
    return F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (p, vid, copies) whose multisets overlap enough, as a, b."""
    common = F.size(F.array_intersect("left", "right"))
    enough = common >= similarity * (F.size("left") + F.size("right") - common) - 1e-9
    return stored(_with_sets(pairs, sets).filter(enough).select(F.least("p", "vid").alias("a"), F.greatest("p", "vid").alias("b")), "minhash-links")


def around_pivots(members: DataFrame, used: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """members (g, vid, n) as p, pn, copies, vid, n: every member with the pivot of its group, groups with
    the same pivot together. A vertex is a pivot in one round only; as second table, members (g, vid, n) of
    groups of which all have been pivots."""
    sizes = members.groupBy("g").agg(F.count("*").alias("size"))
    weights = members.join(sizes, "g").groupBy("vid").agg(F.sum("size").alias("weight"))
    weights = weights.withColumn("fresh", F.lit(True)) if used is None else weights.join(used.withColumn("seen", F.lit(True)), "vid", "left").select("vid", "weight", F.col("seen").isNull().alias("fresh"))
    heads = members.join(weights, "vid").groupBy("g").agg(F.max(F.struct("fresh", "weight", F.xxhash64("vid"), "vid", "n")).alias("head"))
    rows = members.join(heads, "g")
    copies = (F.col("head.weight") / COPIES).cast("int") + 1
    stars = rows.filter("head.fresh").select(F.col("head.vid").alias("p"), F.col("head.n").alias("pn"), copies.alias("copies"), "vid", "n")
    return stored(stars.filter("vid != p").distinct(), "minhash-stars"), rows.filter("not head.fresh").select("g", "vid", "n")


def _labelled(rows: DataFrame, labels: DataFrame | None, of: str, name: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(name, F.col(of))
    found = labels.select(F.col("v").alias(of), F.col("label").alias(name))
    return rows.join(found, of, "left").withColumn(name, F.coalesce(name, of))


def regrouped(stars: DataFrame, sets: DataFrame, labels: DataFrame | None, similarity: float) -> DataFrame:
    """Of groups with members apart from their pivot: a row for each member and element of its
    difference from the pivot by which it may have to be compared: p, e, vid, n, label, apart, short."""
    marked = _labelled(_labelled(stars, labels, "vid", "label"), labels, "p", "main").withColumn("apart", F.col("label") != F.col("main"))
    open_ = marked.groupBy("p").agg(F.count("*").alias("size"), F.sum(F.col("apart").cast("int")).alias("away")).filter("away > 0 and size > 1").select("p")
    both = _with_sets(marked.join(open_, "p"), sets)
    k = (1 - similarity) / (1 + similarity)
    m, excess = F.size("d"), F.size("d") - k * F.col("n")
    first = lambda other: F.greatest(F.lit(0), F.least(m, m - F.ceil((excess + other) / 2 - 1e-9).cast("int") + 1))
    cut = both.select("p", "pn", "vid", "n", "label", "apart", F.concat(F.array_except("right", "left"), F.array_except("left", "right")).alias("d"))
    cut = stored(cut.select("p", "d", F.struct("vid", "n", "label", "apart", m.alias("m"), excess.alias("a"), first(k * F.col("pn")).alias("few"), first(-k * F.col("pn")).alias("many")).alias("x")), "minhash-differences")
    rows = cut.select("p", "x", F.explode("d").alias("e"))
    often = rows.groupBy("p", "e").agg(F.count("*").alias("f"))
    # of one text's elements, the rarest of the group first
    ranked = rows.join(often, ["p", "e"]).groupBy("p", "x").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("d"))
    needed = F.slice("d", F.lit(1), F.when(F.col("x.apart"), F.col("x.many")).otherwise(F.col("x.few")))
    placed = ranked.select("p", "x", F.posexplode(needed).alias("at", "d")).filter("d.f > 1")
    return stored(placed.select("p", "d.e", "x.vid", "x.n", "x.label", "x.apart", "x.a", (F.col("x.m") - F.col("at")).alias("left"), (F.col("at") < F.col("x.few")).alias("short")), "minhash-prefixes")


def link(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """v, label of vertices with links; members: g, vid, n of buckets with several vertices."""
    links = tried = used = labels = None
    for step in count():
        stars, rest = around_pivots(members, used)
        pivots = stars.select(F.col("p").alias("vid")).distinct()
        first = used is None
        used = pivots if first else used.union(pivots).distinct()
        told = _labelled(_labelled(stars, labels, "vid", "label"), labels, "p", "main").filter("label != main")
        pairs = told.filter(_near(F.col("n"), F.col("pn"), similarity)).select("p", "vid", "copies")

        def try_(pairs: DataFrame) -> None:
            nonlocal links, tried, labels
            ordered = pairs.withColumn("a", F.least("p", "vid")).withColumn("b", F.greatest("p", "vid")).dropDuplicates(["a", "b"])
            new = stored((ordered if tried is None else ordered.join(tried, ["a", "b"], "left_anti")).select("p", "vid", "copies", "a", "b"), "minhash-pairs")
            tried = new.select("a", "b") if tried is None else tried.union(new.select("a", "b"))
            found = verified(new.select("p", "vid", "copies"), sets, similarity)
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                labels = components(links)

        if not first:
            both = rest.join(rest.select("g", F.col("vid").alias("p"), F.col("n").alias("pn")), "g").filter("p < vid")
            pairs = pairs.union(both.filter(_near(F.col("n"), F.col("pn"), similarity)).select("p", "vid", F.lit(1).alias("copies")))
        try_(pairs)
        rows = regrouped(stars, sets, labels, similarity)
        away, short = F.col("apart").cast("int"), F.col("short").cast("int")
        groups = rows.groupBy("p", "e").agg(F.count("*").alias("size"), F.sum(away).alias("away"), F.sum(short).alias("short_"), F.min("label").alias("l1"), F.max("label").alias("l2"))
        few = F.col("away") * F.col("short_") <= DIRECT * 8**step * F.col("size")
        groups = stored(groups.filter("away > 0 and short_ > 0 and size > 1 and l1 != l2").select("p", "e", few.alias("few")), "minhash-regroups")
        some = rows.join(groups, ["p", "e"])
        x = some.filter("few and apart").select("p", "e", *[F.col(c).alias(f"{c}1") for c in ("vid", "n", "label", "short", "a", "left")])
        # from the first element that two have in common on, each must have as many as they need in common
        enough = F.least("left1", "left") >= (F.col("a1") + F.col("a")) / 2 - 1e-9
        open_ = (F.col("label1") != F.col("label")) & (F.col("short1") | F.col("short")) & _near(F.col("n1"), F.col("n"), similarity)
        meet = x.join(some.filter("few").drop("apart", "few"), ["p", "e"]).filter(open_ & enough)
        try_(meet.select(F.col("vid1").alias("p"), "vid", F.lit(1).alias("copies")))
        members = stored(some.filter("not few").select(F.xxhash64("p", "e").alias("g"), "vid", "n").distinct(), "minhash-members")
        if members.isEmpty():
            return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, v (digest of the text), class_id, head (the digest of the text of that id which stands
    for the class, for ids may repeat) for each row of `docs`."""
    verts = vertices(docs, bands, rows, words, id_col, text_col)
    member = verts.select(F.explode("bands").alias("g"), "vid", "n")
    several = member.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1").select("g")
    shared = stored(member.join(several, "g"), "minhash-members")
    labels = link(shared, element_sets(verts, shared, docs, words, id_col, text_col), similarity)
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "v long, label long")
    named = verts.select("v", "vid", "rep").join(labels.withColumnRenamed("v", "of"), F.col("vid") == F.col("of"))
    least = named.groupBy("label").agg(F.min(F.struct("rep", "v")).alias("least"))
    linked = stored(named.join(least, "label").select("v", "least"), "minhash-classes")
    own = F.struct("rep", "v")
    ids = verts.select("v", "rep").join(linked, "v", "left").select("v", F.coalesce("least", own).alias("least"))
    ids = stored(ids.select("v", F.col("least.rep").alias("class_id"), F.col("least.v").alias("head")), "minhash-names")
    return _texts(docs, id_col, text_col).select("doc_id", "v").join(ids, "v")
