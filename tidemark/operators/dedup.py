"""Records and stories: exact dedup, same-story groups, syndication, injection sweep, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.places import shared_folder
from . import pairs
from .pairs import large


def first_arrival(rows: DataFrame, keys: list[str], order: list[str], store: DataFrame | None = None) -> DataFrame:
    """The first row of each key by `order`, unless the store has the key already. The first is found by
    partial aggregates, so a key with very many rows brings one row per task."""
    lead = F.min_by(F.struct(*rows.columns), F.struct(*order))
    out = rows.groupBy(*keys).agg(lead.alias("__row")).select("__row.*")
    return out if store is None else out.join(store.select(*keys), keys, "left_anti")


def fingerprinted(headlines: DataFrame) -> DataFrame:
    """`headlines` (record_id, source_id, title) with tokens and fingerprint (null: too short)."""
    tokens = X.title_tokens(F.col("title"))
    return headlines.withColumn("tokens", F.array_sort(F.array_distinct(tokens))).withColumn("fingerprint", X.fingerprint(tokens))


#: Bits of a token set's mark, in longs of 64.
MARKS = 4


def marks(tokens: Column) -> list[Column]:
    """m0, m1 and so on: a bit for each token, by its hash. Two marks differ in no more bits than their sets do in tokens."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(64 * MARKS)))

    def mark(k: int) -> Column:
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
        own = F.filter(places, lambda at: F.floor(at / 64) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda m, at: m.bitwiseOR(bit(at)))

    return [mark(k).alias(f"m{k}") for k in range(MARKS)]


def near_pairs(stories: DataFrame, threshold: float = 0.7, most: int = pairs.MOST) -> DataFrame:
    """Pairs of stories (fingerprint, tokens) whose token sets overlap by `threshold` of Jaccard.

    Prefix filter: with tokens in order of rarity, two such sets share one of their first
    n - ceil(threshold n) + 1 tokens; only these are joined, in blocks, with lengths and places bounded. A token of a pair
    that is near is shared by two sets of which few tokens differ, so pairs whose marks differ in more bits are dropped where
    they are formed, and what leaves the join grows with the pairs that are near, not with those that share a token.
    These are ids; tokens are joined to them to verify the overlap."""
    tokens = stories.select("fingerprint", F.explode(F.array_distinct("tokens")).alias("token"))
    ranked = pairs.by_rarity(tokens, "token", "fingerprint")
    need = lambda n: F.ceil(n * F.lit(threshold) - 1e-9)
    prefix = ranked.filter(F.col("place") <= F.col("size") - need(F.col("size")) + 1).join(stories.select("fingerprint", *marks(F.array_distinct("tokens"))), "fingerprint")

    def fits(x, y):
        """As many tokens as needed can still be common, counted from this one on."""
        common = F.ceil((x("size") + y("size")) * F.lit(threshold / (1 + threshold)) - 1e-9)
        longest = F.least(x("size") - x("place"), y("size") - y("place")) + F.least(x("place"), y("place"))
        differ = sum((F.bit_count(x(f"m{k}").bitwiseXOR(y(f"m{k}"))) for k in range(MARKS)), F.lit(0))
        few = differ <= x("size") + y("size") - 2 * common
        return (F.least(x("size"), y("size")) >= F.greatest(x("size"), y("size")) * F.lit(threshold) - 1e-9) & (longest >= common) & few

    found = pairs.within(prefix, "token", "fingerprint", fits, most).distinct()
    own = lambda k: stories.select(F.col("fingerprint").alias(k), F.col("tokens").alias(f"{k}_tokens"))
    scored = found.join(own("a"), "a").join(own("b"), "b").select("a", "b", X.jaccard(F.col("a_tokens"), F.col("b_tokens")).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)


def story_labels(stories: DataFrame, pairs: DataFrame) -> DataFrame:
    """fingerprint, story: the least fingerprint of its component of near pairs.

    Every round takes, for all vertices of a label together, the least label among them and their
    neighbours, then the label of that label, so that paths halve; rounds end when no label changes."""
    shared_folder(stories.sparkSession)
    edges = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = stories.select(F.col("fingerprint").alias("v"), F.col("fingerprint").alias("story"))
    while True:
        near = edges.join(large(labels), F.col("b") == F.col("v")).groupBy("a").agg(F.min("story").alias("near"))
        least = labels.join(large(near), F.col("v") == F.col("a"), "left").select("v", "story", F.least("story", "near").alias("least"))
        own = least.groupBy("story").agg(F.min("least").alias("to"))
        over = labels.select(F.col("v").alias("of"), F.col("story").alias("further"))
        lead = own.join(large(over), F.col("to") == F.col("of")).select(F.col("story").alias("from"), F.least("to", "further").alias("new"))
        moved = labels.join(large(lead), F.col("story") == F.col("from")).select("v", "new", (F.col("new") != F.col("story")).alias("changed")).checkpoint()
        labels = moved.select("v", F.col("new").alias("story"))
        if moved.filter("changed").isEmpty():
            break
    return labels.withColumnRenamed("v", "fingerprint")


def duplication(records: DataFrame, key: str = "subject") -> DataFrame:
    """key, duplication_ratio: 1 - stories / records that have a story; 0 under two such records."""
    n, stories = F.count("story"), F.countDistinct("story")
    return records.groupBy(key).agg(F.when(n >= 2, F.round(1 - stories / n, 4)).otherwise(0.0).alias("duplication_ratio"))


def syndicated(records: DataFrame) -> DataFrame:
    return records.filter(F.col("story").isNotNull()).groupBy("story").agg(F.count("*").alias("records"), F.countDistinct("source_id").alias("sources")).withColumn("is_syndicated", F.col("sources") > 1)


def injection_sweep(records: DataFrame, key: str, text: str) -> DataFrame:
    """key, label, records and matches of each kind of injection found."""
    found = records.select(key, F.explode(X.injection_counts(F.col(text))).alias("label", "n"))
    return found.groupBy(key, "label").agg(F.count("*").alias("records"), F.sum("n").cast("bigint").alias("matches"))


def reject_reason() -> Column:
    """The first rule that an envelope (external_id, status, signal_type, entity_name, metric_value,
    metric_currency) breaks; null if it is valid."""
    c = F.col
    gap, value = c("status") != "ok", c("metric_value")
    return (
        F.when(F.coalesce(c("external_id"), F.lit("")) == "", "missing external_id")
        .when(c("status").isNull() | ~c("status").isin("ok", "missing", "failed"), "unknown status")
        .when(gap & (c("signal_type").isNull() | c("entity_name").isNull()), "gap without series")
        .when(gap & value.isNotNull(), "gap with value")
        .when(value.isNotNull() & c("signal_type").isNull(), "metric without signal_type")
        .when(value.isNotNull() & c("entity_name").isNull(), "metric without entity_name")
        .when(F.isnan(value) | (F.abs(value) == float("inf")), "metric not finite")
        .when((c("metric_currency") != "") & (F.length("metric_currency") != 3), "bad currency")
    )


def live_reason(adapter: Column, source_class: Column, needs_network: Column) -> Column:
    """Why a source's evidence isn't live; null if it is. An unknown adapter fails."""
    return (
        F.when(F.coalesce(source_class, F.lit("")) == "demo", "demo class").when(adapter.isin("demo_mock", "scenario"), "generates its own data")
        .when(needs_network.isNull(), "unknown adapter").when(~needs_network, "offline adapter")
    )


def capped(rows: DataFrame, key: str, order: list[str], cap: int) -> DataFrame:
    """At most `cap` rows of each key in order, and whether the key was cut."""
    w = Window.partitionBy(key)
    return rows.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count("*").over(w) > cap).filter(F.col("__r") <= cap).drop("__r")


def run_ledger(stored: DataFrame, rejected: DataFrame, fetched: DataFrame, key: str = "source_id") -> DataFrame:
    """fetched, stored, rejected and duplicate counts of each source's run."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    out = count(fetched, "fetched").join(count(stored, "stored"), key, "left").join(count(rejected, "rejected"), key, "left").fillna(0, ["stored", "rejected"])
    return out.withColumn("duplicates", F.col("fetched") - F.col("stored") - F.col("rejected"))
