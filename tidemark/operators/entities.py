"""Entities and topics: resolving mentions on proof, look-alikes for review, merges, topic clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import pairs
from .dedup import story_labels
from .upkeep import final_survivors


def resolve(mentions: DataFrame, identifiers: DataFrame, aliases: DataFrame, decisions: DataFrame) -> DataFrame:
    """entity_id and how it was found for each mention (mention_id, name, entity_type, identifier).

    Precedence: a shared identifier, an exact alias of the same type, a confirmed human decision,
    else a new entity for each different identifier or normalised name. identifiers: identifier,
    entity_id; aliases: normalized, entity_type, entity_id; decisions: normalized, entity_type, entity_id.
    Several entities for one key: the least id."""
    one = lambda df, *keys: df.groupBy(*keys).agg(F.min("entity_id").alias("hit"))
    m = mentions.withColumn("normalized", X.normal_name(F.col("name")))
    m = m.join(one(identifiers, "identifier").withColumnRenamed("hit", "by_id"), "identifier", "left")
    m = m.join(one(aliases, "normalized", "entity_type").withColumnRenamed("hit", "by_alias"), ["normalized", "entity_type"], "left")
    m = m.join(one(decisions, "normalized", "entity_type").withColumnRenamed("hit", "by_decision"), ["normalized", "entity_type"], "left")
    fresh = F.concat(F.lit("new:"), F.coalesce("identifier", F.concat_ws("/", "entity_type", "normalized")))
    how = F.when(F.col("by_id").isNotNull(), "identifier").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_decision").isNotNull(), "decision").otherwise("new")
    return m.select("mention_id", F.coalesce("by_id", "by_alias", "by_decision", fresh).alias("entity_id"), how.alias("how"))


def look_alikes(entities: DataFrame, least: float = 0.6, top: int = 3, most: int = pairs.MOST) -> DataFrame:
    """a, b, similarity, rank: for each entity (id, name, entity_type) its most similar ones of the type.

    A pair of at least `least` either has the same name but for spaces, or one holds all words of the
    other, and then the rarest of them, or their overlap is at least `least`, and then they share one of the rarest
    words of both that are as many as may be missing, and one more. Only such pairs are formed, of ids and counts;
    names are joined to what is left. Equal names are one entity and not look-alikes."""
    e = entities.select("id", "entity_type", X.normal_name(F.col("name")).alias("n")).dropDuplicates(["entity_type", "n"])
    of_type = lambda key: F.concat_ws("/", "entity_type", key)
    spaced = pairs.within(e.select("id", of_type(X.squashed(F.col("n"))).alias("key")), "key", "id", most=most)
    words = e.select("id", "entity_type", F.explode(F.array_distinct(F.split("n", " "))).alias("word")).select("id", of_type("word").alias("key"))
    ranked = pairs.by_rarity(words, "key", "id")
    held = pairs.across(ranked.filter("place = 1"), ranked, "key", "id", lambda x, y: x("size") <= y("size"), most)
    missing = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9)
    near = pairs.within(ranked.filter(F.col("place") <= missing + 1), "key", "id", lambda x, y: F.least(x("size"), y("size")) >= F.greatest(x("size"), y("size")) * F.lit(least) - 1e-9, most)
    held = held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = spaced.union(held).union(near).distinct()
    named = lambda k: e.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"))
    scored = found.join(named("a"), "a").join(named("b"), "b").select("a", "b", X.name_similarity(F.col("na"), F.col("nb")).alias("similarity")).filter(F.col("similarity") >= least)
    both = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= top)


def merged(children: DataFrame, merges: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows of a child table repointed to the final survivors (merges: duplicate, survivor)."""
    m = final_survivors(merges).select(F.col("duplicate").alias(key), "survivor")
    return children.join(m, key, "left").withColumn(key, F.coalesce("survivor", key)).drop("survivor")


def _words(entities: DataFrame, stopwords: list[str], most_share: float) -> tuple[DataFrame, DataFrame]:
    """Words of each entity (fingerprint, word), and those that two of them, and at most the larger of 3 and `most_share`
    of all, hold (word, hub: the least of these)."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(stopwords)))
    held = entities.select(F.col("id").cast("string").alias("fingerprint"), F.explode(words).alias("word"))
    limit = F.greatest(F.lit(3), F.lit(most_share) * entities.count())
    return held, held.groupBy("word").agg(F.count("*").alias("df"), F.min("fingerprint").alias("hub")).filter((F.col("df") >= 2) & (F.col("df") <= limit))


def telling_words(entities: DataFrame, stopwords: list[str], most_share: float = 0.4) -> DataFrame:
    """id, word: the words by which topics() connects entities."""
    held, telling = _words(entities, stopwords, most_share)
    return held.join(pairs.large(telling), "word").select(F.col("fingerprint").alias("id"), "word")


def topics(entities: DataFrame, stopwords: list[str], most_share: float = 0.4, most_members: int = 12) -> DataFrame:
    """topic, members: entities (id, name) connected by words that two of them, and at most the
    larger of 3 and `most_share` of all, hold. Clusters of 2 to most_members stay; members are counted first,
    so that no larger cluster is ever collected."""
    held, telling = _words(entities, stopwords, most_share)
    linked = held.join(pairs.large(telling), "word").filter("fingerprint != hub").select(F.col("hub").alias("a"), F.col("fingerprint").alias("b")).distinct()
    labels = story_labels(entities.select(F.col("id").cast("string").alias("fingerprint")), linked)
    fits = labels.groupBy("story").agg(F.count("*").alias("n")).filter((F.col("n") >= 2) & (F.col("n") <= most_members)).select("story")
    return labels.join(pairs.large(fits), "story").groupBy(F.col("story").alias("topic")).agg(F.array_join(F.array_sort(F.collect_list("fingerprint")), "|").alias("members"))


#: Entities of a run up to which all its pairs are formed and counted.
SMALL = 64


def cooccurrence(seen: DataFrame, run: str, entity: str, least: int = 3, most: int = pairs.MOST) -> DataFrame:
    """a, b, runs: unordered pairs of entities that at least `least` runs have in common.

    Runs of up to SMALL entities form all their pairs, which are counted: at most half of SMALL for each row. With the runs
    of an entity in order of their size, a pair to be found shares one that is not among the `least` - 1 largest of either,
    so larger runs form pairs only where they are such; a run that holds nearly everything forms none. Larger runs
    that a pair has in common are counted from those of the one with fewer."""
    s = seen.select(F.col(run).alias("run"), F.col(entity).alias("entity")).dropna().distinct()
    if least == 1:
        return pairs.within(s, "run", "entity", most=most).groupBy("a", "b").agg(F.count("*").alias("runs"))
    large = s.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("run")
    few = pairs.within(s.join(large, "run", "left_anti"), "run", "entity", most=most).groupBy("a", "b").agg(F.count("*").alias("few"))
    if large.isEmpty():
        return few.filter(F.col("few") >= least).withColumnRenamed("few", "runs")
    held = s.join(large, "run", "left_semi")
    ranked = pairs.by_rarity(s, "run", "entity").filter(F.col("place") <= F.col("size") - (least - 1))
    found = pairs.within(ranked.join(large, "run", "left_semi"), "run", "entity", most=most).distinct().withColumn("few", F.lit(0).cast("long"))
    found = few.unionByName(found).groupBy("a", "b").agg(F.max("few").alias("few"))
    sizes = held.groupBy("entity").agg(F.count("*").alias("n"))
    size_of = lambda k: sizes.select(F.col("entity").alias(k), F.col("n").alias(f"n{k}"))
    sized = found.join(size_of("a"), "a").join(size_of("b"), "b").filter(F.col("few") + F.least("na", "nb") >= least)
    fewer = F.col("na") <= F.col("nb")
    asked = sized.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("entity"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    shared = asked.join(held, "entity").select("a", "b", F.col("other").alias("entity"), "run").join(held, ["entity", "run"], "left_semi")
    many = shared.groupBy("a", "b").agg(F.count("*").alias("many"))
    both = found.join(many, ["a", "b"], "left").select("a", "b", (F.col("few") + F.coalesce("many", F.lit(0))).alias("runs"))
    return both.filter(F.col("runs") >= least)
