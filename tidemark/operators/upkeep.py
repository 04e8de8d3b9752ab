"""Upkeep of entities and topics: identifiers in one form, merges and aliases, what a topic is about; stories
folded greedily; the earlier gate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.connectors import upserted
from ..sources.places import kept
from .pairs import large

c = F.col

# The category that an entity's type belongs to.
CATEGORIES = {
    "technology": "technology",
    "software_project": "technology",
    "repository": "technology",
    "public_company": "public_investment",
    "company": "public_investment",
    "crypto_asset": "crypto",
    "product": "import_distribution",
    "commodity": "import_distribution",
    "industry": "business",
    "problem": "business",
    "skill": "business",
    "keyword": "business",
    "indicator": "macro",
    "country": "macro",
}


def identifiers(ids: Column) -> Column:
    """map<string,string> of loose identifiers as the ones to match on: padded, in one case, and composed where
    only both parts together are proof. Composed ones are also taken as they are. Blank ones are left out."""
    at = lambda k: F.nullif(F.trim(F.try_element_at(ids, F.lit(k))), F.lit(""))
    pair = lambda a, b: F.when(at(a).isNotNull() & at(b).isNotNull(), F.concat(at(a), F.lit(":"), at(b)))
    cik = at("sec_cik")
    forms = {
        "sec_cik": F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik),
        "github_repo_id": at("github_repo_id"),
        "iso_country": F.upper(at("iso_country")),
        "package_name": F.lower(at("package_name")),
        "ticker_exchange": F.upper(F.coalesce(at("ticker_exchange"), pair("exchange", "ticker"))),
        "chain_address": F.lower(F.coalesce(at("chain_address"), pair("chain", "contract_address"))),
    }
    found = F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), v)])
    return F.map_filter(found, lambda _, v: v.isNotNull())


def undecided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (a, b) on which nobody has ruled: a pair is the same both ways round, and a ruling of any
    kind (confirmed, rejected, keep_separate) is for good."""
    ruled = decisions.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return candidates.join(ruled, (F.least("a", "b") == c("x")) & (F.greatest("a", "b") == c("y")), "left_anti")


def final_survivors(merges: DataFrame) -> DataFrame:
    """duplicate, survivor: where each merge (duplicate, survivor) leads to in the end.

    Every round follows twice as many merges as the one before, so a chain takes rounds as its logarithm. Of several
    survivors of a duplicate the least counts; of entities that are merged in a circle the least is the survivor of
    all, and of those that lead into it."""
    first = merges.dropna().filter("duplicate != survivor").groupBy("duplicate").agg(F.min("survivor").alias("survivor"))
    # low: the least of the entities on the way up to, and without, the survivor
    steps = kept(first.select("duplicate", "survivor", c("duplicate").alias("low"), F.lit(False).alias("ended")), "merges")
    rounds = steps.count().bit_length() + 1
    for _ in range(rounds):
        further = steps.select(c("duplicate").alias("survivor"), c("survivor").alias("beyond"), c("low").alias("low_beyond"))
        # one whose survivor is no duplicate has ended; the others go on
        longer = steps.filter("not ended").join(further, "survivor", "left").select("duplicate", F.coalesce("beyond", "survivor").alias("survivor"), F.least("low", "low_beyond").alias("low"), c("beyond").isNull().alias("ended"))
        steps = kept(longer.unionByName(steps.filter("ended")), "merges")
        if steps.filter("not ended").isEmpty():
            break
    # what hasn't ended behind more steps than there are merges stands, or leads, in a circle
    circles = steps.filter("not ended").select(c("duplicate").alias("survivor"), c("low").alias("least"))
    found = steps.join(circles, "survivor", "left").select("duplicate", F.coalesce("least", "survivor").alias("survivor"))
    return found.filter("duplicate != survivor")


def merged_aliases(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """Aliases (normalized, entity_type, entity_id, alias) behind merges (duplicate, survivor): moved to the
    final survivor, unless it has the alias already."""
    merges = final_survivors(merges)
    moved = aliases.join(merges.select(c("duplicate").alias("entity_id"), "survivor"), "entity_id", "left")
    rows = moved.withColumn("own", c("survivor").isNull()).withColumn("entity_id", F.coalesce("survivor", "entity_id")).drop("survivor")
    first = F.min_by(F.struct("alias"), F.struct(~c("own"), "alias"))  # the survivor's own goes before
    return rows.groupBy("normalized", "entity_type", "entity_id").agg(first.getField("alias").alias("alias"))


def merged_identifiers(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities (entity_id, ids) behind merges: duplicates are gone, and survivors have their identifiers too,
    where they had none of the kind. Of several duplicates the one with the least id gives it."""
    merges = final_survivors(merges)
    into = entities.join(merges.select(c("duplicate").alias("entity_id"), "survivor"), "entity_id", "left")
    rows = into.select(F.coalesce("survivor", "entity_id").alias("to"), c("survivor").isNotNull().alias("late"), "entity_id", F.explode_outer("ids").alias("kind", "value"))
    one = rows.groupBy("to", "kind").agg(F.min_by("value", F.struct("late", "entity_id")).alias("value"))
    entries = F.array_sort(F.collect_list(F.when(c("kind").isNotNull(), F.struct("kind", "value"))))
    return one.groupBy(c("to").alias("entity_id")).agg(F.map_from_entries(entries).alias("ids"))  # six kinds at most


def with_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases with new ones (entity_id, entity_type, alias) whose name is free: the first by entity takes it."""
    named = new.withColumn("normalized", X.normal_name(c("alias")))
    fresh = named.groupBy("normalized", "entity_type").agg(F.min(F.struct("entity_id", "alias")).alias("x")).select("normalized", "entity_type", "x.entity_id", "x.alias")
    return aliases.unionByName(fresh.join(aliases.select("normalized", "entity_type"), ["normalized", "entity_type"], "left_anti"))


def topic_attributes(members: DataFrame, words: DataFrame, most: int = 3, share: float = 0.6) -> DataFrame:
    """topic, shared (words), category and label of topics (topic, id, entity_type, name) from their members'
    distinctive words (id, word): words that all have, else up to `most` that `share` of them have; without
    any a topic is a chain and goes. Words of up to three letters are acronyms and stay in capitals; a bare one
    gets the commonest longer word beside it."""
    sizes = members.groupBy("topic").agg(F.count("*").alias("n"))
    kinds = members.groupBy("topic", "entity_type").agg(F.count("*").alias("k")).groupBy("topic").agg(F.min_by("entity_type", F.struct(-c("k"), "entity_type")).alias("kind"))
    counts = members.join(large(words), "id").groupBy("topic", "word").agg(F.count("*").alias("k")).join(large(sizes), "topic")
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("k"), "word"))
    ranked = counts.withColumn("place", place)
    every, often = F.collect_list(F.when(c("k") == c("n"), c("word"))), F.collect_list(F.when((c("place") <= most) & (c("k") >= share * c("n")), F.struct("place", "word")))
    longer = F.min_by("word", F.when((F.length("word") > 3) & (c("k") < c("n")), F.struct(-c("k"), "word")))
    found = ranked.groupBy("topic").agg(F.array_sort(every).alias("every"), F.array_sort(often).alias("often"), longer.alias("longer"))  # words of at most twelve names
    shared = F.when(F.size("every") > 0, c("every")).otherwise(F.transform("often", lambda x: x["word"]))
    shown = lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.initcap(w))
    words_ = F.transform(F.slice("shared", 1, most), shown)
    bare = (F.size("shared") == 1) & (F.length(c("shared")[0]) <= 3) & c("longer").isNotNull()
    label = F.array_join(F.when(bare, F.concat(words_, F.array(shown(c("longer"))))).otherwise(words_), " ")
    category = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CATEGORIES.items() for x in p]), c("kind")), F.lit("technology"))
    rows = found.withColumn("shared", shared).filter(F.size("shared") > 0).join(large(kinds), "topic")
    return rows.select("topic", F.array_join("shared", "|").alias("shared"), category.alias("category"), label.alias("label"))


def rebuilt_topics(stored: DataFrame, members: DataFrame, found: DataFrame, clusters: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Topics and their members behind a run of clustering. A topic is known by the words that its members share, so
    a cluster with the same words is the same topic, whatever its members are by now: it keeps when it was first
    seen, and gets the run's label and category. Members are only added.

    stored: normalized, label, category, first_seen, last_seen; members: normalized, id; found: topic, shared, category,
    label of topic_attributes(); clusters: topic, id. Of clusters with the same words the least topic names them."""
    now = F.lit(at).cast("timestamp")
    named = found.withColumn("normalized", F.array_join(F.array_sort(F.split("shared", "\\|")), "|"))
    fresh = named.groupBy("normalized").agg(F.min_by(F.struct("label", "category"), "topic").alias("x")).select("normalized", "x.label", "x.category", now.alias("first_seen"), now.alias("last_seen"))
    topics = upserted(stored, fresh, "normalized", first=["first_seen"], peak=["last_seen"])
    own = clusters.join(large(named.select("topic", "normalized")), "topic").select("normalized", "id")
    return topics, members.select("normalized", "id").unionByName(own).distinct()


def greedy_stories(headlines: DataFrame, threshold: float = 0.7, most: int = 200) -> DataFrame:
    """subject, story, records, sources by greedy folding of each subject's newest `most` headlines (subject,
    record_id, source_id, title, at), which is the operator's feature and bounds a group: equal fingerprints first,
    then, the largest group first (ties by fingerprint), a group joins the first story that has a title near to its
    own first one. Unlike components, a story isn't the closure of nearness."""
    tokens = X.title_tokens(c("title"))
    rows = headlines.withColumn("tokens", F.array_distinct(tokens)).withColumn("fingerprint", X.fingerprint(tokens)).filter("fingerprint is not null")
    newest = rows.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("at"), "record_id"))).filter(c("place") <= most)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        exact = {}
        for r in group.sort_values("record_id").itertuples():
            exact.setdefault(r.fingerprint, []).append((frozenset(r.tokens), r.source_id))
        stories: list[tuple[str, list]] = []
        for name, held in sorted(exact.items(), key=lambda x: (-len(x[1]), x[0])):
            own = held[0][0]
            near = (s for s in stories if any(len(own & t) >= threshold * len(own | t) - 1e-12 for t, _ in s[1]))
            story = next(near, None)
            if story is None:
                stories.append((name, list(held)))
            else:
                story[1].extend(held)
        subject = group["subject"].iloc[0]
        return pd.DataFrame([(subject, n, len(h), len({s for _, s in h})) for n, h in stories], columns=["subject", "story", "records", "sources"])

    kind = headlines.schema["subject"].dataType.simpleString()
    return newest.select("subject", "record_id", "source_id", "fingerprint", "tokens").groupBy("subject").applyInPandas(fold, f"subject {kind}, story string, records long, sources long")


def first_gate(rows: DataFrame, least_types: int, least_sources: int, least_confidence: float, most_days: int) -> DataFrame:
    """Rows (signal_types, sources, confidence, newest_days, stage, blocking) with the reasons why nothing may come of
    them: the gate of the earlier formula."""
    reasons = F.array_compact(
        F.array(
            F.when(c("signal_types") < least_types, "signal_types"),
            F.when(c("sources") < least_sources, "sources"),
            F.when(c("confidence") < least_confidence, "confidence"),
            F.when(c("newest_days") > most_days, "age"),
            F.when(c("stage").isin("mature", "declining"), "stage"),
            F.when(F.size("blocking") > 0, "blocking"),
        )
    )
    return rows.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
