"""Alerts and digests as rows: which rule tells whom about which change, on which channel, and when a
digest's period begins and ends. Nothing is sent from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairs

c = F.col

# Which kinds of change a trigger listens to; None: all.
TRIGGERS = {
    "score_threshold": ("score_increased", "score_decreased"),
    "confidence_threshold": ("confidence_increased", "confidence_decreased"),
    "risk_change": ("risk_increased", "risk_decreased"),
    "confirmation_met": ("confirmation_met",),
    "invalidation_triggered": ("invalidation_triggered",),
    "new_opportunity": ("created",),
    "trend_acceleration": ("trend_stage_changed",),
    "new_geography": ("new_geography",),
    "country_gap": ("new_geography",),
    "watchlist_change": None,
}
EVERYWHERE = "in_app"


def rules_by_kind(rules: DataFrame) -> DataFrame:
    """Enabled rules with a row for each kind of change that their trigger listens to; `kind` is '*' for all."""
    pairs = [(t, k) for t, kinds in TRIGGERS.items() for k in (kinds or ("*",))]
    kinds = rules.sparkSession.createDataFrame(pairs, "trigger string, kind string")
    return rules.filter("enabled").join(F.broadcast(kinds), "trigger")  # a dozen rows


def matched(events: DataFrame, rules: DataFrame, now: Column, watched: DataFrame | None = None) -> DataFrame:
    """Every change event with every rule that listens to it, and why the rule doesn't pass (null: it does).

    events: event_id, subject, kind, magnitude, score, opportunity_type, country; rules: rule_id, user_id,
    trigger, min_score, min_magnitude, type, country, watchlist_id, channels, last_fired_at, cooldown_hours,
    enabled. A null condition of a rule is none. watched: watchlist_id, subject.

    Rules with a country meet only that country's events. Others meet all events of their kinds, since a
    rule without that condition has to answer for each of them."""
    by_kind = rules_by_kind(rules).withColumnsRenamed({"country": "in_country", "kind": "on_kind"})
    e = events.withColumn("kinds", F.array("kind", F.lit("*")))
    at = e.withColumn("on_kind", F.explode("kinds")).drop("kinds")
    bound = by_kind.filter(c("in_country").isNotNull()).withColumn("__at", F.upper("in_country"))
    local = at.withColumn("__at", F.upper(F.coalesce("country", F.lit("")))).join(bound, ["on_kind", "__at"]).drop("__at")
    met = local.unionByName(at.join(by_kind.filter(c("in_country").isNull()), "on_kind"))
    if watched is None:
        seen = met.withColumn("is_watched", c("watchlist_id").isNull())
    else:
        on_list = watched.select("watchlist_id", "subject").distinct().withColumn("listed", F.lit(True))
        seen = met.join(on_list, ["watchlist_id", "subject"], "left").withColumn("is_watched", c("watchlist_id").isNull() | c("listed").isNotNull()).drop("listed")
    why = (
        F.when(_quiet(now), "cooldown")
        .when(~c("is_watched"), "not_watched")
        .when(c("score") < c("min_score"), "score")
        .when(F.abs(F.coalesce("magnitude", F.lit(0.0))) < c("min_magnitude"), "magnitude")
        .when(c("opportunity_type") != c("type"), "type")
    )
    return seen.withColumn("why_not", why).drop("on_kind", "is_watched")


def _quiet(now: Column) -> Column:
    return F.coalesce(now < c("last_fired_at") + F.make_dt_interval(hours=F.greatest(F.lit(0), c("cooldown_hours"))), F.lit(False))


def passing(events: DataFrame, rules: DataFrame, now: Column, watched: DataFrame | None = None, most: int = pairs.MOST) -> DataFrame:
    """The rows of matched() that pass, without forming those that don't.

    A rule is filed under what it asks for: kind of change, country, type and each subject that it watches, or none of
    these. An event looks under its own, in the shapes of rules that there are, so it meets rules alone whose
    conditions of this sort it meets; scores and magnitudes are compared where a pair would be formed. Rules under one
    entry are dealt to blocks of `most`, to which its events go. A condition that an event has no type for holds."""
    ready = rules_by_kind(rules.filter(~_quiet(now))).withColumnsRenamed({"country": "in_country", "kind": "on_kind"})
    free = ready.filter(c("watchlist_id").isNull()).withColumn("on_subject", F.lit(None).cast("string"))
    if watched is not None:
        lists = watched.select("watchlist_id", c("subject").cast("string").alias("on_subject")).dropna().distinct()
        free = free.unionByName(ready.join(lists, "watchlist_id").select(free.columns))
    # once under its type, or none, and once for events without a type
    typed = free.withColumn("on_type", F.explode(F.array(F.coalesce(F.concat(F.lit("="), "type"), F.lit("*")), F.lit("?"))))
    asked = [F.when(c("on_kind") == "*", None).otherwise(c("on_kind")), F.upper("in_country"), F.when(c("on_type") != "*", c("on_type")), c("on_subject")]
    shape = F.concat(*[F.when(x.isNull(), "-").otherwise("+") for x in asked])
    entry = lambda shape, parts: F.concat_ws("\x01", shape, *[F.coalesce(x, F.lit("-")) for x in parts])
    filed = typed.withColumn("__entry", entry(shape, asked))
    shapes = [r[0] for r in typed.select(shape.alias("shape")).distinct().collect()]  # sixteen at most
    own = [c("kind"), F.upper(F.coalesce("country", F.lit(""))), F.coalesce(F.concat(F.lit("="), "opportunity_type"), F.lit("?")), c("subject").cast("string")]
    looks = [F.when(F.lit(x[2] == "+") | c("opportunity_type").isNotNull(), entry(F.lit(x), [o if used == "+" else F.lit(None) for o, used in zip(own, x)])) for x in shapes]
    blocks = pairs._blocks(filed, "__entry", most)
    right = pairs._dealt(filed, blocks, "__entry", "rule_id").withColumnsRenamed({"__entry": "__at", "__block": "__in"}).drop("on_kind", "on_type", "on_subject", "__blocks")
    sought = events.withColumn("__entry", F.explode(F.array_compact(F.array(*looks)) if looks else F.array().cast("array<string>"))).join(blocks, "__entry", "left")
    left = sought.withColumn("__block", F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1)))
    fails = (c("score") < c("min_score")) | (F.abs(F.coalesce("magnitude", F.lit(0.0))) < c("min_magnitude"))
    found = left.join(right, (c("__entry") == c("__at")) & (c("__block") == c("__in")) & ~F.coalesce(fails, F.lit(False)))
    return found.withColumn("why_not", F.lit(None).cast("string")).drop("__entry", "__block", "__blocks", "__at", "__in")


def personal(met: DataFrame, relevance: DataFrame) -> DataFrame:
    """Pairs of matched() judged by the user's relevance too (relevance: user_id, subject, relevance; rules'
    min_relevance): one that isn't known doesn't pass a floor."""
    known = met.join(relevance.select("user_id", "subject", "relevance"), ["user_id", "subject"], "left")
    low = F.when(c("min_relevance").isNotNull(), F.when(c("relevance").isNull(), "relevance_unknown").when(c("relevance") < c("min_relevance"), "relevance"))
    return known.withColumn("why_not", F.coalesce("why_not", low)).drop("relevance")


def fan_out(met: DataFrame, links: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """A row for each passing pair, channel and address: the application always, others where the rule
    wants them and the user (links: user_id, channel, address, verified) has proved to own them. dedupe_key
    is the same for the same fact, so what is in `delivered` (dedupe_key) isn't told again."""
    said = met.filter(c("why_not").isNull())
    key = F.left(F.sha2(F.concat_ws("|", c("rule_id").cast("string"), "subject", "kind", c("event_id").cast("string")), 256), F.lit(48))
    wanted = said.withColumn("key", key).withColumn("channel", F.explode(F.array_union(F.array(F.lit(EVERYWHERE)), F.coalesce("channels", F.array().cast("array<string>")))))
    proved = links.filter("verified").select("user_id", "channel", "address").distinct()
    found = wanted.join(proved, ["user_id", "channel"], "left")
    reach = found.withColumn("address", F.when(c("channel") == EVERYWHERE, c("user_id").cast("string")).otherwise(c("address"))).filter(c("address").isNotNull())
    out = reach.select("rule_id", "user_id", "event_id", "subject", "kind", "channel", "address", F.concat_ws(":", "key", "channel").alias("dedupe_key")).dropDuplicates(["dedupe_key", "address"])
    return out if delivered is None else out.join(delivered.select("dedupe_key"), "dedupe_key", "left_anti")


def period(now: Column, frequency: Column, zone: Column) -> Column:
    """struct<key, start, end> of the last completed day or ISO week of a time zone before `now` (UTC): half
    open, its ends are midnights there. Null for other frequencies."""
    today = F.to_date(F.from_utc_timestamp(now, zone))
    first = F.when(frequency == "daily", F.date_sub(today, 1)).when(frequency == "weekly", F.date_sub(F.to_date(F.date_trunc("week", today)), 7))
    return _span(first, frequency, zone)


def period_around(at: Column, frequency: Column, zone: Column) -> Column:
    """As period(): the day or ISO week of a time zone that holds `at` (UTC)."""
    today = F.to_date(F.from_utc_timestamp(at, zone))
    return _span(F.when(frequency == "daily", today).when(frequency == "weekly", F.to_date(F.date_trunc("week", today))), frequency, zone)


def _span(first: Column, frequency: Column, zone: Column) -> Column:
    """struct<key, start, end> of the period whose first day is `first`."""
    last = F.when(frequency == "daily", F.date_add(first, 1)).when(frequency == "weekly", F.date_add(first, 7))
    iso = F.concat(F.extract(F.lit("YEAROFWEEK"), first).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), first).cast("string"), 2, "0"))
    key = F.when(frequency == "daily", F.concat(F.lit("daily:"), first.cast("string"))).when(frequency == "weekly", F.concat(F.lit("weekly:"), iso))
    midnight = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    return F.when(key.isNotNull(), F.struct(key.alias("key"), midnight(first).alias("start"), midnight(last).alias("end")))


def latest(rows: DataFrame, keys: list[str], at: str, ties: list[str], most: int) -> DataFrame:
    """The newest `most` rows of every key, with their place."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), *ties))
    return rows.withColumn("place", place).filter(c("place") <= most)


def digests(users: DataFrame, deliveries: DataFrame, events: DataFrame, watched: DataFrame, most_alerts: int = 100, most_events: int = 50) -> DataFrame:
    """A digest a user (user_id, start, end, key): how many alerts, watched and other changes its period has,
    and whether it is empty. Of the events of a period the newest `most_events` count, the same ones for all
    who share the period; an alert without a subject counts too."""
    own = deliveries.filter(c("channel") == EVERYWHERE).join(users.select("user_id", "start", "end"), "user_id").filter((c("at") >= c("start")) & (c("at") < c("end")))
    alerts = latest(own, ["user_id"], "at", ["dedupe_key"], most_alerts).groupBy("user_id").agg(F.count("*").alias("alerts"))
    periods = users.select("key", "start", "end").distinct()  # a day or a week, for a handful of time zones
    inside = events.join(F.broadcast(periods), (c("at") >= c("start")) & (c("at") < c("end")))
    shown = latest(inside, ["key", "start"], "at", ["event_id"], most_events).groupBy("key", "start").agg(F.collect_list("subject").alias("subjects"))
    mine = watched.groupBy("user_id").agg(F.collect_set("subject").alias("mine"))  # what one person watches
    rows = users.join(shown, ["key", "start"], "left").join(mine, "user_id", "left").join(alerts, "user_id", "left")
    none = F.array().cast("array<string>")
    hits = F.size(F.filter(F.coalesce("subjects", none), lambda s: F.array_contains(F.coalesce("mine", none), s)))
    total = F.size(F.coalesce("subjects", none))
    return rows.select("user_id", "key", F.coalesce("alerts", F.lit(0)).alias("alerts"), hits.alias("watched"), (total - hits).alias("other")).withColumn("is_empty", c("alerts") + c("watched") + c("other") == 0)


def digest_deliveries(digests: DataFrame, users: DataFrame, links: DataFrame, channel: str, sent: DataFrame | None = None) -> DataFrame:
    """user_id, key, address: digests of active users who still want that frequency, on their oldest verified
    link of the channel, unless sent (user_id, key, channel) before."""
    oldest = links.filter(c("verified") & (c("channel") == channel)).groupBy("user_id").agg(F.min_by("address", F.struct("verified_at", "address")).alias("address"))
    want = users.filter("is_active").select("user_id", c("digest_frequency").alias("frequency"))
    out = digests.join(want, ["user_id", "frequency"]).join(oldest, "user_id").select("user_id", "key", F.lit(channel).alias("channel"), "address")
    return out if sent is None else out.join(sent.select("user_id", "key", "channel"), ["user_id", "key", "channel"], "left_anti")


def with_previous(checks: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Checks (condition_id, at, state) with the state of the check before, from `before` (condition_id, state)
    for the first, and whether the condition is newly met or newly failed."""
    last = F.lag("state").over(Window.partitionBy("condition_id").orderBy("at"))
    rows = checks.withColumn("previous", last)
    if before is not None:
        rows = rows.join(before.select("condition_id", c("state").alias("stored")), "condition_id", "left").withColumn("previous", F.coalesce("previous", "stored")).drop("stored")
    is_new = lambda state: (c("state") == state) & (F.coalesce("previous", F.lit("unknown")) != state)
    return rows.withColumn("newly_met", is_new("met")).withColumn("newly_failed", is_new("failed"))
