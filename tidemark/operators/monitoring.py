"""Monitoring: measurable conditions, change events, alerts, digests and windows of spending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
RISK = ("low", "moderate", "high", "very_high")


def check_conditions(conditions: DataFrame, readings: DataFrame, as_of: str, most: int = 200) -> DataFrame:
    """state of each condition (condition_id, series, comparator, threshold, window_days) by the latest
    readings (series, at, value) of its window: met, partially_met, failed, or unknown."""
    since = c("at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(c("window_days"))
    rows = conditions.join(readings, "series").filter(since & c("value").isNotNull())
    recent = rows.withColumn("r", F.row_number().over(Window.partitionBy("condition_id").orderBy(F.desc("at"), "value"))).filter(c("r") <= most)
    v, t, op = c("value"), c("threshold"), c("comparator")
    test = F.when(op == "gt", v > t).when(op == "gte", v >= t).when(op == "lt", v < t).when(op == "lte", v <= t).when(op == "eq", v == t)
    seen = recent.withColumn("test", test).groupBy("condition_id").agg(F.count("*").alias("n"), F.count_if(c("test")).alias("passing"), F.min_by("test", "r").alias("now"))
    state = F.when(c("now").isNull(), "unknown").when(c("now"), F.when(c("passing") / c("n") >= 0.6, "met").otherwise("partially_met")).when(c("passing") > 0, "partially_met").otherwise("failed")
    return conditions.join(seen, "condition_id", "left").select("condition_id", state.alias("state"), F.coalesce("n", F.lit(0)).alias("readings"), F.coalesce("passing", F.lit(0)).alias("passing"))


def kinds_of_change(score_step: float = 5.0, confidence_step: float = 8.0) -> Column:
    """array<struct<kind, magnitude>>: what changed between the was_ columns of a row and its score, confidence,
    risk_level and state. Where one of both isn't known, nothing did."""
    ds, dc = c("score") - c("was_score"), c("confidence") - c("was_confidence")
    rank = lambda x: F.array_position(F.array(*map(F.lit, RISK)), x)
    dr = rank(c("risk_level")) - rank(c("was_risk_level"))
    event = lambda when, kind, size: F.when(when, F.struct(F.lit(kind).alias("kind"), size.cast("double").alias("magnitude")))
    return F.array_compact(F.array(
        event(ds >= score_step, "score_increased", ds), event(ds <= -score_step, "score_decreased", -ds), event(dc >= confidence_step, "confidence_increased", dc), event(dc <= -confidence_step, "confidence_decreased", -dc),
        event(dr > 0, "risk_increased", dr), event(dr < 0, "risk_decreased", -dr), event(c("state") != c("was_state"), "state_changed", F.lit(0.0)),
    ))


def change_events(history: DataFrame, score_step: float = 5.0, confidence_step: float = 8.0) -> DataFrame:
    """subject, at, kind, magnitude: what changed between successive rows of a history (subject, at,
    score, confidence, risk_level, state)."""
    w = Window.partitionBy("subject").orderBy("at")
    p = history.withColumns({f"was_{k}": F.lag(k).over(w) for k in ("score", "confidence", "risk_level", "state")}).filter(c("was_score").isNotNull())
    return p.select("subject", "at", F.explode(kinds_of_change(score_step, confidence_step)).alias("e")).select("subject", "at", "e.kind", "e.magnitude")


def match_alerts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events that enabled rules (rule_id, user_id, kind, min_magnitude, min_score, cooldown_until)
    fire on, with a key that makes each once-only for a user."""
    hits = events.join(rules.filter("enabled"), "kind").filter((c("magnitude") >= F.coalesce("min_magnitude", F.lit(0.0))) & (c("score") >= F.coalesce("min_score", F.lit(0.0))) & (c("cooldown_until").isNull() | (c("at") >= c("cooldown_until"))))
    key = F.left(F.sha2(F.concat_ws("|", "rule_id", "subject", "kind", F.date_format("at", "yyyy-MM-dd")), 256), F.lit(48))
    return hits.withColumn("dedupe_key", key)


def undelivered(alerts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Alerts whose (user_id, dedupe_key) the ledger hasn't, each once."""
    return alerts.dropDuplicates(["user_id", "dedupe_key"]).join(ledger.select("user_id", "dedupe_key"), ["user_id", "dedupe_key"], "left_anti")


def digest(events: DataFrame, watched: DataFrame, start: str, end: str, most: int = 50) -> DataFrame:
    """A row for each user: counts and the newest watched and other changes in [start, end).
    watched: user_id, subject, is_watched."""
    period = events.filter((c("at") >= F.lit(start).cast("timestamp")) & (c("at") < F.lit(end).cast("timestamp")))
    rows = period.join(watched, "subject").withColumn("r", F.row_number().over(Window.partitionBy("user_id", "is_watched").orderBy(F.desc("magnitude"), "subject", "kind"))).filter(c("r") <= most)
    line = F.concat_ws(":", "subject", "kind")
    part = lambda on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("r", line.alias("line"))))), lambda x: x["line"]), "|")
    return rows.groupBy("user_id").agg(F.count_if("is_watched").alias("n_watched"), F.count_if(~c("is_watched")).alias("n_other"), part(c("is_watched")).alias("watched"))


def spend_window(spend: DataFrame, days: int) -> DataFrame:
    """spend (key, at, amount) with the sum of the trailing days, this row included."""
    w = Window.partitionBy("key").orderBy(F.unix_timestamp("at")).rangeBetween(-days * 86400, 0)
    return spend.withColumn("spent", F.sum("amount").over(w))
