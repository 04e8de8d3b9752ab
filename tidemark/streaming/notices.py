"""What users are told, as streams: changes of every kind, counts of their local periods, and alerts with a cooldown that tell a
fact once. Each is one query: Spark closes event-time windows and folds their rows, and a stateful step follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import alerts, monitoring
from .streams import folded, in_groups, only_timer, put_all

c = F.col
HISTORY = ("score", "confidence", "risk_level", "state")
ROW = "struct<at: timestamp, score: double, confidence: double, risk_level: string, state: string>"


def changes(history: DataFrame, score_step: float = 5.0, confidence_step: float = 8.0, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """subject, at, kind, magnitude: monitoring.change_events of a stream (subject, at, score, confidence, risk_level, state).

    State is the last row of each subject. A window's rows travel with the row before them, and are compared by the same
    expression as in a batch. Rows without subject, time or score are left out; rows of one moment are ordered by their values."""
    known = history.dropna(subset=["subject", "at", "score"]).withColumn("subject", c("subject").cast("string"))
    rows = F.sort_array(F.collect_list(F.struct("at", *HISTORY)))
    windows = known.withWatermark("at", late).groupBy(F.window("at", every), "subject").agg(rows.alias("rows"))
    sent = windows.select("subject", F.window_time("window").alias("at"), F.to_json("rows").alias("rows"), F.to_json(F.element_at("rows", -1)).alias("last"))

    def step(key, state, closed):
        was, out = state[0] if state else None, []
        for w in closed:
            out.append((key, was, w["rows"]))
            was = w["last"]
        return (was,), out, None

    met = folded(sent, "subject", step, "was string", "subject string, was string, rows string")
    own, before = F.from_json("rows", f"array<{ROW}>"), F.from_json("was", ROW)
    both = F.arrays_zip(own.alias("now"), F.concat(F.array(before), F.slice(own, F.lit(1), F.size(own) - 1)).alias("was"))
    pairs = met.select("subject", F.explode(both).alias("p")).filter("p.was is not null").select("subject", "p.now.*", *[c(f"p.was.{k}").alias(f"was_{k}") for k in HISTORY])
    return pairs.select("subject", "at", F.explode(monitoring.kinds_of_change(score_step, confidence_step)).alias("e")).select("subject", "at", "e.kind", "e.magnitude")


def local_periods(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """user_id, key, start, end, n: rows of each user (user_id, ts, frequency, zone) in every day or ISO week of the user's time zone
    that is over. A timer tells a period when event time has passed its local end, summer time or not; the next one of the same
    user tells it too. A period without rows isn't told, nor is another frequency than daily and weekly.

    Ends of days are quarters of an hour in every zone of today, so rows are counted by quarter, wherever they are, and state
    holds one open period for each user. A user has one frequency and one zone at a time; a change takes effect with the next
    quarter, and ends the period that is open."""
    quarters = stream.withWatermark("ts", late).groupBy(F.window("ts", "15 minutes"), c("user_id").cast("string").alias("user_id"), "frequency", "zone").agg(F.count("*").alias("n"))
    held = quarters.select("user_id", F.window_time("window").alias("at"), alerts.period_around(c("window.start"), c("frequency"), c("zone")).alias("p"), "n").filter("p is not null and user_id is not null")
    held = held.select("user_id", "at", "p.key", F.unix_millis("p.start").alias("start"), F.unix_millis("p.end").alias("end"), "n")
    moment = lambda ms: pd.Timestamp(ms, unit="ms")

    def told(user, state):
        return user, state[0], moment(state[1]), moment(state[2]), state[3]

    def step(user, state, rows):
        out = []
        for r in rows:
            if state and state[:2] != (r["key"], r["start"]):
                out.append(told(user, state))
                state = None
            state = (r["key"], int(r["start"]), int(r["end"]), (state[3] if state else 0) + int(r["n"]))
        return state, out, state[2]

    return folded(held, "user_id", step, "key string, start long, end long, n long", "user_id string, key string, start timestamp, end timestamp, n long", lambda user, state, due: (None, [told(user, state)], None))


class Alerts(StatefulProcessor):
    """Rules of users: until when each is quiet, and which facts it has told, in two lists for a group of rules. What can't
    matter to a run that is still to come is forgotten, by the group's timer if no run comes."""

    columns = ("rule_id", "user_id", "fact", "at")

    def __init__(self, remember: int):
        self.remember = remember

    def init(self, handle) -> None:
        self.handle = handle
        self.quiet = handle.getListState("quiet", "rule_id string, user_id string, until long")
        self.told = handle.getListState("told", "rule_id string, user_id string, fact string, at long")

    def _held(self) -> tuple[dict, dict]:
        held = lambda state: {tuple(k): v for *k, v in state.get()} if state.exists() else {}
        return held(self.quiet), held(self.told)

    def _keep(self, quiet: dict, told: dict, mark: int) -> None:
        """Runs that are still to come are not before the watermark."""
        quiet = {k: until for k, until in quiet.items() if until > mark}
        told = {k: at for k, at in told.items() if at + self.remember >= mark}
        put_all(self.quiet, [(*k, v) for k, v in quiet.items()])
        put_all(self.told, [(*k, v) for k, v in told.items()])
        only_timer(self.handle, min((*quiet.values(), *(at + self.remember + 1 for at in told.values())), default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (quiet, told), out = self._held(), []
        # as many rows as windows of the group's rules were closed together, each with its facts
        for rule, user, at, cool, facts in pd.concat(list(rows)).sort_values("at", kind="stable")[["rule_id", "user_id", "at", "cool", "facts"]].itertuples(index=False):
            now = at.value // 1_000_000
            if now < quiet.get((rule, user), now):
                continue
            new = [f for f in facts if (rule, user, f) not in told or now - told[rule, user, f] > self.remember]
            for f in new:
                told[rule, user, f] = now
                out.append((rule, user, f, at))
            if new:
                quiet[rule, user] = now + max(0, int(cool))
        self._keep(quiet, told, timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out, columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(*self._held(), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def told_once(passing: DataFrame, every: str = "1 hour", late: str = "1 hour", remember: int = 30 * 86_400_000) -> DataFrame:
    """rule_id, user_id, fact, at: what rules tell their users of a stream of events that pass them (rule_id, user_id, ts, fact,
    cooldown_hours). A closed window is a run: a rule that is free tells all facts of it that it hasn't told within `remember`
    milliseconds, and is then quiet for its hours; a run that tells nothing new doesn't make it quiet. What comes while it
    is quiet isn't told, and may be later, if it comes again. `at` is the end of the run.

    State by rule and user: one time while it is quiet, and the facts told in `remember`. Rows with a null but in cooldown_hours (0) are left out."""
    known = passing.dropna(subset=["rule_id", "user_id", "ts", "fact"]).withColumns({k: c(k).cast("string") for k in ("rule_id", "user_id", "fact")})
    facts = F.array_sort(F.collect_set("fact"))
    windows = known.withWatermark("ts", late).groupBy(F.window("ts", every), "rule_id", "user_id").agg(facts.alias("facts"), F.max(F.coalesce("cooldown_hours", F.lit(0))).alias("hours"))
    runs = windows.select("rule_id", "user_id", F.window_time("window").alias("at"), (c("hours").cast("long") * 3_600_000).alias("cool"), "facts")
    return in_groups(runs, "rule_id", "user_id").transformWithStateInPandas(Alerts(remember), "rule_id string, user_id string, fact string, at timestamp", "Append", "EventTime")
