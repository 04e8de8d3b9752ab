"""Lifecycles of trends and opportunities as a stream: previous state and peak are kept, and what goes stale ends by
itself, without an evaluation that says so.

An evaluation holds what the rules say by themselves; only what depends on the past is decided here. An end is told
when event time has passed the day on which the trail went cold by the time that evaluations can be behind (`hold`), so
that no observation from before that day is still to come."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import opportunities, trends
from .streams import folded

DAY = 86_400_000
OUT = "subject string, at timestamp, state string, score double, peak double, cause string"


@dataclass(frozen=True)
class Rules:
    strong: tuple[str, ...]  # states from which a fall weakens
    fall: float  # points below the peak
    stale: int  # days without an observation that are still alive
    over: str  # the state after that


TREND = Rules(("active", "confirmed"), 20.0, trends.STALE_DAYS, "ended")
OPPORTUNITY = Rules(("watchlist", "promising", "strong_evidence"), 18.0, 120, "archived")


def advanced(evaluations: DataFrame, rules: Rules, hold: int) -> DataFrame:
    """subject, at, state, score, peak, cause ('evaluation' or 'silence') from evaluations in event time order: subject,
    at, score, seen_first and seen_last (milliseconds of the observations that are new in it), settled (a state
    whatever was before, or null), if_strong (the state behind a strong one, or null), outcome (in all other cases)."""
    stale = (rules.stale + 1) * DAY  # the first day on which more days than that have passed

    def silence(key, last, peak):
        return key, pd.Timestamp(last + stale, unit="ms"), rules.over, None, peak, "silence"

    def step(key, held, rows):
        state, peak, last = held or (None, 0.0, None)
        out = []
        for r in rows:
            if last is not None and r["seen_first"] >= last + stale and state != rules.over:
                out.append(silence(key, last, peak))
                state = rules.over
            peak, strong = max(peak, float(r["score"])), state in rules.strong
            if r["settled"] is not None:
                state = r["settled"]
            elif strong and r["if_strong"] is not None:
                state = r["if_strong"]
            elif strong and peak - r["score"] >= rules.fall:
                state = "weakening"
            else:
                state = r["outcome"]
            out.append((key, r["at"], state, float(r["score"]), peak, "evaluation"))
            last = max(last or 0, int(r["seen_last"]))
        return (state, peak, last), out, last + stale + hold

    def expired(key, held, due):
        state, peak, last = held
        if state == rules.over:
            return held, [], None
        return (rules.over, peak, last), [silence(key, last, peak)], None  # kept: a subject that comes back is the same one

    return folded(evaluations, "subject", step, "state string, peak double, last long", OUT, expired)


def _alone(expression: Column, evaluations: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`evaluations` with `outcome`: the expression as if nothing had been before."""
    kept = evaluations.columns
    return evaluations.withColumns(columns).withColumn("outcome", expression).select(*kept, "outcome")


def trend_lifecycle(evaluations: DataFrame, hold: int) -> DataFrame:
    """Evaluations: subject, at, seen_first, seen_last, trend_score, confidence, independent_sources, stage,
    is_one_day_spike, is_seasonal."""
    nothing = {"previous_state": F.lit(None).cast("string"), "peak_score": F.col("trend_score"), "days_since_last": F.lit(0)}
    e = _alone(trends.next_state(), evaluations, nothing)
    unusual = F.when(F.col("is_one_day_spike") | F.col("is_seasonal"), "invalidated")
    return advanced(e.select("subject", "at", "seen_first", "seen_last", F.col("trend_score").alias("score"), F.lit(None).cast("string").alias("settled"), unusual.alias("if_strong"), "outcome"), TREND, hold)


def opportunity_lifecycle(evaluations: DataFrame, hold: int) -> DataFrame:
    """Evaluations: subject, at, seen_first, seen_last, opportunity_score, opportunity_confidence, risk_level, skeptic_status."""
    c = F.col
    alone = opportunities.next_state(c("opportunity_score"), c("opportunity_confidence"), c("opportunity_score"), F.lit(None).cast("string"), c("risk_level"), F.lit("continue_research"), F.lit(0))
    e = _alone(alone, evaluations, {})
    settled = F.when(c("skeptic_status") == "reject", "invalidated")
    return advanced(e.select("subject", "at", "seen_first", "seen_last", c("opportunity_score").alias("score"), settled.alias("settled"), F.lit(None).cast("string").alias("if_strong"), "outcome"), OPPORTUNITY, hold)
