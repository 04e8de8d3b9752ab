"""Series maths: every function takes observations (series, at, value, status) and gives a row for
each point or each series. A gap is not a zero: only status 'ok' with a value is used, other rows
are counted as missing. Ties in time follow the value.

Each job shuffles the observations once, by series; what windows and aggregates need of the order is a
row number, so all measures of a series come from one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_series() -> WindowSpec:
    return Window.partitionBy("series")


def in_time() -> WindowSpec:
    return by_series().orderBy("at", "value")


def pct(current: Column, previous: Column) -> Column:
    """Change in percent of the previous level; null if that is unknown or zero."""
    return F.when(previous != 0, (current - previous) / F.abs(previous) * 100)


def usable(obs: DataFrame) -> DataFrame:
    return obs.filter((F.col("status") == "ok") & F.col("value").isNotNull())


def ranked(obs: DataFrame) -> DataFrame:
    """Usable points with i (0, 1, ... in time), n (points of the series) and r (1 = the last)."""
    points = usable(obs).withColumn("i", F.row_number().over(in_time()) - 1).withColumn("n", F.count("*").over(by_series()))
    return points.withColumn("r", F.col("n") - F.col("i"))


def daily_counts(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Days without items stay absent."""
    return events.groupBy(F.col(key).alias("series"), F.date_trunc("day", F.col(ts).cast("timestamp")).alias("at")).agg(F.count("*").alias("n"))


def chained(obs: DataFrame) -> DataFrame:
    """Each point with the one before and the change between them."""
    before = F.lag("value").over(in_time())
    return usable(obs).withColumn("previous", before).withColumn("change_pct", pct(F.col("value"), before))


def moving_average(obs: DataFrame, window: int = 7) -> DataFrame:
    """Rolling mean, null until the window is full."""
    w = in_time().rowsBetween(1 - window, 0)
    return usable(obs).withColumn("moving_average", F.when(F.count("value").over(w) == window, F.avg("value").over(w)))


def gap_calendar(obs: DataFrame) -> DataFrame:
    """All months from a series' first to its last: reported ones as they are, others as missing."""
    spans = obs.groupBy("series").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    months = spans.select("series", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("at"))
    gaps = months.join(obs, ["series", "at"], "left_anti").select("series", "at", F.lit(None).cast("double").alias("value"), F.lit("missing").alias("status"))
    return obs.select("series", "at", "value", "status").unionByName(gaps)


def _at(r: int) -> Column:
    return F.max(F.when(F.col("r") == r, F.col("value")))


def statistics(obs: DataFrame, window: int = 7, history: int = 30, alpha: float = 0.3, z_limit: float = 2.5) -> DataFrame:
    """The summary of each series: n, last changes, mean, z, ewma, acceleration, changepoint,
    anomaly, direction and strength. A series with any gap, or under 3 points, concludes nothing."""
    v, r = F.col("value"), F.col("r")
    total = obs.groupBy("series").agg(F.count("*").alias("rows"))
    in_history = (r >= 2) & (r <= history + 1)
    # both sides of each split from running sums and the series' totals, around its mean, so that no row looks at a whole side
    whole, left = Window.partitionBy("series"), in_time().rowsBetween(Window.unboundedPreceding, -1)
    around = v - F.avg("value").over(whole)
    i, sums, squares = F.col("i"), F.col("sums"), F.col("squares")
    all_sums, all_squares = F.sum("around").over(whole), F.sum(F.col("around") * F.col("around")).over(whole)
    noise = 1e-12 * all_squares / (i + r)  # what rounding leaves of a variance of nothing
    spread = lambda sums, squares, n: (squares - sums * sums / n) / F.nullif(n - 1, F.lit(0)) / n
    both = spread(sums, squares, i) + spread(all_sums - sums, all_squares - squares, r)
    shift = F.abs((all_sums - sums) / r - sums / i) / F.sqrt(F.when(both > noise, both))
    split_at = (F.col("i") >= 5) & (F.col("i") < F.col("n") - 5)
    points = ranked(obs).withColumn("around", around)
    points = points.withColumns({"sums": F.sum("around").over(left), "squares": F.sum(F.col("around") * F.col("around")).over(left)}).withColumn("shift", F.when(split_at, F.round(shift, 9)))
    agg = points.groupBy("series").agg(
        F.max("n").alias("n"),
        _at(1).alias("last"), _at(2).alias("second"),
        F.max(F.when(r == F.least(F.lit(window + 1), F.col("n")), v)).alias("back"),
        F.avg(F.when(r <= window, v)).alias("mean"),
        F.avg(F.when(in_history, v)).alias("h_mean"), F.stddev_samp(F.when(in_history, v)).alias("h_sd"), F.count(F.when(in_history, v)).alias("h_n"),
        _at(window).alias("recent_0"), _at(window + 1).alias("prior_1"), _at(2 * window).alias("prior_0"),
        F.max(F.struct("shift", (-F.col("i")).alias("at"))).alias("best"),
        F.sort_array(F.collect_list(F.struct("i", "value"))).alias("points"),
    )
    smooth = F.aggregate(F.slice("points", F.lit(2), F.greatest(F.lit(0), F.size("points") - 1)), F.get("points", F.lit(0))["value"], lambda s, p: p["value"] * alpha + s * (1 - alpha))
    joined = agg.join(total, "series", "right")
    fit = (F.col("n") == F.col("rows")) & (F.col("n") >= 3)
    z = F.when((F.col("n") >= 8) & (F.col("h_n") >= 7) & (F.col("h_sd") != 0), (F.col("last") - F.col("h_mean")) / F.col("h_sd"))
    accel = F.when(F.col("n") >= 2 * window + 1, pct(F.col("last"), F.col("recent_0")) - pct(F.col("prior_1"), F.col("prior_0")))
    out = joined.select(
        "series", F.col("rows").alias("n"),
        F.when(fit, pct(F.col("last"), F.col("second"))).alias("change_last"),
        F.when(fit, pct(F.col("last"), F.col("back"))).alias("change_window"),
        F.when(fit & (F.col("n") >= window), F.col("mean")).alias("moving_average"),
        F.when(fit, z).alias("zscore"), F.when(fit, smooth).alias("ewma"), F.when(fit, accel).alias("acceleration"),
        F.when(fit & (F.col("n") >= 10) & (F.col("best.shift") >= 3), -F.col("best.at")).alias("changepoint"),
    )
    change = F.col("change_window")
    out = out.withColumn("is_anomaly", F.coalesce(F.abs("zscore") >= z_limit, F.lit(False)) | F.col("changepoint").isNotNull())
    out = out.withColumn("direction", F.when(change.isNull(), "unknown").when(change > 1, "up").when(change < -1, "down").otherwise("flat"))
    strength = 0.6 * F.least(F.coalesce(F.abs("zscore"), F.lit(0.0)) / 5, F.lit(1.0)) + 0.4 * F.least(F.coalesce(F.abs("acceleration"), F.lit(0.0)) / 50, F.lit(1.0))
    return out.withColumn("strength", F.round(strength, 4))


def growth_profile(obs: DataFrame) -> DataFrame:
    """The full picture of each series: windowed growth, baseline, momentum, persistence,
    acceleration, direction, one-day spike and seasonality; nothing is imputed."""
    v, i, n, at = F.col("value"), F.col("i"), F.col("n"), F.col("at")
    totals = obs.groupBy("series").agg((F.count("*") - F.count(F.when((F.col("status") == "ok") & v.isNotNull(), 1))).alias("missing_count"))
    p = ranked(obs)
    p = p.withColumn("last_at", F.max("at").over(by_series())).withColumn("peak", F.max(F.struct("value", (-i).alias("neg"))).over(by_series()))
    p = p.withColumn("peak_i", -F.col("peak.neg")).withColumn("peak_value", F.col("peak.value"))
    p = p.withColumn("others", F.percentile(F.when(i != F.col("peak_i"), v), F.lit(0.5)).over(by_series()))
    back = lambda days: at <= F.col("last_at") - F.make_dt_interval(F.lit(days))
    earlier = lambda days: F.max_by(F.when(back(days), v), F.when(back(days), i))
    recent = at >= F.col("last_at") - F.make_dt_interval(F.lit(30))
    few = F.col("r") <= F.least(F.lit(8), n)
    x = F.unix_timestamp("at") / 86400.0
    half = F.floor(n / 2)
    value_at = lambda k: F.max(F.when(i == k, v))
    year = at > F.col("last_at") - F.make_dt_interval(F.lit(365))
    prior = (at > F.col("last_at") - F.make_dt_interval(F.lit(730))) & back(365)
    peak_i, high = F.col("peak_i"), v >= 3 * F.col("others")
    a = p.groupBy("series").agg(
        F.max("n").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.max_by("value", "i").alias("latest"), F.min_by("value", "i").alias("earliest"), F.percentile("value", F.lit(0.5)).alias("typical"),
        F.percentile(F.when(i < F.greatest(F.lit(1), F.least(F.lit(5), F.floor(n / 4))), v), F.lit(0.5)).alias("baseline"),
        *[earlier(d).alias(f"at_{d}") for d in (7, 30, 90, 365)],
        F.count(F.when(recent, 1)).alias("recent_n"),
        F.regr_slope(F.when(recent, v), F.when(recent, x)).alias("slope"), F.avg(F.when(recent, v)).alias("recent_mean"),
        F.regr_slope(F.when(few, v), F.when(few, x)).alias("few_slope"), F.avg(F.when(few, v)).alias("few_mean"),
        value_at(half - 1).alias("early_end"), value_at(half).alias("late_begin"),
        F.max("peak_i").alias("peak_i"), F.max("peak_value").alias("peak_value"), F.max("others").alias("others"),
        value_at(peak_i - 1).alias("before_peak"), value_at(peak_i + 1).alias("after_peak"),
        F.max(F.when((i < peak_i) & ~high, i)).alias("low_left"), F.min(F.when((i > peak_i) & ~high, i)).alias("low_right"),
        F.percentile(F.when(i > peak_i, v), F.lit(0.5)).alias("after_median"),
        F.max(F.when(F.col("r") > 1, v)).alias("prior_maximum"),
        F.avg("value").alias("mean"), F.avg(F.when(F.month("at") == F.month("last_at"), v)).alias("month_mean"),
        F.sum(F.when(year, v)).alias("year"), F.sum(F.when(prior, v)).alias("prior_year"),
    )
    blocks = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(n / 3)))
    q, rest = F.floor(n / blocks), n % blocks
    block = F.when(i < rest * (q + 1), F.floor(i / (q + 1))).otherwise(rest + F.floor((i - rest * (q + 1)) / q))
    means = p.filter("n >= 6").groupBy("series", block.alias("block")).agg(F.avg("value").alias("m"))
    rises = means.withColumn("before", F.lag("m").over(by_series().orderBy("block"))).groupBy("series").agg(F.round(F.count(F.when(F.col("m") > F.col("before"), 1)) / F.count("before"), 4).alias("persistence"))
    days = F.floor((F.unix_timestamp("last_at") - F.unix_timestamp("first_at")) / 86400)
    neighbour = F.least(*[F.when(F.col(c) > 0, F.col(c)) for c in ("before_peak", "after_peak")])
    ratio, local = F.col("peak_value") / F.col("others"), F.col("peak_value") / neighbour
    width = F.coalesce("low_right", "n") - F.coalesce("low_left", F.lit(-1)) - 1
    settled = F.coalesce(F.col("after_median") <= 2 * F.col("others"), F.lit(False)) | (F.col("peak_i") == F.col("n") - 1)
    spike = (F.col("n") >= 5) & (F.col("others") > 0) & (ratio >= 5) & (local >= 5) & (width <= 2) & settled
    testable = (F.col("n") >= 24) & (days >= 400) & (F.col("mean") > 0)
    yoy = pct(F.col("year"), F.col("prior_year"))
    out = totals.join(a.join(rises, "series", "left"), "series", "left").select(
        "series", F.coalesce("n", F.lit(0)).alias("observation_count"), "missing_count", F.coalesce(days, F.lit(0)).alias("history_days"), "first_at", "last_at",
        F.col("latest").alias("latest_value"), F.col("typical").alias("typical_value"), F.col("baseline").alias("baseline_value"), "prior_maximum",
        *[F.when(F.col("n") >= 2, pct(F.col("latest"), F.col(f"at_{d}"))).alias(f"growth_{d}d") for d in (7, 30, 90, 365)],
        (F.col("latest") - F.col("at_30")).alias("absolute_growth_30d"), (F.col("latest") - F.col("baseline")).alias("absolute_growth_total"),
        F.when(F.col("n") >= 4, F.when(F.col("recent_n") >= 3, F.col("slope") / F.abs(F.nullif("recent_mean", F.lit(0.0)))).otherwise(F.col("few_slope") / F.abs(F.nullif("few_mean", F.lit(0.0)))) * 100).alias("momentum"),
        "persistence",
        F.when(F.col("n") >= 6, pct(F.col("latest"), F.col("late_begin")) - pct(F.col("early_end"), F.col("earliest"))).alias("acceleration_pp"),
        pct(F.col("latest"), F.col("earliest")).alias("growth_total"),
        F.coalesce(spike, F.lit(False)).alias("is_one_day_spike"),
        F.when((F.col("n") >= 5) & (F.col("others") > 0), ratio).alias("spike_ratio"),
        F.when(testable, F.col("month_mean") / F.col("mean")).alias("month_index"), F.when(testable, yoy).alias("yoy_change_pct"),
    )
    reference = F.coalesce("growth_30d", "growth_90d", "growth_total")
    direction = F.when(reference.isNull(), "unknown").when(reference > 5, "rising").when(reference < -5, "falling").otherwise("flat")
    return out.withColumn("direction", direction).withColumn("is_seasonal", F.coalesce((F.col("month_index") >= 1.15) & (F.abs("yoy_change_pct") < 15), F.lit(False)))
