"""Daily telemetry: summaries, kill conditions, alerts, weekly and cumulative views, parity, kill metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPENS = ("OPEN_LONG", "OPEN_SHORT")
EXPECTED_GUARD = "CUTOFF"
SLIPPAGE_TOLERANCE = 0.30
PARITY_TOLERANCE = 1e-9
KEYS = ("hypothesis_id", "day")


def aggregate_of(values: Column, how: str) -> Column:
    return F.percentile(values, F.lit(0.5)) if how == "median" else F.avg(values)


def guard_counts(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return rows.where("guard_blocked is not null").groupBy(*keys, "guard_blocked").agg(F.count(F.lit(1)).alias("n"))


def daily_summary(rows: DataFrame, calendar: DataFrame, costs: dict, aggregation: str = "median") -> DataFrame:
    """One row per (hypothesis_id, day) of telemetry with those two columns; net is the pnl of the day's last bar."""
    opens = F.col("decision").isin(*OPENS)
    fee = 2.0 * (costs["exchange_fee"] + costs["brokerage"]) / costs["point_value"]
    day = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("bars_recorded"), F.count_if(opens).alias("trades"), F.max_by("daily_pnl_points", F.struct("bar_time", "ts")).alias("net_pnl_points"),
        F.coalesce(F.sum(F.when(opens, F.col("contracts"))), F.lit(0)).alias("_contracts"), F.avg(F.when(opens, F.col("slippage_ticks"))).alias("slippage_ticks_avg"),
        F.count_if((F.col("decision") == "REJECTED") | F.coalesce(F.col("order_status").startswith("REJECTED"), F.lit(False))).alias("rejections"), aggregate_of(F.col("kill_metric_value"), aggregation).alias("kill_metric_daily"),
    )
    guards = guard_counts(rows).groupBy(*KEYS).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("guard_blocked", "n")))).alias("guard_blocks"))
    out = day.join(guards, list(KEYS), "left").join(calendar.select("day", "bars_expected"), "day", "left")
    out = out.withColumn("gross_pnl_points", F.col("net_pnl_points") + F.col("_contracts") * fee).drop("_contracts")
    return out.withColumns({"bars_expected": F.coalesce("bars_expected", F.lit(0)), "guard_blocks": F.coalesce("guard_blocks", F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<bigint>))"))})


def kill_states(daily: DataFrame, window_days: int, threshold: float, aggregation: str = "median", above: bool = True) -> DataFrame:
    """hypothesis_id, day, value, state over the last window_days measured days; fewer are INSUFFICIENT."""
    w = Window.partitionBy("hypothesis_id").orderBy("day").rowsBetween(-(window_days - 1), 0)
    x = daily.where("kill_metric_daily is not null").withColumns({"value": aggregate_of(F.col("kill_metric_daily"), aggregation).over(w), "_n": F.count(F.lit(1)).over(w)})
    hit = (F.col("value") > threshold) if above else (F.col("value") < threshold)
    return x.select("hypothesis_id", "day", "value", F.when(F.col("_n") < window_days, "INSUFFICIENT").when(hit, "DEAD").otherwise("ALIVE").alias("state"))


def first_kills(states: DataFrame) -> DataFrame:
    """One kill row for each hypothesis, on the first dead day."""
    return states.where("state = 'DEAD'").groupBy("hypothesis_id").agg(F.min("day").alias("day"), F.min_by("value", "day").alias("value"))


def alerts(daily: DataFrame, modeled_slippage: float) -> DataFrame:
    """hypothesis_id, day, alert, reason."""
    s = F.col("slippage_ticks_avg")
    off = F.abs(s - modeled_slippage) / modeled_slippage if modeled_slippage else F.abs(s)
    strange = F.size(F.filter(F.map_keys("guard_blocks"), lambda g: g != EXPECTED_GUARD)) > 0
    one = lambda test, kind, why: F.when(test, F.struct(F.lit(kind).alias("alert"), F.lit(why).alias("reason")))
    raised = F.array_compact(F.array(
        one(F.col("bars_recorded") != F.col("bars_expected"), "OPERATIONAL", "bars"), one(F.col("rejections") > 0, "OPERATIONAL", "rejections"),
        one(strange, "OPERATIONAL", "guards"), one(off > SLIPPAGE_TOLERANCE, "DIVERGENCE", "slippage"),
    ))
    return daily.select("hypothesis_id", "day", F.explode(raised).alias("a")).select("hypothesis_id", "day", "a.alert", "a.reason")


def collect_day(daily_new: DataFrame, daily_known: DataFrame) -> DataFrame:
    """What is new: days already recorded are left out."""
    return daily_new.join(daily_known.select(*KEYS), list(KEYS), "left_anti")


def weekly(daily: DataFrame) -> DataFrame:
    """ISO weeks: trades, and slippage weighted by the trades of days that have one."""
    has = F.col("slippage_ticks_avg").isNotNull() & (F.col("trades") > 0)
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col("day")), F.extract(F.lit("WEEK"), F.col("day")))
    return daily.groupBy("hypothesis_id", week.alias("week")).agg(
        F.sum("trades").alias("trades"), (F.sum(F.when(has, F.col("slippage_ticks_avg") * F.col("trades"))) / F.sum(F.when(has, F.col("trades")))).alias("slippage")
    )


def cumulative(daily: DataFrame, band: tuple[float, float, int] | None = None) -> DataFrame:
    """Running pnl, and the linear band (q1, q3 over n days) if given."""
    w = Window.partitionBy("hypothesis_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.select("hypothesis_id", "day", F.sum("net_pnl_points").over(w).alias("cum_pnl"), F.count(F.lit(1)).over(w).alias("day_no"))
    if band:
        q1, q3, n = band
        out = out.withColumns({"band_lo": F.col("day_no") * (q1 / n), "band_hi": F.col("day_no") * (q3 / n)})
    return out


def parity(expected: DataFrame, logged: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """compared, max_error, missing_in_log, null_mismatch, ok: expected (keys, bar_time, value) against logged (keys, bar_time, signal, guard_blocked)."""
    period = logged.groupBy(*keys).agg(F.min("bar_time").alias("_lo"), F.max("bar_time").alias("_hi"))
    use = logged.where("guard_blocked is null or guard_blocked <> 'DATA_GAP'").select(*keys, "bar_time", F.col("signal").alias("_s"), F.lit(True).alias("_in"))
    x = expected.join(period, list(keys)).where("bar_time between _lo and _hi").join(use, [*keys, "bar_time"], "left")
    both = F.col("value").isNotNull() & F.col("_s").isNotNull()
    error = F.abs(F.col("value") - F.col("_s")) / F.greatest(F.lit(1.0), F.abs("value"))
    out = x.groupBy(*keys).agg(
        F.count_if(both).alias("compared"), F.coalesce(F.max(F.when(both, error)), F.lit(0.0)).alias("max_error"), F.count_if(F.col("_in").isNull()).alias("missing_in_log"),
        F.count_if(F.col("_in").isNotNull() & (F.col("value").isNull() != F.col("_s").isNull())).alias("null_mismatch"),
    )
    return out.withColumn("ok", (F.col("compared") > 0) & (F.col("max_error") < PARITY_TOLERANCE) & (F.col("missing_in_log") == 0) & (F.col("null_mismatch") == 0))


def kill_metrics(frame: DataFrame, symbol: str = "ES", bars: int = 60) -> DataFrame:
    """realized_vol and ref_corr over the last `bars` returns, and gap_overnight: a day's first open against the close before."""
    w = Window.partitionBy("series").orderBy("ts")
    last = w.rowsBetween(-(bars - 1), 0)
    r = lambda c: F.col(c) / F.lag(c).over(w) - 1
    x = frame.withColumns({"_r": r("close"), "_q": r(f"ref_{symbol}"), "_before": F.lag("close").over(w), "_day": F.lag("day").over(w)})
    full = F.count("_r").over(last) == bars
    return x.select(
        "series", "ts", "day", F.when(full, F.stddev_samp("_r").over(last)).alias("realized_vol"), F.when(full, F.corr("_r", "_q").over(last)).alias("ref_corr"),
        F.when(F.col("_day") != F.col("day"), F.col("open") - F.col("_before")).alias("gap_overnight"),
    )


def move_lag(frame: DataFrame, symbol: str = "ES") -> DataFrame:
    """lag_ms of each bar at which the reference moved: milliseconds until the first bar, from this one on, at which the main symbol moves the same way; NULL if none comes."""
    w = Window.partitionBy("series").orderBy("ts")
    move = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    x = frame.withColumns({"_m": move("close"), "_q": move(f"ref_{symbol}")})
    on = Window.partitionBy("series").orderBy(F.col("ts").desc()).rowsBetween(Window.unboundedPreceding, 0)  # from the last bar back, so that one pass does
    at = lambda sign: F.min(F.when(F.col("_m") == sign, F.col("ts"))).over(on)
    x = x.withColumn("_at", F.when(F.col("_q") > 0, at(1.0)).when(F.col("_q") < 0, at(-1.0)))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return x.where("_q <> 0").select("series", "ts", (ms("_at") - ms("ts")).alias("lag_ms"))


def mean_spread(quotes: DataFrame, tick: float) -> DataFrame:
    """spread_ticks of each bar of quotes (series, ts, spread): the mean spread, in ticks."""
    return quotes.groupBy("series", "ts").agg((F.avg("spread") / F.lit(float(tick))).alias("spread_ticks"))


def fill_ratio(rows: DataFrame) -> DataFrame:
    """The running share of orders that were filled, per hypothesis."""
    w = Window.partitionBy("hypothesis_id").orderBy("bar_time", "ts").rowsBetween(Window.unboundedPreceding, 0)
    order = F.col("decision").isin(*OPENS, "REJECTED")
    return rows.where(order).withColumn("fill_ratio", F.avg((F.col("decision") != "REJECTED").cast("double")).over(w))
