"""Statistical gates over per-fold metrics."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewick.functions.scalar import normal_cdf, normal_quantile

GAMMA = 0.5772156649015329
#: The pre-registered limits.
LIMITS = {
    "min_total_trades": 400, "min_trades_per_path": 30, "min_active_days": 120, "max_trade_concentration": 0.25, "max_sign_flip_frac": 0.30,
    "max_pbo": 0.20, "min_dsr": 0.95, "max_trials": 3000, "n_groups": 8, "k_test": 2, "embargo_mult": 3.0,
}
NOISE_RESAMPLES, SUBPERIODS, COST_FACTORS = 100, 3, (1.5, 2.0)


class StatisticsError(Exception):
    """Inputs for which a statistic is not defined."""


def sr_star(var_sr: float, trials: int) -> float:
    """The Sharpe ratio that the best of `trials` worthless strategies is expected to show."""
    if trials < 1 or not math.isfinite(var_sr) or var_sr < 0:
        raise StatisticsError("trials and variance")
    if trials == 1:
        return 0.0
    q = NormalDist().inv_cdf
    return math.sqrt(var_sr) * ((1 - GAMMA) * q(1 - 1 / trials) + GAMMA * q(1 - 1 / (trials * math.e)))


def sr_star_sql(var_sr: str, trials: str) -> str:
    a, b = normal_quantile(f"(1.0D - 1.0D / {trials})"), normal_quantile(f"(1.0D - 1.0D / ({trials} * {math.e!r}D))")
    return f"(CASE WHEN {trials} = 1 THEN 0.0D ELSE sqrt({var_sr}) * ({1 - GAMMA!r}D * {a} + {GAMMA!r}D * {b}) END)"


def deflated_sharpe(rows: DataFrame, sr: str, star: str, n: str, skew: str, kurt: str) -> DataFrame:
    """rows with dsr; kurt is not the excess; NULL where the statistic is not defined. Staged, so that no expression is written out twice."""
    x = rows.withColumn("_den", 1.0 - F.col(skew) * F.col(sr) + (F.col(kurt) - 1.0) / 4.0 * F.col(sr) * F.col(sr))
    ok = (F.col(n) >= 2) & (F.col("_den") > 0)
    x = x.withColumn("_z", F.when(ok, (F.col(sr) - F.col(star)) * F.sqrt(F.col(n) - 1.0) / F.sqrt("_den")))
    return x.withColumn("dsr", F.when(F.col("_z").isNotNull(), F.expr(normal_cdf("_z")))).drop("_den", "_z")


def deannualised(sr: Column, periods: float) -> Column:
    return sr / F.lit(math.sqrt(periods))


def fold_metrics(trades: DataFrame, keys: list[str], periods: float = 252.0) -> DataFrame:
    """Per fold, of trades (keys, day, seq, gross, cost, holding_s): the 14 metrics."""
    w = Window.partitionBy(*keys)
    run = w.orderBy("day", "seq").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("net", F.col("gross") - F.col("cost"))
    t = t.withColumns({"_m": F.avg("net").over(w), "_eq": F.sum("net").over(run)})
    t = t.withColumn("_dd", F.greatest(F.max("_eq").over(run), F.lit(0.0)) - F.col("_eq"))
    days = t.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("_most"), F.count(F.lit(1)).alias("active_days"))
    c = F.col("net") - F.col("_m")
    m2, m3, m4 = F.avg(c * c), F.avg(c * c * c), F.avg(c * c * c * c)
    flat = m2 <= 1e-24
    agg = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("gross").alias("gross_pnl_points"), F.sum("cost").alias("cost_points"), F.sum("net").alias("net_pnl_points"),
        F.when(F.stddev_samp("net") > 1e-12, F.avg("net") / F.stddev_samp("net") * math.sqrt(periods)).otherwise(0.0).alias("sharpe"), F.max("_dd").alias("max_dd_points"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.floor(F.avg("holding_s")).alias("avg_holding_s"),
        F.when(flat, 0.0).otherwise(m3 / F.pow(m2, F.lit(1.5))).alias("skew"), F.when(flat, 3.0).otherwise(m4 / (m2 * m2)).alias("kurtosis"),
    )
    return agg.join(days, keys).withColumn("max_day_share", F.col("_most") / F.col("n_trades")).drop("_most")


def aggregate_folds(folds: DataFrame, keys: list[str], unit: str = "partitions", expected: int = 28, periods: float = 252.0) -> DataFrame:
    """One gate row per trial. Partitions overlap, so counts are medians (whole part); paths do not, so counts are sums."""
    overlap = unit == "partitions"
    med = lambda c: F.percentile(c, F.lit(0.5))
    count = (lambda c: F.floor(med(c)).cast("long")) if overlap else (lambda c: F.sum(c).cast("long"))
    middle = folds.groupBy(*keys).agg(med("net_pnl_points").alias("_net"))
    sign = F.when(F.col("_net") >= 0, 1.0).otherwise(-1.0)
    total = (lambda c: F.sum(c)) if overlap else (lambda c: F.avg(c))
    out = folds.join(middle, keys).groupBy(*keys).agg(
        count("n_trades").alias("total_trades"), F.min("n_trades").alias("min_path_trades"), count("active_days").alias("active_days"), F.max("max_day_share").alias("max_day_share"),
        total("gross_pnl_points").alias("gross_points"), total("cost_points").alias("cost_points"), F.avg((F.col("net_pnl_points") * sign < 0).cast("double")).alias("sign_flip_frac"),
        deannualised(med("sharpe"), periods).alias("sr"), med("skew").alias("skew"), med("kurtosis").alias("kurtosis"), F.count(F.lit(1)).alias("units"),
    )
    return out.withColumn("n_obs", F.greatest("total_trades", F.lit(2))).withColumn("complete", F.col("units") == expected)


def collapse(rows: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """verdict: the first cut that a trial (gate row with pbo, dsr, robust) fails, in a fixed order."""
    x = limits
    v = (
        F.when(F.col("total_trades") < x["min_total_trades"], "INSUFFICIENT_SAMPLE").when(F.col("min_path_trades") < x["min_trades_per_path"], "INSUFFICIENT_SAMPLE")
        .when(F.col("active_days") < x["min_active_days"], "INSUFFICIENT_SAMPLE").when(F.col("max_day_share") > x["max_trade_concentration"], "INSUFFICIENT_SAMPLE")
        .when(F.col("gross_points") <= F.col("cost_points"), "COST_DOMINATED").when(F.col("sign_flip_frac") > x["max_sign_flip_frac"], "UNSTABLE_ACROSS_FOLDS")
        .when(F.col("pbo") > x["max_pbo"], "FAILED_GATE").when(F.col("dsr") < x["min_dsr"], "FAILED_GATE").when(~F.col("robust"), "FAILED_GATE").otherwise("ACCEPTED")
    )
    return rows.withColumn("verdict", v)


def overfitting(perf: DataFrame, n_blocks: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    """by, pbo, combinations: of perf (by, t, config, value), how often the best configuration in one half of the blocks is in the lower half of the other.

    Each (block, config) is reduced to count, mean and squared deviations once; halves merge those, so the work beyond the
    first aggregation depends on blocks and configurations only. All groups of `by` are worked on together.
    """
    if n_blocks < 2 or n_blocks % 2:
        raise StatisticsError("blocks must be even")
    spark, by = perf.sparkSession, list(by)
    place = perf.select(*by, "t").distinct().withColumn("day", F.floor(F.col("t") / 1024))
    # the ordinal of t: offsets of chunks of t, then the place within the chunk
    chunk = place.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(*by)
    chunk = chunk.withColumns({"before": F.coalesce(F.sum("c").over(whole.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("c").over(whole)})
    index = place.join(chunk, [*by, "day"]).withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy(*by, "day").orderBy("t")) - 1)
    base, extra = F.floor(F.col("n") / n_blocks), F.col("n") % n_blocks
    wide = extra * (base + 1)
    block = F.when(F.col("i") < wide, F.floor(F.col("i") / (base + 1))).otherwise(extra + F.floor((F.col("i") - wide) / F.greatest(base, F.lit(1))))
    stats = perf.join(index.select(*by, "t", block.cast("int").alias("block")), [*by, "t"]).groupBy(*by, "block", "config").agg(
        F.count("value").alias("c"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v")
    )
    halves = list(combinations(range(n_blocks), n_blocks // 2))
    member = spark.createDataFrame([(k, b, int(b in set(h))) for k, h in enumerate(halves) for b in range(n_blocks)], "combo int, block int, inside int")
    side = stats.join(F.broadcast(member), "block")  # as many rows as halves times blocks, whatever the data
    side = side.groupBy(*by, "combo", "config", "inside").agg(F.sum("c").alias("c"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("m"), F.collect_list(F.struct("c", "m", "v")).alias("parts"))
    m2 = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["c"] * p["v"] + p["c"] * (p["m"] - F.col("m")) * (p["m"] - F.col("m")))
    side = side.withColumn("sd", F.sqrt(m2 / (F.col("c") - 1)))
    side = side.withColumn("sharpe", F.when(F.col("sd") > 1e-12, F.col("m") / F.col("sd")).otherwise(0.0)).withColumn("sharpe", F.round("sharpe", 12))
    best = side.where("inside = 1").groupBy(*by, "combo").agg(F.max(F.struct("sharpe", -F.col("config"))).alias("b"), F.count(F.lit(1)).alias("configs"))
    best = best.select(*by, "combo", (-F.col("b").getField("col2")).alias("config"), "configs")
    w = Window.partitionBy(*by, "combo")
    rank = side.where("inside = 0").withColumn("r", F.rank().over(w.orderBy("sharpe"))).withColumn("r", F.col("r") + (F.count(F.lit(1)).over(Window.partitionBy(*by, "combo", "sharpe")) - 1) / 2.0)
    omega = rank.join(best, [*by, "combo", "config"]).withColumn("omega", F.col("r") / (F.col("configs") + 1))
    return omega.groupBy(*by).agg(F.avg((F.col("omega") <= 0.5).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("combinations"))


def judge(nets: DataFrame, key: str) -> DataFrame:
    """noise, subperiods, costs, parameters, robust: per trial, of nets (key, battery, variant, net); battery "reference" has the plain run."""
    is_ = lambda b: F.col("battery") == b
    got = nets.groupBy(key).agg(
        F.max(F.when(is_("reference"), F.col("net"))).alias("_ref"), F.percentile(F.when(is_("noise"), F.col("net")), F.lit(0.5)).alias("_noise"), F.count_if(is_("noise")).alias("_n_noise"),
        F.min(F.when(is_("subperiod"), F.col("net"))).alias("_sub"), F.count_if(is_("subperiod")).alias("_n_sub"), F.min(F.when(is_("cost"), F.col("net"))).alias("_cost"),
        F.count_if(is_("cost")).alias("_n_cost"), F.min(F.when(is_("parameter"), F.col("net"))).alias("_par"), F.count_if(is_("parameter")).alias("_n_par"),
    )
    up = F.col("_ref") > 0
    out = got.select(
        key, ((F.col("_n_noise") == NOISE_RESAMPLES) & (F.col("_noise") > 0)).alias("noise"), ((F.col("_n_sub") == SUBPERIODS) & up & (F.col("_sub") > 0)).alias("subperiods"),
        ((F.col("_n_cost") == len(COST_FACTORS)) & (F.col("_cost") > 0)).alias("costs"), (up & ((F.col("_n_par") == 0) | (F.col("_par") > 0))).alias("parameters"),
    )
    return out.withColumn("robust", F.coalesce(F.col("noise") & F.col("subperiods") & F.col("costs") & F.col("parameters"), F.lit(False)))


def validate_outcome(folds: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Per trial, how many rows break each rule, and whether the outcome is valid."""
    number = ("gross_pnl_points", "cost_points", "net_pnl_points", "sharpe", "max_dd_points", "hit_rate", "max_day_share", "skew", "kurtosis")
    finite = F.lit(True)
    for c in number:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    off = F.abs(F.col("gross_pnl_points") - F.col("cost_points") - F.col("net_pnl_points")) > 1e-6 * F.greatest(F.lit(1.0), F.abs("gross_pnl_points"))
    out = folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("path_id").alias("_paths"), F.min("path_id").alias("_lo"), F.max("path_id").alias("_hi"), F.count_if(~finite).alias("not_finite"),
        F.count_if((F.col("n_trades") < 0) | (F.col("cost_points") < 0) | (F.col("max_dd_points") < 0)).alias("negative"), F.count_if(~F.col("hit_rate").between(0, 1)).alias("bad_hit_rate"), F.count_if(off).alias("net_mismatch"),
    )
    ids = (F.col("_paths") == expected) & (F.col("_lo") == 0) & (F.col("_hi") == expected - 1)
    ok = (F.col("rows") == expected) & ids & (F.col("not_finite") + F.col("negative") + F.col("bad_hit_rate") + F.col("net_mismatch") == 0)
    return out.withColumn("bad_ids", ~ids).withColumn("valid", ok).drop("_paths", "_lo", "_hi")


def round_trip_points(costs: dict, factor: float = 1.0) -> float:
    """Slippage on both sides; scaled ticks round up."""
    return 2 * math.ceil(costs["slippage_ticks"] * factor) * costs["tick_size"]


def fees(costs: dict, contracts: Column, sides: int = 2, factor: float = 1.0) -> Column:
    return contracts * F.lit(float(sides * factor * (costs["exchange_fee"] + costs["brokerage"])))
