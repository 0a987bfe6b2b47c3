"""Calibration of the gate: generated strategies over given bars, through every cut, and the rate at which they are accepted.

Strategies are signals (formulas, evaluated together, so that subtrees are shared) times settings (threshold, direction, bars held). Every bar whose
signal passes the threshold is a trade from its close to the close so many bars later.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewick.operators import cross_validation as cv
from tidewick.operators import gate, prep, robustness
from tidewick.plans.compiler import evaluate
from tidewick.plans.formula import neighbours, parse
from tidewick.sources.shared import new_folder, written


@dataclass(frozen=True)
class Setting:
    config: int
    threshold: float
    direction: int
    hold: int


def settings(thresholds, directions, holds) -> list[Setting]:
    every = [(t, d, h) for t in thresholds for d in directions for h in holds]
    return [Setting(i, *x) for i, x in enumerate(every)]


def as_column(some: list[Setting]) -> Column:
    return F.array(*[F.struct(F.lit(s.config).alias("config"), F.lit(s.threshold).alias("threshold"), F.lit(s.direction).alias("direction"), F.lit(s.hold).alias("hold")) for s in some])


def trades(bars: DataFrame, formulas: Mapping, some: list[Setting], cost: float) -> DataFrame:
    """series, name, config, day, seq, gross, cost, holding_s: the trades of every strategy (name, config) on each series of bars."""
    w = Window.partitionBy("series").orderBy("ts")
    x = evaluate(bars, formulas)
    exits = F.create_map(*[c for h in sorted({s.hold for s in some}) for c in (F.lit(h), F.lead("close", h).over(w))])
    ends = F.create_map(*[c for h in sorted({s.hold for s in some}) for c in (F.lit(h), F.lead("ts", h).over(w))])
    x = x.withColumns({"_exits": exits, "_ends": ends})
    x = x.select("series", "ts", "day", "close", "_exits", "_ends", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in formulas])).alias("s")).where("s.value is not null")
    passed = F.filter(as_column(some), lambda c: F.abs(F.col("s.value")) > c["threshold"])
    x = x.select("series", "ts", "day", "close", "_exits", "_ends", "s.name", "s.value", F.explode(passed).alias("c"))
    x = x.withColumns({"_exit": F.expr("_exits[c.hold]"), "_end": F.expr("_ends[c.hold]")}).where("_exit is not null")
    seconds = F.unix_timestamp(F.col("_end").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    gross = (F.col("_exit") - F.col("close")) * F.signum("value") * F.col("c.direction")
    return x.select("series", "name", F.col("c.config").alias("config"), "day", F.col("ts").alias("seq"), gross.alias("gross"), F.lit(cost).alias("cost"), seconds.cast("double").alias("holding_s"))


def gate_rows(made: DataFrame, days: DataFrame, parts: DataFrame, blocks: int) -> DataFrame:
    """name, config and a gate row with pbo and dsr for each strategy, of its trades: folds by partitions of days, the overfitting probability of each signal's settings, and the Sharpe ratio deflated by the spread over all strategies."""
    key = ["name", "config"]
    folds = made.join(F.broadcast(days), "day").join(F.broadcast(parts), "grp")  # tables of days and of partitions
    rows = gate.aggregate_folds(gate.fold_metrics(folds, [*key, "path_id"]), key)
    daily = made.groupBy(*key, "day").agg(F.sum(F.col("gross") - F.col("cost")).alias("net"))
    grid = made.select(*key).distinct().withColumn("one", F.lit(1)).join(days.select("day").withColumn("one", F.lit(1)), "one").drop("one")  # a row for each strategy and day
    perf = grid.join(daily, [*key, "day"], "left").select("name", "config", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("t"), F.round(F.coalesce("net", F.lit(0.0)), 6).alias("value"))
    pbo = gate.overfitting(perf, blocks, ("name",)).select("name", "pbo")
    spread = rows.agg(F.var_samp("sr").alias("var_sr"), F.count(F.lit(1)).alias("trials"))
    rows = rows.join(pbo, "name").join(F.broadcast(spread))  # one row
    rows = rows.withColumn("star", F.expr(gate.sr_star_sql("var_sr", "trials")))
    return gate.deflated_sharpe(rows, "sr", "star", "n_obs", "skew", "kurtosis")


def rerun(bars: DataFrame, formulas: Mapping[str, str], some: list[Setting], cost: float, tick: float) -> DataFrame:
    """name, config, battery, variant, net: the strategies on noise, slices of time, at dearer costs and with neighbouring windows; those without a trade have net 0."""
    named = lambda x, name: x.withColumn("battery", F.lit(name))
    runs = named(bars.withColumn("variant", F.lit(0)), "reference").unionByName(named(robustness.noisy(bars, tick), "noise")).unionByName(named(robustness.slices(bars), "subperiod"))
    runs = runs.withColumn("series", F.struct("battery", "variant"))
    every = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(s.config).alias("config")) for k in formulas for s in some])
    made = trades(runs, formulas, some, cost).select("series.*", "name", "config", "gross")
    wanted = runs.select("battery", "variant").distinct().select("battery", "variant", F.explode(every).alias("e")).select("battery", "variant", "e.*")
    for k, text in formulas.items():
        for v, other in enumerate(neighbours(parse(text))):
            x = trades(bars, {k: other}, some, cost).select(F.lit("parameter").alias("battery"), F.lit(v).alias("variant"), "name", "config", "gross")
            made = made.unionByName(x)
            wanted = wanted.unionByName(bars.sparkSession.createDataFrame([("parameter", v, k, s.config) for s in some], wanted.schema))
    got = made.groupBy("battery", "variant", "name", "config").agg(F.count(F.lit(1)).alias("n"), F.sum("gross").alias("gross"))
    x = wanted.join(got, ["battery", "variant", "name", "config"], "left").select("battery", "variant", "name", "config", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("gross", F.lit(0.0)).alias("gross"))
    net = lambda f: F.col("gross") - F.col("n") * cost * f
    dearer = [F.struct(F.lit("cost").alias("battery"), F.lit(k).alias("variant"), net(f).alias("net")) for k, f in enumerate(gate.COST_FACTORS)]
    own = F.struct("battery", "variant", net(1.0).alias("net"))
    return x.select("name", "config", F.explode(F.when(F.col("battery") == "reference", F.array(own, *dearer)).otherwise(F.array(own))).alias("r")).select("name", "config", "r.*")


def verdicts(bars: DataFrame, formulas: Mapping[str, str], some: list[Setting], cost: float, tick: float, limits: dict, blocks: int = 6) -> DataFrame:
    """name, config, verdict of each strategy with a trade in every partition's test days, of bars (series, ts, day, close ..) of one series.

    Cuts are made in their order, so only strategies that pass all others are run again for robustness.
    """
    folder = new_folder(bars.sparkSession, "calibration")
    frame = prep.positions(bars)
    days = cv.day_groups(frame, limits["n_groups"])
    parts = cv.partitions(bars.sparkSession, limits["n_groups"], limits["k_test"])
    rows = gate_rows(trades(frame, formulas, some, cost), days, parts, blocks)
    first = written(gate.collapse(rows.withColumn("robust", F.lit(True)), limits).select("name", "config", "verdict"), f"{folder}/first")
    passed = first.where("verdict = 'ACCEPTED'").select("name", "config")
    again = {r.name for r in passed.select("name").distinct().collect()}  # signals, of those that were given
    if not again:
        return first
    nets = rerun(frame, {k: f for k, f in formulas.items() if k in again}, some, cost, tick).join(passed, ["name", "config"], "left_semi")
    robust = gate.judge(nets.withColumn("trial", F.struct("name", "config")), "trial").select("trial.*", "robust")
    return first.join(robust, ["name", "config"], "left").select("name", "config", F.when(F.col("robust") == F.lit(False), "FAILED_GATE").otherwise(F.col("verdict")).alias("verdict"))


def rates(found: DataFrame) -> DataFrame:
    """verdict, n, share of all strategies."""
    n = found.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row for each verdict
