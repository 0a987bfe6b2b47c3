"""The battery of robustness: a trial's formula and order rules, run again.

Each rerun is a series of its own, so reruns are evaluated and simulated beside each other by the plan that serves one
series. What grows is the number of series, not the length of any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewick.operators import gate, robot
from tidewick.plans.compiler import evaluate
from tidewick.plans.formula import Node, lookback, neighbours, parse

SHIFTED = ("open", "high", "low", "close", "vwap")


def noisy(bars: DataFrame, tick: float, resamples: int = gate.NOISE_RESAMPLES) -> DataFrame:
    """bars (.., pos) once for each resample, its variant: all prices of a bar a tick up or down, by a hash of resample and place."""
    x = bars.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    odd = F.ascii(F.md5(F.concat(F.col("variant").cast("string"), F.lit(":"), F.col("pos").cast("string")))) % 2
    shift = F.when(odd == 0, tick).otherwise(-tick)
    return x.withColumns({c: F.col(c) + shift for c in SHIFTED if c in bars.columns})


def slices(bars: DataFrame, periods: int = gate.SUBPERIODS) -> DataFrame:
    """bars with variant, the slice in time; pos counts from the slice's first bar."""
    x = bars.join(bars.groupBy("series").agg(F.count(F.lit(1)).alias("_n")), "series")
    x = x.withColumn("variant", F.expr(f"int(pos * {periods} div _n)"))
    return x.withColumn("pos", F.expr(f"pos - (variant * _n + {periods - 1}) div {periods}")).drop("_n")


def signal_of(runs: DataFrame, tree: Node) -> DataFrame:
    """series, battery, variant, ts, pos, close, signal; no signal before the formula has seen the bars it looks back to."""
    runs = runs.withColumn("series", F.struct("series", "battery", "variant"))
    x = evaluate(runs, {"signal": tree})
    return x.select("series", "ts", "pos", "close", F.when(F.col("pos") >= lookback(tree), F.col("signal")).alias("signal"))


def battery(bars: DataFrame, formula: str | Node, costs: dict, limits: robot.Limits, threshold: float = 1.5, direction: int = 1, max_holding: int = 30) -> DataFrame:
    """series, battery, variant, trades, net of bars (series, ts, pos, prices ..), a row for each rerun; those without a trade have net 0.

    "reference" is the plain run, "noise" has every price a tick off, "subperiod" one slice of time each, "parameter" all
    windows a bucket lower or higher (none where that changes nothing), "cost" the reference at higher costs.
    """
    tree = parse(formula) if isinstance(formula, str) else formula
    named = lambda x, name: x.withColumn("battery", F.lit(name))
    same = named(bars.withColumn("variant", F.lit(0)), "reference").unionByName(named(noisy(bars, limits.tick_size), "noise")).unionByName(named(slices(bars), "subperiod"))
    runs = signal_of(same, tree)
    for k, other in enumerate(neighbours(tree)):
        runs = runs.unionByName(signal_of(named(bars.withColumn("variant", F.lit(k)), "parameter"), other))
    sim = robot.simulate(runs, 0, limits, threshold, direction, max_holding=max_holding)
    made = sim.groupBy("series").agg(F.count("gross").alias("trades"), F.coalesce(F.sum("gross"), F.lit(0.0)).alias("gross")).select("series.*", "trades", "gross")

    def trip(factor: float) -> float:
        """A round trip's costs in points."""
        return gate.round_trip_points(costs, factor) + 2 * factor * (costs["exchange_fee"] + costs["brokerage"]) / costs["point_value"]

    plain = F.struct("battery", "variant", F.lit(trip(1.0)).alias("trip"))
    dearer = [F.struct(F.lit("cost").alias("battery"), F.lit(k).alias("variant"), F.lit(trip(f)).alias("trip")) for k, f in enumerate(gate.COST_FACTORS)]
    runs_of = F.when(F.col("battery") == "reference", F.array(plain, *dearer)).otherwise(F.array(plain))
    x = made.select("series", "trades", "gross", F.explode(runs_of).alias("r")).select("series", "r.*", "trades", "gross")
    return x.select("series", "battery", "variant", "trades", (F.col("gross") - F.col("trades") * F.col("trip")).alias("net"))
