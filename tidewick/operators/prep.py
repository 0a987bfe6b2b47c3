"""Preparing bars: stitching contracts, alignment, quality checks, hold-out, digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewick.plans.formula import MarketDataError

PRICES = ("open", "high", "low", "close")
MAX_GAP_MINUTES = 3
MIN_CORR = 0.05


def stitch(parts: list[DataFrame]) -> DataFrame:
    """One back-adjusted series of contracts given from the oldest to the newest; the newest prices stay.

    A contract gives way at the last time that it shares with what follows it, and is shifted by the difference of closes there.
    """
    times = [p.select(F.lit(i).alias("c"), "ts", "close") for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, times)
    newer = every.select((F.col("c") - 1).alias("c"), "ts", F.col("close").alias("_new"))
    met = every.join(newer, ["c", "ts"]).groupBy("c").agg(F.max("ts").alias("at"), F.max_by(F.col("_new") - F.col("close"), "ts").alias("diff"))
    rolls = {r.c: r for r in met.collect()}  # a row for each contract but the newest
    if len(rolls) < len(parts) - 1:
        raise MarketDataError("two contracts share no time")
    days = [F.lit(r["at"].date()) for r in rolls.values()]
    out = []
    for i, part in enumerate(parts):
        shift = sum(rolls[k]["diff"] for k in range(len(parts) - 2, i - 1, -1))
        if i in rolls:
            part = part.where(F.col("ts") < F.lit(rolls[i]["at"]))
        if i:
            part = part.where(F.col("ts") >= F.lit(rolls[i - 1]["at"]))
        moved = part.withColumns({p: F.col(p) + F.lit(shift) for p in PRICES}) if i in rolls else part
        out.append(moved.withColumn("roll_day", F.to_date("ts").isin(*days) if i else F.lit(False)))
    return reduce(DataFrame.unionByName, out)


def dropped(bars: DataFrame, main: str, refs: tuple[str, ...]) -> DataFrame:
    """How many of the main symbol's bars lack a reference."""
    times = bars.where(F.col("symbol") == main).select("ts")
    kept = reduce(lambda a, r: a.join(bars.where(F.col("symbol") == r).select("ts"), "ts", "left_semi"), refs, times)
    return times.agg(F.count(F.lit(1)).alias("bars")).crossJoin(kept.agg(F.count(F.lit(1)).alias("aligned"))).withColumn("dropped", F.col("bars") - F.col("aligned"))  # one row each


def alignment(frame: DataFrame, *symbols: str, max_lag: int = 3, least: int = 100) -> DataFrame:
    """symbol, lag, corr for each of symbols: at which shift the log returns of the main symbol and a reference agree best; the first of equals, (0, 0.0) without enough data.

    The frame is read once; references are shifted side by side.
    """
    w = Window.partitionBy("series").orderBy("ts")
    gain = lambda c: F.log(F.col(c) / F.lag(c).over(w))
    gains = frame.select("series", "ts", gain("close").alias("m"), *[gain(f"ref_{s}").alias(f"r_{s}") for s in symbols])
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), F.col(f"r_{s}").alias("r")) for s in symbols]))
    r = gains.select("series", "ts", "m", pairs.alias("x")).select("series", "ts", "m", "x.*").where("m is not null and r is not null")
    w = Window.partitionBy("series", "symbol").orderBy("ts")
    lags = list(range(-max_lag, max_lag + 1))
    shifted = r.withColumns({f"m{i}": F.lead("m", k).over(w) if k >= 0 else F.lag("m", -k).over(w) for i, k in enumerate(lags)})
    aggs = []
    for i in range(len(lags)):
        pair = F.col(f"m{i}").isNotNull()
        x, y = F.when(pair, F.col(f"m{i}")), F.when(pair, F.col("r"))
        aggs += [F.count(x).alias(f"n{i}"), F.stddev_pop(x).alias(f"sx{i}"), F.stddev_pop(y).alias(f"sy{i}"), F.corr(x, y).alias(f"c{i}")]
    every = frame.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, symbols))).alias("symbol"))
    one = every.join(shifted.groupBy("symbol").agg(*aggs), "symbol", "left")
    options = F.array(*[F.when((F.col(f"n{i}") >= least) & (F.col(f"sx{i}") > 0) & (F.col(f"sy{i}") > 0), F.struct(F.col(f"c{i}").alias("corr"), F.lit(-i).alias("first"), F.lit(k).alias("lag"))) for i, k in enumerate(lags)])
    best = F.array_max(F.array_compact(options))
    return one.select("symbol", F.coalesce(best["lag"], F.lit(0)).alias("lag"), F.coalesce(best["corr"], F.lit(0.0)).alias("corr"))


def gaps(frame: DataFrame, minutes: int = MAX_GAP_MINUTES) -> DataFrame:
    """after, before, minutes: pauses within a day's session."""
    w = Window.partitionBy("series", "day").orderBy("ts")
    marked = frame.withColumns({"_ts": F.lag("ts").over(w), "_in": F.lag("session_mask").over(w)})
    length = F.expr("timestampdiff(MINUTE, _ts, ts)")
    return marked.where(F.col("session_mask") & F.col("_in")).select("series", F.col("_ts").alias("after"), F.col("ts").alias("before"), length.alias("minutes")).where(F.col("minutes") > minutes)


def quality(frame: DataFrame) -> DataFrame:
    """One row: bars, days, first and last day, bars without volume, repeated times."""
    return frame.agg(
        F.count(F.lit(1)).alias("bars"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"), (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicated"),
    )


def report_ok(gap_count: Column, duplicated: Column, lags: Column) -> Column:
    """lags: an array of structs (lag, corr)."""
    return (gap_count == 0) & (duplicated == 0) & F.forall(lags, lambda x: (x["lag"] == 0) | (F.abs(x["corr"]) < MIN_CORR))


def calendar(frame: DataFrame) -> DataFrame:
    return frame.groupBy("day").agg(F.count(F.lit(1)).cast("int").alias("bars_expected"))


def holdout_cut(frame: DataFrame, months: int) -> DataFrame:
    return frame.agg(F.add_months(F.trunc(F.max("ts"), "MM"), 1 - months).alias("cut"))


def split_holdout(frame: DataFrame, months: int) -> tuple[DataFrame, DataFrame]:
    """Research and hold-out: the last `months` calendar months are held out."""
    cut = F.broadcast(holdout_cut(frame, months))  # one row
    sides = [frame.join(cut, F.col("ts") < F.col("cut")).drop("cut"), frame.join(cut, F.col("ts") >= F.col("cut")).drop("cut")]
    if any(x.isEmpty() for x in sides):
        raise MarketDataError("one side of the hold-out is empty")
    return sides[0], sides[1]


def positions(frame: DataFrame, pos: str = "pos") -> DataFrame:
    """frame with a column pos, the bar's ordinal in its series: the day's offset plus the place in the day."""
    days = frame.groupBy("series", "day").agg(F.count(F.lit(1)).alias("_n"))
    offset = days.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("series", "day").orderBy("ts"))
    return frame.join(offset, ["series", "day"]).withColumn(pos, F.col("_offset") + place - 1).drop("_offset")


def data_hash(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """data_hash: sha256 of the days' digests in order; a day's digest is the sha256 of its bars' texts in order. Numbers count with 6 decimals."""
    row = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *[F.format_string("%.6f", F.col(c)) for c in columns])
    days = frame.withColumn("_r", row).groupBy("day").agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("ts", "_r"))), lambda x: x["_r"])), 256).alias("_h"))
    return days.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("day", "_h"))), lambda x: x["_h"])), 256).alias("data_hash"))
