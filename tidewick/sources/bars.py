"""Bars from tables: resampling, and the aligned frame of a main symbol with its references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REFS = ("ES", "WDO")
#: Which label of each table stands for which symbol.
LINEITEM = {"N": "WIN", "A": "ES", "R": "WDO"}
EVENTS = {"view": "WIN", "click": "ES", "purchase": "WDO"}


def named(label: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def resample(rows: DataFrame, bucket: Column, price: Column, volume: Column, tie: list[Column]) -> DataFrame:
    """Bars of (symbol, bucket): open and close are the first and last price in the order of tie."""
    rows = rows.withColumns({"_ts": bucket, "_p": price.cast("double"), "_v": volume.cast("double"), "_o": F.struct(*tie)}).where("symbol is not null")
    return rows.groupBy("symbol", F.col("_ts").alias("ts")).agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"),
        F.count(F.lit(1)).cast("double").alias("trades"), F.sum("_v").alias("volume"),
    )


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each return flag."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("symbol", named(F.col("l_returnflag"), LINEITEM))
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return resample(t, F.col("l_shipdate").cast("timestamp_ntz"), F.col("l_extendedprice"), F.col("l_quantity"), order)


def event_bars(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    """Bars of `hours` of three event types; ts is the end of the bar."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("symbol", named(F.col("event_type"), EVENTS)).where("value is not null")
    seconds = hours * 3600
    begin = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds + seconds
    return resample(t, F.timestamp_seconds(begin).cast("timestamp_ntz"), F.col("value"), F.lit(1.0), [F.col("ts"), F.col("event_id")])


def build_frame(bars: DataFrame, main: str = "WIN", refs: tuple[str, ...] = REFS, session: tuple[int, int] = (0, 1440)) -> DataFrame:
    """The main symbol's bars at the timestamps that every reference has too.

    The bars are read once: those of one time meet in a window. Of a reference's repeated bars the largest close counts.
    """
    at = Window.partitionBy("ts")
    met = bars.where(F.col("symbol").isin(main, *refs) & F.col("ts").isNotNull())
    met = met.withColumns({f"ref_{r}": F.max(F.when(F.col("symbol") == r, F.col("close"))).over(at) for r in refs} | {f"_has_{r}": F.count_if(F.col("symbol") == r).over(at) > 0 for r in refs})
    out = met.where(F.col("symbol") == main).where(reduce(Column.__and__, [F.col(f"_has_{r}") for r in refs], F.lit(True)))
    out = out.drop("symbol", *[f"_has_{r}" for r in refs]).withColumn("series", F.lit(main))
    tod = F.hour("ts") * 60 + F.minute("ts")
    return out.withColumns({
        "vwap": (F.col("high") + F.col("low") + F.col("close")) / 3, "session_mask": (tod > session[0]) & (tod <= session[1]), "day": F.to_date("ts"),
    })


def invariants(frame: DataFrame, refs: tuple[str, ...] = REFS) -> DataFrame:
    """One row of counts that must all be 0 (but rows)."""
    values = ["close", "high", "low", "volume", "trades", "vwap", *(f"ref_{r}" for r in refs)]
    bad = F.lit(False)
    for v in values:
        bad = bad | F.col(v).isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    before = F.lag("ts").over(Window.partitionBy("series").orderBy("ts"))
    return frame.withColumn("_before", before).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ts").isNull()).alias("no_time"), F.count_if(F.col("ts") <= F.col("_before")).alias("not_increasing"), F.count_if(bad).alias("not_finite"),
    )
