"""Streaming queries, run to the end of what is there and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewick.queries.bars_sql import E
from tidewick.queries.formulas import CASES, CORE, translation
from tidewick.queries.operations import COSTS, KILL_SQL, expected_bars, telemetry
from tidewick.queries.preparation import frame_e, stamp
from tidewick.sources import files
from tidewick.sources.bars import REFS, event_bars
from tidewick.sources.shared import new_folder, written
from tidewick.streaming import signals
from tidewick.streaming.collector import Collector


def finished(out, where: str, mode: str = "append"):
    """Runs a stream over what is there and returns what it wrote.

    Each stateful step keeps its stores in as many parts as there are cores, however many partitions the session's shuffles have: every micro-batch opens and commits them all.
    """
    spark = out.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    conf = {**signals.STORE, "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        q = out.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")


def in_order(bars, where: str, files: int = 4) -> str:
    """Writes bars as files of slices of time, the earliest first, and returns their folder. Bars are found once; ranges of time are sorted each on its own."""
    bars = written(bars, f"{where}/bars")
    lo, hi = bars.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    width = ((hi or 0) - (lo or 0)) // files + 1
    for k in range(files):
        bars.where(F.floor((F.unix_timestamp("ts") - F.lit(lo or 0)) / width) == k).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(f"{where}/in")
    return f"{where}/in"


def streamed(spark, bars, where: str):
    """The bars as a stream of one file at a time."""
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(in_order(bars, where))


def stream_bars(spark, d):
    return frame_e(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).drop("day", "session_mask")


def stream_signal(spark, d):
    where = new_folder(spark, "stream")
    out = finished(signals.stream_signal(streamed(spark, stream_bars(spark, d), where), CORE), where)
    return out.select(stamp("ts").alias("ts"), F.round("signal", 6).alias("value"), "error")


#: Every kind of node once, some of them inside each other.
NODES = {
    "fields": "sub(high(),low())", "reference": 'delta(ref("WDO"),2)', "lagged": "lag(ret(close(),2),3)", "mean": "rolling_mean(vwap(),13)", "spread": "rolling_std(delta(close(),1),21)",
    "extremes": "sub(rolling_max(high(),8),rolling_min(low(),8))", "smooth": "ema(rolling_mean(close(),5),8)", "standard": "clip(zscore(close(),34),-2,2)", "rank": "rank_ts(volume(),21)",
    "clock": 'and_(in_window("09:00","17:00"), gt(minutes_since_open(), const(120,"Time")))',
}


def stream_nodes(spark, d):
    """The first hundred hours of the bars are history that fills the state; the others stream."""
    where, bars = new_folder(spark, "stream"), stream_bars(spark, d)
    begin = bars.agg(F.min("ts")).first()[0]
    new = F.col("ts") > F.lit(begin) + F.expr("interval 100 hours")
    out = finished(signals.stream_signals(streamed(spark, bars.where(new), where), NODES, bars.where(~new)), where)
    return out.select(stamp("ts").alias("ts"), F.col("name").alias("formula"), F.when(F.round("value", 6) == 0, 0.0).otherwise(F.round("value", 6)).alias("value"))


def stream_frame(spark, d):
    """The bars of all symbols stream; each main bar waits for its references, then for its signal."""
    where, b = new_folder(spark, "stream"), event_bars(spark, d)
    b = b.withColumn("ts", F.col("ts").cast("timestamp"))
    frame = finished(signals.stream_frame(streamed(spark, b, where), "WIN", REFS), where)
    return frame.select(stamp("ts").alias("ts"), "series", *[F.round(c, 6).alias(c) for c in ("close", "high", "low", "volume", "ref_ES", "ref_WDO")])


def stream_collect(spark, d):
    """Telemetry is written as files of a week each and collected as a stream: daily rows, kills and alerts, in long form."""
    where, rows = new_folder(spark, "stream"), telemetry(spark, d)
    begin = rows.agg(F.min("day")).first()[0]
    lines = rows.withColumns({"ts": F.lpad(F.col("ts").cast("string"), 12, "0"), "threshold": F.lit(1.0), "ref_price": F.lit(0.0), "position": F.lit(0), "kill_metric_name": F.lit("value")})
    lines = lines.withColumns({"signal": F.lit(None), "fill_price": F.lit(None), "week": F.floor(F.datediff("day", F.lit(begin)) / 7)})
    weeks = (lines.agg(F.max("week")).first()[0] or 0) + 1
    c = Collector(spark, f"{where}/out", expected_bars(rows), COSTS, 1.0, 5, 12.0)
    for k in range(weeks):  # a file of each hypothesis for each week, and a micro-batch for each week
        files.write_telemetry(lines.where(F.col("week") == k).repartition("hypothesis_id"), f"{where}/in", ("hypothesis_id",), "append")
        c.run(files.stream_telemetry(spark, f"{where}/in"), f"{where}/state")
    daily, kills, alerts = c.daily(), c.kills(), c.alerts()
    out = daily.select(F.lit("daily").alias("kind"), "hypothesis_id", "day", F.lit(None).cast("string").alias("what"), "bars_recorded", "trades", "rejections", F.round("net_pnl_points", 6).alias("value"))
    out = out.unionByName(kills.select(F.lit("kill").alias("kind"), "hypothesis_id", "day", F.round("value", 6).alias("value")), allowMissingColumns=True)
    out = out.unionByName(alerts.select(F.lit("alert").alias("kind"), "hypothesis_id", "day", F.concat_ws(":", "alert", "reason").alias("what")), allowMissingColumns=True)
    return out.withColumn("day", F.col("day").cast("string"))


def stream_daily(spark, d):
    """The last day stays open: no later event moves the watermark past it."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    out = finished(signals.stream_daily(source), new_folder(spark, "stream"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (stream_signal, stream_nodes, stream_frame, stream_collect, stream_daily)}
ORACLE_SQL = {
    "stream_signal": f"{E} SELECT ts, value, NULL::VARCHAR AS error FROM ({CASES['formula_spread'][2]})",
    "stream_nodes": f"SELECT ts, formula, value FROM ({translation('E', NODES)}) WHERE ts::TIMESTAMP > (SELECT min(ts::TIMESTAMP) FROM ({translation('E', {'first': 'close()'})})) + INTERVAL 100 HOUR",
    "stream_frame": f"{E} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'WIN' AS series, {', '.join(f'round({c}, 6) AS {c}' for c in ('close', 'high', 'low', 'volume', 'ref_ES', 'ref_WDO'))} FROM b",
    "stream_collect": f"""{KILL_SQL}
SELECT 'daily' AS kind, hypothesis_id, day::VARCHAR AS day, NULL::VARCHAR AS what, bars_recorded, trades, rejections, round(net_pnl_points, 6) AS value FROM dd
UNION ALL SELECT 'kill', hypothesis_id, min(day)::VARCHAR, NULL, NULL, NULL, NULL, round(arg_min(value, day), 6) FROM ks WHERE state = 'DEAD' GROUP BY hypothesis_id
UNION ALL SELECT 'alert', hypothesis_id, day::VARCHAR, what, NULL, NULL, NULL, NULL FROM (
  SELECT hypothesis_id, day, unnest([CASE WHEN bars_recorded <> bars_expected THEN 'OPERATIONAL:bars' END, CASE WHEN rejections > 0 THEN 'OPERATIONAL:rejections' END, CASE WHEN strange THEN 'OPERATIONAL:guards' END,
    CASE WHEN abs(slippage_ticks_avg - 1) / 1 > 0.3 THEN 'DIVERGENCE:slippage' END]) AS what FROM dd) WHERE what IS NOT NULL""",
    "stream_daily": """WITH m AS (SELECT max(ts)::TIMESTAMP - INTERVAL 1 DAY AS mark FROM events)
SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, m WHERE ts::DATE + INTERVAL 1 DAY <= mark GROUP BY 1, 2""",
}
