"""Readers and writers of the file formats: market CSV, calendar, telemetry, YAML settings, JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewick.plans.formula import MarketDataError

#: Names of columns in market files, ours first.
ALIASES = {
    "date": ("date",), "time": ("time",), "datetime": ("datetime",), "open": ("open",), "high": ("high",), "low": ("low",), "close": ("close",),
    "tick_volume": ("tickvol", "tick_volume"), "real_volume": ("vol", "volume", "real_volume"),
}

TELEMETRY = T.StructType([
    T.StructField(n, k) for n, k in [
        ("ts", T.StringType()), ("bar_time", T.TimestampNTZType()), ("signal", T.StringType()), ("threshold", T.DoubleType()), ("decision", T.StringType()), ("contracts", T.IntegerType()),
        ("ref_price", T.DoubleType()), ("fill_price", T.StringType()), ("slippage_ticks", T.StringType()), ("order_status", T.StringType()), ("position", T.IntegerType()),
        ("daily_pnl_points", T.DoubleType()), ("guard_blocked", T.StringType()), ("kill_metric_name", T.StringType()), ("kill_metric_value", T.StringType()),
    ]
])
OPTIONAL = ("signal", "fill_price", "slippage_ticks", "kill_metric_value")


#: Characters at the begin of a file that decide what separates its fields.
SNIFFED = 4096


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line: the lines of text files with their numbers, from 1, blank ones counted.

    A file is read in splits. A line's number is its place in the split and the count of lines in the splits before, which is a row for each split.
    """
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))
    splits = x.groupBy("file", "begin").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.join(splits.withColumn("before", before), ["file", "begin"]).select("value", "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"))


def read_market_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars ts, open, high, low, close, tick_volume, real_volume of a CSV or TSV file; ts is the bar's end, a minute after the file's time.

    A field that is no time or no finite number is refused, with the number of its line; so is a line with too few fields. Columns that the file lacks are 0.
    """
    lines = numbered(spark, path).where("trim(value) <> ''").withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    head = lines.orderBy("line").limit(64).collect()  # enough for the characters that decide
    if not head:
        raise MarketDataError(f"{path} is empty")
    start = "\n".join(r.value for r in head)[:SNIFFED]
    sep = max("\t,;", key=start.count)
    names = [re.sub(r"[^a-z_]", "", x.lower()) for x in head[0].value.split(sep)]
    place = {ours: names.index(a) for ours, known in ALIASES.items() for a in known if a in names}
    if "close" not in place or not ("datetime" in place or "date" in place):
        raise MarketDataError(f"{path} lacks a time or close column")
    fields = F.split("value", re.escape(sep))
    field = lambda c: F.trim(F.get(fields, F.lit(place[c])))
    text = field("datetime") if "datetime" in place else F.concat_ws(" ", field("date"), field("time") if "time" in place else F.lit("00:00"))
    text = F.regexp_replace(text, r"[./]", "-")
    ts = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")]).cast("timestamp_ntz")
    number = {c: field(c).try_cast("double") for c in ("open", "high", "low", "close", "tick_volume", "real_volume") if c in place}
    rows = lines.where(F.col("line") > head[0].line).select("line", (ts + F.expr("INTERVAL 1 MINUTE")).alias("ts"), *[v.alias(c) for c, v in number.items()])
    wrong = F.when(F.col("ts").isNull(), "time")
    for c in number:
        wrong = F.coalesce(wrong, F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), c))
    found = rows.withColumn("wrong", wrong).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("wrong").isNotNull(), F.struct("line", "wrong"))).alias("bad")).first()
    if found.bad is not None:
        raise MarketDataError(f"{path}: line {found.bad.line}: no {found.bad.wrong} can be read")
    if not found.n:
        raise MarketDataError(f"{path} has no rows")
    return rows.select("ts", *[F.col(c) if c in number else F.lit(0.0).alias(c) for c in ("open", "high", "low", "close", "tick_volume", "real_volume")])


def write_calendar(calendar: DataFrame, path: str) -> None:
    calendar.select("day", "bars_expected").write.mode("overwrite").csv(path, header=True)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="day date, bars_expected int")


def typed_telemetry(raw: DataFrame) -> DataFrame:
    """An empty text or nan is a missing number."""
    missing = lambda c: F.lower(F.trim(c)).isin("", "nan")
    return raw.withColumns({c: F.when(~missing(F.col(c)), F.col(c).try_cast("double")) for c in OPTIONAL}).withColumn("guard_blocked", F.when(F.trim("guard_blocked") != "", F.col("guard_blocked")))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Batch read; the header must be exact and bar_time must increase."""
    out = typed_telemetry(spark.read.csv(path, header=True, schema=TELEMETRY, enforceSchema=False)).withColumn("_file", F.input_file_name())
    before = F.lag("bar_time").over(Window.partitionBy("_file").orderBy(F.monotonically_increasing_id()))
    if not out.withColumn("_b", before).where("bar_time <= _b").isEmpty():
        raise MarketDataError("bar_time does not increase")
    return out.drop("_file")


def stream_telemetry(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Telemetry with hypothesis_id as a stream of the files below path/hypothesis_id=.., at most so many in a micro-batch."""
    schema = T.StructType([*TELEMETRY.fields, T.StructField("hypothesis_id", T.StringType())])
    reader = spark.readStream.schema(schema).option("header", True)
    return typed_telemetry((reader.option("maxFilesPerTrigger", files) if files else reader).csv(path))


def write_telemetry(rows: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """CSV with the exact header; `by` names columns beside it that become folders."""
    text = rows.select(*[F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in TELEMETRY], *by)
    text.write.mode(mode).partitionBy(*by).csv(path, header=True)


def load_costs(path: str) -> dict[str, float]:
    """The cost model; all fields must be there, finite and not negative."""
    import math

    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f)
    want = {"point_value", "tick_size", "slippage_ticks", "exchange_fee", "brokerage", "margin_per_contract"}
    if not isinstance(got, dict) or set(got) != want or any(isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0 for v in got.values()):
        raise ValueError(f"costs need exactly {sorted(want)}, finite and not negative")
    return got


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def save_frame(frame: DataFrame, path: str) -> None:
    """Aligned bars, a folder for each day."""
    frame.repartition("day").sortWithinPartitions("day", "ts").write.mode("overwrite").partitionBy("day").parquet(path)


def load_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
