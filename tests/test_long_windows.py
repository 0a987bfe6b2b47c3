"""Windows put together from running aggregates, against sliding frames."""

import time

import pytest
from pyspark.sql import functions as F

from tidewick.plans import compiler
from tidewick.plans.compiler import evaluate

OPS = ("rolling_mean", "rolling_max", "rolling_min", "rolling_std", "zscore", "rank_ts")


def made(spark, n, series=2):
    """Prices near 130,000 in steps of 5; a stretch is flat, some values are missing."""
    step = F.pmod(F.hash("id", "k"), F.lit(9)) - 4
    flat = F.col("id").between(400, 520)
    close = F.when(flat, 130_000.0).when(F.col("id") % 211 == 7, None).otherwise(130_000 + 5.0 * step + 40 * F.sin(F.col("id") / 50))
    ts = F.expr("timestampadd(MINUTE, id, timestamp_ntz'2026-01-05 00:00:00')")
    return spark.range(n).crossJoin(spark.range(series).withColumnRenamed("id", "k")).select(F.col("k").cast("string").alias("series"), ts.alias("ts"), close.alias("close"), (close - 3).alias("low"))


@pytest.mark.parametrize("block", [None, 150])
def test_long_windows_equal_sliding_frames(spark, monkeypatch, block):
    bars = made(spark, 1200)
    names = {f"{op}_{w}": f"{op}(close(),{w})" for op in OPS for w in (2, 55)} | {"inner": "zscore(rolling_mean(low(),40),60)", "both": "sub(rank_ts(delta(close(),1),33),zscore(close(),55))"}
    rows = lambda: evaluate(bars, names, block).orderBy("series", "ts").select("series", "ts", *names).collect()
    want = rows()
    monkeypatch.setattr(compiler, "LINEAR", 1)
    for a, b in zip(rows(), want, strict=True):
        assert (a.series, a.ts) == (b.series, b.ts)
        for n in names:
            assert (a[n] is None) == (b[n] is None), (n, a, b)
            assert a[n] is None or abs(a[n] - b[n]) / max(1, abs(b[n])) < 1e-9, (n, a[n], b[n])
    flat = [r for r in want if r.series == "0"][460]
    assert flat.rolling_std_55 == 0.0 == flat.zscore_55 and flat.rank_ts_55 == 0.0


def test_cost_does_not_grow_with_the_window(spark):
    bars = made(spark, 12_000, 1).cache()
    bars.count()

    def seconds(w):
        began = time.perf_counter()
        evaluate(bars, {op: f"{op}(low(),{w})" for op in OPS}).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(300)
    assert seconds(5000) < 4 * seconds(300) + 1


def test_a_long_window_over_missing_values_and_few_rows(spark):
    bars = made(spark, 700, 1)
    out = evaluate(bars, {"r": "rank_ts(close(),300)", "m": "rolling_mean(close(),300)", "far": "rolling_max(low(),900)"}).agg(F.count("r"), F.count("m"), F.count("far")).first()
    assert tuple(out) == (122, 122, 0)  # from 219 to 639 no value is missing; 900 rows there are not
