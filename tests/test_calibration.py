"""The gate over generated strategies: noise is turned away, an edge that is there passes, and reruns are what they claim to be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.operators import calibration, gate, prep
from tests.test_engine import pbo_brute

LIMITS = {**gate.LIMITS, "min_total_trades": 20, "min_trades_per_path": 5, "min_active_days": 5, "max_trade_concentration": 0.6}


def made(spark, edge, days=64, per_day=24):
    """Hourly bars; with an edge, every rise is followed by a fall."""
    rng = np.random.default_rng(2)
    step = rng.normal(0, 4, days * per_day)
    if edge:
        step[1::2] = -step[::2] * 0.9 + rng.normal(0, 0.5, len(step) // 2)
    p = 1000 + np.cumsum(step)
    rows = [("s", i, float(round(x * 2) / 2)) for i, x in enumerate(p)]
    ts = F.expr("timestampadd(HOUR, i, timestamp_ntz'2026-01-01 00:30:00')")
    df = spark.createDataFrame(rows, "series string, i int, close double").withColumn("ts", ts)
    return df.withColumns({"day": F.to_date("ts"), "high": F.col("close") + 1, "low": F.col("close") - 1, "open": F.col("close"), "vwap": F.col("close"), "volume": F.lit(1.0), "trades": F.lit(1.0)}).drop("i")


SIGNALS = {"slow": "zscore(delta(close(),1),21)", "level": "zscore(close(),13)"}
GRID = calibration.settings((0.5, 1.0), (1, -1), (1, 2))


def test_an_edge_passes_and_noise_does_not(spark):
    noise = {(r.name, r.config): r.verdict for r in calibration.verdicts(made(spark, False), SIGNALS, GRID, 0.2, 0.5, LIMITS).collect()}
    assert len(noise) == 16 and "ACCEPTED" not in noise.values()
    # The edge itself spreads the Sharpe ratios, so that their deflation would turn it away.
    real = {(r.name, r.config): r.verdict for r in calibration.verdicts(made(spark, True), SIGNALS, GRID, 0.2, 0.5, {**LIMITS, "max_pbo": 0.6, "min_dsr": 0.0}).collect()}
    good = {k for k, v in real.items() if v == "ACCEPTED"}
    assert good and all(GRID[c].direction == -1 for _, c in good)
    share = {r.verdict: (r.n, r.share) for r in calibration.rates(spark.createDataFrame([(v,) for v in real.values()], "verdict string")).collect()}
    assert share["ACCEPTED"] == (len(good), pytest.approx(len(good) / 16))


def test_reruns(spark):
    frame = prep.positions(made(spark, True, days=16))
    some = GRID[:3]
    rows = calibration.rerun(frame, {"slow": SIGNALS["slow"]}, some, 0.2, 0.5).collect()
    count = {b: sum(r.battery == b for r in rows) for b in ("reference", "noise", "subperiod", "cost", "parameter")}
    assert count == {"reference": 3, "noise": 300, "subperiod": 9, "cost": 6, "parameter": 3 * 2}
    t = calibration.trades(frame, {"slow": SIGNALS["slow"]}, some, 0.2).groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.sum("gross").alias("g")).collect()
    ref = {r.config: r.net for r in rows if r.battery == "reference"}
    assert {r.config: pytest.approx(r.g - 0.2 * r.n) for r in t} == ref
    assert {(r.config, r.variant): pytest.approx(r.net) for r in rows if r.battery == "cost"} == {(r.config, k): r.g - 0.2 * f * r.n for r in t for k, f in enumerate(gate.COST_FACTORS)}


def test_trades_are_what_the_signal_says(spark):
    bars = made(spark, False, days=6)
    from tidewick.plans.compiler import evaluate

    rows = evaluate(bars, SIGNALS).orderBy("ts").collect()
    want = []
    for i, r in enumerate(rows):
        for name in SIGNALS:
            for s in GRID:
                if r[name] is not None and abs(r[name]) > s.threshold and i + s.hold < len(rows):
                    want.append((name, s.config, r.ts, (rows[i + s.hold].close - r.close) * np.sign(r[name]) * s.direction, 3600.0 * s.hold))
    got = [(r.name, r.config, r.seq, r.gross, r.holding_s) for r in calibration.trades(bars, SIGNALS, GRID, 0.1).collect()]
    assert sorted(got) == sorted(want)


def test_overfitting_of_groups_equals_each_alone(spark):
    rng = np.random.default_rng(9)
    data = {g: rng.normal(0, 1, (50 + 7 * k, 5)) + (np.arange(5) == 3) * k / 2 for k, g in enumerate("abc")}
    rows = [(g, t * (k + 1), c, float(v)) for k, (g, x) in enumerate(data.items()) for t, r in enumerate(x) for c, v in enumerate(r)]
    df = spark.createDataFrame(rows, "g string, t long, config int, value double")
    got = {r.g: (r.pbo, r.combinations) for r in gate.overfitting(df, 6, ("g",)).collect()}
    assert got == {g: (pytest.approx(pbo_brute(x, 6)), 20) for g, x in data.items()}
    one = gate.overfitting(df.where("g = 'b'"), 6).first()
    assert one.asDict() == {"pbo": pytest.approx(pbo_brute(data["b"], 6)), "combinations": 20}
