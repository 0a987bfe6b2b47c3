"""Streams against batch results: typed state, warm start, restarts, late bars, timers, live frames, the collector."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewick.plans.compiler import evaluate
from tidewick.queries import streams
from tidewick.queries.streams import NODES, finished
from tidewick.streaming import signals

BARS = "series string, ts timestamp, close double, high double, low double, volume double, trades double, vwap double, ref_ES double, ref_WDO double"


def made(series, days, per_day=40, seed=1, first=5):
    rng = random.Random(seed)
    out, p = [], 1000.0
    for d in range(days):
        for m in range(per_day):
            p += rng.choice([-5.0, 0.0, 5.0])
            ts = dt.datetime(2026, 1, first, 9, 0) + dt.timedelta(days=d, minutes=5 * m)
            es = None if rng.random() < 0.01 else p / 20 + rng.gauss(0, 1)
            out.append((series, ts, p, p + rng.randrange(3), p - rng.randrange(3), float(rng.randrange(1, 90)), float(rng.randrange(1, 9)), p, es, p / 30 + rng.gauss(0, 1)))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(made("A", 9) + made("B", 9, seed=2), BARS)


def batch(bars, formulas):
    out = evaluate(bars.withColumn("ts", F.col("ts").cast("timestamp_ntz")), formulas).collect()
    return {(r.series, r.ts, k): r[k] for r in out for k in formulas}


def files(bars, where, days):
    """One file for each of the days given."""
    for d in days:
        bars.where(F.dayofmonth("ts") == d).coalesce(1).write.mode("append").parquet(where)


def source(spark, where):
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(where)


def same(rows, want):
    got = {(r.series, r.ts, r.name): r.value for r in rows if r.kind == "bar"}
    assert len(got) == sum(r.kind == "bar" for r in rows) and got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k] is None) == (w is None), k
        assert w is None or abs(got[k] - w) / max(1, abs(w)) < 1e-9, k


def test_all_nodes_over_a_restart_equal_the_batch(spark, bars, tmp_path):
    where, again = str(tmp_path / "in"), str(tmp_path / "run")
    files(bars, where, range(5, 9))
    rows = finished(signals.stream_signals(source(spark, where), NODES), again).collect()
    assert {r.ts.day for r in rows} == set(range(5, 9))
    files(bars, where, range(9, 14))  # a new query goes on from the checkpoint
    rows = finished(signals.stream_signals(source(spark, where), NODES), again).collect()
    same(rows, batch(bars, NODES))


def test_state_filled_from_history(spark, bars, tmp_path):
    old = F.dayofmonth("ts") < 10
    files(bars.where(~old), str(tmp_path / "in"), range(10, 14))
    rows = finished(signals.stream_signals(source(spark, str(tmp_path / "in")), NODES, bars.where(old)), str(tmp_path / "run")).collect()
    same(rows, {k: v for k, v in batch(bars, NODES).items() if k[1].day >= 10})


def test_late_bars_change_nothing(spark, bars, tmp_path):
    where = str(tmp_path / "in")
    files(bars, where, (5, 6))
    bars.where("dayofmonth(ts) = 5 and hour(ts) = 10").withColumn("close", F.lit(9e9)).coalesce(1).write.mode("append").parquet(where)
    files(bars, where, (7,))
    one = {"x": "rolling_mean(close(),8)"}
    rows = finished(signals.stream_signals(source(spark, where), one), str(tmp_path / "run")).collect()
    late = [r for r in rows if r.kind == "late"]
    assert len(late) == 24 and all(r.error and r.value is None for r in late)
    same(rows, {k: v for k, v in batch(bars, one).items() if k[1].day <= 7})


def test_cutoff_timers(spark, bars, tmp_path):
    """Forty bars of five minutes from 9:00; the cutoff at 11:00 is passed by once a later day has moved the watermark."""
    where = str(tmp_path / "in")
    files(bars, where, (5, 6, 7))
    rows = finished(signals.stream_signals(source(spark, where), {"x": "close()"}, cutoff=11 * 60, late="1 minute"), str(tmp_path / "run")).collect()
    cut = sorted((r.series, r.ts) for r in rows if r.kind == "cutoff")
    assert set(cut) >= {(s, dt.datetime(2026, 1, d, 11)) for s in "AB" for d in (5, 6)} and len(cut) == len(set(cut))


def test_frame_waits_for_all_references(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, dt.datetime(2026, 1, d, 9, m), float(m), 1.0) for d in range(5, 9) for m in range(30) for s in ("WIN", "ES", "WDO", "XX") if rng.random() < 0.8]
    rows += [("WIN", None, 1.0, 1.0), (None, dt.datetime(2026, 1, 5, 9, 0), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double")
    where = str(tmp_path / "in")
    for d in range(5, 9):
        df.where(F.dayofmonth("ts") == d).orderBy("symbol").repartition(2).write.mode("append").parquet(where)
    frame = signals.stream_frame(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(where), "WIN", ("ES", "WDO"))
    got = sorted((r.ts, r.close, r.ref_ES, r.ref_WDO) for r in finished(frame, str(tmp_path / "run")).collect())
    have = {(s, t) for s, t, *_ in rows}
    want = sorted((t, c, c, c) for s, t, c, _ in rows if s == "WIN" and t and {("ES", t), ("WDO", t)} <= have)
    assert got == want and 20 < len(got) < 96


def test_state_is_kept_in_no_more_parts_than_cores(spark, tmp_path):
    """Bars are found once for all files, and a session with many shuffle partitions has no more stores for it."""
    rows = [(s, dt.datetime(2026, 1, d, 9, m), float(m), 1.0) for d in range(5, 9) for m in range(10) for s in ("WIN", "ES", "WDO")]
    found = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            found.add(b.num_rows)
            yield b

    schema = "symbol string, ts timestamp, close double, volume double"
    df = spark.createDataFrame(rows, schema).mapInArrow(run, schema)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = finished(signals.stream_frame(streams.streamed(spark, df, str(tmp_path)), "WIN", ("ES", "WDO")), str(tmp_path / "run")).count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [p for p in (tmp_path / "run/state/state/0").iterdir() if p.name.isdigit()]
    assert got == 40 and found.value == len(rows) and 1 < len(stores) <= spark.sparkContext.defaultParallelism


def test_a_single_window(spark, bars, tmp_path):
    files(bars, str(tmp_path / "in"), (5, 6))
    one = {"lag": "lag(close(),1)", "rank": "rank_ts(close(),1)", "std": "rolling_std(close(),1)", "ema": "ema(close(),1)", "max": "rolling_max(close(),1)"}
    rows = finished(signals.stream_signals(source(spark, str(tmp_path / "in")), one), str(tmp_path / "run")).collect()
    same(rows, {k: v for k, v in batch(bars, one).items() if k[1].day <= 6})


COSTS = {"point_value": 0.2, "tick_size": 5, "slippage_ticks": 1, "exchange_fee": 0.25, "brokerage": 0.0, "margin_per_contract": 155.0}


def telemetry(spark, days, hypotheses=("h1", "h2"), kill=lambda h, d: float(d)):
    rows = []
    for h in hypotheses:
        for d in days:
            for m in range(4):
                t = dt.datetime(2026, 2, d, 10, m)
                rows.append((h, t.isoformat(), t, None, 1.5, "OPEN_LONG" if m == 1 else "REJECTED" if m == 2 and d % 2 else "NONE", 1 if m == 1 else 0, 100.0, None, 2.0 if m == 1 else None, "", 0, float(m + d), None, "spread", kill(h, d)))
    schema = "hypothesis_id string, ts string, bar_time timestamp_ntz, signal double, threshold double, decision string, contracts int, ref_price double, fill_price double, slippage_ticks double, order_status string, position int, daily_pnl_points double, guard_blocked string, kill_metric_name string, kill_metric_value double"
    return spark.createDataFrame(rows, schema)


def held(c):
    return [sorted(map(str, x.collect())) for x in (c.daily(), c.kills(), c.alerts())]


def test_collector_writes_each_row_once(spark, tmp_path):
    from tidewick.operators import monitor
    from tidewick.sources import files as fl
    from tidewick.streaming.collector import Collector

    calendar = spark.createDataFrame([(dt.date(2026, 2, d), 4 if d < 6 else 5) for d in range(1, 12)], "day date, bars_expected int")
    c = Collector(spark, str(tmp_path / "out"), calendar, COSTS, 1.0, 3, 4.0)
    assert held(c) == [[], [], []]
    every = telemetry(spark, range(1, 10))
    for days in (range(1, 4), range(4, 7), range(7, 10)):  # a new query each time, from the same checkpoint
        fl.write_telemetry(every.where(F.dayofmonth("bar_time").isin(*days)), str(tmp_path / "in"), ("hypothesis_id",), "append")
        c.run(fl.stream_telemetry(spark, str(tmp_path / "in")), str(tmp_path / "state"))
    whole = monitor.daily_summary(every.withColumn("day", F.to_date("bar_time")), calendar, COSTS)
    kills = monitor.first_kills(monitor.kill_states(whole, 3, 4.0))
    columns = c.daily().columns
    assert held(c) == [sorted(map(str, x.collect())) for x in (whole.select(*columns), kills, monitor.alerts(whole, 1.0))]
    assert c.kills().count() == 2 and c.alerts().where("reason = 'bars'").count() == 8
    before = held(c)
    # A batch is run again by force, with the rows that it had, then one with days that were collected before.
    c.collect(every.where(F.dayofmonth("bar_time").between(4, 6)), 1)
    assert held(c) == before
    c.collect(telemetry(spark, range(1, 9), kill=lambda h, d: 99.0), 3)
    assert held(c) == before


def test_collector_after_a_crash_between_its_writes(spark, tmp_path, monkeypatch):
    from tidewick.sources import files as fl
    from tidewick.streaming.collector import Collector

    calendar = spark.createDataFrame([(dt.date(2026, 2, 1), 4)], "day date, bars_expected int")
    c = Collector(spark, str(tmp_path / "out"), calendar, COSTS, 1.0, 1, 0.5)
    fl.write_telemetry(telemetry(spark, [1]), str(tmp_path / "in"), ("hypothesis_id",))
    rows = lambda: fl.stream_telemetry(spark, str(tmp_path / "in"))
    write, told = Collector.write, []

    def broken(self, df, name, *a):
        told.append(name)
        if name == "kills":
            raise RuntimeError("lost")
        return write(self, df, name, *a)

    monkeypatch.setattr(Collector, "write", broken)
    with pytest.raises(Exception, match="lost"):
        c.run(rows(), str(tmp_path / "state"))
    assert told == ["daily", "alerts", "kills"] and c.daily().count() == 2 and c.kills().count() == 0
    monkeypatch.setattr(Collector, "write", write)
    c.run(rows(), str(tmp_path / "state"))
    assert c.daily().count() == 2 and c.kills().count() == 2 and c.alerts().where("reason = 'rejections'").count() == 2
    c.collect(telemetry(spark, []), 1)  # nothing came
    assert c.daily().count() == 2
