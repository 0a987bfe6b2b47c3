"""The order simulation against a plain walk, bar by bar."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewick.operators import orders
from tidewick.operators.orders import Rules

SCHEMA = "series string, ts timestamp_ntz, close double, high double, low double, signal double, pos long, roll_day boolean"


def grid(p, tick, side):
    import math

    q = p / tick
    return (math.ceil(q - 1e-9) if side > 0 else math.floor(q + 1e-9)) * tick


def plain(bars, r, warmup):
    """The contract read bar by bar; returns order rows."""
    out, held, rest, day, pnl, refusals = [], None, None, None, 0.0, 0
    for b in bars:
        if None in (b["ts"], b["close"], b["high"], b["low"]):
            continue
        ts, tod = b["ts"], b["ts"].hour * 60 + b["ts"].minute
        if ts.date() != day:
            day, pnl, refusals = ts.date(), 0.0, 0
        if held is not None:
            o, side, px = held, held["side"], held["fill_px"]
            stop = px - side * r.stop_points if r.stop_points is not None else None
            goal = px + side * r.target_points if r.target_points is not None else None
            if stop is not None and (b["low"] <= stop if side > 0 else b["high"] >= stop):
                x, kind = grid(stop, r.tick, -side) - side * r.tick, "STOP"
            elif goal is not None and (b["high"] > goal if side > 0 else b["low"] < goal):
                x, kind = grid(goal, r.tick, -side), "TARGET"
            elif tod >= r.cutoff or ts - o["fill_ts"] >= dt.timedelta(minutes=r.max_holding):
                x, kind = grid(b["close"], r.tick, -side) - side * r.tick, "FLATTEN"
            else:
                continue
            o.update(exit_ts=ts, exit_px=x, exit_kind=kind, points=(x - px) * side)
            pnl += o["points"]
            held = None
            continue
        if rest is not None:
            o, side = rest, rest["side"]
            if ts.date() != o["ts"].date() or tod >= r.cutoff or ts - o["ts"] > dt.timedelta(minutes=r.life):
                o["status"], rest = "EXPIRED", None
            elif b["low"] < o["level"] if side > 0 else b["high"] > o["level"]:
                o.update(status="FILLED", fill_ts=ts, fill_px=o["level"])
                held, rest = o, None
                continue
            else:
                continue
        s = None if b["signal"] is None or b["pos"] < warmup else b["signal"] * r.direction
        side = 0 if s is None else 1 if s > r.threshold else -1 if s < -r.threshold else 0
        if not side:
            continue
        why = "BREAKER" if refusals >= r.max_refusals else "DAILY_LOSS" if pnl <= -r.daily_loss else "CUTOFF" if tod >= r.cutoff or tod > r.session[1] else None
        why = why or ("SESSION" if tod <= r.session[0] else "ROLL_DAY" if b["roll_day"] else "MARGIN" if r.contracts * r.margin > r.equity else None)
        refusals += why in orders.COUNTED
        o = {"ts": ts, "side": side, "status": "REJECTED" if why else "FILLED", "reason": why, "refusals": refusals, "day_points": pnl}
        out.append(o)
        if why:
            continue
        if r.limit_points is None:
            o.update(fill_ts=ts, fill_px=grid(b["close"], r.tick, side) + side * r.tick)
            held = o
        else:
            o.update(status="RESTING", level=grid(b["close"] - side * r.limit_points, r.tick, side))
            rest = o
    return out


def made(seed, days=12, step=20, begin=8 * 60, end=19 * 60, gaps=0.05):
    """Days of bars; some bars and some days are missing, some values are null."""
    rng = random.Random(seed)
    rows, price, pos = [], 1000.0, 0
    for d in range(days):
        if rng.random() < 0.15:
            continue
        for t in range(begin, end, step):
            if rng.random() < gaps:
                continue
            price += rng.gauss(0, 12)
            hi, lo = price + abs(rng.gauss(0, 8)), price - abs(rng.gauss(0, 8))
            close = None if rng.random() < 0.02 else round(price, 1)
            signal = None if rng.random() < 0.05 else rng.gauss(0, 1.5)
            rows.append((dt.datetime(2026, 1, 1) + dt.timedelta(days=d, minutes=t), close, round(hi, 1), round(lo, 1), signal, pos, d % 5 == 3))
            pos += 1
    return rows


CASES = {
    "market": (Rules(stop_points=30.0, target_points=25.0, max_holding=60, daily_loss=60.0), {}),
    "held into the night": (Rules(max_holding=2000, cutoff=1441, session=(0, 1441), stop_points=80.0, daily_loss=50.0), {"step": 60, "begin": 0, "end": 1440}),
    "held for days": (Rules(max_holding=6000, cutoff=1441, session=(0, 1441), target_points=150.0), {"step": 240, "begin": 0, "end": 1440, "days": 40}),
    "limit": (Rules(limit_points=10.0, life=60, max_holding=90, threshold=0.7, direction=-1, tick=0.5), {}),
    "limit at night": (Rules(limit_points=6.0, life=500, max_holding=1500, cutoff=1441, session=(60, 1441), threshold=0.4), {"step": 30, "begin": 0, "end": 1440}),
    "margin": (Rules(contracts=40), {}),
}


@pytest.mark.parametrize("case", CASES)
def test_orders_equal_a_walk_bar_by_bar(spark, case):
    r, shape = CASES[case]
    series = {f"s{k}": made(k, **shape) for k in range(4)}
    df = spark.createDataFrame([(n, *x) for n, rows in series.items() for x in rows], SCHEMA).repartition(5)
    columns = ("ts", "side", "status", "reason", "fill_ts", "fill_px", "exit_ts", "exit_px", "exit_kind", "points", "refusals", "day_points")
    got = sorted((x.series, *(x[c] for c in columns)) for x in orders.simulate(df, r, 3).collect())
    want = []
    for n, rows in series.items():
        for o in plain([dict(zip(("ts", "close", "high", "low", "signal", "pos", "roll_day"), x, strict=True)) for x in rows], r, 3):
            want.append((n, *(o.get(c) for c in columns)))
    assert len(got) == len(want) and len(want) > 20
    for a, b in zip(got, sorted(want), strict=True):
        assert a == pytest.approx(b, abs=1e-6) if None not in a else [round(x, 6) if isinstance(x, float) else x for x in a] == [round(x, 6) if isinstance(x, float) else x for x in b]


def test_every_reason_occurs_and_days_are_counted(spark):
    r = Rules(stop_points=30.0, max_holding=60, daily_loss=60.0)
    df = spark.createDataFrame([("s", *x) for x in made(1, days=20)], SCHEMA)
    out = orders.simulate(df, r)
    assert {x.reason for x in out.select("reason").distinct().collect()} >= {None, "BREAKER", "DAILY_LOSS", "CUTOFF", "SESSION", "ROLL_DAY"}
    rows = orders.rejections(out).collect()
    assert all(x.orders == x.filled + x.expired + x.rejected for x in rows)
    assert all(sum((x.by_reason or {}).values()) == x.rejected for x in rows) and sum(x.rejected for x in rows) == out.where("status = 'REJECTED'").count()


def test_a_series_without_bars_has_no_orders(spark):
    assert orders.simulate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_series_that_is_never_flat_at_night(spark):
    """Two years of hourly bars in one series, always in a position: the walks between days are found by doubling."""
    n = 24 * 730
    ts = F.expr("timestampadd(HOUR, id, timestamp_ntz'2016-01-01 00:00:00')")
    price = 1000 + 50 * F.sin(F.col("id") / 37) + F.pmod(F.hash("id"), F.lit(17))
    df = spark.range(n).select(F.lit("s").alias("series"), ts.alias("ts"), price.alias("close"), (price + 3).alias("high"), (price - 3).alias("low"), F.sin(F.col("id") / 5).alias("signal"), F.col("id").alias("pos"), F.lit(False).alias("roll_day"))
    r = Rules(threshold=0.1, max_holding=300, cutoff=1441, session=(-1, 1441), daily_loss=1e9)
    out = orders.simulate(df, r)
    x = out.agg(F.count(F.lit(1)), F.count_if(F.expr("exit_ts <= fill_ts")), F.min("fill_ts"), F.max("fill_ts")).first()
    assert x[0] > n / 8 and x[1] == 0 and (x[3] - x[2]).days > 720
    nxt = F.lead("ts").over(Window.partitionBy("series").orderBy("ts"))
    assert out.withColumn("n", nxt).where("n <= exit_ts").count() == 0
