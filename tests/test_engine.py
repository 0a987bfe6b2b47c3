"""Operators on hand vectors, properties of the compiler, and the library beside the queries."""

import datetime as dt
import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.operators import cross_validation as cv
from tidewick.operators import gate, ledger, monitor, prep, robot, robustness, texts
from tidewick.plans import formula as fl
from tidewick.plans.compiler import evaluate
from tidewick.sources import files
from tidewick.sources.bars import build_frame

CLOSE = [100.0, 105.0, 95.0, 110.0, 110.0, 110.0, 120.0]
SD = np.std([105, 95, 110], ddof=1)
VECTORS = {
    "lag(close(),2)": [None, None, 100, 105, 95, 110, 110],
    "delta(close(),1)": [None, 5, -10, 15, 0, 0, 10],
    "ret(close(),1)": [None, 0.05, 95 / 105 - 1, 110 / 95 - 1, 0, 0, 120 / 110 - 1],
    "rolling_mean(close(),3)": [None, None, 100, 310 / 3, 105, 110, 340 / 3],
    "rolling_max(close(),3)": [None, None, 105, 110, 110, 110, 120],
    "rolling_min(close(),3)": [None, None, 95, 95, 95, 110, 110],
    "div(delta(close(),1),delta(close(),1))": [None, 1, 1, 1, 0, 0, 1],
    "gt(close(),lag(close(),1))": [None, 1, 0, 1, 0, 0, 1],
    "and_(gt(close(),lag(close(),1)),lt(close(),high()))": [None, 1, 0, 1, 0, 0, 1],
    "clip(zscore(close(),2),0,0)": [None, 0, 0, 0, 0, 0, 0],
    'in_window("10:30","10:32")': [0, 0, 0, 1, 1, 0, 0],
    "minutes_since_open()": [1, 2, 3, 4, 5, 6, 7],
}


@pytest.fixture(scope="module")
def seven(spark):
    t0 = dt.datetime(2026, 3, 2, 10, 28)
    rows = [("WIN", t0 + dt.timedelta(minutes=i), c, c + 5, c - 5, float(i + 1), 1.0, c, c / 20) for i, c in enumerate(CLOSE)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, close double, high double, low double, volume double, trades double, vwap double, ref_ES double")


def values(df, bars, text):
    return [r.v for r in evaluate(bars, {"v": text}).orderBy("ts").collect()]


def test_hand_vectors(seven):
    out = evaluate(seven, {f"v{i}": t for i, t in enumerate(VECTORS)}).orderBy("ts").collect()
    for i, (t, want) in enumerate(VECTORS.items()):
        got = [r[f"v{i}"] for r in out]
        assert [g is None for g in got] == [w is None for w in want], t
        assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], abs=1e-12), t


def test_hand_points(seven):
    got = {t: values(None, seven, t) for t in ("rolling_std(close(),3)", "zscore(close(),3)", "rank_ts(close(),3)", "ema(close(),3)", "rolling_std(close(),1)", "rank_ts(close(),1)", "ema(close(),1)")}
    assert got["rolling_std(close(),3)"][2] == 5.0 and got["rolling_std(close(),3)"][5] == 0.0
    assert got["zscore(close(),3)"][3] == pytest.approx((110 - 310 / 3) / SD) and got["zscore(close(),3)"][5] == 0
    assert [got["rank_ts(close(),3)"][i] for i in (2, 3, 5)] == [-1, 1, 0]
    assert got["ema(close(),3)"][1] is None and got["ema(close(),3)"][2] == 98.75
    assert got["rolling_std(close(),1)"] == [0.0] * 7 == got["rank_ts(close(),1)"] and got["ema(close(),1)"] == CLOSE


def test_missing_symbol_and_constant(seven):
    with pytest.raises(fl.MarketDataError):
        evaluate(seven, {"v": 'zscore(ref("WDO"),2)'})
    with pytest.raises(fl.TypingError):
        evaluate(seven, {"v": "lag(close())"})


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(7)
    t, rows, day = 0, [], dt.datetime(2026, 1, 5, 9, 0)
    p = 130_000.0
    for d in range(12):
        for m in range(60):
            p += 5 * int(rng.integers(-4, 5))
            rows.append(("WIN", day + dt.timedelta(days=d, minutes=m + 1), p, p + 5 * int(rng.integers(0, 3)), p - 5 * int(rng.integers(0, 3)), float(rng.integers(1, 900)), float(rng.integers(1, 90)), p, p / 20 + float(rng.normal()), p / 30 + float(rng.normal())))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, close double, high double, low double, volume double, trades double, vwap double, ref_ES double, ref_WDO double")


def random_formulas(seed, n=9):
    """Formulas grown at random from the operator table; every windowed operator stands in one of them at least."""
    rng = random.Random(seed)
    leaves = ["close()", "high()", "low()", "volume()", "trades()", "vwap()", 'ref("ES")', 'ref("WDO")']
    rest = sorted(fl.WINDOWED)
    rng.shuffle(rest)

    def price(depth):
        if depth == 0:
            return rng.choice(leaves)
        op = rest.pop() if rest else rng.choice(sorted(fl.WINDOWED))
        return f"{op}({price(depth - 1)},{rng.choice([2, 3, 5, 8, 13, 21, 34])})"

    def score(depth):
        return f"zscore({price(depth)},{rng.choice([8, 13, 21])})"

    tops = ["{0}", "clip({0},-2,2)", "add({0},{1})", "sub({0},{1})", "mul({0},{1})", "div({0},{1})", "lag(lt({0},{1}),3)", 'or_(gt({0},{1}),in_window("09:10","09:40"))', "and_(lt({0},{1}),gt(minutes_since_open(),lag(minutes_since_open(),2)))"]
    return [tops[i % len(tops)].format(score(1 + i % 2), score(1)) for i in range(n)] + ["ema(ema(vwap(),8),5)"]


FORMULAS = random_formulas(11)


def test_null_prefix_is_the_lookback(many):
    out = evaluate(many, {f"v{i}": t for i, t in enumerate(FORMULAS)}).orderBy("ts").collect()
    for i, t in enumerate(FORMULAS):
        got = [r[f"v{i}"] is None for r in out]
        n = fl.lookback(fl.parse(t))
        assert got == [True] * n + [False] * (len(got) - n), t


def test_ema_is_null_where_its_input_is(spark):
    rows = [("WIN", dt.datetime(2026, 1, 5, 9, i), None if i == 4 else float(i)) for i in range(6)]
    bars = spark.createDataFrame(rows, "series string, ts timestamp_ntz, close double")
    assert [r.v for r in evaluate(bars, {"v": "ema(close(),3)"}).orderBy("ts").collect()] == [None, None, 1.25, 2.125, None, 3.5625]


def test_blocks_give_the_same(many):
    names = {f"v{i}": t for i, t in enumerate(FORMULAS)}
    whole, cut = (evaluate(many, names, block=b).orderBy("ts").select("ts", *names).collect() for b in (None, 50))
    assert whole == cut


def test_ema_in_blocks_over_many_stretches(spark):
    """Windows of 2 and 3 have stretches of 523 and 830 values; a long run of nulls covers whole blocks."""
    t0 = dt.datetime(2026, 1, 5)
    x = [None if i < 3 or 700 <= i < 900 or i % 97 == 0 else math.sin(i) * 50 + 100 for i in range(2400)]
    bars = spark.createDataFrame([(k, t0 + dt.timedelta(minutes=i), v) for k in ("A", "B") for i, v in enumerate(x)], "series string, ts timestamp_ntz, close double")
    names = {"one": "ema(close(),2)", "two": "ema(ema(close(),2),3)", "around": "rolling_max(ema(close(),3),5)"}
    whole, cut = (evaluate(bars, names, b).orderBy("series", "ts").select("series", "ts", *names).collect() for b in (None, 60))
    assert whole == cut
    e, n, want = 0.0, 0, []
    for v in x:
        if v is not None:
            e, n = (v if n == 0 else e / 3 + v * 2 / 3), n + 1
        want.append(e if v is not None and n >= 2 else None)
    for s in (cut[:2400], cut[2400:]):
        assert [r.one is None for r in s] == [w is None for w in want]
        assert [r.one for r in s if r.one is not None] == pytest.approx([w for w in want if w is not None], rel=1e-12)


def test_frame_keeps_the_times_of_all_references(spark):
    t = [dt.datetime(2026, 1, 5, 9, m) for m in range(4)]
    rows = [("WIN", t[0], 1.0), ("WIN", t[1], 2.0), ("WIN", t[2], 3.0), ("ES", t[0], 7.0), ("ES", t[2], None), ("WDO", t[0], 8.0), ("WDO", t[2], 9.0), ("WDO", t[1], 9.5), ("ES", t[3], 1.0), ("WDO", t[3], 1.0), ("XX", t[1], 0.0)]
    frame = build_frame(spark.createDataFrame([(*r, r[2], r[2]) for r in rows], "symbol string, ts timestamp_ntz, close double, high double, low double"))
    assert sorted((r.ts, r.close, r.ref_ES, r.ref_WDO) for r in frame.collect()) == [(t[0], 1.0, 7.0, 8.0), (t[2], 3.0, None, 9.0)]


def test_alignment_of_two_references_in_one_pass(spark):
    rng = np.random.default_rng(5)
    level = np.exp(np.cumsum(rng.normal(0, 0.01, 304)))
    t0 = dt.datetime(2026, 1, 5)
    rows = [("WIN", t0 + dt.timedelta(minutes=i), float(level[i]), float(level[i + 2]), float(level[i])) for i in range(300)]
    frame = spark.createDataFrame(rows, "series string, ts timestamp_ntz, close double, ref_ES double, ref_WDO double")
    assert {r.symbol: (r.lag, round(r["corr"], 9)) for r in prep.alignment(frame, "ES", "WDO").collect()} == {"ES": (2, 1.0), "WDO": (0, 1.0)}
    assert sorted(prep.alignment(frame.limit(50), "ES", "WDO").collect()) == [("ES", 0, 0.0), ("WDO", 0, 0.0)]
    assert sorted(prep.alignment(frame.limit(0), "ES", "WDO").collect()) == [("ES", 0, 0.0), ("WDO", 0, 0.0)]


def test_a_prefix_of_the_bars_gives_a_prefix_of_the_values(many):
    cut = many.orderBy("ts").limit(400)
    names = {f"v{i}": t for i, t in enumerate(FORMULAS)}
    a = evaluate(many, names).orderBy("ts").limit(400).select(*names).collect()
    assert a == evaluate(cut, names).orderBy("ts").select(*names).collect()


def test_gate_numbers(spark):
    for n, want in ((10, 1.22), (500, 2.36), (2400, 2.71), (3000, 2.75), (5000, 2.86)):
        assert round(gate.sr_star(0.6, n), 2) == want
    row = spark.createDataFrame([(0.25, gate.sr_star(0.001, 3000), 2000, 0.0, 3.0), (9.0, 0.0, 1, 0.0, 3.0)], "sr double, star double, n int, skew double, kurt double")
    got = [r.dsr for r in gate.deflated_sharpe(row, "sr", "star", "n", "skew", "kurt").collect()]
    z = (0.25 - gate.sr_star(0.001, 3000)) * math.sqrt(1999) / math.sqrt(1 + 0.5 * 0.0625)
    assert got == [pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-12), None]
    with pytest.raises(gate.StatisticsError):
        gate.sr_star(0.1, 0)


def pbo_brute(x, blocks):
    from itertools import combinations

    parts = np.array_split(np.arange(len(x)), blocks)
    low = []
    for c in combinations(range(blocks), blocks // 2):
        inside = np.concatenate([parts[i] for i in c])
        outside = np.setdiff1d(np.arange(len(x)), inside)
        sharpe = [x[i].mean(0) / x[i].std(0, ddof=1) for i in (inside, outside)]
        low.append((sharpe[1] <= sharpe[1][sharpe[0].argmax()]).sum() / (x.shape[1] + 1) <= 0.5)
    return np.mean(low)


def test_overfitting(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=(400, 12))
    frame = lambda x: spark.createDataFrame([(t, c, float(x[t, c])) for t in range(len(x)) for c in range(x.shape[1])], "t long, config int, value double")
    assert gate.overfitting(frame(noise), 6).first().pbo == pytest.approx(pbo_brute(noise, 6))
    assert gate.overfitting(frame(noise[:37, :4]), 4).first().pbo == pytest.approx(pbo_brute(noise[:37, :4], 4))
    noise[:, 7] += 0.5
    assert gate.overfitting(frame(noise), 6).first().pbo < 0.05


def test_collapse_order(spark):
    base = {"total_trades": 2000, "min_path_trades": 60, "active_days": 300, "max_day_share": 0.05, "gross_points": 20000.0, "cost_points": 8000.0, "sign_flip_frac": 0.1, "pbo": 0.05, "dsr": 0.99, "robust": True}
    change = [({}, "ACCEPTED"), ({"total_trades": 399}, "INSUFFICIENT_SAMPLE"), ({"max_day_share": 0.26}, "INSUFFICIENT_SAMPLE"), ({"cost_points": 20000.0}, "COST_DOMINATED"), ({"sign_flip_frac": 0.31}, "UNSTABLE_ACROSS_FOLDS"),
              ({"pbo": 0.21}, "FAILED_GATE"), ({"dsr": 0.94}, "FAILED_GATE"), ({"robust": False}, "FAILED_GATE")]
    df = spark.createDataFrame([{**base, **c, "i": i} for i, (c, _) in enumerate(change)])
    assert [r.verdict for r in gate.collapse(df).orderBy("i").collect()] == [v for _, v in change]


def test_stitch(spark):
    t0 = dt.datetime(2026, 1, 5, 9)
    part = lambda lo, hi, add: spark.createDataFrame([(t0 + dt.timedelta(minutes=i), *[100.0 + i + add] * 4, 1.0) for i in range(lo, hi)], "ts timestamp_ntz, open double, high double, low double, close double, real_volume double")
    out = prep.stitch([part(0, 100, 0), part(40, 200, 1500)]).orderBy("ts").collect()
    assert len(out) == 200 and [r.close for r in out] == [1600.0 + i for i in range(200)] and sum(r.roll_day for r in out) > 0
    with pytest.raises(fl.MarketDataError):
        prep.stitch([part(0, 10, 0), part(20, 30, 0)])


def test_market_csv(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2026.01.05\t09:00:00\t1\t2\t0\t1.5\t3\t4\t5\n")
    r = files.read_market_csv(spark, str(a)).first()
    assert (r.ts, r.close, r.tick_volume, r.real_volume) == (dt.datetime(2026, 1, 5, 9, 1), 1.5, 3.0, 4.0)
    b = tmp_path / "b.csv"
    b.write_text("datetime,open,high,low,close,volume\n2026-01-05 09:00,1,2,0,1.5,7\n")
    assert files.read_market_csv(spark, str(b)).first().real_volume == 7.0
    for bad in ("", "datetime,open\n2026-01-05 09:00,1\n", "datetime,close\n", "datetime,close\nyesterday,1\n"):
        b.write_text(bad)
        with pytest.raises(fl.MarketDataError):
            files.read_market_csv(spark, str(b)).collect()


def test_kill_sequence(spark):
    rows = [("h", dt.date(2026, 1, i + 1), v) for i, v in enumerate([1.0, 3.0, 3.0, 3.0])]
    s = monitor.kill_states(spark.createDataFrame(rows, "hypothesis_id string, day date, kill_metric_daily double"), 3, 2.0)
    assert [r.state for r in s.orderBy("day").collect()] == ["INSUFFICIENT", "INSUFFICIENT", "DEAD", "DEAD"]
    assert monitor.first_kills(s).count() == 1


def test_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    base = {"data_hash": "d", "config_hash": "c", "ts": "t"}
    book.append({**base, "kind": "genesis", "trial_id": "g"})
    book.append({**base, "kind": "backtest", "trial_id": "s/1", "ast_hash": "a", "structural_sig": "x"})
    book.append({**base, "kind": "hypothesis", "trial_id": "s/h", "hypothesis_id": "h1", "payload": {"é": 1.5, "a": None}})
    book.append({**base, "kind": "verdict", "trial_id": "s/1/v", "hypothesis_id": "h1", "verdict": "ACCEPTED", "payload": {"family": "F"}})
    assert ledger.verify_chain(book.rows()).first().ok
    assert ledger.count_trials(book.rows()).first().trials == 1
    assert ledger.attempts(book.rows(), "s").first().asDict() == {"trial": "s/1", "hypothesis_id": "h1", "verdict": "ACCEPTED", "sig": "x"}
    for bad in ({"kind": "backtest", "trial_id": "s/1", "ast_hash": "a", "structural_sig": "x"}, {"kind": "genesis", "trial_id": "g"}, {"kind": "verdict", "trial_id": "v", "hypothesis_id": "h"}, {"kind": "backtest", "trial_id": "n", "config_hash": "z"}):
        with pytest.raises(ledger.LedgerError):
            book.append({**base, **bad})
    for c in ("trial_id", "verdict", "payload", "ts", "prev_hash"):
        broken = book.rows().withColumn(c, F.when(F.col("seq") == 3, "tampered").otherwise(F.col(c)))
        assert ledger.verify_chain(broken).first().first_bad == 3


def test_chains_of_long_and_many_books(spark):
    """A book may be longer than a batch and a batch hold many books; no book is a group of its own in Python."""
    rows = [("long", i, f"x{i}") for i in range(1, 25_001)] + [(f"b{k}", i, None if i == 2 else f"é{k}") for k in range(60) for i in (3, 1, 2)] + [(None, 1, "z")]
    df = spark.createDataFrame(rows, "book string, seq long, kind string").repartition(5, "kind")
    x = ledger.chained(df, "book", ("seq", "kind", "prev_hash"), ("book", "seq"))
    assert x.columns == ["book", "seq", "prev_hash", "row_hash"] and "FlatMapGroups" not in x._jdf.queryExecution().toString()
    got = {(r.book, r.seq): (r.prev_hash, r.row_hash) for r in x.collect()}
    want, before = {}, {}
    for b, i, kind in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        p = before.get(b, ledger.ZERO)
        text = json.dumps({"kind": kind, "prev_hash": p, "seq": i}, separators=(",", ":"), ensure_ascii=False)
        before[b] = hashlib.sha256(text.encode()).hexdigest()
        want[b, i] = p, before[b]
    assert got == want
    full = ledger.chained(df, "book", ("seq", "kind", "prev_hash"))
    assert full.columns == ["book", "seq", "kind", "prev_hash", "row_hash"] and ledger.verify_chain(full.where("book like 'b%'").withColumn("kind", F.when(F.col("seq") == 1, "genesis").otherwise("x")), ("book",), ("seq", "kind", "prev_hash")).where("first_bad = 1").count() == 60


def test_bandit(spark):
    fam = spark.createDataFrame([("A", 0, True), ("B", 1, True), ("C", 2, False)], "name string, place int, available boolean")
    history = spark.createDataFrame([("A", "ACCEPTED"), ("A", "COST_DOMINATED"), ("A", "INSUFFICIENT_SAMPLE"), ("B", "INVALID_AST")], "family string, verdict string")
    s = {r.name: r.score for r in ledger.bandit_scores(history, fam).collect()}
    assert s == {"A": pytest.approx(1.9 / 3 + 0.8 * math.sqrt(math.log(4) / 3)), "B": pytest.approx(0.8 * math.sqrt(math.log(4)))}
    assert ledger.pick(ledger.bandit_scores(history.where("family = 'A'"), fam)).first().name == "B"


def test_robot_rules(spark):
    one = spark.range(1)
    got = one.select(robot.to_grid(F.lit(101.0), 5, F.lit(1)).alias("a"), robot.to_grid(F.lit(104.0), 5, F.lit(-1)).alias("b"), robot.to_grid(F.lit(100.0), 5, F.lit(1)).alias("c"), robot.max_lots(F.lit(500.0), 155.0).alias("d")).first()
    assert tuple(got) == (105.0, 100.0, 100.0, 3)


def minute_bars(spark, closes, signals_=None):
    """Bars of two days from 10:00 on, a minute apart; the second day repeats the first."""
    rows = []
    for day in (2, 3):
        for i, c in enumerate(closes):
            rows.append(("WIN", dt.datetime(2026, 3, day, 10, i), c, signals_[i] if signals_ else 0.0, len(rows)))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, close double, signal double, pos long")


def test_daily_loss_holds_openings_back_until_the_next_day(spark):
    closes, up = [100.0, 50.0, 60.0, 60.0, 70.0], [2.0, 0.0, 2.0, 2.0, 0.0]
    bars = minute_bars(spark, closes, up)
    run = lambda loss: robot.simulate(bars, 0, robot.Limits(tick_size=5.0, daily_loss_points=loss), max_holding=1).orderBy("ts").collect()
    free, held = run(1500.0), run(55.0)
    assert [r.decision for r in free] == ["OPEN_LONG", "CLOSE", "OPEN_LONG", "CLOSE", "NONE"] * 2
    assert [r.points for r in free] == [None, -55.0, None, -5.0, None] * 2 and [r.gross for r in free] == [None, -50.0, None, 0.0, None] * 2
    assert [r.decision for r in held] == ["OPEN_LONG", "CLOSE", "NONE", "NONE", "NONE"] * 2
    assert [r.guard_blocked for r in held] == [None, None, "DAILY_LOSS", "DAILY_LOSS", None] * 2


def test_reruns_of_the_battery(spark):
    rng = np.random.default_rng(3)
    closes = [float(c) for c in 100 + rng.normal(0, 20, 50).round(1)]
    bars = minute_bars(spark, closes).drop("signal").withColumns({c: F.col("close") for c in ("open", "high", "low", "vwap")})
    noise = robustness.noisy(bars, 5.0, 7).join(bars.select("ts", F.col("close").alias("was")), "ts").select(F.col("close") - F.col("was"), "variant", "vwap", "close").collect()
    assert len(noise) == 700 and {round(r[0], 9) for r in noise} == {-5.0, 5.0} and all(r.vwap == r.close for r in noise)
    cut = robustness.slices(bars).groupBy("variant").agg(F.count("pos"), F.min("pos"), F.max("pos"), F.min("ts").alias("at")).orderBy("at").collect()
    assert [tuple(r)[:4] for r in cut] == [(0, 34, 0, 33), (1, 33, 0, 32), (2, 33, 0, 32)]
    costs = {"point_value": 1.0, "tick_size": 5.0, "slippage_ticks": 1, "exchange_fee": 1.0, "brokerage": 0.0}
    nets = robustness.battery(bars, "zscore(close(),8)", costs, robot.Limits(tick_size=5.0), 0.8, -1, 3).drop("series").collect()
    got = {(r.battery, r.variant): r for r in nets}
    assert len(nets) == len(got) == 1 + 100 + 3 + 2 + 2
    plain, (a, b) = got["reference", 0], (got["cost", 0], got["cost", 1])
    assert plain.trades == a.trades == b.trades > 0
    assert plain.net - a.net == pytest.approx(plain.trades * 11.0) and a.net - b.net == pytest.approx(plain.trades * 1.0)
    idle = robustness.battery(bars, "zscore(close(),8)", costs, robot.Limits(tick_size=5.0), 99.0).collect()
    assert len(idle) == 108 and all(r.net == 0 and r.trades == 0 for r in idle)


def test_purge_and_embargo(spark):
    days = [dt.date(2026, 1, 5) + dt.timedelta(days=i) for i in range(16)]
    rows = [(d, dt.datetime.combine(d, dt.time(9)) + dt.timedelta(minutes=30 * k)) for d in days for k in range(18)]
    s = spark.createDataFrame(rows, "day date, ts timestamp_ntz")
    out = cv.split(s, cv.day_groups(s, 8), cv.partitions(spark), horizon_min=16 * 60).collect()
    assert len(out) == 28 * len(rows)
    test = {(r.path_id, r.ts) for r in out if r.role == "test"}
    for r in out:
        if r.role == "train":
            assert not any((r.path_id, r.ts + dt.timedelta(minutes=m)) in test for m in range(0, 16 * 60 + 1, 30))
    assert cv.paths_per_partition() == 7


def test_texts(spark):
    df = spark.createDataFrame([("Ação, É  ôÇ-1!",), ("mercado em geral",), ("hedger local",), ("",)], "t string")
    got = df.select(texts.normalized(F.col("t")).alias("n"), texts.circular(F.col("t")).alias("c")).collect()
    assert [r.n for r in got] == ["acao e oc 1", "mercado em geral", "hedger local", ""] and [r.c for r in got] == [False, True, False, True]
    leak = spark.createDataFrame([("it was 12.35 up", 12.345), ("it was 112.35 up", 12.345), ("1500 days", 1500.0), ("15 days", 15.0)], "t string, v double")
    assert [r[0] for r in leak.select(texts.holds_number(F.col("t"), texts.number_forms(F.col("v")))).collect()] == [True, False, True, False]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 408
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_research_rules(spark, tmp_path):
    from tidewick.operators import research as r

    assert r.families(spark).count() == 8 and [x.name for x in r.families(spark, r.STARTERS).orderBy("place").collect()] == list(r.STARTERS)
    with pytest.raises(r.SettingError):
        r.families(spark, ("NOPE",))
    assert r.duration_minutes("PT1H30M") == 90 and r.duration_text(90.5) == "PT1H30M30S"
    c = fl.Constraints(max_depth=4, max_window=9)
    assert r.tightened(c, "TOO_COMPLEX", 3, 10)[0].max_depth == 3 and r.tightened(c, "UNSTABLE_ACROSS_FOLDS", 3, 10)[0].max_window == 4
    assert r.tightened(c, "COST_DOMINATED", 3, 10)[1] == 5 and r.tightened(c, "COST_DOMINATED", 8, 10)[1] == 10
    assert "zscore" in r.without_root(c, fl.parse("zscore(close(),3)")).forbidden and r.without_root(c, fl.parse("close()")) == c
    text = "prose MAX_TRIALS: 1\n```\nmin_total_trades: 400\nmin_trades_per_path: 30\nmin_active_days: 120\nmax_trade_concentration: 0,25\nmax_sign_flip_frac: 0.30\nmax_pbo: 0.2 # share\nmin_dsr: 0.95\nMAX_TRIALS: 3.000\nn_grupos: 8\nk_teste: 2\nembargo_mult: 3.0\ncaminhos: 28\n```\n"
    assert r.read_preregistration(text) == gate.LIMITS
    for bad in (text.replace("0.95", "<<< DECIDIR >>>"), text.replace("caminhos: 28", "caminhos: 7"), text.replace("min_dsr: 0.95", "max_pbo: 0.1")):
        with pytest.raises(r.SettingError):
            r.read_preregistration(bad)
    h = tmp_path / "h.yaml"
    h.write_text("id: h\nfamily: F\nclaim: c\nwho_pays: w\nobservable: o\ndirection: LONG_ON_HIGH\nhorizon: PT3M\nsession_window: {start: '10:30', end: '16:30'}\nkill_condition: {metric: lag_ms}\ndsl_constraints: {allowed_ops: [ZSCORE, RET], forbidden_ops: [RANK_TS], max_window: 120, max_depth: 4, max_nodes: 12, max_free_params: 3, required_refs: [ES]}\n")
    got = r.load_hypothesis(str(h))
    assert got["horizon_min"] == 3 and got["constraints"].required_symbols == {"ES"} and "close" in r.permitted(got["constraints"])


def test_saved_frame_and_calendar(spark, many, tmp_path):
    frame = many.withColumn("day", F.to_date("ts"))
    files.save_frame(frame, str(tmp_path / "f"))
    back = files.load_frame(spark, str(tmp_path / "f"))
    assert back.select(sorted(frame.columns)).exceptAll(frame.select(sorted(frame.columns))).count() == 0 and back.count() == frame.count()
    files.write_calendar(prep.calendar(frame), str(tmp_path / "c"))
    assert files.read_calendar(spark, str(tmp_path / "c")).agg(F.sum("bars_expected")).first()[0] == frame.count()


def test_cli(spark, tmp_path):
    from tidewick import cli

    rng, lines = np.random.default_rng(3), {"WIN": ["datetime,open,high,low,close,volume"], "ES": ["datetime,open,high,low,close,volume"]}
    p = 1000.0
    for month in range(1, 5):
        for m in range(200):
            p += float(rng.normal())
            t = dt.datetime(2026, month, 5, 9, 0) + dt.timedelta(minutes=m)
            for s, x in (("WIN", p), ("ES", p / 20)):
                lines[s].append(f"{t:%Y-%m-%d %H:%M},{x},{x + 1},{x - 1},{x},5")
    for s, x in lines.items():
        (tmp_path / f"{s}.csv").write_text("\n".join(x) + "\n")
    argv = ["data", "--win", str(tmp_path / "WIN.csv"), "--ref", f"ES={tmp_path / 'ES.csv'}", "--holdout-months", "1", "--out", str(tmp_path / "out")]
    assert cli.main(argv) == 0
    assert files.load_frame(spark, str(tmp_path / "out/research")).count() == 600
    assert cli.main([*argv[:2], str(tmp_path / "none.csv"), *argv[3:]]) == 2


def test_cli_of_the_ledger_and_the_collector(spark, tmp_path, capsys):
    from tidewick import cli
    from tidewick.sources.files import TELEMETRY

    book = str(tmp_path / "book")
    assert cli.main(["genesis", "--ledger", book, "--config-hash", "c", "--data-hash", "d", "--at", "2026-01-01"]) == 0
    assert cli.main(["genesis", "--ledger", book, "--config-hash", "c", "--data-hash", "d", "--at", "2026-01-01"]) == 2
    assert cli.main(["verify", "--ledger", book]) == 0 and cli.main(["report", "--ledger", book]) == 0
    assert "'trials': 0" in capsys.readouterr().out
    header = [f.name for f in TELEMETRY]
    for day, value in ((5, 1), (6, 3), (7, 3)):
        row = dict.fromkeys(header, "") | {"ts": f"2026-01-0{day} 10:00:00", "bar_time": f"2026-01-0{day} 10:00:00", "threshold": "1", "decision": "NONE", "contracts": "0", "ref_price": "1", "order_status": "NONE", "position": "0", "daily_pnl_points": "0", "kill_metric_name": "lag_ms", "kill_metric_value": str(value)}
        (tmp_path / f"win_{day}.csv").write_text(",".join(header) + "\n" + ",".join(row[h] for h in header) + "\n")
    (tmp_path / "calendar.csv").write_text("day,bars_expected\n2026-01-05,1\n2026-01-06,1\n2026-01-07,2\n")
    (tmp_path / "costs.yaml").write_text("{point_value: 0.2, tick_size: 5, slippage_ticks: 1, exchange_fee: 0.25, brokerage: 0, margin_per_contract: 155}")
    out = str(tmp_path / "out")
    args = ["--calendar", str(tmp_path / "calendar.csv"), "--costs", str(tmp_path / "costs.yaml"), "--hypothesis", "h1", "--out", out, "--window", "2", "--threshold", "1.5"]
    for day in (5, 6, 7, 7):
        assert cli.main(["collect", "--telemetry", str(tmp_path / f"win_{day}.csv"), *args]) == 0
    daily = spark.read.parquet(f"{out}/daily")
    assert daily.count() == 3 and [(str(r.day), r.reason) for r in spark.read.json(f"{out}/alerts").collect()] == [("2026-01-07", "bars")]
    assert "2026, 1, 6" in capsys.readouterr().out


def test_moves_spreads_and_proof_routes(spark):
    from tidewick.operators import monitor, texts

    t0 = dt.datetime(2026, 1, 5, 9, 0)
    rows = [("WIN", t0 + dt.timedelta(minutes=i), c, r) for i, (c, r) in enumerate(((10.0, 5.0), (10.0, 6.0), (11.0, 6.0), (11.0, 5.0), (12.0, 5.0), (9.0, 6.0)))]
    bars = spark.createDataFrame(rows, "series string, ts timestamp_ntz, close double, ref_ES double")
    assert [r.lag_ms for r in monitor.move_lag(bars).orderBy("ts").collect()] == [60_000, 120_000, None]
    quotes = spark.createDataFrame([("WIN", t0, 5.0), ("WIN", t0, 15.0)], "series string, ts timestamp_ntz, spread double")
    assert monitor.mean_spread(quotes, 5).first().spread_ticks == 2.0
    status = spark.createDataFrame([("FAILED", 1), ("FAILED", 3), ("PASSED", 3), ("SKIPPED", 0), ("OPEN", 0)], "s string, n int")
    assert [r[0] for r in status.select(texts.route_proof(F.col("s"), F.col("n"), F.lit(3))).collect()] == ["retry", "abandon", "backtest", "backtest", None]


def test_private_numbers_are_written_without_exponents(spark):
    from tidewick.operators import texts

    df = spark.createDataFrame([(0.00012345,), (float("nan"),), (float("inf"),), (1234.0,), (12345678.25,)], "v double")
    small, nan, inf, whole, large = (r[0] for r in df.select(texts.number_forms(F.col("v"))).collect())
    assert "0.00012345" in small and nan == inf == [] and whole == ["1234"] and "12345678.25" in large
    said = spark.createDataFrame([("value 0.00012345 here", 0.00012345), ("value 10.00012345", 0.00012345)], "t string, v double")
    assert [r[0] for r in said.select(texts.holds_number(F.col("t"), texts.number_forms(F.col("v")))).collect()] == [True, False]
