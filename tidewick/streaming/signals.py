"""Formulas over a stream of bars, live frames of a main symbol with its references, and daily aggregates of telemetry.

The state of a series is typed and bounded: for every windowed node of the formulas the ring of its last inputs, for every ema its
value and how many inputs it has seen, and the last bar's time and day. A micro-batch brings new bars only; no earlier bar is read
or evaluated again. The state can be filled from history before the first bar.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidewick.plans.formula import SERIES, WINDOWED, Node, minutes, parse

GUARD = 1e-12
#: The state store that typed state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "series string, ts timestamp, kind string, name string, value double, error string"


def subtrees(trees: list[Node]) -> list[Node]:
    """The distinct subtrees, each after what it is made of."""
    out: dict[str, Node] = {}

    def visit(n: Node) -> None:
        for c in n.children():
            visit(c)
        out.setdefault(str(n), n)

    for t in trees:
        visit(t)
    return list(out.values())


def windows(y: np.ndarray, w: int, n: int) -> np.ndarray:
    """The windows of w values that end at each of the last n places of y, one a row; y has at least w - 1 + n values."""
    return np.lib.stride_tricks.sliding_window_view(y[len(y) - (n + w - 1) :], w)


def ring_length(n: Node) -> int:
    w = n.args[1]
    return w if n.op in ("lag", "delta", "ret") else w - 1


def windowed(n: Node, ring: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node's values at the new inputs x, given the inputs before them; missing ones are NaN."""
    op, w, k = n.op, n.args[1], len(x)
    need = ring_length(n)
    y = np.concatenate([np.full(max(need - len(ring), 0), np.nan), ring, x])
    with np.errstate(all="ignore"):
        if op in ("lag", "delta", "ret"):
            before = y[len(y) - k - w : len(y) - w]
            if op == "lag":
                return before
            if op == "delta":
                return x - before
            return np.where(np.isnan(x) | np.isnan(before), np.nan, np.where(np.abs(before) < GUARD, 0.0, x / before - 1))
        v = windows(y, w, k)
        if op == "rolling_mean":
            return v.mean(1)
        if op == "rolling_max":
            return v.max(1)
        if op == "rolling_min":
            return v.min(1)
        gone = np.isnan(v).any(1)
        if op == "rank_ts":
            rank = 2 * ((v < x[:, None]).sum(1) + 0.5 * ((v == x[:, None]).sum(1) - 1)) / max(w - 1, 1) - (w > 1)
            return np.where(gone, np.nan, rank)
        sd = np.where(v.max(1) == v.min(1), 0.0, v.std(1, ddof=1) if w > 1 else 0.0)
        if op == "zscore":
            return np.where(gone, np.nan, np.where(sd < GUARD, 0.0, (x - v.mean(1)) / sd))
        return np.where(gone, np.nan, sd)


def ema(w: int, e: float, seen: int, x: np.ndarray) -> tuple[np.ndarray, float, int]:
    g, out = 2.0 / (w + 1), np.full(len(x), np.nan)
    for i, v in enumerate(x):
        if v == v:
            e, seen = (v if not seen else (1 - g) * e + g * v), seen + 1
            if seen >= w:
                out[i] = e
    return out, float(e), seen


def pointwise(n: Node, c: list[np.ndarray]) -> np.ndarray:
    x, a = c[0], n.args
    with np.errstate(all="ignore"):
        if n.op == "clip":
            return np.clip(x, a[1], a[2])
        y = c[1]
        out = {
            "add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: np.where(np.abs(y) < GUARD, 0.0, x / y), "gt": lambda: x > y, "lt": lambda: x < y,
            "and_": lambda: (x != 0) & (y != 0), "or_": lambda: (x != 0) | (y != 0),
        }[n.op]()
        return np.where(np.isnan(x) | np.isnan(y), np.nan, out)


class Signals(StatefulProcessor):
    """The formulas of a series, bar after bar."""

    def __init__(self, formulas: dict[str, str], cutoff: int | None):
        self.formulas, self.cutoff = formulas, cutoff

    def init(self, handle) -> None:
        trees = {k: parse(f) for k, f in self.formulas.items()}
        self.nodes, self.roots = subtrees(list(trees.values())), {k: str(t) for k, t in trees.items()}
        self.handle = handle
        self.clock = handle.getValueState("clock", "last timestamp, day date, opened int, bars long")
        self.rings, self.emas = {}, {}
        for i, n in enumerate(self.nodes):
            if n.op == "ema":
                self.emas[str(n)] = handle.getValueState(f"ema{i}", "value double, seen long")
            elif n.op in WINDOWED and ring_length(n):
                self.rings[str(n)] = handle.getListState(f"ring{i}", "value double")

    def step(self, bars: pd.DataFrame) -> dict[str, np.ndarray]:
        """The roots' values at new bars, in order; the state goes on behind them."""
        day, opened, count = None, 0, 0
        if self.clock.exists():
            _, day, opened, count = self.clock.get()
        tod = (bars.ts.dt.hour * 60 + bars.ts.dt.minute).to_numpy()
        since = np.empty(len(bars))
        for i, (d, t) in enumerate(zip(bars.ts.dt.date, tod, strict=True)):
            if d != day:
                day, opened, count = d, int(t), 0
            count += 1
            since[i] = t - opened + 1
        got: dict[str, np.ndarray] = {}
        for n in self.nodes:
            key, c = str(n), [got[str(x)] for x in n.children()]
            if n.op in SERIES:
                v = bars[n.op].to_numpy(dtype=float)
            elif n.op == "ref":
                v = bars[f"ref_{n.args[0]}"].to_numpy(dtype=float)
            elif n.op == "const":
                v = np.full(len(bars), float(n.args[0]))
            elif n.op == "in_window":
                v = ((tod > minutes(n.args[0])) & (tod <= minutes(n.args[1]))).astype(float)
            elif n.op == "minutes_since_open":
                v = since
            elif n.op == "ema":
                e, seen = self.emas[key].get() if self.emas[key].exists() else (0.0, 0)
                v, e, seen = ema(n.args[1], e, seen, c[0])
                self.emas[key].update((e, seen))
            elif n.op in WINDOWED:
                state = self.rings.get(key)
                ring = np.array([r[0] for r in state.get()], dtype=float) if state is not None else np.zeros(0)
                v = windowed(n, ring, c[0])
                if state is not None:
                    state.put([(float(x),) for x in np.concatenate([ring, c[0]])[-ring_length(n) :]])
            else:
                v = pointwise(n, c)
            got[key] = v
        self.clock.update((bars.ts.iloc[-1].to_pydatetime(), day, int(opened), int(count)))
        return {k: got[r] for k, r in self.roots.items()}

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values("ts", kind="stable", ignore_index=True)
        last = pd.Timestamp(self.clock.get()[0]) if self.clock.exists() else pd.Timestamp.min
        later = new.ts.cummax().shift(fill_value=last).clip(lower=last)
        late = ~(new.ts > later)
        good = new[~late].reset_index(drop=True)
        if len(good):
            for name, v in self.step(good).items():
                yield pd.DataFrame({"series": key[0], "ts": good.ts, "kind": "bar", "name": name, "value": v, "error": None})
            self.watch(good.ts.iloc[-1], timerValues)
        if late.any():
            yield pd.DataFrame({"series": key[0], "ts": new.ts[late], "kind": "late", "name": None, "value": np.nan, "error": "not later than the last bar"})

    def watch(self, ts: pd.Timestamp, timers) -> None:
        """A timer at the cutoff of the bar's day, unless that has passed."""
        if self.cutoff is not None:
            at = int((ts.normalize() + dt.timedelta(minutes=self.cutoff)).tz_localize("UTC").timestamp() * 1000)
            if at > timers.getCurrentWatermarkInMs() and at not in list(self.handle.listTimers()):
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = pd.to_datetime(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        _, day, _, bars = self.clock.get()
        yield pd.DataFrame({"series": [key[0]], "ts": [at], "kind": ["cutoff"], "name": [None], "value": [float(bars) if day == at.date() else np.nan], "error": [None]})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        bars = initialState.dropna(subset=["ts"]).drop_duplicates("ts").sort_values("ts", ignore_index=True)
        if len(bars):
            self.step(bars)

    def close(self) -> None:
        pass


def needed(formulas: dict[str, str]) -> list[str]:
    refs = sorted({s for f in formulas.values() for s in parse(f).symbols()})
    return ["series", "ts", "close", "high", "low", "volume", "trades", "vwap", *(f"ref_{s}" for s in refs)]


def stream_signals(bars: DataFrame, formulas: dict[str, str], history: DataFrame | None = None, cutoff: int | None = None, late: str = "1 day") -> DataFrame:
    """series, ts, kind, name, value, error: for each bar of a stream of bars a row of kind "bar" for each formula (name -> text).

    Bars of one series have to come in order: one that is not later than those before changes nothing and gives a row of kind "late". `history` (a
    table of bars before the stream's first) fills the state of its series. With `cutoff` (minutes of the day) a row of kind "cutoff" follows once the
    watermark, `late` behind the latest bar, has passed it; its value is the count of the day's bars until then, NULL if a later day has begun. Write
    the result with the settings of STORE.
    """
    columns = needed(formulas)
    source = bars.select(*columns)
    if cutoff is not None:
        source = source.withWatermark("ts", late)
    first = history.select(*columns).groupBy("series") if history is not None else None
    mode = "EventTime" if cutoff is not None else "None"
    out = source.groupBy("series").transformWithStateInPandas(Signals(dict(formulas), cutoff), OUT, "Append", mode, first)
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def stream_signal(bars: DataFrame, formula: str, history: DataFrame | None = None) -> DataFrame:
    """series, ts, signal, error: a row for each bar of a stream of bars."""
    return stream_signals(bars, {"signal": formula}, history).select("series", "ts", F.col("value").alias("signal"), "error")


def stream_frame(bars: DataFrame, main: str, refs: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """The main symbol's bars at the times that every reference has too, as a stream: bars (symbol, ts, close ..) joined with the bars of each reference.

    A bar waits for its references until the watermark has passed it by; then it is dropped, and with it its state. So a missing reference bar leaves
    the signal's state untouched, and what is kept is bounded by the watermark. Of repeated bars of one symbol and time the first counts.
    """
    x = bars.where("symbol is not null and ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])
    out = x.where(F.col("symbol") == main).withColumnRenamed("ts", "at").withColumn("series", F.lit(main)).drop("symbol")
    for r in refs:
        other = x.where(F.col("symbol") == r).select(F.col("ts").alias(f"at_{r}"), F.col("close").alias(f"ref_{r}"))
        out = out.join(other, F.expr(f"at = at_{r}")).drop(f"at_{r}")
    return out.withColumnRenamed("at", "ts")


def stream_daily(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Per day and event type: rows and sum of value, once the watermark has passed the day."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
