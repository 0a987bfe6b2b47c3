"""Order rules as column expressions, and the plain bar-by-bar simulation; tidewick.operators.orders has resting orders, stops and refusals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewick.functions.scalar import minute_of_day


@dataclass(frozen=True)
class Limits:
    cutoff_min: int = 17 * 60 + 50
    session: tuple[int, int] = (9 * 60, 17 * 60 + 55)
    tick_size: float = 5.0
    margin_per_contract: float = 155.0
    daily_loss_points: float = 1500.0
    max_rejections: int = 3


def decide(signal: Column, threshold: float, direction: int, position: Column) -> Column:
    s = signal * direction
    return F.when(signal.isNull() | (position != 0), "NONE").when(s > threshold, "OPEN_LONG").when(s < -threshold, "OPEN_SHORT").otherwise("NONE")


def max_lots(equity: Column, margin: float) -> Column:
    return F.greatest(F.floor(equity / F.lit(margin)), F.lit(0))


def to_grid(price: Column, tick: float, side: Column) -> Column:
    """On the grid, rounded against us."""
    q = price / F.lit(float(tick))
    return F.when(side > 0, F.ceil(q - 1e-9)).otherwise(F.floor(q + 1e-9)) * F.lit(float(tick))


def on_grid(price: Column, tick: float) -> Column:
    q = price / F.lit(float(tick))
    return F.abs(q - F.round(q)) < 1e-9


def guard_order(x: Limits, tod: Column, lots: Column, equity: Column, price: Column, pnl: Column, rejections: Column) -> Column:
    """Why an opening order is held back, or NULL; the tests keep their order."""
    return (
        F.when(rejections >= x.max_rejections, "BREAKER").when(pnl <= -x.daily_loss_points, "DAILY_LOSS")
        .when((tod >= x.cutoff_min) | (tod <= x.session[0]) | (tod > x.session[1]), "CUTOFF")
        .when((lots < 1) | (lots > max_lots(equity, x.margin_per_contract)), "MARGIN").when(~on_grid(price, x.tick_size), "GRID")
    )


def must_flatten(tod: Column, held: Column, x: Limits, max_holding: int) -> Column:
    return (tod >= x.cutoff_min) | (held >= max_holding)


def exit_price(price: Column, position: Column, tick: float) -> Column:
    """Rounded against us, and a tick worse."""
    return to_grid(price, tick, -position) - position * F.lit(float(tick))


def nullable(t: pa.DataType) -> pa.DataType:
    """The type with fields that may be null, as a result's schema has them."""
    return pa.struct([pa.field(f.name, nullable(f.type)) for f in t]) if pa.types.is_struct(t) else t


def simulate(bars: DataFrame, warmup: int, limits: Limits = Limits(), threshold: float = 1.5, direction: int = 1, equity: float = 5000.0, max_holding: int = 30) -> DataFrame:
    """series, ts, signal, decision, position, fill_price, guard_blocked, points, gross: a row for each bar of bars (series, ts, close, signal, pos).

    Where a position closes, points is what it made after a tick given up and prices rounded against us, gross what it made
    from close to close. Once the day's points have fallen to the daily loss, openings are held back until the next day.
    Every order is filled, so rejections stay 0. A position ends at the cutoff, so a chain of days begins wherever the day before reached it; chains are independent and
    run in parallel, each as one walk over its bars in order, whose rows its task holds; orders.simulate bounds that to days.
    """
    x = bars.withColumns({"_tod": minute_of_day(F.col("ts")), "_day": F.to_date("ts")})
    days = x.groupBy("series", "_day").agg(F.max("_tod").alias("_last"))
    w = Window.partitionBy("series").orderBy("_day")
    days = days.withColumn("_new", F.when(F.coalesce(F.lag("_last").over(w), F.lit(limits.cutoff_min)) >= limits.cutoff_min, 1).otherwise(0))
    days = days.select("series", "_day", F.sum("_new").over(w).alias("chain"))
    x = x.join(days, ["series", "_day"])
    wanted = decide(F.col("signal"), threshold, direction, F.lit(0))
    side = F.when(wanted == "OPEN_LONG", 1).when(wanted == "OPEN_SHORT", -1).otherwise(0)
    x = x.withColumns({"_want": F.when(F.col("pos") >= warmup, wanted).otherwise("NONE"), "_side": side}).withColumn("_px", to_grid(F.col("close"), limits.tick_size, F.col("_side")))
    x = x.withColumn("_guard", F.when(F.col("_want") != "NONE", guard_order(limits, F.col("_tod"), F.lit(1), F.lit(equity), F.col("_px"), F.lit(0.0), F.lit(0))))
    x = x.withColumn("_m", F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    x = x.select("series", "chain", "ts", F.col("_m").cast("long").alias("m"), F.col("_tod").alias("tod"), F.col("_want").alias("want"), F.col("_side").alias("side"), F.col("_px").alias("px"), F.col("_guard").alias("guard"), "signal", F.col("_day").alias("day"), "close")
    tick = limits.tick_size

    def left(price: float, p: int) -> float:
        q = price / tick
        return (math.floor(q + 1e-9) if p > 0 else math.ceil(q - 1e-9)) * tick - p * tick

    def fold(table: pa.Table) -> pa.Table:
        """The chain's bars in order; what is kept from bar to bar is the position, its entry and the day's points."""
        table = table.sort_by("ts")
        p, since, px, entry, pnl, day = 0, 0, 0.0, 0.0, 0.0, None
        rows = []
        for s in zip(*[table[c].to_pylist() for c in ("m", "tod", "want", "side", "px", "guard", "day", "close")], strict=True):
            m, tod, want, side, price, guard, on, close = s
            if on != day:
                pnl, day = 0.0, on
            if want != "NONE" and pnl <= -limits.daily_loss_points:
                guard = "DAILY_LOSS"
            if p and (tod >= limits.cutoff_min or m - since >= max_holding):
                points = (left(close, p) - px) * p
                rows.append(("CLOSE", 0, None, None, points, (close - entry) * p))
                pnl, p = pnl + points, 0
            elif not p and want != "NONE" and guard is None:
                p, since, px, entry = side, m, price, close
                rows.append((want, p, price, None, None, None))
            else:
                rows.append(("NONE", p, None, guard if not p else None, None, None))
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.string(), pa.float64(), pa.float64()]
        out = table.select(["series", "ts", "signal"])
        out = out.set_column(0, "series", out["series"].cast(nullable(out["series"].type)))
        for name, kind, values in zip(("decision", "position", "fill_price", "guard_blocked", "points", "gross"), kinds, zip(*rows, strict=True), strict=True):
            out = out.append_column(name, pa.array(values, kind))
        return out

    kind = bars.schema["series"].dataType.simpleString()
    return x.groupBy("series", "chain").applyInArrow(fold, f"series {kind}, ts timestamp_ntz, signal double, decision string, position int, fill_price double, guard_blocked string, points double, gross double")


def round_trips(sim: DataFrame, bars: DataFrame, tick: float) -> DataFrame:
    """series, opened, closed, side, entry, exit, points: each opening with the closing that follows it; the exit gives up a tick."""
    w = Window.partitionBy("series").orderBy("ts")
    x = sim.where("decision <> 'NONE'").join(bars.select("series", "ts", "close"), ["series", "ts"])
    x = x.withColumns({"closed": F.lead("ts").over(w), "_next": F.lead("decision").over(w), "_close": F.lead("close").over(w)}).where("decision like 'OPEN%' and _next = 'CLOSE'")
    out = exit_price(F.col("_close"), F.col("position"), tick)
    return x.select("series", F.col("ts").alias("opened"), "closed", F.col("position").alias("side"), F.col("fill_price").alias("entry"), out.alias("exit")).withColumn("points", (F.col("exit") - F.col("entry")) * F.col("side"))
