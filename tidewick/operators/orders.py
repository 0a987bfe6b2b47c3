"""Simulation of orders: market or resting limit openings, stops, targets, holding time, cutoff, sessions, roll days, and the day's two breakers.

What becomes of an order once it is placed depends on the bars behind it alone, so every bar with a signal gets the outcome that an order placed
there would have. Only the way from one order to the next depends on the past: a series is in one state at the begin of
a day, flat or in a position that an earlier order opened, and a day's loss and refusals start at nothing. So each day is walked
from every state that it can begin in, days in parallel, and a walk ends in the state in which a later day begins. Which of
these walks take place is found by doubling along the edges between them. A task holds one day's bars and those of the next days that a position may last; no
array grows with the series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewick.functions.scalar import minute_of_day
from tidewick.sources.shared import new_folder, written


@dataclass(frozen=True)
class Rules:
    threshold: float = 1.5
    direction: int = 1
    contracts: int = 1
    #: Minutes after the fill at which a position is closed.
    max_holding: int = 30
    #: None: orders are filled at the market. Else they rest so many points better than the close, for at most `life` minutes.
    limit_points: float | None = None
    life: int = 30
    stop_points: float | None = None
    target_points: float | None = None
    cutoff: int = 17 * 60 + 50
    session: tuple[int, int] = (9 * 60, 17 * 60 + 55)
    tick: float = 5.0
    equity: float = 5000.0
    margin: float = 155.0
    daily_loss: float = 1500.0
    max_refusals: int = 3


#: Refusals that count towards the breaker; before the session opens nothing is sent.
COUNTED = ("CUTOFF", "ROLL_DAY", "MARGIN")
FLAT = -1

ATTEMPT = "series string, day int, m long, ts timestamp_ntz, side int, refused string, status string, fill_m long, fill_px double, exit_day int, exit_m long, exit_px double, exit_kind string, points double, free long"
ORDER = "series string, ts timestamp_ntz, side int, status string, reason string, fill_m long, fill_px double, exit_m long, exit_px double, exit_kind string, points double, refusals int, day_points double"


def on_tick(price, tick: float, side):
    """On the grid, rounded against a trade of that side."""
    q = np.asarray(price) / tick
    return np.where(np.asarray(side) > 0, np.ceil(q - 1e-9), np.floor(q + 1e-9)) * tick


def outcomes(t: dict, own: int, r: Rules) -> dict:
    """For each bar of day `own` with a side: what an order placed there comes to. The bars (numpy columns, in order) go on into the next days."""
    m, tod, day, close, high, low = (t[c] for c in ("m", "tod", "day", "close", "high", "low"))
    at = np.flatnonzero((day == own) & (t["side"] != 0))
    out: dict[str, list] = {c: [] for c in ("i", "status", "fill_m", "fill_px", "exit_day", "exit_m", "exit_px", "exit_kind", "points", "free")}
    for i in at:
        side = int(t["side"][i])
        fill, px, status, free = int(i), float(on_tick(close[i], r.tick, side)) + side * r.tick, "FILLED", None
        if r.limit_points is not None:
            px = float(on_tick(close[i] - side * r.limit_points, r.tick, side))
            end = i + 1
            while end < len(m) and day[end] == own and tod[end] < r.cutoff and m[end] - m[i] <= r.life:
                end += 1
            through = np.flatnonzero(low[i + 1 : end] < px if side > 0 else high[i + 1 : end] > px)
            if len(through):
                fill = int(i + 1 + through[0])
            else:  # an order that the data end upon rests
                fill, status, free = None, "EXPIRED" if end < len(m) else "RESTING", int(m[end]) if end < len(m) else None
        x: dict = dict.fromkeys(out)
        x.update(i=i, status=status, free=free)
        if fill is not None:
            x.update(fill_m=int(m[fill]), fill_px=px)
            last = min(fill + 1 + int(np.searchsorted(m[fill + 1 :], m[fill] + r.max_holding)), len(m) - 1)
            late = np.flatnonzero(tod[fill + 1 : last + 1] >= r.cutoff)
            last = fill + 1 + int(late[0]) if len(late) else last
            k, price, kind = None, None, None
            if last > fill and (len(late) or m[last] - m[fill] >= r.max_holding):
                k, kind, price = last, "FLATTEN", float(on_tick(close[last], r.tick, -side)) - side * r.tick
            a, z = fill + 1, last + 1
            # What is met first counts; of a stop and a target in one bar, the stop.
            if r.target_points is not None:
                goal = px + side * r.target_points
                hit = np.flatnonzero(high[a:z] > goal if side > 0 else low[a:z] < goal)
                if len(hit):
                    k, kind, price = a + int(hit[0]), "TARGET", float(on_tick(goal, r.tick, -side))
            if r.stop_points is not None:
                stop = px - side * r.stop_points
                hit = np.flatnonzero(low[a:z] <= stop if side > 0 else high[a:z] >= stop)
                if len(hit) and (k is None or a + int(hit[0]) <= k):
                    k, kind, price = a + int(hit[0]), "STOP", float(on_tick(stop, r.tick, -side)) - side * r.tick
            if k is not None:
                x.update(exit_day=int(day[k]), exit_m=int(m[k]), exit_px=price, exit_kind=kind, points=(price - px) * side, free=int(m[k]) + 1)
        for c in out:
            out[c].append(x[c])
    return out


def attempts(bars: DataFrame, r: Rules) -> DataFrame:
    """An ATTEMPT row for each bar of bars (series, ts, day, m, tod, side, refused, close, high, low) with a side."""
    lent = 1 + math.ceil(r.max_holding / 1440)  # trading days after which a position is closed for certain
    blocks = bars.withColumn("block", F.explode(F.sequence(F.col("day") - lent, F.col("day"))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("m")
        t = {c: table[c].to_numpy(zero_copy_only=False) for c in ("m", "tod", "day", "close", "high", "low", "side")}
        own = table["block"][0].as_py()
        x = outcomes(t, own, r)
        i = pa.array(x.pop("i"), pa.int64())
        kept = table.select(["series", "day", "m", "ts", "side", "refused"]).take(i)
        types = {"status": pa.string(), "exit_kind": pa.string(), "exit_day": pa.int32(), "fill_px": pa.float64(), "exit_px": pa.float64(), "points": pa.float64()}
        for c, v in x.items():
            kept = kept.append_column(c, pa.array(v, types.get(c, pa.int64())))
        return kept

    return blocks.groupBy("series", "block").applyInArrow(run, ATTEMPT)


def walked(rows: list[dict], free: int, points: float, r: Rules):
    """Goes through a day's attempts in order, from the first free minute and the points made so far; yields each with reason, refusals and points, and ends where one is open at the day's end."""
    refusals = 0
    for x in rows:
        if x["m"] < free:
            continue
        reason = "BREAKER" if refusals >= r.max_refusals else "DAILY_LOSS" if points <= -r.daily_loss else x["refused"]
        if reason is not None:
            refusals += reason in COUNTED
            yield x, reason, refusals, points
            continue
        yield x, None, refusals, points
        if x["free"] is None or (x["exit_day"] is not None and x["exit_day"] != x["day"]):
            return
        free = x["free"]
        points += x["points"] or 0.0


EDGE = "series string, day int, held long, next_day int, next_held long"
#: A start has the side 0, the minute from which on it is free, and the points that its first exit has brought.
START = ("series", "day", "m", "side", "free", "points")


def split(table: pa.Table) -> tuple[list[dict], list[dict]]:
    rows = sorted(table.to_pylist(), key=lambda x: x["m"])
    return [x for x in rows if x["side"] != 0], [x for x in rows if x["side"] == 0]


def simulate(bars: DataFrame, r: Rules = Rules(), warmup: int = 0) -> DataFrame:
    """series, ts, side, status, reason, fill_ts, fill_px, exit_ts, exit_px, exit_kind, points, refusals, day_points: a row for each order.

    bars: series, ts (whole minutes, distinct in a series), close, high, low, signal, pos and roll_day. Status is FILLED, EXPIRED (a limit order good for
    its day and life that no price went through), RESTING (the data end first) or REJECTED, for a reason: BREAKER once so many of the day's orders were refused,
    DAILY_LOSS once its points have fallen so far, SESSION before the session, CUTOFF after the cutoff or the session, ROLL_DAY, MARGIN.
    A market order is filled at the close, a tick worse; a limit order at its level, where a later bar's price goes through it, not where
    it touches it; all prices are rounded against us. A stop is left a tick worse, a target only once the price goes through it; a position that neither ends is left at the close, a
    tick worse, at the cutoff or after the holding time. Without an exit in the data it has none. refusals and day_points are the day's, the row's own
    refusal among them. A bar without a signal or prices places no order.
    """
    folder = new_folder(bars.sparkSession, "orders")
    x = bars.where("ts is not null").select("series", "ts", "close", "high", "low", "signal", "pos", "roll_day").withColumns({"tod": minute_of_day(F.col("ts")), "_date": F.to_date("ts"), "m": F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', ts)")})
    s = F.col("signal") * r.direction
    priced = F.col("close").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull()
    side = F.when((F.col("pos") >= warmup) & (s > r.threshold), 1).when((F.col("pos") >= warmup) & (s < -r.threshold), -1).otherwise(0)
    margin = r.contracts < 1 or r.contracts > r.equity // r.margin
    refused = (
        F.when((F.col("tod") >= r.cutoff) | (F.col("tod") > r.session[1]), "CUTOFF").when(F.col("tod") <= r.session[0], "SESSION")
        .when(F.col("roll_day"), "ROLL_DAY").when(F.lit(margin), "MARGIN")
    )
    # Days are numbered in each series: a window over days, not bars.
    days = x.select("series", "_date").distinct().withColumn("day", F.row_number().over(Window.partitionBy("series").orderBy("_date")))
    x = x.where(priced).join(days, ["series", "_date"]).select("series", "ts", "day", "m", "tod", side.alias("side"), refused.alias("refused"), *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low")])
    tried = written(attempts(x, r), f"{folder}/attempts")

    over = tried.where("status = 'FILLED' and refused is null and (exit_day is null or exit_day > day)")
    flat = days.select("series", "day", F.lit(FLAT).cast("long").alias("m"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("free"), F.lit(0.0).alias("points"))
    held = over.where("exit_day is not null").select("series", F.col("exit_day").alias("day"), "m", F.lit(0).alias("side"), "free", "points")
    starts = flat.unionByName(held)
    # Where nothing can be open the day begins flat for certain; walks of other days have to be reached.
    ends = over.groupBy("series", "day").agg(F.max(F.coalesce("exit_day", F.lit(2**31 - 1))).alias("end"))
    before = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    sure = days.join(ends, ["series", "day"], "left").withColumn("sure", F.coalesce(F.max("end").over(before) < F.col("day"), F.lit(True)))
    since = F.max(F.when(F.col("sure"), F.col("day"))).over(Window.partitionBy("series").orderBy("day"))
    gap = sure.select((F.col("day") - since).alias("gap")).agg(F.max("gap")).first()[0] or 0

    def edges(table: pa.Table) -> pa.Table:
        rows, begins = split(table)
        out = []
        for b in begins:
            last = None
            for x, reason, *_ in walked(rows, b["free"], b["points"], r):
                last = x if reason is None and x["fill_m"] is not None and (x["exit_day"] is None or x["exit_day"] != x["day"]) else None
            nothing = last is None
            out.append({"series": b["series"], "day": b["day"], "held": b["m"], "next_day": b["day"] + 1 if nothing else last["exit_day"], "next_held": FLAT if nothing else last["m"]})
        return pa.Table.from_pylist(out, pa.schema([("series", pa.string()), ("day", pa.int32()), ("held", pa.int64()), ("next_day", pa.int32()), ("next_held", pa.int64())]))

    reached = sure.where("sure").select("series", "day", F.lit(FLAT).cast("long").alias("held"))
    if gap:
        every = tried.unionByName(starts, allowMissingColumns=True)
        to = every.groupBy("series", "day").applyInArrow(edges, EDGE)
        for k in range(gap.bit_length()):  # a walk takes a day at least, so these doublings pass the longest gap
            to = written(to, f"{folder}/edges-{k}")
            more = reached.join(to, ["series", "day", "held"]).where("next_day is not null").select("series", F.col("next_day").alias("day"), F.col("next_held").alias("held"))
            reached = written(reached.unionByName(more).distinct(), f"{folder}/reached-{k}")
            on = to.select("series", F.col("day").alias("next_day"), F.col("held").alias("next_held"), F.col("next_day").alias("d"), F.col("next_held").alias("h"))
            to = to.join(on, ["series", "next_day", "next_held"]).select("series", "day", "held", F.col("d").alias("next_day"), F.col("h").alias("next_held"))
    begun = starts.join(reached.select("series", "day", F.col("held").alias("m")), ["series", "day", "m"])

    def orders(table: pa.Table) -> pa.Table:
        rows, begins = split(table)
        out = []
        for b in begins:
            for x, reason, refusals, points in walked(rows, b["free"], b["points"], r):
                y = {c: x[c] for c in ("series", "ts", "side")} | {"status": "REJECTED" if reason else x["status"], "reason": reason, "refusals": refusals, "day_points": points}
                out.append(y | ({} if reason else {c: x[c] for c in ("fill_m", "fill_px", "exit_m", "exit_px", "exit_kind", "points")}))
        fields = [("series", pa.string()), ("ts", pa.timestamp("us")), ("side", pa.int32()), ("status", pa.string()), ("reason", pa.string()), ("fill_m", pa.int64()), ("fill_px", pa.float64())]
        fields += [("exit_m", pa.int64()), ("exit_px", pa.float64()), ("exit_kind", pa.string()), ("points", pa.float64()), ("refusals", pa.int32()), ("day_points", pa.float64())]
        return pa.Table.from_pylist(out, pa.schema(fields))

    out = tried.unionByName(begun, allowMissingColumns=True).groupBy("series", "day").applyInArrow(orders, ORDER)
    at = lambda c: F.expr(f"timestampadd(MINUTE, {c}, timestamp_ntz'1970-01-01 00:00:00')")
    return out.select("series", "ts", "side", "status", "reason", at("fill_m").alias("fill_ts"), "fill_px", at("exit_m").alias("exit_ts"), "exit_px", "exit_kind", "points", "refusals", "day_points")


def rejections(orders: DataFrame) -> DataFrame:
    """series, day, orders, filled, expired, rejected, by_reason (reason -> count): a row for each day with an order."""
    day = F.to_date("ts").alias("day")
    reasons = orders.where("reason is not null").groupBy("series", day, "reason").agg(F.count(F.lit(1)).alias("n"))
    reasons = reasons.groupBy("series", "day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("by_reason"))
    count = lambda s: F.count_if(F.col("status") == s)
    out = orders.groupBy("series", day).agg(F.count(F.lit(1)).alias("orders"), count("FILLED").alias("filled"), count("EXPIRED").alias("expired"), count("REJECTED").alias("rejected"))
    return out.join(reasons, ["series", "day"], "left")
