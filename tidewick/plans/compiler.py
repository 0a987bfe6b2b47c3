"""Formulas to columns.

Window functions cannot nest, so the distinct windowed subtrees of all formulas
are put in stages: a stage adds every windowed column whose inputs are ready.
All stages share one partitioning and order, so the bars are shuffled and sorted
once. Everything that is not windowed stays an expression in whole-stage code.

A window over one series is one task: enough where series are many, and the bars are read once. For few long series
``evaluate(..., block=n)`` cuts each series into blocks of n bars, gives every block the bars before it that its formulas
look back to as well, evaluates blocks in parallel and drops the lent bars again. An ema needs all that came before: the
innermost ones are solved first, in stretches (``ema_in_blocks``), and are columns to what stands around them. Values are
the same. The bars are read once more to number them and once for each level of emas, so dear ones are best written first.

A sliding frame aggregates its whole window again for each row. Windows longer than LINEAR rows are therefore put together from
two running aggregates, whose cost doesn't depend on the window: rows are cut into chunks of its length, and every window is the end
of one chunk and the begin of the next (``scan``). Ranks in such windows are kept in order while a chunk is gone through (``ranks``).
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewick.functions import scalar as s
from tidewick.plans.formula import WINDOWED, MarketDataError, Node, check_shape, lookback, minutes, parse

BY, AT, BLOCK, OWN, POS = "series", "ts", "_block", "_own", "_pos"
SINCE_OPEN = Node("_since_open")  # its column, once it is there
SERIES_KEY = (BY,)
#: Rows of a window up to which a sliding frame is used.
LINEAR = 256
SCANNED = ("rolling_mean", "rolling_max", "rolling_min", "rolling_std", "zscore")


def windowed(n: Node, x: Column, by: tuple[str, ...] = SERIES_KEY) -> Column:
    op, w = n.op, n.args[1]

    def order():
        return Window.partitionBy(*by).orderBy(AT)

    def rows(w: int):
        return order().rowsBetween(-(w - 1), 0)

    def full(x: Column, w: int, value: Column) -> Column:
        return F.when(F.count(x).over(rows(w)) == w, value)

    def deviation(x: Column, w: int) -> Column:
        """Sample deviation; exactly 0 for one row or equal rows."""
        if w == 1:
            return F.lit(0.0)
        return F.when(F.max(x).over(rows(w)) == F.min(x).over(rows(w)), 0.0).otherwise(F.stddev_samp(x).over(rows(w)))

    if op == "lag":
        return F.lag(x, w).over(order())
    if op == "delta":
        return x - F.lag(x, w).over(order())
    if op == "ret":
        return s.guarded_return(x, F.lag(x, w).over(order()))
    if op == "rolling_mean":
        return full(x, w, F.avg(x).over(rows(w)))
    if op == "rolling_max":
        return full(x, w, F.max(x).over(rows(w)))
    if op == "rolling_min":
        return full(x, w, F.min(x).over(rows(w)))
    if op == "rolling_std":
        return full(x, w, deviation(x, w))
    if op == "zscore":
        d = deviation(x, w)
        return full(x, w, F.when(d < s.GUARD, 0.0).otherwise(F.try_divide(x - F.avg(x).over(rows(w)), d)))
    if op == "rank_ts":
        if w == 1:
            return full(x, w, F.lit(0.0))
        seen = F.collect_list(x).over(rows(w))
        less, equal = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
        return full(x, w, F.lit(2.0) * (less + F.lit(0.5) * (equal - 1)) / F.lit(float(w - 1)) - F.lit(1.0))
    raise MarketDataError(op)


def scan(df: DataFrame, nodes: Mapping[Node, tuple[str, str]], by: tuple[str, ...] = SERIES_KEY) -> DataFrame:
    """df with the columns of windowed nodes (node -> input, output) that are in SCANNED, at a cost that doesn't grow with the windows.

    A window of w rows ends in a chunk of w rows and begins in the one before. The running aggregates of a chunk from its first row on and
    from its last row back hold both parts; counts add up, extremes are compared, means and squared deviations are merged, so nothing is
    the difference of large sums.
    """
    order = Window.partitionBy(*by).orderBy(AT)
    df = df.withColumn("_row", F.row_number().over(order) - 1)
    helpers = ["_row"]
    parts = {"n": F.count, "m": F.avg, "v": F.var_pop, "hi": F.max, "lo": F.min}
    for w in sorted({n.args[1] for n in nodes}):
        chunk = f"_chunk{w}"
        df = df.withColumn(chunk, F.floor(F.col("_row") / w))
        inside = Window.partitionBy(*by, chunk)
        forth, back = (inside.orderBy(k).rowsBetween(Window.unboundedPreceding, 0) for k in (F.col(AT).asc(), F.col(AT).desc()))
        inputs = {n: x for n, (x, _) in nodes.items() if n.args[1] == w}
        some = dict.fromkeys(inputs.values())
        df = df.withColumns({f"{x}_p{k}{w}": f(x).over(forth) for x in some for k, f in parts.items()})
        df = df.withColumns({f"{x}_s{k}{w}": f(x).over(back) for x in some for k, f in parts.items()})
        whole = F.col("_row") % w == w - 1  # the window is the chunk
        df = df.withColumns({f"{x}_s{k}{w}": F.when(~whole, F.lag(f"{x}_s{k}{w}", w - 1).over(order)) for x in some for k in parts})
        new = {}
        for n, x in inputs.items():
            p, q = ({k: F.col(f"{x}_{side}{k}{w}") for k in parts} for side in "ps")
            pn, qn = p["n"], F.coalesce(q["n"], F.lit(0))
            full = (pn + qn == w) & (F.col("_row") >= w - 1)
            hi, lo = F.greatest(p["hi"], q["hi"]), F.least(p["lo"], q["lo"])
            mean = F.when(qn > 0, (pn * p["m"] + qn * q["m"]) / w).otherwise(p["m"])
            apart = F.when(qn > 0, qn * q["v"] + (p["m"] - q["m"]) * (p["m"] - q["m"]) * pn * qn / w).otherwise(0.0)
            sd = F.when(hi == lo, 0.0).otherwise(F.sqrt((pn * p["v"] + apart) / (w - 1)))
            value = {
                "rolling_mean": lambda: mean, "rolling_max": lambda: hi, "rolling_min": lambda: lo, "rolling_std": lambda: sd,
                "zscore": lambda: F.when(sd < s.GUARD, 0.0).otherwise(F.try_divide(F.col(x) - mean, sd)),
            }[n.op]()
            new[nodes[n][1]] = F.when(full, value)
        df = df.withColumns(new).drop(chunk, *[f"{x}_{side}{k}{w}" for x in some for side in "ps" for k in parts])
    return df.drop(*helpers)


def ranks(df: DataFrame, n: Node, x: str, out: str, by: tuple[str, ...] = SERIES_KEY) -> DataFrame:
    """df with the rank of x in the last rows of n, in out. A task holds two chunks of the window's length at a time: a chunk is gone through with its window kept in order."""
    w = n.args[1]
    df = df.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(AT)) - 1)
    keys = [*by, "_row"]
    lent = df.select(*keys, F.col(x).cast("double").alias("x"), F.floor(F.col("_row") / w).alias("own")).withColumn("chunk", F.explode(F.array("own", F.col("own") + 1)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        v, own = table["x"].to_numpy(zero_copy_only=False), table["own"].to_numpy()
        begin = int(np.searchsorted(own, table["chunk"][0].as_py()))
        got, kept = np.full(len(v), np.nan), []
        for i, a in enumerate(v):
            if a == a:
                bisect.insort(kept, a)
            if i >= w and v[i - w] == v[i - w]:
                del kept[bisect.bisect_left(kept, v[i - w])]
            if i >= begin and len(kept) == w:
                less = bisect.bisect_left(kept, a)
                got[i] = 2.0 * (less + 0.5 * (bisect.bisect_right(kept, a) - less - 1)) / (w - 1) - 1.0
        return table.select(keys).append_column(out, pa.array(got, from_pandas=True)).slice(begin)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lent.select(*keys).schema)
    found = lent.groupBy(*by, "chunk").applyInArrow(run, f"{types}, {out} double")
    same = functools.reduce(Column.__and__, [df[k].eqNullSafe(found[k]) for k in keys])
    return df.join(found, same, "left").select(*[df[c] for c in df.columns if c != "_row"], found[out])


def stretch(w: int) -> int:
    """How many values g ** -i stays finite for, with g = 1 - 2 / (w + 1)."""
    return max(1, int(250 / -math.log10(1.0 - 2.0 / (w + 1))))


def ema(df: DataFrame, x: str, w: int, out: str, seen: str | None = None, by: tuple[str, ...] = SERIES_KEY) -> DataFrame:
    """e[t] = (1 - a) e[t-1] + a x[t] with a = 2 / (w + 1), from the first value on; NULL until w values and where x is, which leaves e as it was.

    The recurrence is solved in stretches: within a stretch a running sum of x / g**i, scaled back by g**i; over stretches
    the end of the one before, scaled. A stretch is as long as g**-i stays finite, so what lies two stretches back is below
    1e-250. seen: a column with the number of values up to each bar, where by does not hold the series from its first on.
    """
    if w == 1:
        return df.withColumn(out, F.col(x))
    a = 2.0 / (w + 1)
    g = 1.0 - a
    size = stretch(w)
    n, i, part_of, part, end = (f"{out}_{k}" for k in ("n", "i", "stretch", "part", "end"))
    order = Window.partitionBy(*by).orderBy(AT)
    df = df.withColumn(n, F.col(seen) if seen else F.count(x).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn(part_of, F.floor((F.col(n) - 1) / size)).withColumn(i, (F.col(n) - 1) % size)
    weight = F.when(F.col(n) == 1, 1.0).otherwise(a)
    inside = Window.partitionBy(*by, part_of).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    scale = F.pow(F.lit(g), F.col(i).cast("double"))
    df = df.withColumn(part, F.sum(weight * F.col(x) / scale).over(inside) * scale)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(end, F.last(F.when(F.col(i) == size - 1, F.col(part)), ignorenulls=True).over(before))
    carry = F.when(F.col(part_of) > 0, F.col(end) * scale * g).otherwise(0.0)
    return df.withColumn(out, F.when(F.col(x).isNotNull() & (F.col(n) >= w), F.col(part) + carry)).drop(n, i, part_of, part, end)


def ema_in_blocks(bars: DataFrame, emas: Mapping[str, tuple[str, int]]) -> DataFrame:
    """bars with a column for each name: (x, w) of emas, in parallel.

    Values are counted in each block; a row for each block then tells how many came before it. A stretch is evaluated
    together with the one before it, whose end it goes on from.
    """
    counts = {x: f"{x}_seen" for x, _ in emas.values()}
    so_far = Window.partitionBy(BY).orderBy(OWN).rowsBetween(Window.unboundedPreceding, -1)
    earlier = bars.groupBy(BY, OWN).agg(*[F.count(x).alias(n) for x, n in counts.items()])
    earlier = earlier.select(BY, OWN, *[F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(n) for n in counts.values()])
    within = Window.partitionBy(BY, OWN).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.join(earlier, [BY, OWN]).withColumns({n: F.col(n) + F.count(x).over(within) for x, n in counts.items()})
    for out, (x, w) in emas.items():
        if w == 1:
            bars = bars.withColumn(out, F.col(x))
            continue
        own = F.floor((F.col(counts[x]) - 1) / stretch(w))
        bars = bars.withColumn("_from", own).withColumn(BLOCK, F.explode(F.array(own, own + 1)))
        bars = ema(bars, x, w, out, counts[x], (BY, BLOCK)).where(F.col(BLOCK) == F.col("_from")).drop("_from", BLOCK)
    return bars.drop(*counts, *counts.values())


def plain(n: Node, done: Mapping[Node, str], columns: set[str]) -> Column:
    if n in done:
        return F.col(done[n])
    op, a = n.op, n.args
    if op == "ref":
        if f"ref_{a[0]}" not in columns:
            raise MarketDataError(f"no bars of {a[0]}")
        return F.col(f"ref_{a[0]}")
    if op == "const":
        return F.lit(float(a[0]))
    if op == "in_window":
        tod = s.minute_of_day(F.col(AT))
        return s.truth((tod > minutes(a[0])) & (tod <= minutes(a[1])))
    if not a:
        return F.col(op)
    x = [plain(c, done, columns) for c in n.children()]
    if op == "clip":
        return s.clipped(x[0], a[1], a[2])
    p, q = x
    return {
        "add": lambda: p + q, "sub": lambda: p - q, "mul": lambda: p * q, "div": lambda: s.guarded_div(p, q), "gt": lambda: s.truth(p > q), "lt": lambda: s.truth(p < q),
        "and_": lambda: s.both(p, q), "or_": lambda: s.either(p, q),
    }[op]()


def since_open() -> Column:
    minute = s.minute_of_day(F.col(AT))
    return (minute - F.min(minute).over(Window.partitionBy(BY, F.to_date(AT))) + 1).cast("double")


def needs_window(n: Node) -> bool:
    return n.op in WINDOWED or n.op == "minutes_since_open"


def placed(bars: DataFrame, block: int, trees: Mapping[str, Node]) -> DataFrame:
    """bars with their place in the series (POS) and their block (OWN), and the minutes since the open if a formula asks for them."""
    from tidewick.operators.prep import positions

    if any(n.op == "minutes_since_open" for t in trees.values() for n in t.walk()):
        bars = bars.withColumn(SINCE_OPEN.op, since_open())
    day = "day" in bars.columns
    bars = positions(bars if day else bars.withColumn("day", F.to_date(AT)), POS).withColumn(OWN, F.floor(F.col(POS) / block))
    return bars if day else bars.drop("day")


def blockwise(bars: DataFrame, trees: Mapping[str, Node], block: int) -> DataFrame:
    """staged, in blocks: each bar goes to its own and is lent to those that look back to it."""
    if not any(needs_window(n) for t in trees.values() for n in t.walk()):
        return staged(bars, trees)
    last = F.floor((F.col(POS) + max(map(lookback, trees.values()))) / block)
    lent = bars.withColumn(BLOCK, F.explode(F.sequence(F.col(OWN), last)))
    return staged(lent, trees, (BY, BLOCK)).where(F.col(BLOCK) == F.col(OWN)).drop(BLOCK)


def replaced(n: Node, by: Mapping[Node, Node]) -> Node:
    """n with the subtrees that by names replaced."""
    return by.get(n) or Node(n.op, tuple(replaced(a, by) if isinstance(a, Node) else a for a in n.args))


def innermost_emas(trees: Mapping[str, Node]) -> list[Node]:
    every = dict.fromkeys(n for t in trees.values() for n in t.walk() if n.op == "ema")
    return [n for n in every if not any(c.op == "ema" for c in n.args[0].walk())]


def evaluate(bars: DataFrame, formulas: Mapping[str, str | Node], block: int | None = None) -> DataFrame:
    """bars with a column for each formula; equal subtrees are computed once. block: see above."""
    trees = {k: parse(f) if isinstance(f, str) else f for k, f in formulas.items()}
    for t in trees.values():
        check_shape(t)
    if not block or not any(needs_window(n) for t in trees.values() for n in t.walk()):
        return staged(bars, trees)
    bars = placed(bars, block, trees)
    trees = {k: replaced(t, {Node("minutes_since_open"): SINCE_OPEN}) for k, t in trees.items()}
    helpers = [POS, OWN, SINCE_OPEN.op]
    while emas := innermost_emas(trees):
        names = {n: f"_e{len(helpers) + k}" for k, n in enumerate(emas)}
        inputs = {c: f"{names[n]}_x" for n in emas for c in n.children()}
        bars = blockwise(bars, {x: c for c, x in inputs.items()}, block)
        bars = ema_in_blocks(bars, {names[n]: (inputs[n.args[0]], n.args[1]) for n in emas})
        trees = {k: replaced(t, {n: Node(x) for n, x in names.items()}) for k, t in trees.items()}
        helpers += names.values()
    return blockwise(bars, trees, block).drop(*helpers)


def staged(bars: DataFrame, trees: Mapping[str, Node], by: tuple[str, ...] = SERIES_KEY) -> DataFrame:
    """bars with a column for each tree, by stages of windows over by."""
    columns = set(bars.columns)
    level: dict[Node, int] = {}

    def place(n: Node) -> int:
        if n not in level:
            level[n] = max((place(c) for c in n.children()), default=0) + needs_window(n)
        return level[n]

    top = max(map(place, trees.values()), default=0)
    done: dict[Node, str] = {}
    for stage in range(1, top + 1):
        new = [n for n, k in level.items() if k == stage and needs_window(n)]
        names = {n: f"_w{len(done) + j}" for j, n in enumerate(new)}
        inputs = {n: f"{names[n]}_x" for n in new if n.op != "minutes_since_open"}
        bars = bars.withColumns({inputs[n]: plain(n.args[0], done, columns) for n in inputs})
        long = [n for n in inputs if n.args[1] > LINEAR and n.op in (*SCANNED, "rank_ts")]
        bars = bars.withColumns({names[n]: windowed(n, F.col(inputs[n]), by) if n in inputs else since_open() for n in new if n.op != "ema" and n not in long})
        if scanned := {n: (inputs[n], names[n]) for n in long if n.op in SCANNED}:
            bars = scan(bars, scanned, by)
        for n in long:
            if n.op == "rank_ts":
                bars = ranks(bars, n, inputs[n], names[n], by)
        for n in new:
            if n.op == "ema":
                bars = ema(bars, inputs[n], n.args[1], names[n])
        bars = bars.drop(*inputs.values())
        done |= names
    return bars.withColumns({k: plain(t, done, columns) for k, t in trees.items()}).drop(*done.values())
