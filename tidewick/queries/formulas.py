"""One query for each operator of the formula language, and whole formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewick.functions.scalar import BUCKETS
from tidewick.plans.compiler import evaluate
from tidewick.plans.formula import SERIES, WINDOWED, Node, minutes, parse
from tidewick.queries.bars_sql import E, L
from tidewick.sources import bars

VIEWS = {"L": bars.lineitem_bars, "E": bars.event_bars}
H001 = 'mul(in_window("10:30","16:30"), sub(zscore(ret(ref("ES"),2),55), zscore(ret(close(),2),55)))'
BLOCK = 500  # bars
CORE = 'sub(zscore(ret(ref("ES"),2),55), zscore(ret(close(),2),55))'

#: name: (bars, formula, SQL of the value over b, or of a whole FROM clause)
O = "OVER (ORDER BY ts)"


def roll(w: int) -> str:
    return f"OVER (ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, w: int, value: str) -> str:
    return f"CASE WHEN count({x}) {roll(w)} = {w} THEN {value} END"


def std(x: str, w: int) -> str:
    return f"CASE WHEN max({x}) {roll(w)} = min({x}) {roll(w)} THEN 0.0 ELSE stddev_samp({x}) {roll(w)} END"


def z(x: str, w: int) -> str:
    return full(x, w, f"CASE WHEN ({std(x, w)}) < 1e-12 THEN 0.0 ELSE ({x} - avg({x}) {roll(w)}) / nullif({std(x, w)}, 0) END")


def ret(x: str, w: int) -> str:
    p = f"lag({x}, {w}) {O}"
    return f"CASE WHEN {p} IS NULL OR {x} IS NULL THEN NULL WHEN abs({p}) < 1e-12 THEN 0.0 ELSE {x} / {p} - 1 END"


def staged(inner: dict[str, str], value: str) -> str:
    return f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({value}, 6) AS value FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in inner.items())} FROM b)"


def over(value: str) -> str:
    return f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({value}, 6) AS value FROM b"


EMA_SQL = over("CASE WHEN count(close) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) >= 34 THEN list_reduce(list(close) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda e, x: e * (33.0::DOUBLE / 35) + x * (2.0::DOUBLE / 35)) END")
RANK = full("close", 34, "2.0 * (len(list_filter(s, lambda v: v < close)) + 0.5 * (len(list_filter(s, lambda v: v = close)) - 1)) / 33 - 1")

CASES: dict[str, tuple[str, str, str]] = {
    "op_close": ("L", "close()", over("close")),
    "op_high": ("L", "high()", over("high")),
    "op_low": ("L", "low()", over("low")),
    "op_volume": ("L", "volume()", over("volume")),
    "op_trades": ("L", "trades()", over("trades")),
    "op_vwap": ("L", "vwap()", over("vwap")),
    "op_ref": ("L", 'ref("ES")', over("ref_ES")),
    "op_const": ("L", 'const(3,"Z")', over("3.0::DOUBLE")),
    "op_lag": ("L", "lag(close(),3)", over(f"lag(close, 3) {O}")),
    "op_delta": ("L", "delta(close(),5)", over(f"close - lag(close, 5) {O}")),
    "op_ret": ("L", "ret(close(),2)", over(ret("close", 2))),
    "op_rolling_mean": ("L", "rolling_mean(close(),21)", over(full("close", 21, f"avg(close) {roll(21)}"))),
    "op_rolling_std": ("L", "rolling_std(close(),21)", over(full("close", 21, std("close", 21)))),
    "op_rolling_max": ("L", "rolling_max(high(),13)", over(full("high", 13, f"max(high) {roll(13)}"))),
    "op_rolling_min": ("L", "rolling_min(low(),13)", over(full("low", 13, f"min(low) {roll(13)}"))),
    "op_ema": ("L", "ema(close(),34)", EMA_SQL),
    "op_zscore": ("L", "zscore(close(),55)", over(z("close", 55))),
    "op_rank_ts": ("L", "rank_ts(close(),34)", f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({RANK}, 6) AS value FROM (SELECT *, list(close) {roll(34)} AS s FROM b)"),
    "op_clip": ("L", "clip(zscore(close(),21),-1,1)", staged({"z": z("close", 21)}, "CASE WHEN z IS NOT NULL THEN least(greatest(z, -1.0), 1.0) END")),
    "op_add": ("L", "add(close(),high())", over("close + high")),
    "op_sub": ("L", "sub(high(),low())", over("high - low")),
    "op_mul": ("L", "mul(gt(close(),vwap()),close())", over("(close > vwap)::INT::DOUBLE * close")),
    "op_div": ("L", 'div(delta(close(),1),ref("ES"))', staged({"d": f"close - lag(close, 1) {O}"}, "CASE WHEN d IS NULL THEN NULL WHEN abs(ref_ES) < 1e-12 THEN 0.0 ELSE d / ref_ES END")),
    "op_gt": ("L", "gt(close(),lag(close(),1))", over(f"(close > lag(close, 1) {O})::INT::DOUBLE")),
    "op_lt": ("L", "lt(volume(),rolling_mean(volume(),21))", over(f"(volume < {full('volume', 21, f'avg(volume) {roll(21)}')})::INT::DOUBLE")),
    "op_and": ("L", "and_(gt(close(),lag(close(),1)),lt(close(),high()))", staged({"a": f"close > lag(close, 1) {O}"}, "CASE WHEN a IS NULL THEN NULL ELSE (a AND close < high)::INT::DOUBLE END")),
    "op_or": ("L", "or_(gt(close(),lag(close(),1)),lt(close(),high()))", staged({"a": f"close > lag(close, 1) {O}"}, "CASE WHEN a IS NULL THEN NULL ELSE (a OR close < high)::INT::DOUBLE END")),
    "op_in_window": ("E", 'in_window("10:30","16:30")', over("(tod > 630 AND tod <= 990)::INT::DOUBLE")),
    "op_minutes_since_open": ("E", "minutes_since_open()", over("(tod - min(tod) OVER (PARTITION BY day) + 1)::DOUBLE")),
    "formula_h001": ("E", H001, f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round((tod > 630 AND tod <= 990)::INT * ({z('re', 55)} - ({z('rc', 55)})), 6) AS value FROM (SELECT *, {ret('ref_ES', 2)} AS re, {ret('close', 2)} AS rc FROM b)"),
    "formula_spread": ("L", CORE, f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({z('re', 55)} - ({z('rc', 55)}), 6) AS value FROM (SELECT *, {ret('ref_ES', 2)} AS re, {ret('close', 2)} AS rc FROM b)"),
    "formula_cross_mean": ("L", "gt(rolling_mean(close(),21),rolling_mean(close(),55))", over(f"(({full('close', 21, f'avg(close) {roll(21)}')}) > ({full('close', 55, f'avg(close) {roll(55)}')}))::INT::DOUBLE")),
}

#: Formulas whose SQL is written by translation().
TRANSLATED = {
    "formula_vol_regime": ("L", "gt(rolling_std(delta(high(),1),8), rolling_mean(rolling_std(delta(high(),1),8),55))"),
    "formula_lagged_return": ("L", "clip(div(ret(vwap(),1), lag(rolling_mean(ret(vwap(),1),5),1)),-3,3)"),
}


def shared_batch() -> dict[str, str]:
    """A batch by rule: every windowed operator over one series and another window, standardised, and each neighbouring two of these in one formula, so that all subtrees are shared."""
    inputs = ("close()", "high()", "low()", "vwap()", "volume()", 'ref("ES")', "trades()")
    parts = [f"zscore({op}({inputs[i % len(inputs)]},{BUCKETS[2 + i % 5]}),{BUCKETS[5 + i % 5]})" for i, op in enumerate(sorted(WINDOWED))]
    joins = ("add({0},{1})", "sub({0},{1})", "mul({0},{1})", "div({0},{1})", "gt({0},{1})", "lt({0},{1})", "and_(gt({0},{1}),lt({0},{1}))", "or_(gt({0},{1}),lt({0},{1}))", "clip(add({0},{1}),-2,2)", "mul(lt({0},{1}),{0})")
    return {f"f{i}": j.format(parts[i % len(parts)], parts[(i + 1) % len(parts)]) for i, j in enumerate(joins)}


#: A batch whose formulas share subtrees; each is evaluated once.
BATCH = shared_batch()


def value_of(view: str, formula: str, block: int | None = None):
    def query(spark, sf_dir):
        frame = bars.build_frame(VIEWS[view](spark, sf_dir))
        return evaluate(frame, {"value": parse(formula)}, block).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("value", 6).alias("value"))

    return query


def batch(block: int | None = None):
    """Long form: ts, formula, value."""

    def query(spark, sf_dir):
        out = evaluate(bars.build_frame(bars.lineitem_bars(spark, sf_dir)), BATCH, block)
        pairs = ", ".join(f"'{k}', `{k}`" for k in BATCH)
        return out.selectExpr("date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ts", f"stack({len(BATCH)}, {pairs}) AS (formula, value)").withColumn("value", F.round("value", 6)).withColumn("value", F.when(F.col("value") == 0, 0.0).otherwise(F.col("value")))  # no -0.0

    return query


def entry_frame(spark, sf_dir):
    return value_of("L", CORE)(spark, sf_dir)


def ema_sql(x: str, w: int) -> str:
    seen = f"list_filter(list({x}) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda v: v IS NOT NULL)"
    return f"CASE WHEN {x} IS NOT NULL AND len({seen}) >= {w} THEN list_reduce({seen}, lambda e, v: e * ({w - 1}.0::DOUBLE / {w + 1}) + v * (2.0::DOUBLE / {w + 1})) END"


def rank_sql(x: str, w: int) -> str:
    below = lambda sign: f"len(list_filter(list({x}) {roll(w)}, lambda v: v {sign} {x}))"
    return full(x, w, f"2.0 * ({below('<')} + 0.5 * ({below('=')} - 1)) / {max(w - 1, 1)} - {int(w > 1)}")


def node_sql(n: Node, c: list[str]) -> str:
    """SQL of a node over the columns of its children."""
    x, w = (c + [""])[0], n.args[1] if n.op in WINDOWED else 0
    pair = lambda value: f"CASE WHEN {c[0]} IS NOT NULL AND {c[1]} IS NOT NULL THEN {value} END"
    truth = lambda value: pair(f"({value})::INT::DOUBLE")
    if n.op in SERIES:
        return n.op
    match n.op:
        case "ref":
            return f"ref_{n.args[0]}"
        case "const":
            return f"{n.args[0]}::DOUBLE"
        case "in_window":
            return f"(tod > {minutes(n.args[0])} AND tod <= {minutes(n.args[1])})::INT::DOUBLE"
        case "minutes_since_open":
            return "(tod - min(tod) OVER (PARTITION BY day) + 1)::DOUBLE"
        case "lag":
            return f"lag({x}, {w}) {O}"
        case "delta":
            return f"{x} - lag({x}, {w}) {O}"
        case "ret":
            return ret(x, w)
        case "rolling_mean" | "rolling_max" | "rolling_min":
            return full(x, w, f"{ {'rolling_mean': 'avg', 'rolling_max': 'max', 'rolling_min': 'min'}[n.op]}({x}) {roll(w)}")
        case "rolling_std":
            return full(x, w, std(x, w))
        case "zscore":
            return z(x, w)
        case "ema":
            return ema_sql(x, w)
        case "rank_ts":
            return rank_sql(x, w)
        case "clip":
            return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {n.args[1]}::DOUBLE), {n.args[2]}::DOUBLE) END"
        case "add" | "sub" | "mul":
            return f"{c[0]} { {'add': '+', 'sub': '-', 'mul': '*'}[n.op]} {c[1]}"
        case "div":
            return pair(f"CASE WHEN abs({c[1]}) < 1e-12 THEN 0.0 ELSE {c[0]} / {c[1]} END")
        case "gt" | "lt":
            return truth(f"{c[0]} {'>' if n.op == 'gt' else '<'} {c[1]}")
        case "and_" | "or_":
            return truth(f"{c[0]} <> 0 {'AND' if n.op == 'and_' else 'OR'} {c[1]} <> 0")


def translation(view: str, formulas: dict[str, str], digits: int | None = 6) -> str:
    """SQL of formulas over a view's bars: ts, formula, value (rounded to digits, None: as it is). One stage for each depth, each subtree once."""
    trees = {k: parse(t) for k, t in formulas.items()}
    column: dict[str, str] = {}
    stages: dict[int, list[str]] = {}
    for t in trees.values():
        for n in reversed(list(t.walk())):
            if str(n) not in column:
                sql = node_sql(n, [column[str(x)] for x in n.children()])
                column[str(n)] = f"v{len(column)}"
                stages.setdefault(n.depth(), []).append(f"{sql} AS {column[str(n)]}")
    ctes, at = [], "b"
    for d in sorted(stages):
        ctes.append(f"d{d} AS MATERIALIZED (SELECT *, {', '.join(stages[d])} FROM {at})")
        at = f"d{d}"
    number = lambda x: x if digits is None else f"CASE WHEN round({x}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {digits}) END"  # noqa: E731  no -0.0
    rows = " UNION ALL ".join(f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, '{k}' AS formula, {number(column[str(t)])} AS value FROM {at}" for k, t in trees.items())
    return f"{L if view == 'L' else E}, {', '.join(ctes)} {rows}"


QUERIES = {name: value_of(view, formula) for name, (view, formula, _) in CASES.items()} | {name: value_of(view, formula) for name, (view, formula) in TRANSLATED.items()} | {
    "formula_batch_shared": batch(), "formula_batch_blocks": batch(BLOCK), "formula_spread_blocks": value_of("L", CORE, BLOCK), "op_ema_blocks": value_of("L", "ema(close(),34)", BLOCK),
}
ORACLE_SQL = {name: f"{L if view == 'L' else E} {sql}" for name, (view, _, sql) in CASES.items()}
ORACLE_SQL |= {name: f"SELECT ts, value FROM ({translation(view, {'value': formula})})" for name, (view, formula) in TRANSLATED.items()}
ORACLE_SQL |= {"formula_spread_blocks": ORACLE_SQL["formula_spread"], "op_ema_blocks": ORACLE_SQL["op_ema"]}
BATCH_SQL = translation("L", BATCH)
ORACLE_SQL |= {"formula_batch_shared": BATCH_SQL, "formula_batch_blocks": BATCH_SQL}
