"""Queries of the order simulation, and its bar-by-bar twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewick.operators import orders, prep
from tidewick.plans.compiler import evaluate
from tidewick.queries.bars_sql import E
from tidewick.queries.formulas import z
from tidewick.queries.preparation import frame_e, stamp

WARMUP = 24
RULES = {
    "market": orders.Rules(threshold=0.8, max_holding=180, tick=0.5, stop_points=40.0, target_points=25.0, daily_loss=20.0),
    "limit": orders.Rules(threshold=0.5, direction=-1, max_holding=1500, tick=0.5, limit_points=5.0, life=240, stop_points=60.0, daily_loss=45.0, cutoff=1441, session=(300, 1441), max_refusals=4),
}


def simulated(spark, d):
    """Every rule set over the same bars; each tenth day of a month counts as a roll day."""
    bars = evaluate(prep.positions(frame_e(spark, d)), {"signal": "zscore(close(),8)"})
    bars = bars.withColumn("roll_day", F.dayofmonth("ts") % 10 == 0)
    out = None
    for name, r in RULES.items():
        x = orders.simulate(bars.withColumn("series", F.lit(name)), r, WARMUP)
        out = x if out is None else out.unionByName(x)
    return out


def sim_orders(spark, d):
    x = simulated(spark, d)
    number = {c: F.round(c, 6).alias(c) for c in ("fill_px", "exit_px", "points", "day_points")}
    times = {c: stamp(c).alias(c) for c in ("ts", "fill_ts", "exit_ts")}
    return x.select(*[number.get(c, times.get(c, F.col(c))) for c in x.columns])


def sim_rejections(spark, d):
    x = orders.rejections(simulated(spark, d))
    return x.withColumns({"day": F.col("day").cast("string"), "by_reason": F.to_json("by_reason")})


QUERIES = {f.__name__: f for f in (sim_orders, sim_rejections)}


def rounded(x: str, side: str, tick: float) -> str:
    return f"(CASE WHEN {side} > 0 THEN ceil(({x}) / {tick} - 1e-9) ELSE floor(({x}) / {tick} + 1e-9) END * {tick})"


def walk_sql(name: str, r: orders.Rules) -> str:
    """One bar after the other: a state of position or resting order, the day's points and refusals, and what the bar did."""
    t = r.tick
    same = "x.day = s.day"
    pnl, ref = f"CASE WHEN {same} THEN s.pnl ELSE 0 END", f"CASE WHEN {same} THEN s.ref ELSE 0 END"
    stop = f"s.held <> 0 AND CASE WHEN s.held > 0 THEN x.low <= s.px - {r.stop_points} ELSE x.high >= s.px + {r.stop_points} END" if r.stop_points is not None else "false"
    goal = f"s.held <> 0 AND CASE WHEN s.held > 0 THEN x.high > s.px + {r.target_points} ELSE x.low < s.px - {r.target_points} END" if r.target_points is not None else "false"
    late = f"s.held <> 0 AND (x.tod >= {r.cutoff} OR x.m - s.fm >= {r.max_holding})"
    kind = f"CASE WHEN {stop} THEN 'STOP' WHEN {goal} THEN 'TARGET' WHEN {late} THEN 'FLATTEN' END"
    price = (
        f"CASE WHEN {stop} THEN {rounded(f's.px - s.held * {r.stop_points or 0}', '-s.held', t)} - s.held * {t} WHEN {goal} THEN {rounded(f's.px + s.held * {r.target_points or 0}', '-s.held', t)} "
        f"WHEN {late} THEN {rounded('x.close', '-s.held', t)} - s.held * {t} END"
    )
    gone = f"s.rest <> 0 AND (x.day <> s.oday OR x.tod >= {r.cutoff} OR x.m - s.om > {r.life})"
    through = f"s.rest <> 0 AND NOT ({gone}) AND CASE WHEN s.rest > 0 THEN x.low < s.lv ELSE x.high > s.lv END"
    why = (
        f"CASE WHEN {ref} >= {r.max_refusals} THEN 'BREAKER' WHEN {pnl} <= -{r.daily_loss} THEN 'DAILY_LOSS' WHEN x.tod >= {r.cutoff} OR x.tod > {r.session[1]} THEN 'CUTOFF' "
        f"WHEN x.tod <= {r.session[0]} THEN 'SESSION' WHEN x.roll THEN 'ROLL_DAY' END"
    )
    asks = f"s.held = 0 AND (s.rest = 0 OR ({gone})) AND x.side <> 0"
    placed = f"(v.asks AND v.why IS NULL)"  # noqa: F541
    limit = r.limit_points is not None
    level = rounded(f"v.close - v.side * {r.limit_points or 0}", "v.side", t)
    market = f"{rounded('v.close', 'v.side', t)} + v.side * {t}"
    sg = f"{name}_sg AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts) - 1 AS n, ts, day, tod, epoch(ts)::BIGINT // 60 AS m, close, high, low, day(day) % 10 = 0 AS roll, {r.direction} * {z('close', 8)} AS sig FROM b)"
    bx = f"{name}_b AS MATERIALIZED (SELECT *, CASE WHEN n < {WARMUP} THEN 0 WHEN sig > {r.threshold} THEN 1 WHEN sig < -{r.threshold} THEN -1 ELSE 0 END AS side FROM {name}_sg)"
    look = (
        f"SELECT x.*, s.held, s.fm, s.px, s.om, s.rest, s.lv, s.oday, {pnl} AS p0, {ref} AS r0, {kind} AS kind, {price} AS price, ({gone}) AS gone, ({through}) AS through, ({asks}) AS asks, {why} AS why "
        f"FROM {name}_s s JOIN {name}_b x ON x.n = s.n + 1"
    )
    step = (
        f"SELECT v.n, v.day, CASE WHEN v.kind IS NOT NULL THEN 0 WHEN v.through THEN v.rest WHEN {placed} AND {not limit} THEN v.side ELSE v.held END AS held, "
        f"CASE WHEN v.through OR ({placed} AND {not limit}) THEN v.m ELSE v.fm END AS fm, CASE WHEN v.through THEN v.lv WHEN {placed} AND {not limit} THEN {market} ELSE v.px END AS px, "
        f"CASE WHEN {placed} THEN v.m ELSE v.om END AS om, CASE WHEN {placed} AND {limit} THEN v.side WHEN v.through OR v.gone THEN 0 ELSE v.rest END AS rest, "
        f"CASE WHEN {placed} AND {limit} THEN {level} ELSE v.lv END AS lv, CASE WHEN {placed} THEN v.day ELSE v.oday END AS oday, "
        f"v.p0 + CASE WHEN v.kind IS NOT NULL THEN (v.price - v.px) * v.held ELSE 0 END AS pnl, v.r0 + (v.asks AND coalesce(v.why IN ('CUTOFF', 'ROLL_DAY', 'MARGIN'), false))::INT AS ref, "
        f"v.ts, v.m, v.side, v.asks, CASE WHEN v.asks THEN v.why END AS why, v.kind, v.price, v.gone, v.through, v.om AS was, v.px AS had, v.held AS hs, v.p0 FROM ({look}) v"
    )
    start = (
        f"SELECT -1::BIGINT AS n, NULL::DATE AS day, 0 AS held, 0::BIGINT AS fm, 0::DOUBLE AS px, 0::BIGINT AS om, 0 AS rest, 0::DOUBLE AS lv, NULL::DATE AS oday, 0::DOUBLE AS pnl, 0 AS ref, NULL::TIMESTAMP AS ts, 0::BIGINT AS m, 0 AS side, "
        "false AS asks, NULL::VARCHAR AS why, NULL::VARCHAR AS kind, 0::DOUBLE AS price, false AS gone, false AS through, 0::BIGINT AS was, 0::DOUBLE AS had, 0 AS hs, 0::DOUBLE AS p0"
    )
    out = (
        f"{name}_o AS (SELECT '{name}' AS series, a.ts, a.side, CASE WHEN a.why IS NOT NULL THEN 'REJECTED' WHEN f.n IS NOT NULL THEN 'FILLED' WHEN g.n IS NOT NULL THEN 'EXPIRED' ELSE 'RESTING' END AS status, a.why AS reason, "
        f"f.ts AS fill_ts, f.px AS fill_px, e.ts AS exit_ts, e.price AS exit_px, e.kind AS exit_kind, (e.price - e.had) * e.hs AS points, a.ref AS refusals, a.p0 AS day_points FROM {name}_s a "
        f"LEFT JOIN {name}_s f ON a.why IS NULL AND " + ("f.through AND f.was = a.m " if limit else "f.n = a.n ")
        + f"LEFT JOIN {name}_s g ON a.why IS NULL AND g.gone AND g.was = a.m LEFT JOIN {name}_s e ON a.why IS NULL AND e.kind IS NOT NULL AND e.was = a.m WHERE a.asks)"
    )
    return f"{sg}, {bx}, {name}_s AS ({start} UNION ALL {step}), {out}"


WALK_SQL = E.replace("WITH", "WITH RECURSIVE", 1) + ", " + ", ".join(walk_sql(n, r) for n, r in RULES.items()) + ", o AS (" + " UNION ALL ".join(f"SELECT * FROM {n}_o" for n in RULES) + ")"
TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
ORACLE_SQL = {
    "sim_orders": f"{WALK_SQL} SELECT series, {TIME.format('ts')}, side, status, reason, {TIME.format('fill_ts')}, round(fill_px, 6) AS fill_px, {TIME.format('exit_ts')}, round(exit_px, 6) AS exit_px, exit_kind, "
    "round(points, 6) AS points, refusals, round(day_points, 6) AS day_points FROM o",
    "sim_rejections": f"""{WALK_SQL}, w AS (SELECT series, ts::DATE AS day, reason, count(*) AS n FROM o WHERE reason IS NOT NULL GROUP BY ALL),
wj AS (SELECT series, day, '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS by_reason FROM w GROUP BY ALL)
SELECT q.series, q.day::VARCHAR AS day, q.orders, q.filled, q.expired, q.rejected, wj.by_reason FROM (
  SELECT series, ts::DATE AS day, count(*) AS orders, count_if(status = 'FILLED')::BIGINT AS filled, count_if(status = 'EXPIRED')::BIGINT AS expired, count_if(status = 'REJECTED')::BIGINT AS rejected FROM o GROUP BY ALL
) q LEFT JOIN wj ON wj.series = q.series AND wj.day = q.day""",
}
