"""Queries of the statistical gates; trials and folds are derived from lineitem."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewick.functions.scalar import for_duckdb, normal_cdf
from tidewick.operators import cross_validation as cv
from tidewick.operators import calibration, gate, prep, robot, robustness
from tidewick.queries.bars_sql import E
from tidewick.queries.formulas import translation, z
from tidewick.queries.preparation import frame_e, stamp

TRADES_SQL = """
t AS MATERIALIZED (
  SELECT l_suppkey % 12 AS trial, (l_partkey % 28)::INT AS path_id, l_shipdate::DATE AS day, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
    l_extendedprice * (l_discount - 0.05) / 100 + (l_suppkey % 12) * 2.5 AS gross, l_tax * 100 AS cost, l_quantity * 60 AS holding_s FROM lineitem
)"""

FOLDS_SQL = f"""{TRADES_SQL},
u AS (SELECT *, gross - cost AS net FROM t),
v AS (SELECT *, avg(net) OVER (PARTITION BY trial, path_id) AS m, sum(net) OVER (PARTITION BY trial, path_id ORDER BY day, seq ROWS UNBOUNDED PRECEDING) AS eq, count(*) OVER (PARTITION BY trial, path_id, day) AS n_day FROM u),
x AS (SELECT *, greatest(max(eq) OVER (PARTITION BY trial, path_id ORDER BY day, seq ROWS UNBOUNDED PRECEDING), 0) - eq AS dd FROM v),
folds AS MATERIALIZED (
  SELECT trial, path_id, count(*) AS n_trades, sum(gross) AS gross_pnl_points, sum(cost) AS cost_points, sum(net) AS net_pnl_points,
    CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * {math.sqrt(252.0)!r} ELSE 0 END AS sharpe, max(dd) AS max_dd_points, avg((net > 0)::INT) AS hit_rate,
    floor(avg(holding_s))::BIGINT AS avg_holding_s, avg((net - m) ** 3) / pow(avg((net - m) ** 2), 1.5) AS skew, avg((net - m) ** 4) / pow(avg((net - m) ** 2), 2) AS kurtosis,
    count(DISTINCT day) AS active_days, max(n_day) / count(*) AS max_day_share
  FROM x GROUP BY 1, 2
)"""

ROWS_SQL = f"""{FOLDS_SQL},
md AS (SELECT trial, median(net_pnl_points) AS net FROM folds GROUP BY 1),
g AS MATERIALIZED (
  SELECT f.trial, floor(median(n_trades))::BIGINT AS total_trades, min(n_trades) AS min_path_trades, floor(median(active_days))::BIGINT AS active_days, max(max_day_share) AS max_day_share,
    sum(gross_pnl_points) AS gross_points, sum(cost_points) AS cost_points, avg((net_pnl_points * (CASE WHEN md.net >= 0 THEN 1 ELSE -1 END) < 0)::INT) AS sign_flip_frac,
    median(sharpe) / {math.sqrt(252.0)!r} AS sr, median(skew) AS skew, median(kurtosis) AS kurtosis, count(*) AS units, greatest(floor(median(n_trades))::BIGINT, 2) AS n_obs
  FROM folds f JOIN md ON f.trial = md.trial GROUP BY 1
)"""


def trades(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select(
        (F.col("l_suppkey") % 12).alias("trial"), (F.col("l_partkey") % 28).cast("int").alias("path_id"), F.to_date("l_shipdate").alias("day"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / 100 + (F.col("l_suppkey") % 12) * 2.5).alias("gross"), (F.col("l_tax") * 100).alias("cost"), (F.col("l_quantity") * 60).alias("holding_s"),
    )


def folds(spark, d):
    return gate.fold_metrics(trades(spark, d), ["trial", "path_id"])


def gate_rows(spark, d):
    return gate.aggregate_folds(folds(spark, d), ["trial"])


def rounded(df, names, k=6):
    return df.withColumns({c: F.round(c, k) for c in names})


FOLD_NUMBERS = ("gross_pnl_points", "cost_points", "net_pnl_points", "sharpe", "max_dd_points", "hit_rate", "skew", "kurtosis", "max_day_share")


def sim_fold_metrics(spark, d):
    return rounded(folds(spark, d), FOLD_NUMBERS, 6)


def gate_aggregate(spark, d):
    return rounded(gate_rows(spark, d), ("max_day_share", "gross_points", "cost_points", "sign_flip_frac", "sr", "skew", "kurtosis"), 6)


def gate_aggregate_paths(spark, d):
    out = gate.aggregate_folds(folds(spark, d), ["trial"], unit="paths", expected=28)
    return rounded(out, ("max_day_share", "gross_points", "cost_points", "sign_flip_frac", "sr"), 6).select("trial", "total_trades", "min_path_trades", "active_days", "gross_points", "cost_points", "sr", "n_obs")


def gate_sr_star(spark, d):
    """What the best of each customer's orders, taken for trials, is expected to show without any worth."""
    n = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("trials"))
    return n.select("o_custkey", "trials", F.round(F.expr(gate.sr_star_sql("0.6D", "cast(trials as double)")), 6).alias("sr_star"))


STAR = gate.sr_star(0.001, 3000)


def with_dsr(rows):
    return gate.deflated_sharpe(rows.withColumn("star", F.lit(STAR)), "sr", "star", "n_obs", "skew", "kurtosis")


DSR_SQL = f"""dz AS (SELECT *, (sr - {STAR!r}) * sqrt(n_obs - 1) / sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) AS z FROM g),
ds AS (SELECT *, {for_duckdb(normal_cdf('z'))} AS dsr FROM dz)"""


def gate_dsr(spark, d):
    return with_dsr(gate_rows(spark, d)).select("trial", F.round("dsr", 6).alias("dsr"))


def gate_var_sr(spark, d):
    return gate_rows(spark, d).agg(F.round(F.var_samp("sr"), 8).alias("var_sr"), F.count(F.lit(1)).alias("trials"))


def performance(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.groupBy(F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("t"), (F.col("l_suppkey") % 8).cast("int").alias("config")).agg(
        F.round(F.sum((F.col("l_discount") - 0.05) * F.col("l_quantity")), 6).alias("value")
    )


def gate_pbo(spark, d):
    return gate.overfitting(performance(spark, d), 6).withColumn("pbo", F.round("pbo", 6))


HALVES_SQL = """
i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM p)),
k AS (SELECT t, CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE n % 6 + (i - (n % 6) * (n // 6 + 1)) // (n // 6) END AS block FROM i),
c AS (SELECT m FROM range(64) r(m) WHERE bit_count(m::INT) = 3),
s AS (
  SELECT c.m, config, (c.m >> block::INT) & 1 AS inside, round(CASE WHEN stddev_samp(value) > 1e-12 THEN avg(value) / stddev_samp(value) ELSE 0 END, 12) AS sharpe FROM p JOIN k USING (t), c GROUP BY 1, 2, 3
),
best AS (SELECT m, arg_max(config, row(sharpe, -config)) AS config, count(*) AS configs FROM s WHERE inside = 1 GROUP BY 1),
r AS (SELECT m, config, rank() OVER (PARTITION BY m ORDER BY sharpe) + (count(*) OVER (PARTITION BY m, sharpe) - 1) / 2 AS r FROM s WHERE inside = 0)"""

PBO_SQL = f"""WITH p AS (SELECT date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS t, (l_suppkey % 8)::INT AS config, round(sum((l_discount - 0.05) * l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2), {HALVES_SQL}
SELECT round(avg((r.r / (configs + 1) <= 0.5)::INT), 6) AS pbo, count(*) AS combinations FROM r JOIN best ON r.m = best.m AND r.config = best.config
"""


def batteries(spark, d):
    """Variants of the trials made of lineitem, which have trades but no formula to run again: stand-ins for gate_collapse."""
    t = trades(spark, d).withColumn("net", F.col("gross") - F.col("cost"))
    ref = t.groupBy("trial").agg(F.round(F.sum("net"), 4).alias("net"), F.count(F.lit(1)).alias("n"))
    noise = ref.select("trial", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("variant"), "net", "n").withColumn("net", F.col("net") + ((F.col("variant") * 37 + F.col("trial") * 11) % 101 - 50) * F.col("n") / 50.0)
    third = F.year("day").cast("int") % 3
    sub = t.groupBy("trial", third.alias("variant")).agg(F.round(F.sum("net"), 4).alias("net"))
    cost = t.groupBy("trial").agg(F.round(F.sum(F.col("gross") - 1.5 * F.col("cost")), 4).alias("a"), F.round(F.sum(F.col("gross") - 2.0 * F.col("cost")), 4).alias("b")).selectExpr("trial", "stack(2, 0, a, 1, b) AS (variant, net)")
    par = t.groupBy("trial", (F.col("path_id") % 2).alias("variant")).agg(F.round(F.sum("net"), 4).alias("net"))
    parts = [("reference", ref.select("trial", F.lit(0).alias("variant"), "net")), ("noise", noise.drop("n")), ("subperiod", sub), ("cost", cost), ("parameter", par)]
    out = None
    for name, x in parts:
        x = x.select("trial", F.lit(name).alias("battery"), F.col("variant").cast("int").alias("variant"), "net")
        out = x if out is None else out.unionByName(x)
    return out


ROBUST_SQL = f"""{TRADES_SQL}, rn AS (SELECT *, gross - cost AS net FROM t),
ref AS (SELECT trial, round(sum(net), 4) AS net, count(*) AS n FROM rn GROUP BY 1),
noise AS (SELECT trial, median(net + ((v * 37 + trial * 11) % 101 - 50) * n / 50.0) AS x FROM ref, range(100) q(v) GROUP BY 1),
sub AS (SELECT trial, min(s) AS x, count(*) AS n FROM (SELECT trial, round(sum(net), 4) AS s FROM rn GROUP BY trial, year(day) % 3) GROUP BY 1),
cst AS (SELECT trial, least(round(sum(gross - 1.5 * cost), 4), round(sum(gross - 2.0 * cost), 4)) AS x FROM rn GROUP BY 1),
par AS (SELECT trial, min(s) AS x FROM (SELECT trial, round(sum(net), 4) AS s FROM rn GROUP BY trial, path_id % 2) GROUP BY 1),
jd AS (SELECT ref.trial, noise.x > 0 AS noise, sub.n = 3 AND ref.net > 0 AND sub.x > 0 AS subperiods, cst.x > 0 AS costs, ref.net > 0 AND par.x > 0 AS parameters
  FROM ref JOIN noise USING (trial) JOIN sub USING (trial) JOIN cst USING (trial) JOIN par USING (trial)),
jr AS (SELECT *, noise AND subperiods AND costs AND parameters AS robust FROM jd)"""


#: Trials that are run again: column and window of a z-score, direction.
RERUN = {"revert": ("close", 8, -1), "follow": ("close", 8, 1), "typical": ("vwap", 21, -1)}
NEAR = {8: (5, 13), 21: (13, 34)}
RERUN_LIMITS = robot.Limits(tick_size=0.5)
RERUN_COSTS = {"point_value": 0.2, "tick_size": 0.5, "slippage_ticks": 1, "exchange_fee": 0.25, "brokerage": 0.0, "margin_per_contract": 155.0}


def reruns(spark, d):
    frame = prep.positions(frame_e(spark, d))
    out = None
    for trial, (column, w, direction) in RERUN.items():
        x = robustness.battery(frame, f"zscore({column}(),{w})", RERUN_COSTS, RERUN_LIMITS, 0.8, direction, 180)
        x = x.select(F.lit(trial).alias("trial"), "battery", "variant", "trades", "net")
        out = x if out is None else out.unionByName(x)
    return out


def gate_reruns(spark, d):
    """Every trial on noise, slices of time, dearer costs and neighbouring windows."""
    return reruns(spark, d).withColumn("net", F.round("net", 6))


def gate_robustness(spark, d):
    return gate.judge(reruns(spark, d), "trial")


def rerun_signals() -> str:
    by = lambda x, w: z(x, w).replace("ORDER BY", "PARTITION BY battery, variant ORDER BY")
    parts = []
    for trial, (x, w, direction) in RERUN.items():
        for v, test in ((w, "battery <> 'parameter'"), *((v, f"battery = 'parameter' AND variant = {k}") for k, v in enumerate(NEAR[w]))):
            parts.append(f"SELECT '{trial}' AS trial, battery, variant, pos, m, tod, close, {direction} * CASE WHEN pos >= {v - 1} THEN {by(x, v)} END AS s FROM rb WHERE {test}")
    return " UNION ALL ".join(parts)


#: Positions by jumps: where an entry at a bar would end, and the first entry after that, are known without the state.
KEY = "trial, battery, variant"
RERUNS_SQL = f"""{E.replace("WITH", "WITH RECURSIVE", 1)},
pl AS (SELECT 'reference' AS battery, 0 AS variant, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n, epoch(ts) // 60 AS m, ts, tod, close, vwap FROM b),
sh AS (SELECT v::INT AS variant, pos, m, ts, tod, close, vwap, CASE WHEN ascii(md5(v || ':' || pos)) % 2 = 0 THEN 0.5 ELSE -0.5 END AS x FROM pl, range(100) q(v)),
rb AS MATERIALIZED (
  SELECT battery, variant, pos, m, ts, tod, close, vwap FROM pl UNION ALL SELECT 'noise', variant, pos, m, ts, tod, close + x, vwap + x FROM sh
  UNION ALL SELECT 'subperiod', (pos * 3 // n)::INT, pos - ((pos * 3 // n) * n + 2) // 3, m, ts, tod, close, vwap FROM pl UNION ALL SELECT 'parameter', v::INT, pos, m, ts, tod, close, vwap FROM pl, range(2) q(v)
),
sg AS MATERIALIZED (SELECT *, CASE WHEN tod >= 1070 OR tod <= 540 OR tod > 1075 THEN 0 WHEN s > 0.8 THEN 1 WHEN s < -0.8 THEN -1 ELSE 0 END AS side FROM ({rerun_signals()})),
jp AS MATERIALIZED (
  SELECT *, least(min(CASE WHEN tod >= 1070 THEN pos END) OVER a, min(pos) OVER (PARTITION BY {KEY} ORDER BY m RANGE BETWEEN 180 FOLLOWING AND UNBOUNDED FOLLOWING)) AS till,
    min(CASE WHEN side <> 0 THEN pos END) OVER a AS later FROM sg WINDOW a AS (PARTITION BY {KEY} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
),
en AS MATERIALIZED (SELECT p.trial, p.battery, p.variant, p.pos, (q.close - p.close) * p.side AS gross, q.later AS next FROM jp p JOIN jp q ON q.trial = p.trial AND q.battery = p.battery AND q.variant = p.variant AND q.pos = p.till WHERE p.side <> 0),
wk AS (
  SELECT e.* FROM en e JOIN (SELECT {KEY}, min(pos) AS pos FROM sg WHERE side <> 0 GROUP BY ALL) f ON e.trial = f.trial AND e.battery = f.battery AND e.variant = f.variant AND e.pos = f.pos
  UNION ALL SELECT e.* FROM wk w JOIN en e ON e.trial = w.trial AND e.battery = w.battery AND e.variant = w.variant AND e.pos = w.next
),
md AS MATERIALIZED (SELECT k.trial, k.battery, k.variant, count(w.pos) AS trades, coalesce(sum(w.gross), 0) AS gross FROM (SELECT DISTINCT {KEY} FROM sg) k LEFT JOIN wk w ON w.trial = k.trial AND w.battery = k.battery AND w.variant = k.variant GROUP BY ALL),
rr AS MATERIALIZED (
  SELECT {KEY}, trades, gross - trades * 3.5 AS net FROM md UNION ALL SELECT trial, 'cost', 0, trades, gross - trades * 5.75 FROM md WHERE battery = 'reference'
  UNION ALL SELECT trial, 'cost', 1, trades, gross - trades * 7.0 FROM md WHERE battery = 'reference'
)"""
RERUN_JUDGE_SQL = f"""{RERUNS_SQL}
SELECT trial, median(net) FILTER (battery = 'noise') > 0 AS noise, max(net) FILTER (battery = 'reference') > 0 AND min(net) FILTER (battery = 'subperiod') > 0 AS subperiods,
  min(net) FILTER (battery = 'cost') > 0 AS costs, max(net) FILTER (battery = 'reference') > 0 AND min(net) FILTER (battery = 'parameter') > 0 AS parameters,
  median(net) FILTER (battery = 'noise') > 0 AND min(net) FILTER (battery IN ('reference', 'subperiod', 'cost', 'parameter')) > 0 AS robust FROM rr GROUP BY 1"""


def gate_collapse(spark, d):
    rows = gate_rows(spark, d).join(gate.judge(batteries(spark, d), "trial").select("trial", "robust"), "trial")
    # the trials' net results by day: how often the best of them is overfitted
    t = trades(spark, d).groupBy(F.datediff("day", F.lit("1992-01-01").cast("date")).cast("long").alias("t"), F.col("trial").cast("int").alias("config"))
    pbo = gate.overfitting(t.agg(F.round(F.sum(F.col("gross") - F.col("cost")), 6).alias("value")), 6).select("pbo")
    rows = with_dsr(rows).join(F.broadcast(pbo))  # one row
    limits = {**gate.LIMITS, "min_total_trades": 100, "min_trades_per_path": 10, "min_active_days": 100}
    return gate.collapse(rows, limits).select("trial", "verdict")


COLLAPSE_SQL = f"""WITH {ROWS_SQL}, {DSR_SQL}, {ROBUST_SQL.replace(TRADES_SQL + ', ', '')},
p AS (SELECT date_diff('day', DATE '1992-01-01', day) AS t, trial::INT AS config, round(sum(gross - cost), 6) AS value FROM t GROUP BY 1, 2), {HALVES_SQL},
pb AS (SELECT avg((r.r / (configs + 1) <= 0.5)::INT) AS pbo FROM r JOIN best ON r.m = best.m AND r.config = best.config)
SELECT ds.trial, CASE WHEN total_trades < 100 OR min_path_trades < 10 OR active_days < 100 OR max_day_share > 0.25 THEN 'INSUFFICIENT_SAMPLE' WHEN gross_points <= cost_points THEN 'COST_DOMINATED'
  WHEN sign_flip_frac > 0.3 THEN 'UNSTABLE_ACROSS_FOLDS' WHEN pbo > 0.2 OR dsr < 0.95 OR NOT robust THEN 'FAILED_GATE' ELSE 'ACCEPTED' END AS verdict
FROM ds JOIN jr ON ds.trial = jr.trial, pb"""


def gate_validate_outcome(spark, d):
    return gate.validate_outcome(folds(spark, d).where("trial < 11 or path_id < 27"), ["trial"], 28)


def gate_costs(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    costs = {"point_value": 0.2, "tick_size": 5, "slippage_ticks": 1, "exchange_fee": 0.25, "brokerage": 0.0, "margin_per_contract": 155.0}
    per = lambda f: gate.round_trip_points(costs, f)
    return t.groupBy("l_returnflag").agg(
        F.sum("l_quantity").alias("contracts"), *[(F.count(F.lit(1)) * per(f)).cast("long").alias(n) for f, n in ((1.0, "points"), (1.5, "points_15"), (2.0, "points_20"))], F.round(gate.fees(costs, F.sum("l_quantity")), 4).alias("fees")
    )


#: A thousand strategies over the hourly bars, whose prices have no memory; limits for a month of data.
SIGNALS = {f"{op}_{column}_{w}": f"zscore({op}({column}(),2),{w})" for op in ("ret", "delta", "rolling_mean", "rolling_std", "lag") for column in ("close",) for w in (8, 13, 21, 34, 55)}
GRID = calibration.settings((0.8, 1.2, 1.6, 2.0), (1, -1), (1, 2, 3, 5, 8))
NOISE_COST, NOISE_TICK = 0.5, 0.5
SMALL = {**gate.LIMITS, "min_total_trades": 10, "min_trades_per_path": 2, "min_active_days": 3, "max_trade_concentration": 0.7}


def gate_calibration(spark, d):
    """What the gate says of strategies over the given bars."""
    found = calibration.verdicts(frame_e(spark, d), SIGNALS, GRID, NOISE_COST, NOISE_TICK, SMALL)
    return calibration.rates(found).withColumn("share", F.round("share", 6))


def gate_pbo_groups(spark, d):
    """The overfitting probability of the configurations of each line status."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    perf = t.groupBy("l_linestatus", F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("t"), (F.col("l_suppkey") % 8).cast("int").alias("config"))
    perf = perf.agg(F.round(F.sum((F.col("l_discount") - 0.05) * F.col("l_quantity")), 6).alias("value"))
    return gate.overfitting(perf, 6, ("l_linestatus",)).withColumn("pbo", F.round("pbo", 6))


def grouped_halves(key: str) -> str:
    """HALVES_SQL over p (key, t, config, value), for each key."""
    return f"""
i AS (SELECT {key}, t, row_number() OVER (PARTITION BY {key} ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM (SELECT DISTINCT {key}, t FROM p)),
k AS (SELECT {key}, t, CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE n % 6 + (i - (n % 6) * (n // 6 + 1)) // (n // 6) END AS block FROM i),
c AS (SELECT m FROM range(64) r(m) WHERE bit_count(m::INT) = 3),
s AS (SELECT p.{key}, c.m, config, (c.m >> block::INT) & 1 AS inside, round(CASE WHEN stddev_samp(value) > 1e-12 THEN avg(value) / stddev_samp(value) ELSE 0 END, 12) AS sharpe FROM p JOIN k ON k.{key} = p.{key} AND k.t = p.t, c GROUP BY 1, 2, 3, 4),
best AS (SELECT {key}, m, arg_max(config, row(sharpe, -config)) AS config, count(*) AS configs FROM s WHERE inside = 1 GROUP BY 1, 2),
r AS (SELECT {key}, m, config, rank() OVER (PARTITION BY {key}, m ORDER BY sharpe) + (count(*) OVER (PARTITION BY {key}, m, sharpe) - 1) / 2 AS r FROM s WHERE inside = 0),
pbo AS (SELECT r.{key}, avg((r.r / (configs + 1) <= 0.5)::INT) AS pbo, count(*) AS combinations FROM r JOIN best ON r.{key} = best.{key} AND r.m = best.m AND r.config = best.config GROUP BY 1)"""


def cpcv_partitions(spark, d):
    groups = cv.day_groups(frame_e(spark, d), 8)
    return cv.partitions(spark).join(groups, "grp").groupBy("path_id").agg(F.count(F.lit(1)).alias("test_days"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


def cpcv_purge_embargo(spark, d):
    f = frame_e(spark, d).select("ts", "day")
    out = cv.split(f, cv.day_groups(f, 8), cv.partitions(spark), horizon_min=120)
    return out.groupBy("path_id", "role").agg(F.count(F.lit(1)).alias("samples"))


def cpcv_roles(spark, d):
    f = frame_e(spark, d).select("ts", "day")
    return cv.split(f, cv.day_groups(f, 8), cv.partitions(spark), horizon_min=120).select("path_id", stamp("ts").alias("ts"), "role")


GROUPS_SQL = f"""{E}, dg AS (SELECT day, ntile(8) OVER (ORDER BY day) - 1 AS grp FROM (SELECT DISTINCT day FROM b)),
pt AS (SELECT row_number() OVER (ORDER BY a, c) - 1 AS path_id, a, c FROM (SELECT x AS a, y AS c FROM range(8) q(x), range(8) r(y) WHERE x < y)),
pg AS (SELECT path_id, a AS grp FROM pt UNION ALL SELECT path_id, c FROM pt)"""

ROLES_SQL = f"""{GROUPS_SQL}, sm AS (SELECT b.ts, b.day, dg.grp FROM b JOIN dg ON b.day = dg.day), sp AS (SELECT grp, min(ts) AS lo, max(ts) AS hi FROM sm GROUP BY 1),
rl AS (SELECT pt.path_id, s.ts, CASE WHEN s.grp IN (pt.a, pt.c) THEN 'test'
  WHEN (s.ts <= x.hi + INTERVAL 120 MINUTE AND s.ts + INTERVAL 120 MINUTE >= x.lo) OR (s.ts <= y.hi + INTERVAL 120 MINUTE AND s.ts + INTERVAL 120 MINUTE >= y.lo) THEN 'purged'
  WHEN (s.ts > x.hi AND s.ts <= x.hi + INTERVAL 480 MINUTE) OR (s.ts > y.hi AND s.ts <= y.hi + INTERVAL 480 MINUTE) THEN 'embargoed' ELSE 'train' END AS role
  FROM pt JOIN sp x ON x.grp = pt.a JOIN sp y ON y.grp = pt.c, sm s)"""

QUERIES = {
    f.__name__: f
    for f in (
        sim_fold_metrics, gate_aggregate, gate_aggregate_paths, gate_sr_star, gate_dsr, gate_var_sr, gate_pbo, gate_reruns, gate_robustness, gate_collapse, gate_validate_outcome, gate_costs, gate_calibration, gate_pbo_groups,
        cpcv_partitions, cpcv_purge_embargo, cpcv_roles,
    )
}


def r(cols, k):
    return ", ".join(f"round({c}, {k}) AS {c}" for c in cols)


ORACLE_SQL = {
    "sim_fold_metrics": f"WITH {FOLDS_SQL} SELECT trial, path_id, n_trades, avg_holding_s, active_days, {r(FOLD_NUMBERS, 6)} FROM folds",
    "gate_aggregate": f"WITH {ROWS_SQL} SELECT trial, total_trades, min_path_trades, active_days, {r(('max_day_share', 'gross_points', 'cost_points', 'sign_flip_frac', 'sr', 'skew', 'kurtosis'), 6)}, units, n_obs, units = 28 AS complete FROM g",
    "gate_aggregate_paths": f"WITH {FOLDS_SQL} SELECT trial, sum(n_trades)::BIGINT AS total_trades, min(n_trades) AS min_path_trades, sum(active_days)::BIGINT AS active_days, round(avg(gross_pnl_points), 6) AS gross_points, round(avg(cost_points), 6) AS cost_points, round(median(sharpe) / {math.sqrt(252.0)!r}, 6) AS sr, greatest(sum(n_trades)::BIGINT, 2) AS n_obs FROM folds GROUP BY 1",
    "gate_sr_star": f"SELECT o_custkey, trials::BIGINT AS trials, round({for_duckdb(gate.sr_star_sql('0.6D', 'trials'))}, 6) AS sr_star FROM (SELECT o_custkey, count(*)::DOUBLE AS trials FROM orders GROUP BY 1)",
    "gate_dsr": f"WITH {ROWS_SQL}, {DSR_SQL} SELECT trial, round(dsr, 6) AS dsr FROM ds",
    "gate_var_sr": f"WITH {ROWS_SQL} SELECT round(var_samp(sr), 8) AS var_sr, count(*) AS trials FROM g",
    "gate_pbo": PBO_SQL,
    "gate_reruns": f"{RERUNS_SQL} SELECT trial, battery, variant, trades, round(net, 6) AS net FROM rr",
    "gate_robustness": RERUN_JUDGE_SQL,
    "gate_collapse": COLLAPSE_SQL,
    "gate_validate_outcome": f"WITH {FOLDS_SQL} SELECT trial, count(*) AS rows, 0::BIGINT AS not_finite, 0::BIGINT AS negative, 0::BIGINT AS bad_hit_rate, 0::BIGINT AS net_mismatch, NOT (count(DISTINCT path_id) = 28) AS bad_ids, count(*) = 28 AS valid FROM folds WHERE trial < 11 OR path_id < 27 GROUP BY 1",
    "gate_costs": "SELECT l_returnflag, sum(l_quantity) AS contracts, count(*) * 10 AS points, count(*) * 20 AS points_15, count(*) * 20 AS points_20, round(sum(l_quantity) * 0.5, 4) AS fees FROM lineitem GROUP BY 1",
    "cpcv_partitions": f"{GROUPS_SQL} SELECT path_id, count(*) AS test_days, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM pg JOIN dg ON pg.grp = dg.grp GROUP BY 1",
    "cpcv_purge_embargo": f"{ROLES_SQL} SELECT path_id, role, count(*) AS samples FROM rl GROUP BY 1, 2",
    "cpcv_roles": f"{ROLES_SQL} SELECT path_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, role FROM rl",
}
ORACLE_SQL["gate_pbo_groups"] = f"""WITH p AS (SELECT l_linestatus, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS t, (l_suppkey % 8)::INT AS config, round(sum((l_discount - 0.05) * l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2, 3),
{grouped_halves('l_linestatus')} SELECT l_linestatus, round(pbo, 6) AS pbo, combinations FROM pbo"""


def calibration_sql() -> str:
    """Every cut but the reruns: what passes all others here would be ACCEPTED, and nothing does on bars of this kind."""
    x = SMALL
    grid = ", ".join(f"({s.config}, {s.threshold}, {s.direction}, {s.hold})" for s in GRID)
    folds = """fo AS (SELECT t.name, t.config, pg.path_id, t.day, t.ts, t.gross, 0.5 AS cost, t.gross - 0.5 AS net FROM t JOIN dg ON dg.day = t.day JOIN pg ON pg.grp = dg.grp),
fm AS (SELECT *, avg(net) OVER w AS m, count(*) OVER (PARTITION BY name, config, path_id, day) AS n_day FROM fo WINDOW w AS (PARTITION BY name, config, path_id)),
folds AS MATERIALIZED (
  SELECT name, config, path_id, count(*) AS n_trades, sum(gross) AS gross_pnl_points, sum(cost) AS cost_points, sum(net) AS net_pnl_points,
    CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * {root} ELSE 0 END AS sharpe, CASE WHEN avg((net - m) ** 2) <= 1e-24 THEN 0.0 ELSE avg((net - m) ** 3) / pow(avg((net - m) ** 2), 1.5) END AS skew,
    CASE WHEN avg((net - m) ** 2) <= 1e-24 THEN 3.0 ELSE avg((net - m) ** 4) / pow(avg((net - m) ** 2), 2) END AS kurtosis, count(DISTINCT day) AS active_days, max(n_day) / count(*) AS max_day_share FROM fm GROUP BY 1, 2, 3)""".format(root=repr(math.sqrt(252.0)))
    leads = ", ".join(f"lead(close, {h}) OVER (ORDER BY ts) AS x{h}" for h in sorted({s.hold for s in GRID}))
    ahead = "CASE hold " + " ".join(f"WHEN {h} THEN x{h}" for h in sorted({s.hold for s in GRID})) + " END"
    return f"""{GROUPS_SQL}, v AS MATERIALIZED (SELECT q.ts::TIMESTAMP AS ts, q.formula AS name, q.value FROM ({translation('E', SIGNALS, digits=None)}) q WHERE q.value IS NOT NULL),
ld AS (SELECT ts, day, close, {leads} FROM b), gd AS (SELECT * FROM (VALUES {grid}) g(config, threshold, direction, hold)),
t AS MATERIALIZED (SELECT name, config, day, ts, (e - close) * sign(value) * direction AS gross FROM (SELECT v.name, gd.config, ld.day, v.ts, ld.close, v.value, gd.direction, {ahead} AS e FROM v JOIN ld ON ld.ts = v.ts JOIN gd ON abs(v.value) > gd.threshold) WHERE e IS NOT NULL),
{folds}, md AS (SELECT name, config, median(net_pnl_points) AS net FROM folds GROUP BY 1, 2),
g AS MATERIALIZED (
  SELECT f.name, f.config, floor(median(n_trades))::BIGINT AS total_trades, min(n_trades) AS min_path_trades, floor(median(active_days))::BIGINT AS active_days, max(max_day_share) AS max_day_share, sum(gross_pnl_points) AS gross_points, sum(cost_points) AS cost_points,
    avg((net_pnl_points * (CASE WHEN md.net >= 0 THEN 1 ELSE -1 END) < 0)::INT) AS sign_flip_frac, median(sharpe) / {math.sqrt(252.0)!r} AS sr, median(skew) AS skew, median(kurtosis) AS kurtosis, greatest(floor(median(n_trades))::BIGINT, 2) AS n_obs
  FROM folds f JOIN md ON md.name = f.name AND md.config = f.config GROUP BY 1, 2),
p AS (SELECT q.name, date_diff('day', DATE '1970-01-01', dg.day) AS t, q.config, round(coalesce(n.net, 0), 6) AS value FROM (SELECT DISTINCT name, config FROM t) q CROSS JOIN dg
  LEFT JOIN (SELECT name, config, day, sum(gross - 0.5) AS net FROM t GROUP BY 1, 2, 3) n ON n.name = q.name AND n.config = q.config AND n.day = dg.day),
{grouped_halves('name')}, vs AS (SELECT var_samp(sr) AS var_sr, count(*) AS trials FROM g), sz AS (SELECT {for_duckdb(gate.sr_star_sql('var_sr', 'trials'))} AS star FROM (SELECT var_sr, trials::DOUBLE AS trials FROM vs)),
dz AS (SELECT g.*, pbo.pbo, CASE WHEN 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr > 0 THEN (sr - star) * sqrt(n_obs - 1) / sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) END AS z FROM g JOIN pbo ON pbo.name = g.name, sz),
ds AS (SELECT *, CASE WHEN z IS NOT NULL THEN {for_duckdb(normal_cdf('z'))} END AS dsr FROM dz),
vd AS (SELECT CASE WHEN total_trades < {x['min_total_trades']} OR min_path_trades < {x['min_trades_per_path']} OR active_days < {x['min_active_days']} OR max_day_share > {x['max_trade_concentration']} THEN 'INSUFFICIENT_SAMPLE'
  WHEN gross_points <= cost_points THEN 'COST_DOMINATED' WHEN sign_flip_frac > 0.3 THEN 'UNSTABLE_ACROSS_FOLDS' WHEN pbo > 0.2 OR dsr < 0.95 THEN 'FAILED_GATE' ELSE 'ACCEPTED' END AS verdict FROM ds)
SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM vd GROUP BY 1"""


ORACLE_SQL["gate_calibration"] = calibration_sql()
