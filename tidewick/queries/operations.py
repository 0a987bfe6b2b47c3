"""Queries of the daily operations, the robot, the ledger, the bandit and the text rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewick.operators import ledger, monitor, research, robot, texts
from tidewick.plans.compiler import evaluate
from tidewick.functions.scalar import BUCKETS, for_duckdb
from tidewick.operators.gate import sr_star_sql
from tidewick.operators import prep
from tidewick.queries.bars_sql import E, L
from tidewick.queries.formulas import z
from tidewick.queries.preparation import frame_e, frame_l, stamp

COSTS = {"point_value": 0.2, "tick_size": 5, "slippage_ticks": 1, "exchange_fee": 0.25, "brokerage": 0.0, "margin_per_contract": 155.0}

TELEMETRY_SQL = """
tm AS MATERIALIZED (
  SELECT 'h' || (user_id % 10) AS hypothesis_id, ts::DATE AS day, ts::TIMESTAMP AS bar_time, event_id AS ts,
    CASE event_type WHEN 'purchase' THEN 'OPEN_LONG' WHEN 'click' THEN 'OPEN_SHORT' WHEN 'signup' THEN 'CLOSE' WHEN 'error' THEN 'REJECTED' ELSE 'NONE' END AS decision,
    CASE WHEN event_type IN ('purchase', 'click') THEN 1 + event_id % 2 ELSE 0 END AS contracts, CASE WHEN event_type IN ('purchase', 'click') THEN (event_id % 3)::DOUBLE END AS slippage_ticks,
    value - 10 AS daily_pnl_points, CASE WHEN event_id % 13 = 0 THEN 'CUTOFF' WHEN event_id % 401 = 0 THEN 'DAILY_LOSS' WHEN event_id % 709 = 0 THEN 'GRID' END AS guard_blocked,
    CASE WHEN event_id % 5 <> 0 THEN value END AS kill_metric_value FROM events
)"""
DAILY_SQL = f"""{TELEMETRY_SQL},
cl AS (SELECT day, max(n)::INT AS bars_expected FROM (SELECT day, hypothesis_id, count(*) AS n FROM tm GROUP BY ALL) GROUP BY 1),
gc AS (SELECT hypothesis_id, day, guard_blocked, count(*) AS n FROM tm WHERE guard_blocked IS NOT NULL GROUP BY ALL),
dd AS MATERIALIZED (
  SELECT hypothesis_id, day, count(*) AS bars_recorded, count_if(decision LIKE 'OPEN%')::BIGINT AS trades, arg_max(daily_pnl_points, row(bar_time, ts)) AS net_pnl_points,
    arg_max(daily_pnl_points, row(bar_time, ts)) + coalesce(sum(contracts) FILTER (decision LIKE 'OPEN%'), 0) * 2.5 AS gross_pnl_points, avg(slippage_ticks) AS slippage_ticks_avg,
    count_if(decision = 'REJECTED')::BIGINT AS rejections, median(kill_metric_value) AS kill_metric_daily, any_value(bars_expected) AS bars_expected, count_if(guard_blocked <> 'CUTOFF') > 0 AS strange
  FROM tm JOIN cl USING (day) GROUP BY ALL
)"""


def telemetry(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    order = F.col("event_type").isin("purchase", "click")
    kind = F.when(F.col("event_type") == "purchase", "OPEN_LONG").when(F.col("event_type") == "click", "OPEN_SHORT").when(F.col("event_type") == "signup", "CLOSE").when(F.col("event_type") == "error", "REJECTED").otherwise("NONE")
    guard = F.when(F.col("event_id") % 13 == 0, "CUTOFF").when(F.col("event_id") % 401 == 0, "DAILY_LOSS").when(F.col("event_id") % 709 == 0, "GRID")
    return t.select(
        F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string")).alias("hypothesis_id"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp_ntz").alias("bar_time"), F.col("event_id").alias("ts"),
        kind.alias("decision"), F.when(order, 1 + F.col("event_id") % 2).otherwise(0).alias("contracts"), F.when(order, (F.col("event_id") % 3).cast("double")).alias("slippage_ticks"), F.lit("").alias("order_status"),
        (F.col("value") - 10).alias("daily_pnl_points"), guard.alias("guard_blocked"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("kill_metric_value"),
    )


def expected_bars(rows):
    return rows.groupBy("day", "hypothesis_id").agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(F.max("n").cast("int").alias("bars_expected"))


def daily(spark, d):
    rows = telemetry(spark, d)
    return monitor.daily_summary(rows, expected_bars(rows), COSTS)


def text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


def ops_daily_summary(spark, d):
    out = daily(spark, d).withColumn("guard_blocks", F.to_json("guard_blocks"))
    return text_day(out.withColumns({c: F.round(c, 6) for c in ("net_pnl_points", "gross_pnl_points", "slippage_ticks_avg", "kill_metric_daily")}))


def ops_guard_counts(spark, d):
    return text_day(monitor.guard_counts(telemetry(spark, d)))


def ops_guard_totals(spark, d):
    """The days' maps, merged."""
    return daily(spark, d).select("hypothesis_id", F.explode("guard_blocks").alias("guard", "n")).groupBy("hypothesis_id", "guard").agg(F.sum("n").alias("n"))


def ops_kill_state(spark, d):
    return text_day(monitor.kill_states(daily(spark, d), 5, 12.0)).withColumn("value", F.round("value", 6))


def ops_kill_records(spark, d):
    return text_day(monitor.first_kills(monitor.kill_states(daily(spark, d), 5, 12.0))).withColumn("value", F.round("value", 6))


def ops_alerts(spark, d):
    return text_day(monitor.alerts(daily(spark, d), 1.0))


def ops_collect(spark, d):
    x = daily(spark, d)
    known = x.where(F.dayofmonth("day") <= 20)
    return text_day(monitor.collect_day(x, known).select("hypothesis_id", "day", "bars_recorded"))


def ops_weekly_slippage(spark, d):
    return monitor.weekly(daily(spark, d)).withColumn("slippage", F.round("slippage", 6))


def ops_cum_pnl(spark, d):
    return text_day(monitor.cumulative(daily(spark, d), (-50.0, 120.0, 30)).withColumns({c: F.round(c, 6) for c in ("cum_pnl", "band_lo", "band_hi")}))


def signals(spark, d):
    f = prep.positions(frame_e(spark, d))
    return evaluate(f, {"signal": "zscore(close(),8)"})


def ops_parity(spark, d):
    """The log is the batch signal with a few bars changed or lost, so that there is something to find."""
    s = signals(spark, d)
    log = s.where("pos % 50 <> 7").select(
        "series", F.col("ts").alias("bar_time"), F.when(F.col("pos") % 90 == 11, F.col("signal") + 0.25).otherwise(F.col("signal")).alias("signal"), F.when(F.col("pos") % 70 == 3, "DATA_GAP").alias("guard_blocked")
    )
    out = monitor.parity(s.select("series", F.col("ts").alias("bar_time"), F.col("signal").alias("value")), log)
    return out.withColumn("max_error", F.round("max_error", 6))


def ops_kill_metrics(spark, d):
    x = monitor.kill_metrics(frame_l(spark, d))
    return x.select(stamp("ts").alias("ts"), F.round("realized_vol", 6).alias("realized_vol"), F.round("ref_corr", 6).alias("ref_corr"), F.round("gap_overnight", 6).alias("gap_overnight"))


def ops_move_lag(spark, d):
    return monitor.move_lag(frame_l(spark, d)).select(stamp("ts").alias("ts"), "lag_ms")


def ops_spread_ticks(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    quotes = t.select(F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_tax") * 1000).alias("spread"))
    return monitor.mean_spread(quotes, COSTS["tick_size"]).select("series", stamp("ts").alias("ts"), F.round("spread_ticks", 6).alias("spread_ticks"))


def ops_minutes_to_open(spark, d):
    f = frame_e(spark, d)
    return f.select(stamp("ts").alias("ts"), (F.lit(540) - (F.hour("ts") * 60 + F.minute("ts"))).alias("minutes_to_open"))


def ops_fill_ratio(spark, d):
    return monitor.fill_ratio(telemetry(spark, d)).select("hypothesis_id", "ts", F.round("fill_ratio", 6).alias("fill_ratio"))


LIMITS = robot.Limits(tick_size=0.5)


def simulated(spark, d):
    return robot.simulate(signals(spark, d), 24, LIMITS, threshold=0.8, max_holding=180)


def sim_positions(spark, d):
    return simulated(spark, d).select(stamp("ts").alias("ts"), "decision", "position", F.round("fill_price", 6).alias("fill_price"), "guard_blocked")


def sim_trades(spark, d):
    t = robot.round_trips(simulated(spark, d), frame_e(spark, d), LIMITS.tick_size)
    return t.select(stamp("opened").alias("opened"), stamp("closed").alias("closed"), "side", *[F.round(c, 6).alias(c) for c in ("entry", "exit", "points")])


def robot_rules(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet")
    tod, lots = (F.col("o_orderkey") % 1440).cast("int"), (F.col("o_custkey") % 40).cast("int")
    side = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    px = robot.to_grid(F.col("o_totalprice"), 5.0, side)
    g = robot.guard_order(robot.Limits(), tod, lots, F.lit(5000.0), px, F.lit(-10.0) * (F.col("o_orderkey") % 200), (F.col("o_custkey") % 4).cast("int"))
    return t.select("o_orderkey", F.round(px, 2).alias("price"), robot.max_lots(F.col("o_totalprice"), 155.0).alias("lots"), g.alias("guard"), robot.must_flatten(tod, lots, robot.Limits(), 30).alias("flatten"))


FEED = f"""
sg AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, {z('close', 8)} AS signal FROM b),
st AS MATERIALIZED (
  SELECT *, CASE WHEN signal > 0.8 THEN 1 WHEN signal < -0.8 THEN -1 ELSE 0 END * (pos >= 24)::INT AS side, epoch(ts) // 60 AS m FROM sg
),
sx AS MATERIALIZED (SELECT *, CASE WHEN side > 0 THEN ceil(close / 0.5 - 1e-9) * 0.5 ELSE floor(close / 0.5 + 1e-9) * 0.5 END AS px, side <> 0 AND (tod >= 1070 OR tod <= 540 OR tod > 1075) AS blocked FROM st)"""
SIM = f"""{FEED},
sm AS (
  SELECT 0::BIGINT AS pos, ts, 'NONE' AS decision, 0 AS position, 0::BIGINT AS since, NULL::DOUBLE AS fill_price, NULL::VARCHAR AS guard_blocked FROM sx WHERE pos = 0
  UNION ALL
  SELECT x.pos, x.ts, CASE WHEN s.position <> 0 AND (x.tod >= 1070 OR x.m - s.since >= 180) THEN 'CLOSE' WHEN s.position = 0 AND x.side <> 0 AND NOT x.blocked THEN CASE WHEN x.side > 0 THEN 'OPEN_LONG' ELSE 'OPEN_SHORT' END ELSE 'NONE' END,
    CASE WHEN s.position <> 0 AND (x.tod >= 1070 OR x.m - s.since >= 180) THEN 0 WHEN s.position = 0 AND x.side <> 0 AND NOT x.blocked THEN x.side ELSE s.position END,
    CASE WHEN s.position = 0 AND x.side <> 0 AND NOT x.blocked THEN x.m::BIGINT ELSE s.since END, CASE WHEN s.position = 0 AND x.side <> 0 AND NOT x.blocked THEN x.px END, CASE WHEN s.position = 0 AND x.blocked THEN 'CUTOFF' END
  FROM sm s JOIN sx x ON x.pos = s.pos + 1
)"""
ER = E.replace("WITH", "WITH RECURSIVE", 1)


# The ledger tables are made of orders: one book for each customer, a chain in order of the order key.
def book_rows(spark, d):
    """Unchained rows: the fields of each order's record."""
    t = spark.read.parquet(f"{d}/orders.parquet")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    kinds = F.when(F.col("seq") == 1, "genesis").when(F.col("o_orderkey") % 3 == 0, "backtest").when(F.col("o_orderkey") % 3 == 1, "verdict").otherwise("hypothesis")
    t = t.withColumn("seq", n.cast("long")).withColumn("kind", kinds)
    verdict = F.when(F.col("kind") == "verdict", F.element_at(F.array(*[F.lit(v) for v in ledger.REWARDS]), (F.col("o_orderkey") % len(ledger.REWARDS) + 1).cast("int")))
    return t.select(
        F.col("o_custkey").alias("book"), "seq", "kind", F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("trial_id"), F.concat(F.lit("h"), (F.col("o_orderkey") % 20).cast("string")).alias("hypothesis_id"),
        F.when(F.col("kind") == "backtest", F.sha2((F.col("o_orderkey") % 500).cast("string"), 256)).alias("structural_sig"), verdict.alias("verdict"), F.when((F.col("kind") == "backtest") & (F.col("o_orderkey") % 10 == 0), 1).otherwise(0).alias("crashed"),
    )


BOOK = ("seq", "kind", "trial_id", "hypothesis_id", "structural_sig", "verdict", "crashed", "prev_hash")


def chained(spark, d, keep=None):
    """Each book's rows with their hashes."""
    return ledger.chained(book_rows(spark, d), "book", BOOK, keep)


def ledger_chain(spark, d):
    return chained(spark, d, ("book", "seq")).select("book", "seq", "row_hash")


def ledger_verify_chain(spark, d):
    """Some rows are altered after the fact, to be found."""
    rows = chained(spark, d).withColumn("verdict", F.when((F.col("kind") == "verdict") & (F.expr("cast(substring(trial_id, 2) as bigint)") % 97 == 0), "ACCEPTED").otherwise(F.col("verdict")))
    return ledger.verify_chain(rows, ("book",), BOOK)


def ledger_count(spark, d):
    return ledger.count_trials(book_rows(spark, d))


def ledger_head(spark, d):
    return chained(spark, d, ("book", "seq")).groupBy("book").agg(F.max("seq").alias("seq"), F.max_by("row_hash", "seq").alias("row_hash"))


def ledger_seen_structural(spark, d):
    c = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.sha2((F.col("p_partkey") % 700).cast("string"), 256).alias("structural_sig"))
    return ledger.seen_structural(c, book_rows(spark, d)).select("p_partkey")


def ledger_verdicts(spark, d):
    return ledger.verdicts_for(book_rows(spark, d), "h7").select("trial_id", "verdict")


def ledger_verdict_funnel(spark, d):
    return book_rows(spark, d).where("kind = 'verdict'").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hypothesis_id").alias("hypotheses"))


def ledger_config_hash(spark, d):
    t = spark.read.parquet(f"{d}/nation.parquet")
    return t.select("n_nationkey", ledger.config_hash(F.sha2(F.col("n_name"), 256), F.sha2(F.col("n_nationkey").cast("string"), 256)).alias("config_hash"))


FAMILIES = tuple(r[0] for r in research.CATALOGUE)
UNAVAILABLE = tuple(r[0] for r in research.CATALOGUE if not r[-1])


def families(spark):
    return spark.createDataFrame([(n, i, n not in UNAVAILABLE) for i, n in enumerate(FAMILIES)], "name string, place int, available boolean")


def scores(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    pickd = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(k) % len(xs) + 1).cast("int"))
    return ledger.bandit_scores(t.where("user_id % 8 <> 4").select(pickd(FAMILIES, "user_id").alias("family"), pickd(list(ledger.REWARDS), "event_id").alias("verdict")), families(spark))


def bandit_scores(spark, d):
    return scores(spark, d).withColumn("score", F.round("score", 6))


def bandit_pick(spark, d):
    return ledger.pick(scores(spark, d)).select("name")


def bandit_reward(spark, d):
    t = book_rows(spark, d).where("verdict is not null")
    return t.groupBy("hypothesis_id").agg(F.round(F.avg(ledger.reward(F.col("verdict"))), 6).alias("reward"), F.count(F.lit(1)).alias("n"))


HISTORY = f"""fm AS (SELECT unnest({list(FAMILIES)}) AS name, unnest(range(8))::INT AS place), rw AS (SELECT unnest({list(ledger.REWARDS)}) AS verdict, unnest({list(ledger.REWARDS.values())})::DOUBLE AS reward, unnest(range(9)) AS k),
hy AS (SELECT fm.name, count(*) AS pulls, avg(reward) AS mean FROM events e JOIN fm ON fm.place = e.user_id % 8 JOIN rw ON rw.k = e.event_id % 9 WHERE user_id % 8 <> 4 GROUP BY 1),
sc AS (SELECT fm.name, fm.place, coalesce(pulls, 0) AS pulls, sum(coalesce(pulls, 0)) OVER () AS total, mean FROM fm LEFT JOIN hy ON fm.name = hy.name WHERE NOT list_contains({list(UNAVAILABLE)}, fm.name)),
so AS (SELECT name, place, pulls, CASE WHEN pulls > 0 THEN mean + 0.8 * sqrt(ln(total / pulls)) END AS score FROM sc)"""
HISTORY = HISTORY.replace("sqrt(ln(total / pulls))", "sqrt(ln(total) / pulls)")


def text_normalize(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    return t.select("conv_id", "turn", texts.normalized(F.col("text")).alias("normal"))


def text_circular(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in PAYERS]), (F.col("c_custkey") % len(PAYERS) + 1).cast("int")).alias("who"))
    return t.select("c_custkey", texts.circular(F.col("who")).alias("circular"))


PAYERS = ("o mercado", "Traders em geral", "market maker que alarga o spread", "", "a tendência", "hedger local", "os investidores e os participantes", "todos", "quem rola tarde")


def text_leak_scan(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", texts.metric_word(F.col("text")).alias("leak"))


def text_number_leak(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet")
    forms = texts.number_forms(F.col("o_totalprice"))
    said = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("value %.2f now", "o_totalprice")).otherwise(F.format_string("value 1%.2f now", "o_totalprice"))
    return t.select("o_orderkey", texts.holds_number(said, forms).alias("leak"))


def semantic_key(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    return t.select("p_partkey", texts.semantic_key(F.col("p_brand"), F.col("p_name"), F.lit("LONG"), (F.col("p_size").cast("int") * 3)).alias("key"))


def window_bucket(spark, d):
    from tidewick.functions.scalar import nearest_bucket

    t = spark.read.parquet(f"{d}/part.parquet")
    return t.select("p_partkey", nearest_bucket((F.col("p_partkey") % 200 + 1).cast("int")).alias("bucket"))


def route_trials(spark, d):
    t = book_rows(spark, d).where("verdict is not null").withColumn("attempt", (F.expr("cast(substring(trial_id, 2) as bigint)") % 12).cast("int"))
    return t.select("trial_id", texts.route_gate(F.col("verdict"), F.col("attempt"), F.lit(10)).alias("gate"), texts.route_formula(F.col("verdict"), F.col("attempt"), F.lit(10)).alias("formula"))


def route_proofs(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "PASSED").when(F.col("o_orderkey") % 2 == 0, "SKIPPED").otherwise("PENDING")
    return t.select("o_orderkey", texts.route_proof(status, F.col("o_orderkey") % 12, F.lit(10)).alias("route"))


def session_report(spark, d):
    return ledger.session_report(book_rows(spark, d), 0.6, "book").withColumn("sr_star", F.round("sr_star", 6))


def hypothesis_rejection(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet").withColumn("k", F.col("c_custkey"))
    who = F.element_at(F.array(*[F.lit(x) for x in PAYERS]), (F.col("k") % len(PAYERS) + 1).cast("int"))
    why = texts.rejection(who, F.lit("spread"), F.col("k") % 7 != 0, F.col("k") % 11 != 0, (F.col("k") % 40).cast("int"), F.lit(2), F.lit(30), F.col("k") % 13 == 0)
    return t.select("c_custkey", why.alias("reason"))


QUERIES = {
    f.__name__: f
    for f in (
        ops_daily_summary, ops_guard_counts, ops_guard_totals, ops_kill_state, ops_kill_records, ops_alerts, ops_collect, ops_weekly_slippage, ops_cum_pnl, ops_parity, ops_kill_metrics, ops_move_lag, ops_spread_ticks, ops_minutes_to_open, ops_fill_ratio,
        sim_positions, sim_trades, robot_rules, ledger_chain, ledger_verify_chain, ledger_count, ledger_head, ledger_seen_structural, ledger_verdicts, ledger_verdict_funnel, ledger_config_hash,
        bandit_scores, bandit_pick, bandit_reward, text_normalize, text_circular, text_leak_scan, text_number_leak, semantic_key, window_bucket, route_trials, route_proofs, session_report, hypothesis_rejection,
    )
}

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
KILL_SQL = f"""WITH {DAILY_SQL},
kl AS (SELECT hypothesis_id, day, median(kill_metric_daily) OVER w AS value, count(*) OVER w AS n FROM dd WHERE kill_metric_daily IS NOT NULL WINDOW w AS (PARTITION BY hypothesis_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
ks AS (SELECT hypothesis_id, day, value, CASE WHEN n < 5 THEN 'INSUFFICIENT' WHEN value > 12.0 THEN 'DEAD' ELSE 'ALIVE' END AS state FROM kl)"""
VERDICTS = list(ledger.REWARDS)
BOOK_SQL = f"""
bk0 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders),
bk1 AS (SELECT *, CASE WHEN seq = 1 THEN 'genesis' WHEN o_orderkey % 3 = 0 THEN 'backtest' WHEN o_orderkey % 3 = 1 THEN 'verdict' ELSE 'hypothesis' END AS kind FROM bk0),
bk AS MATERIALIZED (SELECT o_custkey AS book, seq, kind, 't' || o_orderkey AS trial_id, 'h' || (o_orderkey % 20) AS hypothesis_id, CASE WHEN kind = 'backtest' THEN sha256((o_orderkey % 500)::VARCHAR) END AS structural_sig,
  CASE WHEN kind = 'verdict' THEN {VERDICTS}[o_orderkey % 9 + 1] END AS verdict, (kind = 'backtest' AND o_orderkey % 10 = 0)::INT AS crashed, o_orderkey FROM bk1)"""
JSON_SQL = "to_json({{'crashed': {r}.crashed, 'hypothesis_id': {r}.hypothesis_id, 'kind': {r}.kind, 'prev_hash': {p}, 'seq': {r}.seq, 'structural_sig': {r}.structural_sig, 'trial_id': {r}.trial_id, 'verdict': {r}.verdict}})::VARCHAR"
CHAIN_SQL = f"""WITH RECURSIVE {BOOK_SQL}, ch AS (
  SELECT book, seq, sha256({JSON_SQL.format(r='bk', p=f"repeat('0', 64)")}) AS row_hash FROM bk WHERE seq = 1
  UNION ALL SELECT bk.book, bk.seq, sha256({JSON_SQL.format(r='bk', p='ch.row_hash')}) FROM ch JOIN bk ON bk.book = ch.book AND bk.seq = ch.seq + 1)"""
PAYER_CASE = f"{list(PAYERS)}[c_custkey % {len(PAYERS)} + 1]"
CIRCULAR_SQL = f"len(list_filter(list_filter(string_split(trim(regexp_replace(strip_accents(lower({PAYER_CASE})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains({list(texts.STOP_WORDS)}, w)), lambda w: NOT list_contains({list(texts.GENERIC)}, w))) = 0"
LEAK_WORDS = "|".join((*texts.METRIC_WORDS, *texts.METRIC_FIELDS))


def bucket_sql(w: str) -> str:
    return f"(SELECT arg_min(u, row(abs(u - {w}), u)) FROM (SELECT unnest({list(BUCKETS)}) AS u))"


ORACLE_SQL = {
    "ops_daily_summary": f"""WITH {DAILY_SQL}, gm AS (SELECT hypothesis_id, day, '{{' || string_agg('"' || guard_blocked || '":' || n, ',' ORDER BY guard_blocked) || '}}' AS g FROM gc GROUP BY ALL)
SELECT dd.hypothesis_id, dd.day::VARCHAR AS day, bars_recorded, trades, round(net_pnl_points, 6) AS net_pnl_points, round(slippage_ticks_avg, 6) AS slippage_ticks_avg, rejections, round(kill_metric_daily, 6) AS kill_metric_daily,
  coalesce(g, '{{}}') AS guard_blocks, bars_expected, round(gross_pnl_points, 6) AS gross_pnl_points FROM dd LEFT JOIN gm ON gm.hypothesis_id = dd.hypothesis_id AND gm.day = dd.day""",
    "ops_guard_counts": f"WITH {DAILY_SQL} SELECT hypothesis_id, day::VARCHAR AS day, guard_blocked, n FROM gc",
    "ops_guard_totals": f"WITH {DAILY_SQL} SELECT hypothesis_id, guard_blocked AS guard, sum(n)::BIGINT AS n FROM gc GROUP BY ALL",
    "ops_kill_state": f"{KILL_SQL} SELECT hypothesis_id, day::VARCHAR AS day, round(value, 6) AS value, state FROM ks",
    "ops_kill_records": f"{KILL_SQL} SELECT hypothesis_id, min(day)::VARCHAR AS day, round(arg_min(value, day), 6) AS value FROM ks WHERE state = 'DEAD' GROUP BY 1",
    "ops_alerts": f"""WITH {DAILY_SQL} SELECT hypothesis_id, day::VARCHAR AS day, 'OPERATIONAL' AS alert, 'bars' AS reason FROM dd WHERE bars_recorded <> bars_expected
UNION ALL SELECT hypothesis_id, day::VARCHAR, 'OPERATIONAL', 'rejections' FROM dd WHERE rejections > 0 UNION ALL SELECT hypothesis_id, day::VARCHAR, 'OPERATIONAL', 'guards' FROM dd WHERE strange
UNION ALL SELECT hypothesis_id, day::VARCHAR, 'DIVERGENCE', 'slippage' FROM dd WHERE abs(slippage_ticks_avg - 1) / 1 > 0.3""",
    "ops_collect": f"WITH {DAILY_SQL} SELECT hypothesis_id, day::VARCHAR AS day, bars_recorded FROM dd WHERE day(day) > 20",
    "ops_weekly_slippage": f"""WITH {DAILY_SQL} SELECT hypothesis_id, printf('%d-W%02d', isoyear(day)::INT, week(day)::INT) AS week, sum(trades)::BIGINT AS trades,
  round(sum(slippage_ticks_avg * trades) FILTER (slippage_ticks_avg IS NOT NULL AND trades > 0) / sum(trades) FILTER (slippage_ticks_avg IS NOT NULL AND trades > 0), 6) AS slippage FROM dd GROUP BY 1, 2""",
    "ops_cum_pnl": f"""WITH {DAILY_SQL} SELECT hypothesis_id, day::VARCHAR AS day, round(sum(net_pnl_points) OVER w, 6) AS cum_pnl, count(*) OVER w AS day_no, round(count(*) OVER w * (-50.0::DOUBLE / 30), 6) AS band_lo,
  round(count(*) OVER w * (120.0::DOUBLE / 30), 6) AS band_hi FROM dd WINDOW w AS (PARTITION BY hypothesis_id ORDER BY day ROWS UNBOUNDED PRECEDING)""",
    "ops_parity": f"""{E}, {FEED.strip()}, lg AS (SELECT ts, CASE WHEN pos % 90 = 11 THEN signal + 0.25 ELSE signal END AS s, pos % 70 = 3 AS gap FROM sx WHERE pos % 50 <> 7),
pr AS (SELECT sx.signal AS v, lg.s, lg.ts IS NOT NULL AND NOT lg.gap AS here FROM sx LEFT JOIN lg ON lg.ts = sx.ts WHERE sx.ts BETWEEN (SELECT min(ts) FROM lg) AND (SELECT max(ts) FROM lg))
SELECT 'WIN' AS series, count_if(here AND v IS NOT NULL AND s IS NOT NULL)::BIGINT AS compared, round(max(abs(v - s) / greatest(1.0, abs(v))) FILTER (here), 6) AS max_error, count_if(NOT here)::BIGINT AS missing_in_log,
  count_if(here AND (v IS NULL) <> (s IS NULL))::BIGINT AS null_mismatch, false AS ok FROM pr""",
    "ops_move_lag": f"""{L}, mv AS (SELECT ts, sign(close - lag(close) OVER (ORDER BY ts)) AS m, sign(ref_ES - lag(ref_ES) OVER (ORDER BY ts)) AS q FROM b),
mw AS (SELECT *, min(CASE WHEN m = 1 THEN ts END) OVER w AS up, min(CASE WHEN m = -1 THEN ts END) OVER w AS down FROM mv WINDOW w AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {TS} AS ts, (epoch_ms(CASE WHEN q > 0 THEN up ELSE down END) - epoch_ms(ts))::BIGINT AS lag_ms FROM mw WHERE q <> 0""",
    "ops_spread_ticks": f"SELECT l_returnflag AS series, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ts, round(avg(l_tax * 1000) / 5.0::DOUBLE, 6) AS spread_ticks FROM lineitem GROUP BY l_returnflag, l_shipdate",
    "route_proofs": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 12 >= 10 THEN 'abandon' ELSE 'retry' END WHEN o_orderstatus = 'O' OR o_orderkey % 2 = 0 THEN 'backtest' END AS route FROM orders",
    "session_report": f"""WITH {BOOK_SQL}, sn AS (
  SELECT book, count(DISTINCT CASE WHEN kind = 'hypothesis' THEN hypothesis_id END)::BIGINT AS hypotheses, count_if(kind = 'backtest')::BIGINT AS trials, coalesce(sum(CASE WHEN kind = 'backtest' THEN crashed END), 0)::BIGINT AS crashed,
    count_if(kind = 'verdict')::BIGINT AS verdicts, count_if(kind = 'verdict' AND verdict = 'ACCEPTED')::BIGINT AS accepted FROM bk GROUP BY 1)
SELECT *, CASE WHEN trials > 0 THEN round({for_duckdb(sr_star_sql("0.6D", "cast(trials as double)"))}, 6) END AS sr_star FROM sn""",
    "ops_kill_metrics": f"""{L}, rr AS (SELECT ts, day, open, close / lag(close) OVER (ORDER BY ts) - 1 AS r, ref_ES / lag(ref_ES) OVER (ORDER BY ts) - 1 AS q, lag(close) OVER (ORDER BY ts) AS p, lag(day) OVER (ORDER BY ts) AS pd FROM b)
SELECT {TS} AS ts, round(CASE WHEN count(r) OVER w = 60 THEN stddev_samp(r) OVER w END, 6) AS realized_vol, round(CASE WHEN count(r) OVER w = 60 THEN corr(r, q) OVER w END, 6) AS ref_corr,
  round(CASE WHEN pd <> day THEN open - p END, 6) AS gap_overnight FROM rr WINDOW w AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "ops_minutes_to_open": f"{E} SELECT {TS} AS ts, (540 - tod)::INT AS minutes_to_open FROM b",
    "ops_fill_ratio": f"WITH {TELEMETRY_SQL} SELECT hypothesis_id, ts, round(avg((decision <> 'REJECTED')::INT) OVER (PARTITION BY hypothesis_id ORDER BY bar_time, ts ROWS UNBOUNDED PRECEDING), 6) AS fill_ratio FROM tm WHERE decision IN ('OPEN_LONG', 'OPEN_SHORT', 'REJECTED')",
    "sim_positions": f"{ER}, {SIM.strip()} SELECT {TS} AS ts, decision, position, round(fill_price, 6) AS fill_price, guard_blocked FROM sm",
    "sim_trades": f"""{ER}, {SIM.strip()}, tr AS (SELECT s.ts, decision, position, fill_price, lead(s.ts) OVER (ORDER BY s.ts) AS closed, lead(decision) OVER (ORDER BY s.ts) AS nd, lead(close) OVER (ORDER BY s.ts) AS nc FROM sm s JOIN b ON b.ts = s.ts WHERE decision <> 'NONE'),
ex AS (SELECT *, CASE WHEN position < 0 THEN ceil(nc / 0.5 - 1e-9) * 0.5 ELSE floor(nc / 0.5 + 1e-9) * 0.5 END - position * 0.5 AS x FROM tr WHERE decision LIKE 'OPEN%' AND nd = 'CLOSE')
SELECT {TS} AS opened, strftime(closed, '%Y-%m-%d %H:%M:%S') AS closed, position AS side, round(fill_price, 6) AS entry, round(x, 6) AS exit, round((x - fill_price) * position, 6) AS points FROM ex""",
    "robot_rules": """WITH p AS (SELECT *, (o_orderkey % 1440)::INT AS tod, (o_custkey % 40)::INT AS lots_, CASE WHEN o_orderkey % 2 = 0 THEN ceil(o_totalprice / 5.0 - 1e-9) * 5 ELSE floor(o_totalprice / 5.0 + 1e-9) * 5 END AS px FROM orders)
SELECT o_orderkey, round(px, 2) AS price, greatest(floor(o_totalprice / 155.0), 0)::BIGINT AS lots,
  CASE WHEN o_custkey % 4 >= 3 THEN 'BREAKER' WHEN -10.0 * (o_orderkey % 200) <= -1500 THEN 'DAILY_LOSS' WHEN tod >= 1070 OR tod <= 540 OR tod > 1075 THEN 'CUTOFF' WHEN lots_ < 1 OR lots_ > 32 THEN 'MARGIN' END AS guard,
  tod >= 1070 OR lots_ >= 30 AS flatten FROM p""",
    "ledger_chain": f"{CHAIN_SQL} SELECT book, seq, row_hash FROM ch",
    "ledger_verify_chain": f"""WITH {BOOK_SQL}, bad AS (SELECT book, seq FROM bk WHERE kind = 'verdict' AND o_orderkey % 97 = 0 AND verdict <> 'ACCEPTED')
SELECT bk.book, count(*) AS rows, min(bad.seq) AS first_bad, min(bad.seq) IS NULL AS ok FROM bk LEFT JOIN bad ON bad.book = bk.book AND bad.seq = bk.seq GROUP BY 1""",
    "ledger_count": f"WITH {BOOK_SQL} SELECT count(*) AS trials, sum(crashed)::BIGINT AS crashed FROM bk WHERE kind = 'backtest'",
    "ledger_head": f"{CHAIN_SQL} SELECT book, max(seq) AS seq, arg_max(row_hash, seq) AS row_hash FROM ch GROUP BY 1",
    "ledger_seen_structural": f"WITH {BOOK_SQL} SELECT p_partkey FROM part WHERE sha256((p_partkey % 700)::VARCHAR) IN (SELECT structural_sig FROM bk WHERE kind = 'backtest')",
    "ledger_verdicts": f"WITH {BOOK_SQL} SELECT trial_id, verdict FROM bk WHERE kind = 'verdict' AND hypothesis_id = 'h7'",
    "ledger_verdict_funnel": f"WITH {BOOK_SQL} SELECT verdict, count(*) AS n, count(DISTINCT hypothesis_id) AS hypotheses FROM bk WHERE kind = 'verdict' GROUP BY 1",
    "ledger_config_hash": "SELECT n_nationkey, sha256(sha256(n_name) || sha256(n_nationkey::VARCHAR)) AS config_hash FROM nation",
    "bandit_scores": f"WITH {HISTORY} SELECT name, place, pulls, round(score, 6) AS score FROM so",
    "bandit_pick": f"WITH {HISTORY} SELECT name FROM so ORDER BY score IS NULL DESC, score DESC, place LIMIT 1",
    "bandit_reward": f"WITH {BOOK_SQL}, rw AS (SELECT unnest({VERDICTS}) AS verdict, unnest({list(ledger.REWARDS.values())})::DOUBLE AS reward) SELECT hypothesis_id, round(avg(reward), 6) AS reward, count(*) AS n FROM bk JOIN rw ON rw.verdict = bk.verdict GROUP BY 1",
    "text_normalize": "SELECT conv_id, turn, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS normal FROM conversations",
    "text_circular": f"SELECT c_custkey, {CIRCULAR_SQL} AS circular FROM customer",
    "text_leak_scan": f"SELECT doc_id, regexp_matches(lower(text), '{LEAK_WORDS}') AS leak FROM documents",
    "text_number_leak": "SELECT o_orderkey, o_orderkey % 2 = 0 AND (o_totalprice <> floor(o_totalprice) OR o_totalprice >= 1000) AS leak FROM orders",
    "semantic_key": f"SELECT p_partkey, concat_ws('|', p_brand, trim(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]+', ' ', 'g')), 'LONG', {bucket_sql('greatest(p_size * 3, 1)')}::VARCHAR) AS key FROM part",
    "window_bucket": f"SELECT p_partkey, {bucket_sql('(p_partkey % 200 + 1)')}::INT AS bucket FROM part",
    "route_trials": f"""WITH {BOOK_SQL} SELECT trial_id, CASE WHEN verdict = 'ACCEPTED' THEN 'codegen' WHEN verdict = 'FAILED_GATE' THEN 'abandon' WHEN verdict IN ('INSUFFICIENT_SAMPLE', 'COST_DOMINATED', 'UNSTABLE_ACROSS_FOLDS') THEN CASE WHEN o_orderkey % 12 >= 10 THEN 'abandon' ELSE 'retry' END END AS gate,
  CASE WHEN verdict IN ('INVALID_AST', 'TOO_COMPLEX', 'REDUNDANT') THEN CASE WHEN o_orderkey % 12 >= 10 THEN 'abandon' ELSE 'retry' END END AS formula FROM bk WHERE kind = 'verdict'""",
    "hypothesis_rejection": f"""SELECT c_custkey, CASE WHEN trim({PAYER_CASE}) = '' OR {CIRCULAR_SQL} THEN 'CIRCULAR_PAYER' WHEN c_custkey % 7 = 0 THEN 'NOT_COMPUTABLE' WHEN c_custkey % 11 = 0 THEN 'NOT_INSTRUMENTABLE' WHEN NOT c_custkey % 40 BETWEEN 2 AND 30 THEN 'HORIZON_OUT_OF_RANGE'
  WHEN c_custkey % 13 = 0 THEN 'DUPLICATE' END AS reason FROM customer""",
}
