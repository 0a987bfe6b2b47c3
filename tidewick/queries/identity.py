"""Queries of formula tables, purge by intervals and the scan for private numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewick.operators import cross_validation as cv
from tidewick.operators import texts
from tidewick.plans import tables
from tidewick.plans.formula import Constraints
from tidewick.queries.bars_sql import E
from tidewick.queries.operations import bucket_sql
from tidewick.queries.preparation import frame_e, stamp
from tidewick.sources.shared import new_folder, written


FOUR = Constraints(max_free_params=4)


def trees(spark, d):
    """A tree of each part: comparisons and sums of two scores, both ways round, scores of scores, and broken ones."""
    t = spark.read.parquet(f"{d}/part.parquet")
    k, n = F.col("p_partkey"), lambda m: (F.col("p_partkey") % m + 2).cast("string")
    node = lambda op, *args: F.concat(F.lit(f'{{"op":"{op}","args":['), F.concat_ws(",", *args), F.lit("]}"))
    a = node("zscore", node("ret", node("close"), n(7)), n(50))
    b = node("zscore", node("delta", node("high"), n(5)), n(30))
    tree = (
        F.when(k % 7 == 0, node("gt", a, b)).when(k % 7 == 1, node("lt", b, a)).when(k % 7 == 2, node("add", a, b)).when(k % 7 == 3, node("add", b, a))
        .when(k % 7 == 4, node("zscore", a, n(50))).when(k % 7 == 5, node("add", a, node("volume"))).otherwise(F.concat(F.lit("{"), a))
    )
    return t.select("p_partkey", tree.alias("tree"))


def formula_signatures(spark, d):
    x = tables.identified(trees(spark, d), constraints=FOUR)
    return x.select("p_partkey", "canonical", "exact_signature", "structural_signature", "verdict")


def formula_dedup(spark, d):
    """The ledger holds the signatures of the parts whose key 3 divides; those that 15 divides crashed. The table is read three times, so its identities are written once."""
    x = tables.identified(trees(spark, d), constraints=FOUR).select("p_partkey", "structural_signature", "verdict")
    x = written(x, new_folder(spark, "formulas"))
    ledger = x.where("p_partkey % 3 = 0").select(F.col("structural_signature").alias("structural_sig"), (F.col("p_partkey") % 15 == 0).cast("int").alias("crashed"))
    return tables.novel(x, ledger, "p_partkey").select("p_partkey", "status")


def labelled(spark, d):
    """Samples of the hourly bars whose labels last between half an hour and a week, by their place in the day and month."""
    f = frame_e(spark, d)
    minutes = F.when(F.dayofmonth("ts") % 9 == 0, 10_080).otherwise(30 + F.hour("ts") * 37)
    return f.select("ts", (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("end"), "day")


def cpcv_purge_intervals(spark, d):
    x = labelled(spark, d)
    return cv.removed(x, cv.day_groups(x, 8), 180).select("grp", stamp("ts").alias("ts"), stamp("end").alias("end"), "role")


def text_number_leaks(spark, d):
    """Customers' balances and the orders' keys in hundredths are the private numbers, all documents are searched."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("metric"), F.col("c_acctbal").cast("double").alias("value"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("metric"), (F.col("o_orderkey") / 100).alias("value"))
    return texts.leaked_numbers(spark.read.parquet(f"{d}/documents.parquet"), c.unionByName(o), "doc_id", "metric")


QUERIES = {f.__name__: f for f in (formula_signatures, formula_dedup, cpcv_purge_intervals, text_number_leaks)}

SIGNATURES_SQL = f"""
pw AS (SELECT p_partkey, p_partkey % 7 AS kind, p_partkey % 7 + 2 AS w1, p_partkey % 50 + 2 AS w2, p_partkey % 5 + 2 AS w3, p_partkey % 30 + 2 AS w4 FROM part),
pb AS (SELECT *, {bucket_sql('w1')} AS k1, {bucket_sql('w2')} AS k2, {bucket_sql('w3')} AS k3, {bucket_sql('w4')} AS k4 FROM pw),
ps AS (SELECT p_partkey, kind, printf('(zscore (ret (close) %d) %d)', w1::INT, w2::INT) AS a, printf('(zscore (delta (high) %d) %d)', w3::INT, w4::INT) AS b,
  printf('(zscore (ret (close) %d) %d)', k1::INT, k2::INT) AS c, printf('(zscore (delta (high) %d) %d)', k3::INT, k4::INT) AS d FROM pb),
pc AS (SELECT p_partkey, kind, CASE WHEN kind < 2 THEN '(gt ' || a || ' ' || b || ')' WHEN kind < 4 THEN CASE WHEN sha256(a) > sha256(b) THEN '(add ' || b || ' ' || a || ')' ELSE '(add ' || a || ' ' || b || ')' END WHEN kind = 4 THEN a END AS canonical,
  CASE WHEN kind < 2 THEN '(gt ' || c || ' ' || d || ')' WHEN kind < 4 THEN CASE WHEN sha256(c) > sha256(d) THEN '(add ' || d || ' ' || c || ')' ELSE '(add ' || c || ' ' || d || ')' END WHEN kind = 4 THEN c END AS form FROM ps),
sg AS MATERIALIZED (SELECT p_partkey, canonical, sha256(canonical) AS exact_signature, sha256(form) AS structural_signature, CASE WHEN kind > 4 THEN 'INVALID_AST' END AS verdict FROM pc)"""
PURGE_SQL = f"""{E}, s AS (SELECT ts, ts + to_minutes(CASE WHEN day(ts) % 9 = 0 THEN 10080 ELSE 30 + hour(ts) * 37 END) AS e, g.grp FROM b JOIN (SELECT day, ntile(8) OVER (ORDER BY day) - 1 AS grp FROM (SELECT DISTINCT day FROM b)) g ON g.day = b.day),
p AS (SELECT grp, min(ts) AS lo, max(e) AS hi FROM s GROUP BY 1)
SELECT p.grp, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(s.e, '%Y-%m-%d %H:%M:%S') AS "end", CASE WHEN s.ts <= p.hi THEN 'purged' ELSE 'embargoed' END AS role
FROM s JOIN p ON p.grp <> s.grp AND s.e >= p.lo AND s.ts <= p.hi + INTERVAL 180 MINUTE"""
FORMS = "CASE WHEN v = floor(v) THEN CASE WHEN v >= 1000 THEN [v::BIGINT::VARCHAR] ELSE [] END ELSE list_filter([printf('%.2f', v), printf('%.3f', v), regexp_replace(printf('%.4f', v), '0+$', ''), v::VARCHAR], lambda s: s NOT IN ('0.00', '0.000', '0.')) END"
LEAKS_SQL = f"""WITH m AS (SELECT 'c' || c_custkey AS metric, abs(c_acctbal::DOUBLE) AS v FROM customer UNION ALL SELECT 'o' || o_orderkey, o_orderkey / 100::DOUBLE FROM orders),
f AS (SELECT DISTINCT metric, unnest({FORMS}) AS form FROM m), r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9.]+')) AS run FROM documents),
n AS (SELECT doc_id, regexp_extract(run, '^[0-9]+(\\.[0-9]*)?') AS form FROM r UNION SELECT doc_id, regexp_extract(run, '^[0-9]+') FROM r)
SELECT DISTINCT n.doc_id, f.metric FROM n JOIN f ON f.form = n.form WHERE n.form <> ''"""
ORACLE_SQL = {
    "formula_signatures": f"WITH {SIGNATURES_SQL} SELECT * FROM sg",
    "formula_dedup": f"""WITH {SIGNATURES_SQL}, led AS (SELECT DISTINCT structural_signature FROM sg WHERE p_partkey % 3 = 0 AND p_partkey % 15 <> 0 AND structural_signature IS NOT NULL),
fi AS (SELECT structural_signature, min(p_partkey) AS f FROM sg WHERE verdict IS NULL GROUP BY 1)
SELECT sg.p_partkey, CASE WHEN verdict IS NOT NULL THEN 'INVALID' WHEN led.structural_signature IS NOT NULL THEN 'SEEN' WHEN sg.p_partkey > fi.f THEN 'REPEATED' ELSE 'NEW' END AS status
FROM sg LEFT JOIN led ON led.structural_signature = sg.structural_signature LEFT JOIN fi ON fi.structural_signature = sg.structural_signature""",
    "cpcv_purge_intervals": PURGE_SQL,
    "text_number_leaks": LEAKS_SQL,
}
