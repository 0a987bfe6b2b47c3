"""Queries of the data preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewick.operators import prep
from tidewick.queries.bars_sql import EVENT_BARS, LINEITEM_BARS, E, L
from tidewick.sources import bars

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def frame_l(spark, d):
    return bars.build_frame(bars.lineitem_bars(spark, d))


def frame_e(spark, d):
    return bars.build_frame(bars.event_bars(spark, d), session=(9 * 60, 17 * 60 + 30))


def prep_resample_bars(spark, d):
    b = bars.event_bars(spark, d)
    return b.select("symbol", stamp("ts").alias("ts"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "trades", "volume")])


def prep_build_frame(spark, d):
    return frame_e(spark, d).select(stamp("ts").alias("ts"), *[F.round(c, 6).alias(c) for c in ("close", "vwap", "ref_ES", "ref_WDO")], "session_mask")


def prep_dropped(spark, d):
    return prep.dropped(bars.event_bars(spark, d), "WIN", bars.REFS)


#: Three contracts of the main symbol, cut from the daily bars; the later ones are shifted, so that there is something to adjust.
CONTRACTS = (("1995-01-01", "1997-06-30", 0.0), ("1997-06-01", "1999-06-30", 1500.0), ("1999-06-01", "2001-12-31", 2750.0))


def prep_stitch(spark, d):
    b = bars.lineitem_bars(spark, d).where("symbol = 'WIN'").drop("symbol")
    parts = [b.where(F.col("ts").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))).withColumns({p: F.col(p) + F.lit(x) for p in prep.PRICES}) for lo, hi, x in CONTRACTS]
    return prep.stitch(parts).select(stamp("ts").alias("ts"), *[F.round(p, 6).alias(p) for p in prep.PRICES], "roll_day")


STITCH_SQL = f"""
WITH {LINEITEM_BARS}, w AS (SELECT * FROM lb WHERE symbol = 'WIN'), k AS (
{' UNION ALL '.join(f"SELECT {i} AS c, ts, open + {x} AS open, high + {x} AS high, low + {x} AS low, close + {x} AS close FROM w WHERE ts BETWEEN '{lo}' AND '{hi}'" for i, (lo, hi, x) in enumerate(CONTRACTS))}
), r AS (
  SELECT a.c, max(a.ts) AS roll_at, arg_max(b.close - a.close, a.ts) AS diff FROM k a JOIN k b ON a.c + 1 = b.c AND a.ts = b.ts GROUP BY 1
), s AS (
  SELECT k.*, coalesce((SELECT sum(diff) FROM r WHERE r.c >= k.c), 0) AS shift, (SELECT roll_at FROM r WHERE r.c = k.c) AS till, (SELECT roll_at FROM r WHERE r.c = k.c - 1) AS since FROM k
)
SELECT {TS} AS ts, round(open + shift, 6) AS open, round(high + shift, 6) AS high, round(low + shift, 6) AS low, round(close + shift, 6) AS close,
  ts::DATE IN (SELECT roll_at::DATE FROM r) AND (since IS NOT NULL) AS roll_day
FROM s WHERE (till IS NULL OR ts < till) AND (since IS NULL OR ts >= since)
"""


def prep_alignment_lag(spark, d):
    return prep.alignment(frame_l(spark, d), "ES", "WDO").withColumn("corr", F.round("corr", 6))


def alignment_sql() -> str:
    parts = []
    for r in ("ES", "WDO"):
        rows = [f"SELECT '{r}' AS symbol, {k} AS lag, corr(x, r) AS c, count(*) AS n, stddev_pop(x) AS sx, stddev_pop(r) AS sr FROM (SELECT {'lead' if k >= 0 else 'lag'}(m, {abs(k)}) OVER (ORDER BY ts) AS x, r FROM r{r}) WHERE x IS NOT NULL" for k in range(-3, 4)]
        parts.append(f"SELECT '{r}' AS symbol, coalesce(arg_max(lag, row(c, -lag)), 0)::INT AS lag, coalesce(max(c), 0.0) AS corr FROM ({' UNION ALL '.join(rows)}) WHERE n >= 100 AND sx > 0 AND sr > 0")
    ctes = ", ".join(f"r{r} AS (SELECT * FROM (SELECT ts, ln(close / lag(close) OVER (ORDER BY ts)) AS m, ln(ref_{r} / lag(ref_{r}) OVER (ORDER BY ts)) AS r FROM b) WHERE m IS NOT NULL)" for r in ("ES", "WDO"))
    return f"{L}, {ctes} SELECT symbol, lag, round(corr, 6) AS corr FROM ({' UNION ALL '.join(parts)})"


def prep_gaps(spark, d):
    return prep.gaps(frame_e(spark, d), 60).select(stamp("after").alias("after"), stamp("before").alias("before"), "minutes")


GAPS_SQL = f"""{E}, s AS (SELECT ts, day, lag(ts) OVER (PARTITION BY day ORDER BY ts) AS p, tod > 540 AND tod <= 1050 AS i, lag(tod > 540 AND tod <= 1050) OVER (PARTITION BY day ORDER BY ts) AS pi FROM b)
SELECT strftime(p, '%Y-%m-%d %H:%M:%S') AS after, {TS} AS before, date_diff('minute', p, ts)::BIGINT AS minutes FROM s WHERE i AND pi AND date_diff('minute', p, ts) > 60"""


def prep_quality(spark, d):
    return prep.quality(frame_l(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


QUALITY_SQL = f"{L} SELECT count(*) AS bars, count(DISTINCT day) AS days, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count_if(volume = 0)::BIGINT AS zero_volume, count(*) - count(DISTINCT ts) AS duplicated FROM b"


def prep_zero_volume(spark, d):
    b = bars.event_bars(spark, d)
    return b.groupBy("symbol").agg(F.count_if(F.col("volume") == 0).alias("zero_volume"), F.count_if(F.col("high") == F.col("low")).alias("one_price"))


def prep_calendar(spark, d):
    return prep.calendar(frame_e(spark, d)).withColumn("day", F.col("day").cast("string"))


def prep_holdout(spark, d):
    research, held = prep.split_holdout(frame_l(spark, d), 6)
    side = lambda x, name: x.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("bars"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))
    return side(research, "research").unionByName(side(held, "holdout"))


HOLDOUT_SQL = f"""{L}, c AS (SELECT date_trunc('month', max(ts)) - INTERVAL 5 MONTH AS cut FROM b)
SELECT CASE WHEN ts < cut THEN 'research' ELSE 'holdout' END AS side, count(*) AS bars, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM b, c GROUP BY 1"""


def prep_frame_invariants(spark, d):
    return bars.invariants(frame_e(spark, d))


def prep_positions(spark, d):
    return prep.positions(frame_e(spark, d)).select(stamp("ts").alias("ts"), "pos")


def prep_slice(spark, d):
    return prep.positions(frame_e(spark, d)).where("pos >= 100 and pos < 200").select(stamp("ts").alias("ts"), "pos", F.round("close", 6).alias("close"))


HASHED = ("close", "high", "low", "volume", "trades", "ref_ES", "ref_WDO")


def prep_data_hash(spark, d):
    return prep.data_hash(frame_l(spark, d), HASHED)


HASH_SQL = f"""{L}, d AS (SELECT day, sha256(string_agg({TS} || '|' || {" || '|' || ".join(f"printf('%.6f', {c})" for c in HASHED)}, chr(10) ORDER BY ts)) AS h FROM b GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY day)) AS data_hash FROM d"""


def prep_report_ok(spark, d):
    """One row for each view: the counts of the report and whether the frame may be used."""
    out = None
    for name, frame, minutes in (("lineitem", frame_l(spark, d), prep.MAX_GAP_MINUTES), ("events", frame_e(spark, d), 60)):
        lags = prep.alignment(frame, "ES", "WDO").agg(F.collect_list(F.struct("lag", "corr")).alias("lags"))
        row = prep.quality(frame).join(prep.gaps(frame, minutes).agg(F.count(F.lit(1)).alias("gaps"))).join(lags)  # one row each
        row = row.select(F.lit(name).alias("view"), "bars", "gaps", "duplicated", prep.report_ok(F.col("gaps"), F.col("duplicated"), F.col("lags")).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def ok_sql() -> str:
    """Out of step is a best lag other than 0 with a correlation of 0.05 or more."""
    def best(view: str) -> str:
        parts = []
        for r in ("ES", "WDO"):
            rows = [f"SELECT {k} AS lag, corr(x, r) AS c, count(*) AS n FROM (SELECT {'lead' if k >= 0 else 'lag'}(m, {abs(k)}) OVER (ORDER BY ts) AS x, r FROM (SELECT * FROM (SELECT ts, ln(close / lag(close) OVER (ORDER BY ts)) AS m, ln(ref_{r} / lag(ref_{r}) OVER (ORDER BY ts)) AS r FROM {view}) WHERE m IS NOT NULL)) WHERE x IS NOT NULL" for k in range(-3, 4)]
            parts.append(f"SELECT coalesce(arg_max(lag, row(c, -lag)), 0) AS lag, coalesce(max(c), 0) AS c FROM ({' UNION ALL '.join(rows)}) WHERE n >= 100")
        return f"(SELECT count(*) FROM ({' UNION ALL '.join(parts)}) WHERE lag <> 0 AND abs(c) >= 0.05)"

    le = L.replace(" b AS", " bl AS").replace("\nb AS", "\nbl AS")
    ee = E.replace("\nb AS", "\nbe AS").replace("WITH ", "", 1)
    gaps = "(SELECT count(*) FROM (SELECT ts, lag(ts) OVER (PARTITION BY day ORDER BY ts) AS p, tod > {lo} AND tod <= {hi} AS i, lag(tod > {lo} AND tod <= {hi}) OVER (PARTITION BY day ORDER BY ts) AS pi FROM {v}) WHERE i AND pi AND date_diff('minute', p, ts) > {m})"
    one = lambda name, v, lo, hi, m: f"SELECT '{name}' AS view, (SELECT count(*) FROM {v}) AS bars, {gaps.format(v=v, lo=lo, hi=hi, m=m)} AS gaps, 0::BIGINT AS duplicated, {best(v)} AS off"
    return f"{le}, {ee} SELECT view, bars, gaps, duplicated, gaps = 0 AND off = 0 AS ok FROM ({one('lineitem', 'bl', 0, 1440, 3)} UNION ALL {one('events', 'be', 540, 1050, 60)})"


def prep_bars_per_day(spark, d):
    b = bars.event_bars(spark, d)
    return b.groupBy("symbol", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("bars"))


QUERIES = {
    f.__name__: f
    for f in (
        prep_resample_bars, prep_build_frame, prep_dropped, prep_stitch, prep_alignment_lag, prep_gaps, prep_quality, prep_zero_volume, prep_calendar, prep_holdout,
        prep_frame_invariants, prep_positions, prep_slice, prep_data_hash, prep_bars_per_day, prep_report_ok,
    )
}
ORACLE_SQL = {
    "prep_resample_bars": f"WITH {EVENT_BARS} SELECT symbol, {TS} AS ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(trades, 6) AS trades, round(volume, 6) AS volume FROM eb",
    "prep_build_frame": f"{E} SELECT {TS} AS ts, round(close, 6) AS close, round(vwap, 6) AS vwap, round(ref_ES, 6) AS ref_ES, round(ref_WDO, 6) AS ref_WDO, tod > 540 AND tod <= 1050 AS session_mask FROM b",
    "prep_dropped": f"{E} SELECT n AS bars, k AS aligned, n - k AS dropped FROM (SELECT count(*) AS n FROM eb WHERE symbol = 'WIN'), (SELECT count(*) AS k FROM b)",
    "prep_stitch": STITCH_SQL,
    "prep_alignment_lag": alignment_sql(),
    "prep_gaps": GAPS_SQL,
    "prep_quality": QUALITY_SQL,
    "prep_zero_volume": f"WITH {EVENT_BARS} SELECT symbol, count_if(volume = 0)::BIGINT AS zero_volume, count_if(high = low)::BIGINT AS one_price FROM eb GROUP BY 1",
    "prep_calendar": f"{E} SELECT day::VARCHAR AS day, count(*)::INT AS bars_expected FROM b GROUP BY 1",
    "prep_holdout": HOLDOUT_SQL,
    "prep_frame_invariants": f"{E} SELECT count(*) AS rows, 0::BIGINT AS no_time, 0::BIGINT AS not_increasing, 0::BIGINT AS not_finite FROM b",
    "prep_positions": f"{E} SELECT {TS} AS ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM b",
    "prep_slice": f"{E} SELECT * FROM (SELECT {TS} AS ts, row_number() OVER (ORDER BY ts) - 1 AS pos, round(close, 6) AS close FROM b) WHERE pos >= 100 AND pos < 200",
    "prep_data_hash": HASH_SQL,
    "prep_report_ok": ok_sql(),
    "prep_bars_per_day": f"WITH {EVENT_BARS} SELECT symbol, ts::DATE::VARCHAR AS day, count(*) AS bars FROM eb GROUP BY 1, 2",
}
