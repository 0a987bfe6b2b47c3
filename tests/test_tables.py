"""Tables of formulas, purge by intervals, private numbers in many texts, market files in several splits, normal text."""

import datetime as dt
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewick.operators import cross_validation as cv
from tidewick.operators import monitor, texts
from tidewick.plans import formula as fl
from tidewick.plans import tables
from tidewick.queries import identity
from tidewick.sources import files


def as_json(n):
    return {"op": n.op, "args": [as_json(a) if isinstance(a, fl.Node) else a for a in n.args]}


def test_identity_of_a_table_of_trees(spark):
    text = ["gt(close(),high())", "lt(high(),close())", "zscore(ret(close(),2),20)", "zscore(ret(close(),2),22)", "zscore(zscore(close(),5),5)", "add(close(),volume())", "zscore(ema(ema(ema(ema(close(),2),2),2),2),3)"]
    rows = [(i, json.dumps(as_json(fl.parse(t))), "kept") for i, t in enumerate(text)] + [(90, None, ""), (91, "{", ""), (92, "[1]", ""), (93, '{"op":"lag","args":[3]}', ""), (94, '{"op":"nope"}', ""), (95, "[" * 5000, "")]
    got = {r.id: r for r in tables.identified(spark.createDataFrame(rows, "id int, tree string, canonical_of string")).collect()}
    for i, t in enumerate(text):
        n = fl.parse(t)
        bad = fl.validate(n)
        assert (got[i].verdict, got[i].reason) == bad and got[i].canonical_of == "kept"
        if bad[0] != "INVALID_AST":
            assert (got[i].canonical, got[i].exact_signature, got[i].structural_signature) == (str(fl.canonical(n)), fl.exact_signature(n), fl.structural_signature(n))
        else:
            assert got[i].exact_signature is None
    assert got[0].exact_signature == got[1].exact_signature and got[2].structural_signature == got[3].structural_signature and got[2].exact_signature != got[3].exact_signature
    assert all(got[i].verdict == "INVALID_AST" and got[i].reason and got[i].canonical is None for i in range(90, 96))


def test_identity_is_dealt_out(spark):
    """The trees of one small split are read by several tasks, and those too long to be remembered have the same columns."""
    long = json.dumps(as_json(fl.parse("zscore(close(),5)"))) + " " * 3000
    df = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, F.lit(long)).otherwise(F.lit(long.strip())).alias("tree")).coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = tables.identified(df).select("canonical", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 400 and {r.canonical for r in got} == {"(zscore (close) 5)"} and len({r.task for r in got}) > 1


def test_novel_trees(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", None), (4, "c", None), (5, None, "INVALID_AST"), (6, "c", "TOO_COMPLEX")]
    found = spark.createDataFrame(rows, "id int, structural_signature string, verdict string")
    ledger = spark.createDataFrame([("b", 0), ("b", None), ("c", 1), (None, 0)], "structural_sig string, crashed int")
    assert {r.id: r.status for r in tables.novel(found, ledger, "id").collect()} == {1: "NEW", 2: "REPEATED", 3: "SEEN", 4: "NEW", 5: "INVALID", 6: "INVALID"}


def test_dedup_finds_identities_once(spark, sf):
    """The result reads what the one pass over the trees wrote."""
    x = identity.formula_dedup(spark, sf)
    assert "MapInArrow" not in x._jdf.queryExecution().toString()
    assert {r.status for r in x.collect()} == {"NEW", "SEEN", "REPEATED", "INVALID"} and x.count() == identity.trees(spark, sf).count()


def test_removed_equals_all_pairs(spark):
    rng = random.Random(5)
    t0 = dt.datetime(2026, 1, 1)
    rows = []
    for h in range(0, 24 * 40, 5):
        ts = t0 + dt.timedelta(hours=h)
        end = rng.choice([None, ts, ts - dt.timedelta(hours=3), ts + dt.timedelta(minutes=rng.randrange(1, 20_000))])
        rows.append((ts, end, ts.date()))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, end timestamp_ntz, day date")
    days = cv.day_groups(df, 6)
    of = {r.day: r.grp for r in days.collect()}
    whole = [(ts, max(ts, end) if end else ts, of[d]) for ts, end, d in rows]
    want = []
    for g in range(6):
        lo, hi = min(t for t, _, k in whole if k == g), max(e for _, e, k in whole if k == g)
        for t, e, k in whole:
            if k != g and e >= lo and t <= hi + dt.timedelta(minutes=600):
                want.append((g, t, e, "purged" if t <= hi else "embargoed"))
    gone = cv.removed(df, days, 600)
    got = sorted(tuple(r) for r in gone.collect())
    assert got == sorted(want) and {r for *_, r in want} == {"purged", "embargoed"}
    parts = cv.partitions(spark, 6, 2)
    test = {r.grp for r in parts.where("path_id = 4").collect()}
    left = {t for t, _, k in whole if k not in test} - {t for g, t, _, _ in want if g in test}
    assert {r.ts for r in cv.training(df, days, parts, gone, 4).collect()} == left


def test_private_numbers_in_texts(spark):
    docs = ["made 12.34 points", "id 112.34", "12.345", "1.12.34", "12.34.5 and 5000", "15000 5000.0 0.5", None, "", "at 12.3400, or 0.12", "...12.34", "x5000y"]
    values = [12.34, 5000.0, 7.0, None, float("nan"), 0.125, -12.34]
    d = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    m = spark.createDataFrame(list(enumerate(values)), "metric int, value double")
    pairs = d.crossJoin(m).where(texts.holds_number(F.col("text"), texts.number_forms(F.col("value"))))
    want = {(r.id, r.metric) for r in pairs.collect()}
    got = [(r.id, r.metric) for r in texts.leaked_numbers(d, m, "id", "metric").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(0, 0), (0, 6), (4, 1), (10, 1)} <= want and (1, 0) not in want


def test_market_file_in_several_splits(spark, tmp_path):
    lines = ["<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>"]
    lines += ["" if i % 50 == 9 else f"2026.03.02\t{9 + i // 60:02}:{i % 60:02}:00\t{i}\t{i + 2}\t{i - 1}\t{i + 1}\t5\t7\t1" for i in range(500)]
    path = tmp_path / "a.csv"
    path.write_text("﻿" + "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        numbered = files.numbered(spark, str(path)).collect()
        assert sorted((r.line, r.value.lstrip("﻿")) for r in numbered) == list(enumerate(lines, 1)) and spark.read.text(str(path)).rdd.getNumPartitions() > 4
        out = files.read_market_csv(spark, str(path)).orderBy("ts").collect()
        assert len(out) == 490 and out[0].ts == dt.datetime(2026, 3, 2, 9, 1) and out[-1].close == 500.0
        for at, field, text in ((300, 2, "abc"), (17, 1, "25:99"), (480, 7, "nan"), (222, 4, "")):
            broken = list(lines)
            row = broken[at].split("\t")
            row[field] = text
            broken[at] = "\t".join(row)
            broken[490] = "junk"
            path.write_text("\n".join(broken))
            with pytest.raises(fl.MarketDataError, match=f"line {at + 1}:"):
                files.read_market_csv(spark, str(path))
        path.write_text("\n".join(lines[:40] + ["2026.03.02\t10:00"]))
        with pytest.raises(fl.MarketDataError, match="line 41: no open"):
            files.read_market_csv(spark, str(path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_normal_text_of_compatibility_forms(spark):
    some = ["ﬁxo", "①a²", "Ａｂｃ", "½ Å é", "x̂yz", "İstanbul", "㎏ ﬀ", "Ⅷ", "𝐀𝟙", "ſ ẗ", "日本 a", None, "", "ÀÉÎÕÜ ç"]
    df = spark.createDataFrame([(t,) for t in some], "t string").select("t", texts.normalized(F.col("t")).alias("n"))
    for r in df.collect():
        d = "".join(c for c in unicodedata.normalize("NFKD", (r.t or "").lower()) if not unicodedata.combining(c))
        assert r.n == (None if r.t is None else " ".join(re.findall("[a-z0-9]+", d.lower()))), r.t


def test_move_lag_over_many_bars(spark):
    n = 200_000
    ts = F.expr("timestampadd(MINUTE, id, timestamp_ntz'2000-01-01 00:00:00')")
    df = spark.range(n).select(F.lit("s").alias("series"), ts.alias("ts"), F.pmod(F.hash("id"), F.lit(3)).cast("double").alias("close"), F.pmod(F.hash("id", F.lit(1)), F.lit(3)).cast("double").alias("ref_ES"))
    out = monitor.move_lag(df).agg(F.count(F.lit(1)), F.min("lag_ms"), F.max("lag_ms")).first()
    assert out[0] > n / 2 and out[1] == 0 and out[2] < 60_000 * 200
