"""The append-only ledger: hashing, chain verification, look-ups, a single writer; and the family bandit."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewick.operators.gate import sr_star_sql

ZERO = "0" * 64
KINDS = ("genesis", "backtest", "holdout", "kill", "daily", "hypothesis", "verdict")
TRIALS = ("backtest", "holdout")
COLUMNS = ("seq", "trial_id", "kind", "hypothesis_id", "ast_hash", "structural_sig", "data_hash", "config_hash", "verdict", "crashed", "payload", "prev_hash", "ts")
SCHEMA = "seq long, trial_id string, kind string, hypothesis_id string, ast_hash string, structural_sig string, data_hash string, config_hash string, verdict string, crashed int, payload string, prev_hash string, row_hash string, ts string"
#: What a verdict is worth to the bandit.
REWARDS = {
    "INVALID_AST": 0.0, "REDUNDANT": 0.0, "TOO_COMPLEX": 0.1, "PROOF_FAILED": 0.3, "INSUFFICIENT_SAMPLE": 0.4, "COST_DOMINATED": 0.5, "UNSTABLE_ACROSS_FOLDS": 0.6, "FAILED_GATE": 0.8, "ACCEPTED": 1.0,
}
EXPLORE = 0.8


class LedgerError(Exception):
    """A record that the ledger's rules refuse."""


def row_hash(columns: tuple[str, ...] = COLUMNS) -> Column:
    """sha256 of the row as JSON with sorted keys; nulls stay."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def chained(rows: DataFrame, book: str, columns: tuple[str, ...] = COLUMNS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """rows (book, seq and columns but prev_hash) with prev_hash and row_hash: each book is a chain in the order of seq. Of rows' columns only `keep` come back, if given.

    The JSON of all rows is made in parallel, with a mark where the hash before goes; a task goes through the rows of its books once, in their order, and keeps one hash.
    """
    mark = uuid.uuid4().hex
    body = F.to_json(F.struct(*[F.lit(mark).alias(c) if c == "prev_hash" else F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    x = rows.select(*(keep or rows.columns), body.alias("_body"), F.row_number().over(Window.partitionBy(book).orderBy(F.col("seq").asc_nulls_last())).alias("_place"))
    kept = x.drop("_body", "_place").schema

    def run(batches):
        before = ZERO
        for b in batches:
            old, new = [], []
            for text, place in zip(b.column("_body").to_pylist(), b.column("_place").to_pylist(), strict=True):
                before = ZERO if place == 1 else before
                old.append(before)
                before = hashlib.sha256(text.replace(mark, before).encode()).hexdigest()
                new.append(before)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(old, pa.string()), pa.array(new, pa.string())], [*kept.names, "prev_hash", "row_hash"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return x.mapInArrow(run, f"{types}, prev_hash string, row_hash string")


def config_hash(prereg: Column, catalog: Column) -> Column:
    return F.sha2(F.concat(prereg, catalog), 256)


def verify_chain(rows: DataFrame, books: tuple[str, ...] = (), columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Per book: rows, first_bad (seq of the first row that breaks a rule) and ok. Hashes are recomputed in parallel; only neighbours are compared in order."""
    w = Window.partitionBy(*books).orderBy("seq") if books else Window.orderBy("seq")
    x = rows.withColumns({"_h": row_hash(columns), "_prev": F.lag("row_hash").over(w), "_n": F.row_number().over(w)})
    good = (F.col("seq") == F.col("_n")) & (F.col("prev_hash") == F.coalesce("_prev", F.lit(ZERO))) & ((F.col("seq") == 1) == (F.col("kind") == "genesis")) & (F.col("_h") == F.col("row_hash"))
    out = x.groupBy(*books) if books else x.groupBy()
    return out.agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(~good, F.col("seq"))).alias("first_bad")).withColumn("ok", F.col("first_bad").isNull())


def count_trials(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isin(*TRIALS)).agg(F.count(F.lit(1)).alias("trials"), F.coalesce(F.sum("crashed"), F.lit(0)).alias("crashed"))


def head(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("seq").alias("seq"), F.max_by("row_hash", "seq").alias("row_hash"))


def seen_structural(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidates whose structural_sig an earlier trial has."""
    return candidates.join(rows.where(F.col("kind").isin(*TRIALS)).select("structural_sig"), "structural_sig", "left_semi")


def verdicts_for(rows: DataFrame, hypothesis_id: str) -> DataFrame:
    return rows.where((F.col("kind") == "verdict") & (F.col("hypothesis_id") == hypothesis_id)).select("seq", "trial_id", "verdict")


def attempts(rows: DataFrame, session: str) -> DataFrame:
    """Verdicts of a session with the structural signature of the trial that they judge."""
    mine = rows.where(F.col("trial_id").startswith(f"{session}/"))
    trial = mine.where("kind = 'backtest'").select(F.col("trial_id").alias("trial"), F.col("structural_sig").alias("sig"))
    base = F.expr("substring_index(trial_id, '/', size(split(trial_id, '/')) - 1)")
    return mine.where("kind = 'verdict'").withColumn("trial", base).join(trial, "trial", "left").select("trial", "hypothesis_id", "verdict", F.substring(F.coalesce("sig", F.lit("-")), 1, 16).alias("sig"))


def session_report(rows: DataFrame, var_sr: float, *books: str) -> DataFrame:
    """Of each book: hypotheses, trials, crashes, verdicts, acceptances, and the Sharpe ratio that the best of so many worthless trials is expected to show."""
    trial, verdict = F.col("kind").isin(*TRIALS), F.col("kind") == "verdict"
    out = (rows.groupBy(*books) if books else rows.groupBy()).agg(
        F.count_distinct(F.when(F.col("kind") == "hypothesis", F.col("hypothesis_id"))).alias("hypotheses"), F.count_if(trial).alias("trials"), F.coalesce(F.sum(F.when(trial, F.col("crashed"))), F.lit(0)).cast("long").alias("crashed"),
        F.count_if(verdict).alias("verdicts"), F.count_if(verdict & (F.col("verdict") == "ACCEPTED")).alias("accepted"),
    )
    star = F.expr(sr_star_sql(f"{float(var_sr)!r}D", "cast(trials as double)"))
    return out.withColumn("sr_star", F.when(F.col("trials") > 0, star))


class Ledger:
    """One writer on the driver; rows go to a Parquet folder and are never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def append(self, record: dict) -> dict:
        known = self.rows()
        last = head(known).first()
        first = known.where("seq = 1").first()
        self.check(record, first, known)
        row = dict.fromkeys(COLUMNS) | {"crashed": 0} | record
        row |= {"seq": (last.seq or 0) + 1, "prev_hash": last.row_hash or ZERO}
        if isinstance(row["payload"], dict):
            row["payload"] = json.dumps(row["payload"], sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        text = json.dumps({c: row[c] for c in COLUMNS}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        row["row_hash"] = hashlib.sha256(text.encode()).hexdigest()
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        self.spark.createDataFrame([tuple(row[c] for c in names)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return row

    def check(self, r: dict, first, known: DataFrame) -> None:
        kind = r.get("kind")
        wrong = lambda why: LedgerError(f"{kind}: {why}")
        if kind not in KINDS or (kind == "genesis") != (first is None):
            raise wrong("kind or place")
        if kind == "genesis":
            return
        if r.get("config_hash") != first.config_hash:
            raise wrong("another configuration")
        if kind != "holdout" and r.get("data_hash") != first.data_hash:
            raise wrong("other data")
        if kind in TRIALS:
            if not r.get("ast_hash") or not r.get("structural_sig") or r.get("payload"):
                raise wrong("a trial needs its signatures and has no payload")
            if not known.where(F.col("kind").isin(*TRIALS) & (F.col("trial_id") == r.get("trial_id"))).isEmpty():
                raise wrong("this trial is there already")
        elif not r.get("hypothesis_id") or r.get("crashed") or kind == "verdict" and not r.get("verdict") or kind == "hypothesis" and not r.get("payload"):
            raise wrong("fields")


def reward(verdict: Column) -> Column:
    out = F.lit(None).cast("double")
    for v, x in REWARDS.items():
        out = F.when(verdict == v, x).otherwise(out)
    return out


def bandit_scores(history: DataFrame, families: DataFrame) -> DataFrame:
    """name, place, pulls, score: mean reward plus 0.8 sqrt(ln(all pulls) / pulls) of the available families; NULL if never pulled."""
    h = history.groupBy("family").agg(F.count(F.lit(1)).alias("pulls"), F.avg(reward(F.col("verdict"))).alias("_mean"))
    x = families.where("available").join(h, families["name"] == h["family"], "left").withColumn("pulls", F.coalesce("pulls", F.lit(0)))
    total = F.sum("pulls").over(Window.partitionBy(F.lit(1)))  # a row for each family
    x = x.withColumn("_total", total)
    return x.select("name", "place", "pulls", F.when(F.col("pulls") > 0, F.col("_mean") + EXPLORE * F.sqrt(F.ln("_total") / F.col("pulls"))).alias("score"))


def pick(scores: DataFrame) -> DataFrame:
    """The family to try: never pulled ones first in catalogue order, else the best score, ties in catalogue order."""
    return scores.orderBy(F.col("score").isNull().desc(), F.col("score").desc(), "place").limit(1)
