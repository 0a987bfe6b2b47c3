"""Identity of formulas over tables of trees: canonical form, signatures, verdicts, and what is new."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewick.plans.formula import Constraints, FormulaError, canonical, digest, from_json, nearest, validate, with_windows

#: Trees that a task remembers, and the length up to which it does.
REMEMBERED, SHORT = 10_000, 2_000
IDENTITY = "canonical string, exact_signature string, structural_signature string, verdict string, reason string"


def identity(text: str | None, c: Constraints) -> tuple:
    """The columns of IDENTITY for the JSON of one tree. What is no tree, or breaks a rule, is INVALID_AST and has no signature; one that is TOO_COMPLEX has."""
    try:
        tree = from_json(json.loads(text or ""))
        verdict, reason = validate(tree, c)
        if verdict == "INVALID_AST":
            return None, None, None, verdict, reason
        own = canonical(tree)
        return str(own), digest(own), digest(canonical(with_windows(own, nearest))), verdict, reason
    except (FormulaError, ValueError, TypeError, RecursionError) as e:
        return None, None, None, "INVALID_AST", f"{type(e).__name__}: {e}"


def identified(trees: DataFrame, column: str = "tree", constraints: Constraints = Constraints()) -> DataFrame:
    """trees with the columns of IDENTITY, from a column of JSON objects {"op": name, "args": [..]}. Null is no tree.

    Rows are dealt out first, since a table of keys of few megabytes is read by one task or two, however many trees it stands for.
    """

    def run(batches):
        known = lru_cache(REMEMBERED)(lambda x: identity(x, constraints))
        for b in batches:
            found = [identity(x, constraints) if x and len(x) > SHORT else known(x) for x in b.column(column).to_pylist()]
            more = [pa.array([f[k] for f in found], pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *(x.split(" ")[0] for x in IDENTITY.split(", "))])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trees.schema)
    return trees.hint("rebalance").mapInArrow(run, f"{types}, {IDENTITY}")


def novel(found: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """found (of identified) with status: NEW, or what holds it back.

    INVALID are those with a verdict, SEEN those whose structural signature a row of ledger (structural_sig, crashed) has that didn't crash, REPEATED
    those whose signature an earlier row (in the order of `order`) of the same table has.
    """
    seen = ledger.where("structural_sig is not null and coalesce(crashed, 0) = 0").select(F.col("structural_sig").alias("structural_signature"), F.lit(True).alias("_seen")).distinct()
    good = F.col("verdict").isNull()
    x = found.withColumn("_sig", F.when(good, F.col("structural_signature")))
    first = x.where(good).groupBy(F.col("_sig").alias("structural_signature")).agg(F.min(order).alias("_first"))  # an aggregation, so that a frequent signature is no hot group
    x = x.join(seen, "structural_signature", "left").join(first, "structural_signature", "left")
    status = F.when(~good, "INVALID").when(F.col("_seen"), "SEEN").when(F.col(order) > F.col("_first"), "REPEATED").otherwise("NEW")
    return x.withColumn("status", status).select(*found.columns, "status")

