"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells (source, language, topic). The cell weights are raked
in turn to the three target marginals until every marginal is within ``TOLERANCE``
of its target, or ``MAX_ROUNDS`` are done (targets that contradict each other are
never met; ``marginal_gap`` tells by how much they are missed). A document's
expected copies are budget * weight / tokens of its cell; the whole part is taken
always and the rest with the probability that is left, decided by a hash of
doc_id, so a rerun takes the same documents. DataFrame operations only.

Targets are the corpus shares raised to ``TEMPER`` of each dimension, or those
given in a table (dimension, value, share). Given shares are kept as they are and
the values without one share the rest by their tempered shares; if nothing is
left, or every value has one, the given shares are scaled to sum to 1. The topic is
the documents' own column if there is one, else a label of the text's form.

The cells are a table of distinct label triples, not of documents. Up to
``ONE_TASK_CELLS`` of them are raked in one task without shuffles; of more, each
marginal is an aggregation that is joined back, with equal results.

Defined results: a null label is a label of its own; null and empty texts have no
tokens and are never taken; a null doc_id is decided as an empty one; repeated
rows are decided alike; of repeated targets the largest counts, and null ones do
not; a target value without tokens is left out; empty tables give no rows. Extra
columns pass through, but for those named as the results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import shared_folder

TEMPER: Mapping[str, float] = {"source": 0.5, "lang": 0.7, "topic": 0.9}
ROUNDS = 12  # between two looks at the marginals
PLAN_ROUNDS = 6  # between two checkpoints, which keep the plan short
MAX_ROUNDS = 240
TOLERANCE = 1e-6
KEEP_SHARE = 0.5
SALT = "mix-1"
ONE_TASK_CELLS = 1_000_000
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: str = "text") -> Column:
    """A form label from the text alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.contains(t, F.lit(" | ")), "table").when(F.contains(t, F.lit("!!")), "slogan").when(F.length(t) >= 4000, "long").otherwise("prose")


def token_count(text: str = "text") -> Column:
    t = F.col(text)
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(F.size(F.split(t, " ", -1))).cast("long")


def step(cells: DataFrame, d: str, one_task: bool) -> DataFrame:
    """cells with weights scaled so that the marginal of d is met."""
    if one_task:
        return cells.withColumn("weight", F.col("weight") * F.col(f"_goal_{d}") / F.sum("weight").over(Window.partitionBy(d)))
    cells = cells.checkpoint()  # it is read twice
    sums = cells.groupBy(d).agg(F.sum("weight").alias("_sum"))
    return cells.join(sums, d).withColumn("weight", F.col("weight") * F.col(f"_goal_{d}") / F.col("_sum")).drop("_sum")


def goals(cells: DataFrame, targets: DataFrame | None) -> DataFrame:
    """cells with the target share of their value in each dimension, _goal_source and so on; those of a dimension sum to 1, and cells of a share of 0 are left out."""
    for d in DIMENSIONS:
        shares = cells.groupBy(d).agg(F.sum("weight").alias("_share")).withColumn("_soft", F.pow("_share", F.lit(TEMPER[d])))
        given = F.lit(None).cast("double")
        if targets is not None:
            wanted = targets.where((F.col("dimension") == d) & F.col("share").isNotNull()).groupBy(F.coalesce("value", F.lit("")).alias(d)).agg(F.max("share").alias("_given"))
            shares, given = shares.join(wanted, d, "left"), F.col("_given")
        fixed, soft = shares.agg(F.sum(given).alias("fixed"), F.sum(F.when(given.isNull(), F.col("_soft"))).alias("soft")).first()  # two numbers
        rest = max(0.0, 1.0 - (fixed or 0.0)) if soft else 0.0
        scale = 1.0 if rest else (fixed or 1.0)
        goal = F.coalesce(given / F.lit(scale), F.col("_soft") * F.lit(rest / (soft or 1.0)))
        cells = cells.join(shares.select(d, goal.alias(f"_goal_{d}")), d).where(F.col(f"_goal_{d}") > 0)
    return cells


def cut(cells: DataFrame, one_task: bool) -> DataFrame:
    """cells from a checkpoint, which keeps plans short; in one partition, and known to be, where one task rakes them."""
    return cells.coalesce(1).checkpoint().coalesce(1) if one_task else cells.checkpoint()


def marginal_gap(cells: DataFrame) -> float:
    """The largest distance of a marginal from its target, of cells with weight and goals; 0.0 without cells."""
    parts = [cells.groupBy(F.col(d)).agg((F.abs(F.sum("weight") - F.first(f"_goal_{d}"))).alias("gap")).select("gap") for d in DIMENSIONS]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.max("gap")).first()[0] or 0.0


def rake(cells: DataFrame, targets: DataFrame | None = None, rounds: int = MAX_ROUNDS, one_task: bool = True) -> DataFrame:
    """cells (source, lang, topic, tokens) with tokens and their raked weight; the weights sum to 1."""
    shared_folder(cells.sparkSession)
    cells = cells.where("tokens > 0")
    total = cells.agg(F.sum("tokens")).first()[0] or 0  # one number
    out = cut(goals(cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1))), targets), one_task)
    for done in range(0, rounds, ROUNDS):
        for r in range(min(ROUNDS, rounds - done)):
            if r and r % PLAN_ROUNDS == 0:
                out = cut(out, one_task)
            for d in DIMENSIONS:
                out = step(out, d, one_task)
        out = cut(out, one_task)
        if marginal_gap(out) <= TOLERANCE:
            break
    whole = out.agg(F.sum("weight")).first()[0] or 1.0
    return out.withColumn("weight", F.col("weight") / F.lit(whole))


def uniform(key: str = "doc_id", salt: str = SALT) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, keep_share: float = KEEP_SHARE, rounds: int = MAX_ROUNDS) -> DataFrame:
    """The documents taken, with their topic, tokens, weight (expected copies) and copies (1 or more)."""
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of()
    clash = [c for c in docs.columns if c in ("tokens", "weight", "copies") or c.startswith("_mix_")]
    marked = docs.drop(*clash).withColumn("topic", topic).withColumn("tokens", token_count())
    labels = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS}
    cells = marked.groupBy(*[labels[d].alias(d) for d in DIMENSIONS]).agg(F.sum("tokens").alias("tokens")).persist()
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    raked = rake(cells, targets, rounds, n <= ONE_TASK_CELLS)
    cells.unpersist()
    rates = raked.select(*[F.col(d).alias(f"_mix_{d}") for d in DIMENSIONS], (F.lit((total or 0) * keep_share) * F.col("weight") / F.col("tokens")).alias("weight"))
    rates = F.broadcast(rates) if n <= 100_000 else rates  # a cell takes under 200 bytes
    hit = marked.join(rates, [labels[d] == rates[f"_mix_{d}"] for d in DIMENSIONS], "inner").drop(*[f"_mix_{d}" for d in DIMENSIONS])
    copies = F.floor("weight") + F.when(uniform() < F.col("weight") - F.floor("weight"), 1).otherwise(0)
    return hit.where("tokens > 0").withColumn("copies", copies.cast("long")).where("copies >= 1")
