"""Cross-site boilerplate lines, by the number of distinct sites that carry a line.

Lines are keyed by two 64-bit hashes of their trimmed text. A first aggregation
finds lines with enough rows and more than one site; only their rows go on. For
each such line HyperLogLog sketches of its sites merge by aggregation; where the
estimate is too near the threshold to be trusted, the sites are counted exactly.
A line on ``min_sites`` sites or more is removed from every document but the one
with the smallest doc_id. DataFrame operations only.

Of suspect lines ``HOT_LINES`` at most are looked up by broadcast, so their rows stay where
they are: all, where there are no more, else those of so many rows that at most so many
can have as many; the others are joined by a shuffle.

Defined results: blank lines never count and always stay; a null text stays null,
an empty one empty; a null source counts as a site of its own; rows with a null
doc_id are counted but never changed; repeated rows are changed alike; an empty
table gives no rows. Extra columns pass through ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import shared_folder

MIN_SITES = 10
LG_K = 12
HOT_LINES = 10_000
MARGIN = 0.06  # more than three standard errors of a sketch of 2 ** LG_K registers


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, site, pos, h1, h2: a row for each line that is not blank."""
    lines = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    line = F.trim("line")
    return lines.where(line != "").select("doc_id", "text_key", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


KEY = ["h1", "h2"]


def looked_up(rows: DataFrame, lines: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows joined with lines by KEY; lines has a column hot, and those that are, HOT_LINES at most, are among hot (KEY). None: all lines are, and no row is shuffled."""
    if hot is None:
        return rows.join(F.broadcast(lines.drop("hot")), KEY)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), KEY, "left")
    some = marked.where("_hot").drop("_hot").join(F.broadcast(lines.where("hot").drop("hot")), KEY)
    return some.unionByName(marked.where("_hot is null").drop("_hot").join(lines.where("not hot").drop("hot"), KEY))


def spread_hits(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of line_rows whose line stands on min_sites sites or more, with the keeper's doc_id."""
    shared_folder(docs.sparkSession)
    rows = line_rows(docs)
    suspects = (
        rows.groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("first"), F.max("site").alias("last"), F.min("doc_id").alias("keeper"))
        .where((F.col("n") >= min_sites) & ((F.col("first") != F.col("last")) | (F.lit(min_sites) < 2)))
        .select(*KEY, "n", "keeper")
        .checkpoint()
    )
    count, total = suspects.agg(F.count(F.lit(1)), F.sum("n")).first()
    few = count <= HOT_LINES
    suspects = suspects.withColumn("hot", F.lit(True) if few else F.col("n") > (total or 0) // HOT_LINES).drop("n")
    hot = None if few else suspects.where("hot").select(*KEY)
    hits = looked_up(rows, suspects, hot).checkpoint()
    sketched = hits.groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    sure, doubt = min_sites * (1 + MARGIN) + 1, min_sites * (1 - MARGIN) - 1
    flagged = suspects.select(*KEY, "hot").join(sketched, KEY)
    near = flagged.where((F.col("sites") >= doubt) & (F.col("sites") <= sure)).select(*KEY, "hot")
    exact = looked_up(hits, near, hot).groupBy(*KEY).agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    spread = flagged.where(F.col("sites") > sure).select(*KEY, "hot").unionByName(near.join(exact.select(*KEY), KEY))
    return looked_up(hits, spread.checkpoint(), hot)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with text cleaned, and the counts line_count and lines_removed (blank lines count in neither)."""
    drop = spread_hits(docs, min_sites).where("doc_id <> keeper").groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("_ld_gone"))
    drop = drop.select(F.col("doc_id").alias("_ld_id"), F.col("text_key").alias("_ld_key"), "_ld_gone")
    joined = docs.join(drop, (docs["doc_id"] == drop["_ld_id"]) & (F.xxhash64(docs["text"]) == drop["_ld_key"]), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.transform("_ld_gone", lambda p: p + 1))
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.transform(stay, lambda p: F.element_at(lines, p))))
    full = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: F.trim(x) != "")))
    return joined.select(
        *[c for c in docs.columns if c not in ("text", "line_count", "lines_removed")],
        text.alias("text"), full.cast("long").alias("line_count"), F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("lines_removed"),
    )
