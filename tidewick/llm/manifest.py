"""Merkle manifest of a data set, with a proof for each document by lookup of coordinates.

Every document is a leaf; the leaves of a group (lang) stand in order and every
FAN consecutive nodes become one, until one is left. The groups' last nodes are
the leaves of a top tree. All runs of siblings are written as a table with their
coordinates (tree, level, run). A leaf makes the coordinates of the runs that its
proof needs from its index and the size of its group, joins that table, orders
what it finds by level, and folds it.

A null field counts as '-'; a null lang is a group of its own, the first. Documents of
one doc_id stand in the order of their digests; rows that repeat others have equal
digests and take places beside each other, each with its own proof. Of an empty table
the result is empty. Columns of the input beside `FIELDS` are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import shared_folder, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Runs of a level that are sent to every task: at most 4,096 rows of some 400 bytes. A level with more is joined by shuffle, and then no run is
#: wanted by more than a few hundredths of the leaves.
SENT_RUNS = 4096


def encoded(c: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    return F.sha2(F.concat(*[encoded(text if text is not None and c == "text" else F.col(c)) for c in FIELDS]), 256)


def tampered_text() -> Column:
    return F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_tampered(doc_id: Column) -> Column:
    """Where 3 divides the unsigned crc32 of the decimal doc_id; a null doc_id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def hexed(c) -> Column:
    return F.lower(F.hex(c))


def placed(rows: DataFrame, by: list[str], group: str, path: str) -> tuple[DataFrame, DataFrame]:
    """rows with part and idx, and the (part, group) pairs with first (their first index) and part.

    idx is the place in the group, from 0, in the order of group and by. The rows are dealt out by ranges of that order and numbered in each
    range; only the counts of the ranges are summed up.
    """
    x = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (group, *by)]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (group, *by)])
    x = written(x.withColumn("at", F.monotonically_increasing_id()), path)  # the range above 33 bits, the place in it below
    x = x.withColumn("part", F.shiftright("at", 33))
    parts = x.groupBy("part", group).agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy("part")
    parts = parts.withColumns({"first": F.sum("n").over(w) - F.col("n"), "size": F.sum("n").over(Window.partitionBy(group))})
    return x, parts


def grown(leaves: DataFrame, most: int, path: str) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The runs of each level with their count, and the last node of each tree.

    leaves: tree, idx, size (of the tree), digest (binary). Runs: tree, run, digests (one after the other), parent. Last nodes: tree, digest.
    """
    nodes, levels, last = leaves.select("tree", "idx", "size", "digest"), [], None
    while True:
        peak = nodes.where("size = 1").select("tree", "digest")
        last = peak if last is None else last.unionByName(peak)
        if most <= 1:
            return levels, last
        g = nodes.where("size > 1").groupBy("tree", F.floor(F.col("idx") / FAN).alias("run"), F.ceil(F.col("size") / FAN).alias("above"))
        g = g.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: hexed(x["digest"])).alias("d"))
        joined = F.array_join("d", "")
        runs = written(g.select("tree", "run", "above", F.unhex(joined).alias("digests"), F.unhex(F.sha2(joined, 256)).alias("parent")), f"{path}/{len(levels)}")
        levels.append((runs, runs.count()))
        nodes = runs.select("tree", F.col("run").alias("idx"), F.col("above").alias("size"), F.col("parent").alias("digest"))
        most = -(-most // FAN)


def looked_up(leaves: DataFrame, levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """tree, idx, steps, last: for each leaf (tree, idx, size) its proof, one step (level, place, siblings) for each level, and the last node of its tree.

    A leaf that is alone in its tree makes no coordinates and has no row here.
    """
    if not levels:
        empty = "cast(array() as array<struct<level:int,place:int,siblings:binary>>) as steps"
        return leaves.where("false").selectExpr("tree", "idx", empty, "cast(null as binary) as last")
    depth, width = len(levels), [FAN**k for k in range(len(levels) + 1)]
    need = F.array(*[F.when(F.col("size") > width[k], F.struct(F.lit(k).alias("level"), F.floor(F.col("idx") / width[k]).alias("node"), (F.col("size") <= width[k + 1]).alias("top"))) for k in range(depth)])
    want = leaves.select("tree", "idx", F.explode(F.filter(need, lambda x: x.isNotNull())).alias("w")).select("tree", "idx", "w.*")
    want = want.withColumns({"run": F.floor(F.col("node") / FAN), "place": (F.col("node") % FAN).cast("int")})
    step = F.struct("level", "place", F.concat(F.expr("substring(digests, 1, place * 32)"), F.expr("substring(digests, place * 32 + 33)")).alias("siblings"))
    found = None
    for sent in (False, True):
        some = [k for k in range(depth) if (levels[k][1] <= SENT_RUNS) == sent]
        if not some:
            continue
        table = None
        for k in some:
            t = levels[k][0].select("tree", "run", "digests", "parent").withColumn("level", F.lit(k))
            table = t if table is None else table.unionByName(t)
        out = want.where(F.col("level").isin(some)).join(F.broadcast(table) if sent else table, ["tree", "level", "run"])
        out = out.select("tree", "idx", step.alias("step"), F.when(F.col("top"), F.col("parent")).alias("last"))
        found = out if found is None else found.unionByName(out)
    return found.groupBy("tree", "idx").agg(F.array_sort(F.collect_list("step")).alias("steps"), F.max("last").alias("last"))


def folded(leaf: Column, steps: Column) -> Column:
    """The node that a leaf (hex) comes to with the siblings of its steps."""

    def up(acc, s):
        sib, at = hexed(s["siblings"]), s["place"] * 64
        return F.sha2(F.concat(F.substring(sib, F.lit(1), at), acc, F.substring(sib, at + 1, F.length(sib))), 256)

    return F.aggregate(steps, leaf, up)


def joined_siblings(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: hexed(s["siblings"])), "")


def manifest(docs: DataFrame, tampered=is_tampered) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings (all digests of the proof, in order), folded_root, verified.

    `tampered` says of a doc_id (a column) whether its text is lower-cased (A-Z) before its proof is folded; the digests are those of the table as it stands.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    x = docs.select(*FIELDS)
    altered = F.when(tampered(F.col("doc_id")), F.unhex(leaf_hash(tampered_text())))
    leaves = written(x.select("doc_id", "lang", F.unhex(leaf_hash()).alias("digest"), altered.alias("altered"), F.monotonically_increasing_id().alias("tie")), f"{folder}/leaves")
    rows, parts = placed(leaves, ["doc_id", "digest", "tie"], "lang", f"{folder}/placed")
    parts = written(parts, f"{folder}/parts")
    # The groups in order are the leaves of the top tree.
    langs, lang_parts = placed(parts.groupBy("lang").agg(F.lit(0).alias("one")), ["lang"], "one", f"{folder}/langs")
    ranks = langs.join(F.broadcast(lang_parts.select("part", "begin", "first", "size")), "part")  # a row for each range of a table of groups: as many as there are partitions
    ranks = ranks.select("lang", (F.col("first") + F.col("at") - F.col("begin")).alias("tree"), F.col("size").alias("trees"))
    same = parts["lang"].eqNullSafe(ranks["lang"])
    parts = written(parts.join(ranks, same).select(parts["lang"], "part", "begin", "first", "size", "tree", "trees"), f"{folder}/ranked")
    here = (rows["part"] == parts["part"]) & rows["lang"].eqNullSafe(parts["lang"])
    indexed = rows.join(parts, here).select(rows["part"], "tree", "size", (F.col("first") + F.col("at") - F.col("begin")).alias("idx"), "doc_id", "digest", "altered")
    indexed = written(indexed, f"{folder}/indexed")

    largest = parts.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("trees"), F.lit(0))).first()
    levels, last = grown(indexed, largest[0], f"{folder}/runs")
    trees = parts.select("tree", "trees").distinct()
    subroots = written(last.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("size"), "digest"), f"{folder}/subroots")
    top_levels, top = grown(subroots, largest[1], f"{folder}/top")
    root = top.select(hexed("digest").alias("root")).first()
    root = F.lit(root[0] if root else None)

    none = F.expr("cast(array() as array<struct<level:int,place:int,siblings:binary>>)")
    above = looked_up(subroots, top_levels).select("idx", F.col("steps").alias("top_steps"))
    above = subroots.select("idx", F.col("digest").alias("subroot")).join(above, "idx", "left").withColumnRenamed("idx", "tree")
    # By group and range: a group of many documents is no hot key.
    above = written(parts.select("tree", "part").join(above, "tree"), f"{folder}/above")
    x = indexed.join(looked_up(indexed, levels), ["tree", "idx"], "left").join(above, ["tree", "part"])
    x = x.withColumns({"steps": F.coalesce("steps", none), "top_steps": F.coalesce("top_steps", none)})
    ends = F.coalesce("altered", "digest")
    x = x.select(
        "doc_id", hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), root.alias("root"), F.concat(joined_siblings(F.col("steps")), joined_siblings(F.col("top_steps"))).alias("siblings"),
        folded(folded(hexed(ends), F.col("steps")), F.col("top_steps")).alias("folded_root"),
    )
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))
