"""Merkle fixity audit of two replicas of archived records.

A record is one WARC-style response: header lines and the page. Its leaf has the
sha256 of its bytes and their number. A node of the next level covers ``FAN_OUT``
consecutive ranges of record ids, in order; it hashes, for each child, the range of
offsets that the child takes within the node and the child's hash, and is as long
as they are together. The archive's root is level ``LEVELS``. The audit compares
roots and then descends, level by level, only below nodes that differ, until it has
the records that differ. Ranges count from the start of their node, so that a
record of another length changes the nodes above it and no others. Offsets reported
are those of the record within its file (``FILE_RECORDS`` ids each).

Defined results: a null page is an empty body; a record with a null id is placed by
its own hash, below all others, in no file and at no offset, and reported with a
null id; records that only one replica has are reported with a null hash on the
other side; equal records of one id are one leaf with their number, so that no node
grows with repeated rows, and different ones are told apart by their order of
hash; equal replicas give no rows, and so do two empty tables. Extra columns are
ignored. The top level groups at most FAN_OUT children only while ids stay below
FAN_OUT ** LEVELS; above that more roots stand side by side and are compared as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import shared_folder

FAN_OUT = 64
LEVELS = 4
FILE_RECORDS = 4096


def warc_record(url: Column, body: Column) -> Column:
    """The text of a record."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """place (the id, or a negative number by hash), record, copy (among different records of an id), n (equal rows), file, begin, size, hash."""
    text = warc_record(F.col("url").cast("string"), F.col("html").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("record"), F.sha2(text.cast("binary"), 256).alias("hash"), F.octet_length(text).cast("long").alias("size"))
    by_hash = -F.lit(1).cast("long") - F.conv(F.substring("hash", 1, 15), 16, 10).cast("long")
    rows = rows.groupBy("record", "hash", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.coalesce("record", by_hash))
    rows = rows.withColumn("file", F.floor(F.col("record") / FILE_RECORDS).cast("long"))
    of_file = F.coalesce(F.col("file"), node_of("place", FILE_RECORDS))  # without an id there is no file, and no large group either
    before = Window.partitionBy(of_file).orderBy("record", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.when(F.col("record").isNotNull(), F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0))))
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(of_file, "place").orderBy("hash")))


def hashed(children: Column) -> Column:
    """sha256 over ordered children (order, n, size, hash), each with its range of offsets from the start of the node, and their length."""
    span = lambda x: x["n"] * x["size"]
    step = lambda acc, x: F.struct(
        (acc["at"] + span(x)).alias("at"), F.concat(acc["text"], acc["at"].cast("string"), F.lit("+"), span(x).cast("string"), F.lit(":"), x["n"].cast("string"), F.lit("*"), x["hash"], F.lit(",")).alias("text")
    )
    done = lambda acc: F.struct(acc["at"].alias("size"), F.sha2(acc["text"], 256).alias("hash"))
    return F.aggregate(F.array_sort(children), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")), step, done)


def tree(rows: DataFrame, levels: int = LEVELS, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Level 1 to levels, each (side, node, size, hash); level 1 hashes records in order, the others the nodes below. Each is written, so that none is made twice."""
    below = rows.select("side", node_of("place", fan_out).alias("node"), F.struct("place", "copy", "n", "size", "hash").alias("item"))
    out = []
    for _ in range(levels):
        level = below.groupBy("side", "node").agg(hashed(F.collect_list("item")).alias("x")).select("side", "node", "x.size", "x.hash").checkpoint()
        out.append(level)
        below = level.select("side", node_of("node", fan_out).alias("node"), F.struct(F.col("node").alias("place"), F.lit(1).alias("n"), "size", "hash").alias("item"))
    return out


def node_of(c: str, fan_out: int) -> Column:
    return F.expr(f"({c} - pmod({c}, {fan_out})) div {fan_out}")


def differing(level: DataFrame) -> DataFrame:
    """The nodes that one side lacks or that the sides hash differently."""
    both = level.groupBy("node").agg(F.count("hash").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    return both.where("n < 2 or lo <> hi").select("node")


def audit(primary: DataFrame, replica: DataFrame, levels: int = LEVELS, fan_out: int = FAN_OUT) -> DataFrame:
    """record, copy, file, begin, size and the hash and number of each side: the records that differ; places are the primary's where it has the record."""
    shared_folder(primary.sparkSession)
    rows = leaves(primary).withColumn("side", F.lit(0)).unionByName(leaves(replica).withColumn("side", F.lit(1))).checkpoint()
    trees = tree(rows, levels, fan_out)
    bad = differing(trees[-1])
    for level in trees[-2::-1]:
        parents = bad.select(F.col("node").alias("parent"))
        bad = differing(level.withColumn("parent", node_of("node", fan_out)).join(parents, "parent", "left_semi"))
    found = rows.withColumn("node", node_of("place", fan_out)).join(bad, "node", "left_semi")
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    at = F.min(F.struct("side", "record", "file", "begin", "size"))
    sides = [side(k, c).alias(f"{name}_{c}") for k, name in ((0, "primary"), (1, "replica")) for c in ("hash", "n")]
    both = found.groupBy("place", "copy").agg(at.alias("at"), *sides)
    same = F.col("primary_hash").eqNullSafe(F.col("replica_hash")) & F.col("primary_n").eqNullSafe(F.col("replica_n"))
    return both.where(~same).select("at.record", "copy", "at.file", "at.begin", "at.size", "primary_hash", "replica_hash", "primary_n", "replica_n")
