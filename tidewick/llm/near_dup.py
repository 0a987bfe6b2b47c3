"""Near-duplicate groups by bottom-k sketches of one hash function.

Every document is the set of its distinct five-word shingles, as 63-bit hashes.

1. Equal sets become one class; its smallest doc_id stands for it.
2. Each class keeps the ``K`` smallest hashes. Two sets of similarity s share a
   binomial number of them, so fewer than ``needed`` have a chance below
   ``MISS``; classes with fewer values that another class retains drop out.
3. The others get inverted lists over their whole sets: values are ordered by how
   many classes hold them, rarest first, and a class enters the lists of its
   first values only, as many as any partner must meet at least once.
4. Round one compares each list's members with one hub, the member whose values
   are the most widely held. Round two compares members of a list that the hubs
   left apart. In both, a pair meets only where what both sets have left in the
   common order still allows the similarity, and of two sets the smaller one
   enters fewer lists than the larger. Candidates pass a union-sketch estimate,
   then exact Jaccard of the full sets decides.
5. Links give connected components by alternating stars over checkpoints.

Frequent values and hubs are keys of joins below which no aggregation needs a key
together, so adaptive execution splits them; the rows of a large class of equal
texts get their component by a broadcast of at most ``HOT_CLASSES`` classes.

Defined results: null and empty texts have no shingles and stand alone; a text of
fewer words than the shingle is one shingle; repeated rows share a class; rows of
equal doc_id with different texts are one node; a null doc_id is linked with
nothing and kept; an empty table gives no rows; extra columns are ignored. The
narrow table of sketches stays in the shared folder, as the result reads it.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .folders import forget, shared_folder, written

K = 64
MISS = 1e-12
WORDS = 5
HOT_CLASSES = 10_000


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(float(b)))


def binomial_floor(k: int, p: float, miss: float = MISS) -> int:
    """The largest t with P(Binomial(k, p) < t) <= miss."""
    total = 0.0
    for i in range(k + 1):
        total += math.comb(k, i) * p**i * (1 - p) ** (k - i)
        if total > miss:
            return i
    return k


def needed(n: Column, k: int, percent: int) -> Column:
    """Retained values that a set of n shingles shares with any partner, at least."""
    most = binomial_floor(k, percent / 100)
    whole = ceil_div(n * percent, 100)  # a partner of such a set is retained whole too
    part = F.floor(F.least(n, F.lit(k)) * most / F.lit(float(k)))
    return F.greatest(F.lit(1), F.when(n * 100 <= k * percent, whole).otherwise(part)).cast("int")


def sketch_sets(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n, k1, k2 (a 128-bit key of the set), sketch: a row for each row of docs."""

    def run(batches):
        for b in batches:
            rows = []
            for buf in tn.views(b.column("text")):
                h = tn.shingles(buf, words)
                s = np.unique(h >> np.uint64(1))
                rows.append((len(h), *key_of(h), s[:k].astype(np.int64)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True))], ["doc_id", "n", "k1", "k2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch array<long>")


def key_of(h: np.ndarray) -> tuple[int, int]:
    one, two = h.sum(dtype=np.uint64), tn.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(np.int64(one.view(np.int64))), int(np.int64(two.view(np.int64)))


FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of hashed doc_ids, of fixed size: no id of ids is missed, some others may pass."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits"))
    out = np.zeros(bits // 32, dtype=np.uint32)
    for r in words.toLocalIterator():  # bits / 32 rows at most
        out[r.word] = r.bits
    return out


def full_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, hashes (ascending) of the docs among ids; the texts are read where they lie, not shuffled."""
    may = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches):
        for b in batches:
            at = b.column("at").to_numpy()
            b = b.filter(pa.array((may.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            sets = [np.unique(tn.shingles(v, words) >> np.uint64(1)).astype(np.int64) for v in tn.views(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    return docs.where("doc_id is not null").withColumn("at", at).mapInArrow(run, "doc_id long, hashes array<long>").join(ids, "doc_id", "left_semi")


def survivors(classes: DataFrame, percent: int, k: int = K) -> DataFrame:
    """The classes of which enough retained values are retained by another."""
    values = classes.select("doc_id", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").count().where("count > 1").select("v")
    held = values.join(shared, "v").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).join(classes.select("doc_id", "n"), "doc_id")
    return held.where(F.col("m") >= needed(F.col("n"), k, percent)).select("doc_id")


def inverted_lists(sets: DataFrame, percent: int) -> DataFrame:
    """v, doc_id, n, left (values from this one on in the common order), centre: a class's entries in the lists."""
    values = sets.select("doc_id", F.size("hashes").alias("n"), F.explode("hashes").alias("v"))
    df = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = values.join(df, "v").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("order"), F.avg(F.log("df")).alias("centre"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("order"))  # values that no other class has come first
    take = (F.col("n") - ceil_div(F.col("n") * percent, 100) + 1 - F.col("alone")).cast("int")
    ranked = ranked.where(take > 0).withColumn("centre", F.col("centre") * F.size("order") / F.col("n"))
    entries = ranked.select("doc_id", "n", "centre", "alone", F.posexplode(F.slice("order", F.lit(1), take)).alias("at", "x"))
    return entries.select(F.col("x.v").alias("v"), "doc_id", "n", "centre", (F.col("n") - F.col("alone") - F.col("at")).alias("left"))


def sized(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def share(n_a: Column, n_b: Column, percent: int) -> Column:
    """Values that sets of n_a and n_b have in common, at least, if they are similar."""
    return ceil_div((n_a + n_b) * percent, 100 + percent)


def candidates(meetings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of meetings (a, b, n_a, n_b, left), a row for each list in which the two meet, that may still be similar.

    What they share is what they have met in, and at most what is left behind the last of it in the common order.
    """
    met = meetings.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min("left").alias("left"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return met.where(F.col("met") + F.col("left") - 1 >= share(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def meetings(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a list (v, doc_id, n, left, group), of different groups, that may be similar.

    The first value that two similar sets have in common leaves them ``share`` values each, so the smaller set, which lacks
    less of it, meets others only in the lists of its very first values. A pair whose first meeting is cut is not similar.
    """
    # Of two similar sets the larger is in the size band of the smaller or the next one, so bands and values are the key.
    band = F.floor(F.log("n") / math.log(1.0001 * 100 / percent)).cast("int") if percent < 100 else F.col("n")
    lists = lists.withColumn("band", band)
    one = lists.where(F.col("left") >= share(F.col("n"), F.col("n"), percent)).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    one = one.select("v", "band", F.col("doc_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "left", "group")])
    other = lists.select("v", "band", F.col("doc_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "left", "group")])
    n_a, n_b, left = F.col("n_a"), F.col("n_b"), F.least("left_a", "left_b")
    fit = (F.struct("n_a", "a") < F.struct("n_b", "b")) & (F.col("group_a") != F.col("group_b")) & sized(n_a, n_b, percent) & (left >= share(n_a, n_b, percent))
    return one.join(other, ["v", "band"]).where(fit).select("a", "b", "n_a", "n_b", left.alias("left"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, k: int = K, estimate: bool = True) -> DataFrame:
    """Of pairs (a, b), those that the union sketch (unless estimate is false) does not rule out and the full sets confirm."""
    full = lambda x: sets.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"h{x}"))
    both = pairs.join(full("a"), "a").join(full("b"), "b")
    sa, sb = F.slice("ha", 1, k), F.slice("hb", 1, k)
    union = F.slice(F.sort_array(F.array_union(sa, sb)), 1, k)
    likely = F.size(F.array_intersect(F.array_intersect(sa, sb), union)) >= F.floor(F.size(union) * binomial_floor(k, percent / 100) / F.lit(float(k)))
    inter = F.size(F.array_intersect("ha", "hb"))
    exact = inter * 100 >= (F.size("ha") + F.size("hb") - inter) * percent
    return both.where(F.when(likely, exact).otherwise(False) if estimate else exact).select("a", "b").distinct()


def two_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id that edges (a, b) reach): a row for each doc_id in an edge."""
    known = lambda x: x.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(greatest(a, b), least(a, b)))")).first()
    e = edges.where("a <> b").distinct().checkpoint()
    before = known(e)
    while True:
        w = two_ways(e)
        least = w.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = w.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").union(low.select("a", "m"))
        e = small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        now = known(e)
        if now == before:
            break
        before = now
    one = e.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
    return one.union(one.select("component_id", "component_id").distinct())


def with_components(every: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n, component of every row (doc_id, n, k1, k2), from its class (k1, k2, component, size); null where it has none.

    Classes of more rows than the share of ``HOT_CLASSES`` are as many at most; they are broadcast, the others joined.
    """
    bound = every.count() // HOT_CLASSES
    hot = F.broadcast(classes.where(F.col("size") > bound).select("k1", "k2", F.col("component").alias("hot")))
    rows = every.join(hot, ["k1", "k2"], "left")
    cold = rows.where("hot is null").join(classes.where(F.col("size") <= bound).select("k1", "k2", "component"), ["k1", "k2"], "left")
    return rows.where("hot is not null").select("doc_id", "n", F.col("hot").alias("component")).unionByName(cold.select("doc_id", "n", "component"))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a row for each row of docs (doc_id, text).

    With `exact` no class drops out by its sketch and no pair by its estimate: then inverted lists, whose bounds are certain, and full sets alone decide.
    """
    spark = docs.sparkSession
    tn.small_batches(spark)
    folder = f"{shared_folder(spark)}/near-dup-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(sketch_sets(docs, K, words), f"{folder}/every")  # tables, not caches of caches: else every plan holds all plans before it
    linkable = every.where("n > 0 and doc_id is not null")
    classes = linkable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("x")).select("x.*").persist()
    live = written(classes.select("doc_id") if exact else survivors(classes, percent), f"{folder}/work/live")
    classes.unpersist()
    sets = full_sets(docs, live, words).persist()
    lists = written(inverted_lists(sets, percent), f"{folder}/work/lists")

    hub = lists.groupBy("v").agg(F.max(F.struct("centre", "doc_id", "n", "left")).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hub = written(hub, f"{folder}/work/hub")  # else the join could not be split where a list is long
    fit = sized(F.col("n"), F.col("h.n"), percent) & (F.least("left", "h.left") >= share(F.col("n"), F.col("h.n"), percent))
    star = lists.join(hub, "v").where((F.col("doc_id") != F.col("h.doc_id")) & fit)
    star = star.select(F.col("h.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = verified(star, sets, percent, estimate=not exact).checkpoint()

    label = two_ways(near).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("doc_id"), F.least("u", "m").alias("group"))
    label = label.join(label.select(F.col("doc_id").alias("group"), F.col("group").alias("above")), "group", "left").select("doc_id", F.coalesce("above", "group").alias("group"))
    marked = written(lists.join(label, "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id")).drop("centre"), f"{folder}/work/marked")
    apart = marked.groupBy("v").agg(F.min("group").alias("g1"), F.max("group").alias("g2")).where("g1 <> g2").select("v")
    apart = written(marked.join(apart, "v"), f"{folder}/work/apart")
    links = near.union(verified(candidates(meetings(apart, percent), percent), sets, percent, estimate=not exact))

    found = components(links)
    sets.unpersist()  # what is found lies in a checkpoint
    forget(spark, f"{folder}/work")
    first = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    named = first.join(found.select(F.col("doc_id").alias("rep"), "component_id"), "rep", "left").select("k1", "k2", F.coalesce("component_id", "rep").alias("component"), "size")
    rows = with_components(every.select("doc_id", "n", "k1", "k2"), named)
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """docs without those that another document of their group stands for; repeated rows (equal doc_id and text, with words) become one."""
    near = near_duplicates(docs, percent, words).where("doc_id is not null")
    marks = near.groupBy("doc_id").agg(F.bool_or(~F.col("kept")).alias("_gone"), (F.count_if(F.col("n_shingles") > 0) > 1).alias("_again")).where("_gone or _again").persist()
    left = docs.join(marks.where("_gone"), "doc_id", "left_anti").join(marks.where("not _gone").select("doc_id", "_again"), "doc_id", "left")
    again = F.coalesce(F.col("_again") & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("_none")])
    one = left.where(again).groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("_rest")).select("doc_id", "text", "_rest.*")
    return left.where(~again).select(docs.columns).unionByName(one.select(docs.columns))
