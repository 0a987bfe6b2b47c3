"""Benchmark decontamination: rare seeds find passages, local alignment scores them.

Words are lower-cased runs of letters and digits. Benchmark items are taken in
blocks of ``BLOCK_WORDS`` words (100,000 items of 40), so that what tasks share has
a fixed bound: flat arrays of under 30 bytes a word. For a block, the first pass counts in how many documents each two-word gram of the
items stands, over ALL documents. Each item keeps its rarest grams as seeds. The
second pass finds the seeds in the documents and aligns the item with the words
around them (Smith-Waterman: match 1, mismatch and gap -1). A document is
contaminated by an item if the best score reaches ``THRESHOLD`` of the item's
length.

No such document is missed. An alignment of score s has s more matches than
edits, and the edits cut the matches into at most one run more than there are
edits, so at least s - 1 grams of the item stand in it. Of an item with g grams
any g - s + 2 then hold one of them: so many are its seeds, and where fewer than
s - 1 grams are shared nothing is aligned.

Defined results: null and empty texts and items meet nothing; items of one or two
words must stand whole, and of others two adjacent words at least; repeated rows are each judged; an empty benchmark
contaminates nothing; extra columns pass through ``clean_documents``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

SEED_WORDS = 2
THRESHOLD = 0.5
BLOCK_WORDS = 4_000_000


def words(buf: np.ndarray) -> np.ndarray:
    low = buf.tobytes().decode("utf-8", "replace").lower().encode()
    return tn.hashed_words(np.frombuffer(low, dtype=np.uint8), tn.ALNUM_WORDS, tn.ASIS)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The best local score and the place in the window where it ends."""
    steps = np.arange(len(window) + 1)
    above = np.zeros(len(window) + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        row = np.zeros(len(window) + 1, dtype=np.int64)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(window == w, 1, -1), above[1:] - 1))
        row = np.maximum.accumulate(row + steps) - steps  # gaps along the window
        if (m := int(row.max())) > best:
            best, end = m, int(row.argmax())
        above = row
    return best, end


class Ragged:
    """Arrays of different lengths in one."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.at = flat, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.at[k] : self.at[k + 1]]

    def rows(self, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows ks, one behind the other, the places in flat, and which of ks each comes from."""
        n = self.at[ks + 1] - self.at[ks]
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(ks)), n)
        return self.at[ks][of] + np.arange(len(of)) - first[of], of


def joined(parts: list[np.ndarray], dtype) -> Ragged:
    return Ragged(np.concatenate(parts) if parts else np.zeros(0, dtype), np.array([len(x) for x in parts], dtype=np.int64))


class Block:
    """A block of items with the hashes of their words and grams."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        items = [(i, w) for i, w in items if len(w)]
        self.ids = [i for i, _ in items]
        self.words = joined([w for _, w in items], np.uint64)
        self.all_grams = joined([tn.grams(w, min(SEED_WORDS, len(w))) for _, w in items], np.uint64)
        self.sizes = sorted({min(SEED_WORDS, len(w)) for _, w in items})
        self.grams = np.unique(self.all_grams.flat)

    def counts(self, w: np.ndarray) -> np.ndarray:
        """Which of the grams stand in a document."""
        hit = [np.zeros(0, np.int64)]
        for n in self.sizes:
            hit.append(found(self.grams, tn.grams(w, n))[1])
        return np.unique(np.concatenate(hit))

    def choose(self, df: np.ndarray, threshold: float) -> Block:
        """Fixes the seeds: of each item the rarest grams, as many as an alignment that reaches the threshold can't all avoid."""
        g = self.all_grams
        size, n = np.diff(self.words.at), np.diff(g.at)
        score = np.ceil(threshold * size - 1e-9).astype(np.int64)
        self.need, self.slack = np.maximum(1, score - 1), size - score + 2
        item = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(item)) - g.at[item]
        order = np.lexsort((place, df[np.searchsorted(self.grams, g.flat)], item))  # of each item the rarest first
        seed = order[place < np.maximum(0, n - self.need + 1)[item]]
        seed = seed[np.lexsort((place[seed], item[seed], g.flat[seed]))]
        self.keys, held = np.unique(g.flat[seed], return_counts=True)
        self.seeds = Ragged(np.stack([item[seed], place[seed]], 1).astype(np.int32), held)
        own = np.lexsort((g.flat, item))
        new = np.ones(len(own), dtype=bool)
        new[1:] = (g.flat[own][1:] != g.flat[own][:-1]) | (item[own][1:] != item[own][:-1])
        first = np.flatnonzero(new)
        self.own = Ragged(g.flat[own[first]], np.bincount(item[own[first]], minlength=len(n)))
        self.times = np.diff(np.append(first, len(own))).astype(np.int32)
        del self.all_grams, self.grams
        return self

    def enough(self, k: int, g: np.ndarray) -> bool:
        """Whether sorted grams share as many with an item as the threshold takes."""
        own, times = self.own[k], self.times[self.own.at[k] : self.own.at[k + 1]]
        here = np.searchsorted(g, own, "right") - np.searchsorted(g, own)
        return int(np.minimum(here, times).sum()) >= self.need[k]

    def search(self, w: np.ndarray) -> list[tuple[int, float, int]]:
        """(item_id, score, end word) of the items found in a document."""
        windows = defaultdict(list)
        grams = {}
        for n in self.sizes:
            grams[n] = g = tn.grams(w, n)
            where, key = found(self.keys, g)
            if not len(where):
                continue
            whole, keys = np.sort(g), np.unique(key)
            seeds = self.seeds.flat[self.seeds.rows(keys)[0]]
            may = np.array([k for k in np.unique(seeds[:, 0]).tolist() if self.enough(k, whole)], dtype=np.int64)
            if not len(may):
                continue
            at, of = self.seeds.rows(keys)
            take = np.isin(self.seeds.flat[at][:, 0], may)
            meant = defaultdict(list)  # of each key of the items that may be there, (item, place)
            for i, (k, q) in zip(of[take].tolist(), self.seeds.flat[at[take]].tolist(), strict=True):
                meant[int(keys[i])].append((k, q))
            for p, i in zip(where.tolist(), key.tolist(), strict=True):
                for k, q in meant.get(i, ()):
                    windows[k].append((p - q - int(self.slack[k]), p - q + len(self.words[k]) + int(self.slack[k])))
        out = []
        for k, spans in windows.items():
            item = self.words[k]
            spans.sort()
            merged = [list(spans[0])]
            for lo, hi in spans[1:]:
                if lo <= merged[-1][1] and hi - merged[-1][0] <= 8 * len(item) + 64:
                    merged[-1][1] = max(hi, merged[-1][1])
                elif lo > merged[-1][0]:
                    merged.append([lo, hi])
            best, end = 0, 0
            for lo, hi in merged:
                lo = max(lo, 0)
                if not self.enough(k, np.sort(grams[min(SEED_WORDS, len(item))][lo : hi - 1])):
                    continue
                score, e = align(item, w[lo:hi])
                if score > best:
                    best, end = score, lo + e
                if best == len(item):
                    break
            if best:
                out.append((self.ids[k], best / len(item), end))
        return out


def found(keys: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of those of g that are among sorted keys, and which key each is."""
    if not len(keys) or not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
    where = np.flatnonzero(keys[at] == g)
    return where, at[where]


def blocks_of(benchmark: DataFrame, docs: DataFrame, threshold: float):
    """The benchmark in blocks whose seeds are chosen by counts over all docs."""
    spark = docs.sparkSession
    held: list[tuple[int, np.ndarray]] = []
    taken = 0

    def ready():
        block = Block(held)

        def run(batches):
            total = np.zeros(len(block.grams), dtype=np.int64)
            for b in batches:
                for v in tn.views(b.column("text")):
                    total[block.counts(words(v))] += 1
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

        df = np.zeros(len(block.grams), dtype=np.int64)
        for r in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
            df[r.gram] = r.n  # a row for each gram of the block
        return spark.sparkContext.broadcast(block.choose(df, threshold))

    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        held.append((row.item_id, words(np.frombuffer((row.text or "").encode(), dtype=np.uint8))))
        taken += len(held[-1][1])
        if taken >= BLOCK_WORDS:
            yield ready()
            held, taken = [], 0
    if held:
        yield ready()


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, end_word: a row for each document and item that it holds."""
    tn.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
    for block in blocks_of(benchmark, docs, threshold):

        def run(batches, block=block):
            for b in batches:
                rows = [(d, *hit) for d, v in zip(b.column("doc_id").to_pylist(), tn.views(b.column("text")), strict=True) for hit in block.value.search(words(v)) if hit[1] >= threshold]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.int64()], strict=True)], ["doc_id", "item_id", "score", "end_word"])

        out = out.unionByName(docs.mapInArrow(run, "doc_id long, item_id long, score double, end_word long"))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    tn.small_batches(docs.sparkSession)
    out = docs
    for block in blocks_of(benchmark, docs, threshold):

        def run(batches, block=block):
            for b in batches:
                mask = [not any(s >= threshold for _, s, _ in block.value.search(words(v))) for v in tn.views(b.column("text"))]
                yield b.filter(pa.array(mask, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
