"""Grouping of spelling variants: words that are one edit apart, and the form that each is a variant of.

Words are counted over all texts. Positional grams tile every word, three to eight, each of two to four letters in words of up to 32. One edit
touches one of them, so of the m grams of the longer word the other has m - 1: as they stand before the edit, and at most one place further left behind it.
This is the overlap bound. The index has a posting list for each set of m - 1 grams with their places and the
length of the longer word; words enter it once by their own length and once by the next. A sort-merge join runs through the lists, and pairs that meet are
verified. So no list holds words that differ in more than one gram, whatever the share of words that have a frequent gram.

A null text has no words; a null doc_id counts as an empty one. Repeated rows count each. Very long texts are read in blocks. Of an empty table the result
is empty. Columns of the input beside doc_id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import shared_folder, written
from .textnum import LOWER

#: One run in RATE loses a letter.
RATE = 199
MIN_LETTERS = 6
MIN_COUNT = 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: Grams of a word of 24 letters and more; they grow longer with it.
MOST_GRAMS = 8
BLOCK = 8 << 20
LONG_WORD = 64


def crc_steps() -> np.ndarray:
    """The 256 steps of the CRC-32 register, one for each byte (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


STEPS = crc_steps()
ASCII_LETTERS = np.zeros(256, dtype=bool)
ASCII_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def letters(b: np.ndarray) -> np.ndarray:
    """True on the bytes of A-Z, a-z and U+00C0..U+00FF, which are 0xC3 with one byte after it."""
    c3 = b == 0xC3
    out = ASCII_LETTERS[b] | c3
    out[1:] |= c3[:-1]
    return out


def run_hashes(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, begun in the state that the bytes before it leave."""
    out = np.empty(len(starts), dtype=np.uint32)
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        if n > LONG_WORD:
            for i in which:
                out[i] = zlib.crc32(low[starts[i] : starts[i] + n].tobytes(), int(state[i]) ^ 0xFFFFFFFF)
            continue
        crc, at = state[which], starts[which]
        for j in range(int(n)):
            crc = STEPS[(crc ^ low[at + j]) & 0xFF] ^ (crc >> np.uint32(8))
        out[which] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def block_words(data: np.ndarray, at: np.ndarray, doc_ids: list, rate: int, least: int) -> pa.Array:
    """The words of the texts data[at[i]:at[i + 1]] with at least so many letters, as they stand after the deletions."""
    m = letters(data)
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[at] = True
    before, after = np.concatenate([[False], m[:-1]]), np.append(m[1:], False)
    starts = np.flatnonzero(m & (~before | begin[:-1]))
    ends = np.flatnonzero(m & (~after | begin[1:])) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    marks = np.concatenate([[0], np.cumsum(data == 0xC3)])
    n = ends - starts - (marks[ends] - marks[starts])
    starts, ends, n = starts[n >= least], ends[n >= least], n[n >= least]
    if not len(starts):
        return pa.array([], pa.string())
    low = LOWER[data]
    state = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) ^ 0xFFFFFFFF for d in doc_ids], dtype=np.uint32)
    h = run_hashes(low, starts, ends - starts, state[np.searchsorted(at, starts, "right") - 1])
    hit = h % rate == 0
    cut = []
    for s, e, k, c in zip(starts[hit], ends[hit], n[hit], h[hit], strict=True):
        if k > least:
            w = low[s:e].tobytes().decode()
            d = int(c) % int(k)
            cut.append(w[:d] + w[d + 1 :])
    starts, sizes = starts[~hit], (ends - starts)[~hit]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    text = low[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    whole = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text))
    return pa.concat_arrays([whole, pa.array(cut, pa.large_string())])


def blocks(texts: pa.Array):
    """Bytes, text bounds and first row of blocks of texts; a text longer than a block is cut where a byte is no letter."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        a, z = at[i], at[j]
        while z - a > BLOCK and j == i + 1:
            e = a + BLOCK
            while e < z and letters(buf[e - 1 : e + 1])[-1]:
                e += 1
            yield buf[a:e], np.array([0, e - a]), i, j
            a = e
        yield buf[a:z], (at[i : j + 1] - a).clip(0), i, j
        i = j


def count_words(docs: DataFrame, rate: int = RATE, least: int = MIN_LETTERS) -> DataFrame:
    """word, n: how often each word of at least so many letters stands in the texts, once one run in `rate` has lost a letter."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for data, at, i, j in blocks(batch.column(1)):
                c = pc.value_counts(block_words(data, at, ids[i:j], rate, least))
                yield pa.RecordBatch.from_arrays([c.field("values").cast(pa.string()), c.field("counts")], ["word", "n"])

    words = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def postings(words: DataFrame, longer: int) -> DataFrame:
    """key, word, n: for each gram of a word one letter longer (or as long), the other grams, where they stand and that length."""
    size = F.char_length("word") + longer
    m = F.least(F.greatest(F.lit(3), F.floor(size / 3)), F.lit(MOST_GRAMS)).cast("int")
    x = words.withColumns({"size": size, "m": m}).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    left = F.floor(F.col("c") * F.col("size") / F.col("m")).cast("int")
    right = F.floor((F.col("c") + 1) * F.col("size") / F.col("m")).cast("int") - longer  # as many letters less stand before it
    key = F.xxhash64("size", "c", F.substring("word", F.lit(1), left), F.substring("word", right + 1, F.col("size")))
    return x.select(key.alias("key"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: each pair of words (word, n) that differ by one inserted, deleted or replaced letter, once."""
    own = postings(words, 0).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = postings(words, 0).withColumn("short", F.lit(False)).unionByName(postings(words, 1).withColumn("short", F.lit(True)))
    other = other.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "short")
    met = own.join(other.hint("merge"), "key").where((F.col("short") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def roots(forms: DataFrame, longest: int, path: str) -> DataFrame:
    """word, root: where the forms (word, form) of each word end. Every round doubles the steps taken; no way has more than `longest` steps."""
    x, taken = forms.select("word", F.col("form").alias("root")), 1
    while taken < longest:
        on = x.select(F.col("word").alias("root"), F.col("root").alias("next"))
        x = written(x.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"{path}/{taken}")
        taken *= 2
    return x


def spelling_variants(docs: DataFrame, rate: int = RATE, least: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word with at least min_count places.

    A word's form is the most frequent of its near words (ties: the first in the order of code points), if that has at least ratio times its places.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/spelling-{uuid.uuid4().hex}"
    words = written(count_words(docs, rate, least).where(F.col("n") >= min_count), f"{folder}/words")
    near = written(near_words(words), f"{folder}/near")
    both = near.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("rank"), F.col("b").alias("near")).alias("x"))
    both = both.unionByName(near.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("rank"), F.col("a").alias("near")).alias("x")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("x").alias("best"))
    x = words.join(best, "word", "left")
    enough = -F.col("best.rank") >= ratio * F.col("n")
    x = x.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.rank")).alias("form_n"))
    x = written(x, f"{folder}/forms")
    most = x.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    longest = 0
    while ratio > 1 and min_count * ratio ** (longest + 1) <= most:  # counts grow by the ratio with each step
        longest += 1
    ends = roots(x.where("form is not null"), longest, f"{folder}/roots")
    return x.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
