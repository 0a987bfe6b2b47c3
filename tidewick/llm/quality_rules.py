"""Hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words are hashed into one- and two-word features of ``buckets`` classes. Two
multinomials are counted: the raw one over ALL documents, the target over ALL
trusted ones (documents marked quality = 1). A document's score is the mean over
its features of log p(target) - log p(raw), so it does not depend on length; it is
kept when the base rules pass and the score reaches ``threshold``. Texts whose doc_id
is not in a bitmap of the trusted ids, of fixed size, stay where they lie; the others
are joined with the ids, so that all trusted documents count and no others.

Defined results: null or empty text has no words, fails the base rules and
scores 0; with no trusted rows every score is 0; an empty table gives no rows;
repeated rows are each judged; extra columns are ignored. The model has two
counts for each bucket, a fixed size whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .near_dup import FILTER_BITS, id_filter

BUCKETS = 1 << 16
THRESHOLD = -0.1
PSEUDO = 10.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STARTS = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def features(h: np.ndarray, buckets: int) -> np.ndarray:
    two = tn.grams(h, 2)
    return (np.concatenate([h, two]) % np.uint64(buckets)).astype(np.int64)


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    g = tn.grams(h, 3)
    if len(g) < 2:
        return 0
    _, back, n = np.unique(g, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[back] > 1)
    mark = np.zeros(len(h), dtype=bool)
    for j in range(3):
        mark[at + j] = True
    return int(mark.sum())


def repeated_lines(buf: np.ndarray) -> int:
    """Lines that hold a word and equal an earlier line."""
    raw = buf.tobytes()
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def base_rules(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    n = len(starts)
    chars = int((STARTS[buf] & tn.SPACE_WORDS[buf]).sum())
    repeat = repeated_words(h)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return n, chars, int(SYMBOLS[buf].sum()), repeated_lines(buf), repeat, failed


def count_features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): how often each feature stands in the texts of docs."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for buf in tn.views(b.column("text")):
                ids, n = np.unique(features(tn.hashed_words(buf, fold=tn.ASIS), buckets), return_counts=True)
                total[ids] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def trusted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) that are among ids."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    may = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches):
        for b in batches:
            at = b.column("at").to_numpy()
            held = b.filter(pa.array((may.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([held.column("doc_id"), held.column("text")], ["doc_id", "text"])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").withColumn("at", at)
    return rows.mapInArrow(run, "doc_id long, text string").join(ids.hint("merge"), "doc_id", "left_semi")  # one way at every size


def collected(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets)
    for row in counts.toLocalIterator():  # at most `buckets` rows
        out[row.bucket] = row.n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, pseudo: float = PSEUDO) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket. Both counts, the raw one scaled to the target's total, get `pseudo` more, so what is rare counts little either way."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log(target + pseudo) - np.log(raw * (target.sum() / raw.sum()) + pseudo)


def apply_quality_rules(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text): the base counts, base_failed, score, kept."""
    spark = docs.sparkSession
    tn.small_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    trusted = trusted_texts(docs, trusted_ids)
    weights = log_ratios(collected(count_features(trusted, buckets), buckets), collected(count_features(docs, buckets), buckets))
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            rows = []
            for buf in tn.views(b.column("text")):
                starts, ends = tn.spans(buf)
                h = tn.word_hashes(buf, starts, ends, tn.ASIS)
                base = base_rules(buf, starts, ends, h)
                score = float(w[features(h, buckets)].mean()) if len(h) else 0.0
                rows.append((*base, score, not base[-1] and score >= threshold))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)
