"""Vectorised word hashing over UTF-8 bytes, for use inside Arrow tasks.

All separators used by the operators are ASCII, so words can be found on the
encoded bytes without decoding. Hashes are 64-bit. Texts longer than BLOCK
bytes are hashed in word-aligned blocks, so memory beside the text stays flat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20


def _table(separators) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: True where a byte belongs to a word.
SPACE_WORDS = _table([0x20, *range(0x09, 0x0E)])
ALNUM_WORDS = _table([b for b in range(0x80) if not chr(b).isalnum()])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ASIS = np.arange(256, dtype=np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C55)
_P = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def views(column) -> list[np.ndarray]:
    """One byte view for each row of a string column; null gives an empty one. No copies."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for a in parts:
        if not len(a):
            continue
        wide = pa.types.is_large_string(a.type)
        if not wide and not pa.types.is_string(a.type):
            a = a.cast(pa.string())
        _, offsets, data = a.buffers()
        at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1]
        buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        valid = a.is_valid().to_numpy(zero_copy_only=False)
        out += [buf[at[i] : at[i + 1]] if valid[i] else buf[:0] for i in range(len(a))]
    return out


def spans(buf: np.ndarray, words: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of word bytes."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(words[buf].view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK)))
        s, n = starts[i:j], ends[i:j] - starts[i:j]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        letters = fold[buf[np.repeat(s, n) + within]].astype(np.uint64) + np.uint64(1)
        out[i:j] = mix(np.add.reduceat(letters * powers(int(n.max()))[within], first) + n.astype(np.uint64) * _P)
        i = j
    return out


def hashed_words(buf: np.ndarray, words: np.ndarray = SPACE_WORDS, fold: np.ndarray = LOWER) -> np.ndarray:
    return word_hashes(buf, *spans(buf, words), fold)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows; none if there are fewer words."""
    if len(h) < n:
        return h[:0]
    acc = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        acc = acc * _P + h[j : len(h) - n + 1 + j]
    return mix(acc)


def shingles(buf: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle; no words, none."""
    h = hashed_words(buf)
    if not len(h):
        return h
    return np.unique(grams(h, n) if len(h) >= n else grams(h, len(h)))


def small_batches(spark, rows: int = 512) -> None:
    """Keeps the Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
