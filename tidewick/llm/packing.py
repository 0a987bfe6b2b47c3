"""Packing documents into sequences of a fixed number of tokens by sums of squares.

Documents are cut where they are longer than a sequence and each piece below
that length is placed where the squared counts of open sequences per residual
gap become smallest. Pieces are dealt by hash to shards of about SHARD_TOKENS
tokens, which are packed in parallel, the longest piece first; what a shard
leaves in badly filled sequences is packed again with that of the other shards.

Null texts count as empty; an empty text is one piece that holds the end id
alone. Repeated rows and rows without a doc_id are documents of their own. Of an
empty table the result is empty. Columns of the input beside doc_id and text are
not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import shared_folder, written
from .tokens import Encoder

SIZE = 2048
END_ID = 0
#: Tokens that one task packs at a time: a shard of 2^20 tokens has a million pieces at most.
SHARD_TOKENS = 1 << 20
#: A sequence with a gap of at least this share is opened again in the next round.
OPEN_SHARE = 1 / 16

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut_points(n: int, size: int) -> list[int]:
    """Where the pieces of n ids begin, and n: whole pieces from the end, the first takes what is left."""
    first = n if n <= size else n % size or size
    return [0, *range(first, n, size), n] if n > first else [0, n]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids: a row for each piece of each document; ids are little-endian unsigned 32-bit integers.

    `tokenizer` is the path of a tokenizers file on the driver, which sends it to the workers.
    """
    with open(tokenizer, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = Encoder(file.value)
        for batch in batches:
            doc_ids = batch.column(0)
            for row, texts in encoder.encode(batch.column(1)):
                of, piece, start, length, ids = [], [], [], [], []
                for i, x in enumerate(texts):
                    x = np.append(x, np.uint32(END_ID)).astype("<u4")
                    at = cut_points(len(x), size)
                    for k, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        of.append(row + i), piece.append(k), start.append(a), length.append(z - a), ids.append(x[a:z].tobytes())
                columns = [doc_ids.take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def sums_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length, and the gap of each sequence.

    The longest comes first. Among the open sequences that a piece fits in, it goes where the sum of the squared counts of open sequences per gap
    becomes smallest (ties: the smallest gap left); a new sequence is opened only where none fits.
    """
    count = np.zeros(size + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    gaps: list[int] = []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        left = np.flatnonzero(count[s:size])  # gaps left in the sequences that fit
        if len(left):
            change = 2 * (count[left] - count[left + s]) + 2
            if left[0] == 0:
                change[0] = 1 - 2 * count[s]  # a full sequence counts no more
            r = int(left[np.argmin(change)])
            count[r + s] -= 1
            k = stacks[r + s].pop()
        else:
            r, k = size - s, len(gaps)
            gaps.append(size)
        where[i], offset[i], gaps[k] = k, size - gaps[k], r
        if r:
            count[r] += 1
            stacks[r].append(k)
    return where, offset, np.array(gaps, dtype=np.int64)


def one_round(rows: DataFrame, shards: int, number: int, size: int) -> DataFrame:
    """row, sequence_id, offset, gap of rows (row, length), packed in so many shards."""
    schema = "row long, length long, sequence_id long, offset long, gap long"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        where, offset, gaps = sums_of_squares(table["length"].to_numpy(), size)
        # Distinct numbers: a sequence is named by the first row that it holds, in this round.
        first = np.full(len(gaps), np.iinfo(np.int64).max)
        np.minimum.at(first, where, table["row"].to_numpy())
        return pa.table({"row": table["row"], "length": table["length"], "sequence_id": first[where], "offset": offset, "gap": gaps[where]}, schema=pa.schema([(c, pa.int64()) for c in ("row", "length", "sequence_id", "offset", "gap")]))

    shard = F.pmod(F.xxhash64("row", F.lit(number)), F.lit(shards))
    return rows.select("row", "length", shard.alias("shard")).groupBy("shard").applyInArrow(lambda t: pack(t.select(["row", "length"])), schema)


def pack(pieces: DataFrame, size: int = SIZE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """All columns of pieces (length, at most size, and any others), with sequence_id and offset.

    Each pass writes its rows to the shared folder. A piece of full length is a sequence of its own. Passes end when one shard was enough, or
    when a pass leaves more than half of its pieces in badly filled sequences, since another would not help.
    """
    spark = pieces.sparkSession
    folder = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    rows = written(pieces.withColumn("row", F.monotonically_increasing_id()), f"{folder}/pieces")
    short = rows.where(F.col("length") < size).select("row", "length")
    left, number, done = short, 0, []
    n, tokens = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    while n:
        shards = max(1, -(-tokens // shard_tokens))
        out = written(one_round(left, shards, number, size), f"{folder}/{number}")
        badly = F.col("gap") >= size * OPEN_SHARE
        m, more = out.where(badly).agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        if shards == 1 or m > n / 2:
            done.append(out)
            break
        done.append(out.where(~badly))
        left, n, tokens, number = out.where(badly).select("row", "length"), m, more, number + 1
    places = None
    for out in done:
        out = out.select("row", "sequence_id", "offset")
        places = out if places is None else places.unionByName(out)
    own = rows.where(F.col("length") >= size).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")})
    if places is not None:
        own = own.unionByName(rows.where(F.col("length") < size).join(places, "row"))
    return own.drop("row")


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian unsigned 32-bit integers), documents (doc_id and start of each piece, in order): the packed sequences themselves."""
    x = pack(token_pieces(docs, tokenizer, size), size).groupBy("sequence_id")
    x = x.agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, r: F.concat(acc, r["ids"]))
    return x.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("p", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["start"].alias("start"))).alias("documents"))
