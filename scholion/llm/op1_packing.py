"""Best-fit packing with certified bounds.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces are dealt to
partitions; each packs its own by best-fit decreasing and computes lower bounds from dual
feasible functions.  A partition whose bin count meets its bound is certified optimal and
final.  The others close their full and nearly full bins and release the documents of the
bins with gaps; released documents are dealt anew to as many partitions as they fill and
packed again, round by round, until nothing is released, one partition held them all, or a
round saves no bin.  No partition grows beyond its size in the first round.

Each round is one shuffle of released rows (ids and lengths, never texts).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import documents, give_back, materialise, ship
from scholion.llm.tokens import coder

CAPACITY = 2048
#: Rows whose texts are Python strings at once.
ROWS = 500
#: Pieces that one partition packs, about.
PIECES = 40_000
#: Bins with a larger share of free tokens are released.
GAP = 1 / 64
END_ID = 0

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = "key long, doc_id long, piece int, length long, bin long, offset long, open boolean, bins long, bound long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each text, then END_ID, cut at every
    ``capacity`` ids.  A null or empty text is the single END_ID."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = coder(tokenizer).encode
        step = 4 * capacity
        kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows, out = batch.slice(first, ROWS), []
                for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                    ids = ids_of(text or "") + END_ID.to_bytes(4, "little")
                    for piece, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
                rows = out = None
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best bound over two families of dual feasible
    functions (large items against small ones; rounding to k-ths)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    below = np.concatenate(([0], np.cumsum(count * size)))  # of sizes under e
    n_below = np.concatenate(([0], np.cumsum(count)))
    e = np.arange(1, capacity // 2 + 1)
    large = n_below[-1] - n_below[capacity - e + 1]
    middle = below[capacity - e + 1] - below[e]
    best = max(best, int((-(-(large * capacity + middle) // capacity)).max()))
    for k in range(1, 101):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the free tokens of each bin.

    Free space is an integer of at most ``capacity``, so bins wait in one stack for each
    value, and a bit set finds the least value that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, free = 0, []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = bits >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                bits ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(0)
        bins[i], offsets[i] = b, capacity - room
        free[b] = left = room - n
        if left:
            stacks[left].append(b)
            bits |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def _pack(capacity: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        released = np.zeros(len(free), bool) if last or len(free) <= bound else free > capacity * GAP
        return rows.assign(bin=bins, offset=offsets, open=released[bins], bins=len(free), bound=bound)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES) -> DataFrame:
    """Add sequence_id and offset to rows of (doc_id, piece, length), and the certificate of the
    partition that packed them last: its ``bins``, and the ``bound`` below which no packing of
    its pieces gets.  Where both are equal the partition is optimal.

    Items must not be longer than ``capacity``.  Equal rows are packed as separate items, items
    of equal length in order of doc_id, then piece.
    """
    n = pieces.count()
    groups = max(1, -(-n // per_partition))
    spread = F.xxhash64("doc_id", "piece", "start")
    rows = pieces.select(F.pmod(spread, F.lit(groups)).alias("key"), "doc_id", "piece", "start", "length", "ids_crc32")
    schema = PACKED_SCHEMA.replace("length long", "start long, length long, ids_crc32 long")
    done, before, turn = None, None, 0
    while True:
        packed = materialise(rows.groupBy("key").applyInPandas(_pack(capacity, groups == 1), schema), f"op1-round{turn}")
        # each bin has one piece at its start
        bins, n_open, open_bins = packed.agg(F.count_if(F.expr("offset = 0")), F.count_if("open"), F.count_if(F.expr("open AND offset = 0"))).first()
        # a sequence is named by round, partition and bin
        name = F.lit(turn << 48) + F.shiftleft(F.col("key"), 24) + F.col("bin")
        named = packed.select("open", "doc_id", "piece", "start", "length", "ids_crc32", name.alias("sequence_id"), "offset", "bins", "bound")
        if before is not None and bins >= before[1]:
            return done.unionByName(before[0])  # nothing is saved: the bins that were released stand
        final = named.where("NOT open").drop("open")
        done = final if done is None else done.unionByName(final)
        if not n_open:
            return done
        before = named.where("open").drop("open"), open_bins
        groups = -(-n_open // per_partition)
        turn += 1
        spread = F.xxhash64(F.lit(turn), "key", "bin", "offset")
        rows = packed.where("open").select(F.pmod(spread, F.lit(groups)).alias("key"), "doc_id", "piece", "start", "length", "ids_crc32")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound) of every piece
    of every row: null texts are empty, null and repeated ids are packed like any other row, and an
    empty table gives no row."""
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return pack(materialise(pieces_of(docs, tokenizer, capacity, id_col, text_col), "op1-pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
