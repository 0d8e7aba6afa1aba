"""Ranked lexical search by the Best Position Algorithm.

Documents are indexed in shards: for each query term the places and counts of the documents
that hold it.  Once the counts of the whole corpus are known, a shard sorts each list by impact,
the part of a document's score that the term gives.  A query reads its lists from the top;
each document met is looked up in all other lists at once (direct access), which gives its whole
score and marks its places there.  The best position of a list is the end of its gapless
stretch of marked places: no unmet document scores more than the impacts that follow the best
positions, added up.  Reading goes on at the best positions, not at the places read last, and
stops when that sum is strictly below the score of the k-th best document.

A task works on one shard after another and takes its k-th best score along.  Each task sends
at most k rows a query, which are ranked in two levels.  Queries are taken in blocks of a
bounded number of terms, each against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm.common import documents, give_back, keep_only, materialise, ship

#: Documents that a query returns.
BEST = 50
#: Postings of a shard, and (query, term) pairs of a block of queries.
POSTINGS, PAIRS = 1 << 20, 200_000
#: Rows whose texts are Python strings at once.
ROWS = 500
#: Places of each list that a first reading takes; each further one takes twice as many.
STEP = 16
#: Parts of a query's rows that are cut to k before they meet.
PARTS = 32

#: Letters A-Z become lower case, digits and all bytes from 0x80 on stay, the rest are blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


INDEX = "doc_ids array<long>, sizes array<long>, lists array<struct<term:int,slots:array<int>,tfs:array<int>>>"


def _indexed(number: dict[bytes, int]):
    """Shards of documents: the lists of the terms that ``number`` has."""

    def shard(ids: list, sizes: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        found, tfs = np.unique(np.concatenate(keys), return_counts=True)  # by term, then slot
        terms, slots = found >> 32, found & 0xFFFFFFFF
        firsts = np.flatnonzero(np.diff(terms, prepend=-1))
        ends = np.concatenate((firsts, [len(terms)])).astype(np.int32)
        nested = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (slots, tfs)]
        lists = pa.StructArray.from_arrays([pa.array(terms[firsts].astype(np.int32)), *nested], ["term", "slots", "tfs"])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists)],
            names=["doc_ids", "sizes", "lists"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("op11")
        ids, sizes, keys, held = [], [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"], strict=True):
                    terms = terms_of(text.as_py())
                    if not terms:
                        continue
                    key = np.fromiter(map(number.get, terms, repeat(-1)), np.int64, len(terms))
                    key = (key[key >= 0] << 32) | len(ids)
                    keys.append(key)
                    ids.append(doc_id)
                    sizes.append(len(terms))
                    held += len(key)
                    if held >= POSTINGS:
                        yield shard(ids, sizes, keys)
                        ids, sizes, keys, held = [], [], [], 0
                rows = text = terms = None
        if ids:
            yield shard(ids, sizes, keys)
        give_back()

    return run


class Shard:
    """The impact lists of some documents, and each document's places in them."""

    def __init__(self, doc_ids: list, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, slots: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.doc_ids = doc_ids
        if 50 * n_docs * int(sizes.max(initial=0)) < 1 << 62:
            m = 50 + 50 * n_docs * sizes // n_terms
        else:
            m = np.array([50 + 50 * n_docs * n // n_terms for n in sizes.tolist()], np.int64)
        tf = tfs.astype(np.int64)
        lists = np.repeat(np.arange(len(terms)), counts)
        impact = weights[terms][lists] * (1_000_000_000 * tf // (1000 * tf + 20 * m[slots]))
        order = np.lexsort((slots, -impact, lists))
        self.lists, self.slots, self.impact = lists[order], slots[order], impact[order]
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.row_of = dict(zip(terms.tolist(), range(len(terms)), strict=True))
        self.of_slot = np.argsort(self.slots, kind="stable")
        self.slot_starts = np.concatenate(([0], np.cumsum(np.bincount(self.slots, minlength=len(sizes)))))
        self.marked = np.zeros(len(lists), bool)
        self.asked = np.zeros(len(terms), bool)
        self.read = 0

    @staticmethod
    def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all ranges, and the range of each."""
        n = stops - starts
        which = np.repeat(np.arange(len(n)), n)
        return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + starts[which], which

    def _best_positions(self, at: np.ndarray, ends: np.ndarray) -> None:
        """Move each place on to the first that is not marked, or to its list's end."""
        for k, (place, end) in enumerate(zip(at.tolist(), ends.tolist(), strict=True)):
            step = 64
            while place < end:
                free = np.flatnonzero(~self.marked[place : min(place + step, end)])
                if len(free):
                    place += int(free[0])
                    break
                place, step = min(place + step, end), step * 2
            at[k] = place

    def search(self, terms: list[int], k: int, best: list[tuple[int, float, int | None]]) -> list:
        """The k best of ``best`` and this shard: (-score, id to sort by, id)."""
        rows = np.array([r for r in map(self.row_of.get, terms) if r is not None], np.int64)
        if not len(rows):
            return best
        at, ends = self.starts[rows].copy(), self.starts[rows + 1]
        self.asked[rows] = True
        met, touched = np.zeros(len(self.slot_starts) - 1, bool), []
        step = STEP
        while True:
            live = at < ends
            bound = int(self.impact[at[live]].sum())
            if bound == 0 or len(best) == k and bound < -best[-1][0]:
                break
            places, _ = self._ranges(at[live], np.minimum(at[live] + step, ends[live]))
            slots = np.unique(self.slots[places])
            slots = slots[~met[slots]]
            met[slots] = True
            where, which = self._ranges(self.slot_starts[slots], self.slot_starts[slots + 1])
            where = self.of_slot[where]
            wanted = self.asked[self.lists[where]]
            where, which = where[wanted], which[wanted]
            scores = np.zeros(len(slots), np.int64)
            np.add.at(scores, which, self.impact[where])
            self.marked[where] = True
            touched.append(where)
            self.read += len(slots)
            floor = -best[-1][0] if len(best) == k else 1
            good = np.flatnonzero(scores >= floor)
            if len(good) > k:  # keep ties with the k-th
                good = good[scores[good] >= np.partition(scores[good], -k)[-k]]
            found = [(-int(scores[g]), math.inf if (d := self.doc_ids[slots[g]]) is None else d, d) for g in good]
            best = sorted([*best, *found], key=lambda r: r[:2])[:k]
            self._best_positions(at, ends)
            step *= 2
        self.asked[rows] = False
        for where in touched:
            self.marked[where] = False
        return best


def _searched(items: list[tuple[int, list[int]]], weights: np.ndarray, k: int, n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("op11")
        best: list[list] = [[] for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                lists = batch["lists"].slice(row, 1).flatten()
                terms, slots, tfs = lists.flatten()
                shard = Shard(
                    batch["doc_ids"][row].as_py(), np.array(batch["sizes"].slice(row, 1).flatten(), np.int64), np.array(terms), np.diff(np.array(slots.offsets)),
                    np.array(slots.flatten()), np.array(tfs.flatten()), weights, n_docs, n_terms,
                )
                best = [shard.search(terms, k, b) for (_, terms), b in zip(items, best, strict=True)]
                lists = terms = slots = tfs = shard = None
        out = [(item, r[2], -r[0]) for (item, _), rows in zip(items, best, strict=True) for r in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["item_id", "doc_id", "score"])
        give_back()

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(i, t) for i, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for t in dict.fromkeys(terms_of(text))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.binary())], names=["item_id", "term"])


RANKED = "item_id long, rank int, doc_id long, score long"


def rank_documents(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item,
    equal scores by ascending doc_id.

    Null texts have no terms: such items return nothing, such documents count nowhere.  Rows
    that share an item_id are one item with the terms of all; rows that share a doc_id are
    documents of their own (rank is unique), and a null doc_id comes last among equal scores.
    A null item_id is an item like any other.  Very long texts are counted whole; one item's
    terms are held by every task.  Empty tables give no row.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    pairs = materialise(asked.mapInArrow(_item_terms, "item_id long, term binary").distinct(), "op11-items")
    n_blocks = -(-pairs.count() // PAIRS)
    ranked = spark.createDataFrame([], RANKED)
    for block in range(n_blocks):
        of_item: dict[int | None, list[bytes]] = {}
        for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect():
            of_item.setdefault(r["item_id"], []).append(bytes(r["term"]))
        found = _rank_block(texts, of_item, k)
        ranked = ranked.unionByName(found)
    return ranked


def _rank_block(texts: DataFrame, of_item: dict[int | None, list[bytes]], k: int) -> DataFrame:
    spark = texts.sparkSession
    number = {t: n for n, t in enumerate(sorted({t for terms in of_item.values() for t in terms}))}
    index = materialise(texts.mapInArrow(_indexed(number), INDEX), "op11-index")
    n_docs, n_terms = index.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    if not n_docs:
        return spark.createDataFrame([], RANKED)
    weights = np.full(len(number), weight(n_docs, 0), np.int64)
    held = index.select(F.explode("lists").alias("list")).select("list.term", F.size("list.slots").alias("n"))
    for r in held.groupBy("term").agg(F.sum("n").alias("df")).collect():
        weights[r["term"]] = weight(n_docs, r["df"])
    items = [(item, [number[t] for t in terms]) for item, terms in of_item.items()]
    rows = index.mapInArrow(_searched(items, weights, k, n_docs, n_terms), "item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    first = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
