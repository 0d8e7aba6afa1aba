"""Exact nearest vectors by pivots, and their ingest in batches (K4, K7, K8).

Vectors are dealt to the nearest of a fixed number of pivots.  A cell knows how near and how
far its vectors are from its pivot, so the triangle inequality tells for each query which cells
cannot hold one of its k nearest: first the nearest cells are scored, enough of them to hold k
vectors; the k-th distance found bounds the rest; then the cells that the bound leaves are
scored.  The result equals a scan of all pairs.

Cells are split into parts of bounded size, so a cell that holds a third of all vectors is as
many groups as it needs.  Queries are a stated set, worked on in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.shared import cut_lineage
from scholion.functions.workers import ship
from scholion.sources.versions import Version, VersionedTables

#: Most pivots of an index (they are sent to every task), vectors of a part, queries of a block.
PIVOTS, PART, QUERY_BLOCK = 512, 4096, 1000


@dataclass(frozen=True)
class Cells:
    """An index: pivots (one row a cell), and vectors with cell, part and distance from the pivot."""

    pivots: np.ndarray
    vectors: DataFrame
    cells: DataFrame


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared L2 distances of all rows of ``a`` from all rows of ``b``, as sums of squared differences."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def choose_pivots(vectors: DataFrame, n: int | None = None) -> np.ndarray:
    """Vectors of the least key hashes: as many as the square root of all, PIVOTS at most."""
    n = min(PIVOTS, max(1, int(vectors.count() ** 0.5))) if n is None else n
    rows = vectors.orderBy(F.xxhash64("key"), "key").limit(n).select("embedding").collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def deal(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(key, embedding, cell, away): each vector with its nearest pivot and the distance from it."""
    ship(vectors.sparkSession)
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = distances(_matrix(batch["embedding"]), pivots)
                cell = far.argmin(axis=1)
                yield batch.assign(cell=cell, away=np.sqrt(far[np.arange(len(cell)), cell]))

    return vectors.select("key", "embedding").mapInPandas(run, f"key {kinds['key']}, embedding {kinds['embedding']}, cell int, away double")


def with_parts(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dealt vectors with the part of their cell, and (cell, n, parts, nearest, farthest)."""
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("nearest"), F.max("away").alias("farthest"))
    cells = cut_lineage(cells.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "vector-cells")
    parted = dealt.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    return parted.drop("parts"), cells


def build_cells(vectors: DataFrame, pivots: int | None = None) -> Cells:
    """An index of (key, embedding).  Without a vector there is nothing to search."""
    chosen = choose_pivots(vectors, pivots)
    parted, cells = with_parts(cut_lineage(deal(vectors, chosen), "vectors-dealt"))
    return Cells(chosen, parted, cells)


def _from_pivots(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(query, vector, cell, far): the distance of each query from each pivot."""
    kinds = dict(queries.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = np.sqrt(distances(_matrix(batch["vector"]), pivots))
                yield pd.DataFrame({"query": np.repeat(batch["query"].to_numpy(), len(pivots)), "cell": np.tile(np.arange(len(pivots)), len(batch)), "far": far.ravel()})

    return queries.mapInPandas(run, f"query {kinds['query']}, cell int, far double")


def _scored(index: Cells, pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, key, distance): the k nearest of each part of a cell for the queries that ask it.
    ``pairs`` has (query, cell, parts), ``queries`` has (query, vector, k)."""
    kinds, key_kind = dict(queries.dtypes), dict(index.vectors.dtypes)["key"]
    asked = pairs.join(queries, "query").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("query", "vector", "k", "cell", "part")

    def nearest(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(wanted):
            vectors = vectors.sort_values("key", kind="stable")
            keys, matrix = vectors["key"].to_numpy(), _matrix(vectors["embedding"])
            far = distances(_matrix(wanted["vector"]), matrix)
            for query, most, row in zip(wanted["query"], wanted["k"], far, strict=True):
                best = np.argsort(row, kind="stable")[: int(most)]
                found.append(pd.DataFrame({"query": query, "key": keys[best], "distance": row[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "key": [], "distance": []}).astype({"distance": float})

    both = index.vectors.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part"))
    return both.applyInPandas(nearest, f"query {kinds['query']}, key {key_kind}, distance double")


def nearest_vectors(index: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """K4: (query, key, distance, rank) of the k nearest of each (query, vector[, k]), ties by
    key, and (query, n, scored): how many vectors there are and how many were looked at.

    Distances are squared.  A column ``k`` of the queries takes the place of the argument.  No
    queries or no vectors give no rows.
    """
    ship(queries.sparkSession)
    queries = cut_lineage(queries if "k" in queries.columns else queries.withColumn("k", F.lit(k)), "vector-queries")
    kinds = dict(queries.dtypes)
    ranked, looked = [], []
    blocks = -(-queries.count() // QUERY_BLOCK)
    for b in range(blocks if len(index.pivots) else 0):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        far = _from_pivots(block.select("query", "vector"), index.pivots).join(F.broadcast(index.cells), "cell").join(block.select("query", "k"), "query")
        # cells by their pivots' distance, until they hold k vectors
        before = F.sum("n").over(Window.partitionBy("query").orderBy("far", "cell").rowsBetween(Window.unboundedPreceding, -1))
        far = cut_lineage(far.withColumn("first", F.coalesce(before, F.lit(0)) < F.col("k")), "vector-far")
        asked = block.select("query", "vector", "k")
        once = cut_lineage(_scored(index, far.where("first").select("query", "cell", "parts"), asked), "vector-first")
        kth = once.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))).join(block.select("query", "k"), "query").where("r = k")
        bound = kth.select("query", (F.sqrt("distance") * (1 + 1e-12)).alias("bound"))
        least = F.greatest(F.col("far") - F.col("farthest"), F.col("nearest") - F.col("far"))
        # without a k-th neighbour all cells have been scored
        rest = cut_lineage(far.where("NOT first").join(bound, "query").where(least * (1 - 1e-12) <= F.col("bound")).select("query", "cell", "parts", "n"), "vector-rest")
        again = _scored(index, rest.drop("n"), asked)
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
        ranked.append(once.unionByName(again).withColumn("rank", rank).join(block.select("query", "k"), "query").where("rank <= k").select("query", "key", "distance", "rank"))
        seen = far.where("first").select("query", "n").unionByName(rest.select("query", "n")).groupBy("query").agg(F.sum("n").alias("scored"))
        looked.append(far.groupBy("query").agg(F.sum("n").alias("n")).join(seen, "query"))
    spark = queries.sparkSession
    if not ranked:
        none = spark.createDataFrame([], f"query {kinds['query']}, key {dict(index.vectors.dtypes)['key']}, distance double, rank int")
        return none, spark.createDataFrame([], f"query {kinds['query']}, n long, scored long")
    for r, s in zip(ranked[1:], looked[1:], strict=True):
        ranked[0], looked[0] = ranked[0].unionByName(r), looked[0].unionByName(s)
    return ranked[0], looked[0]


def run_query_sheet(index: Cells, sheet: DataFrame) -> DataFrame:
    """K8: (query, key, distance, rank): each query of (query, vector, max_sources) with as many
    of its nearest as it asks for."""
    return nearest_vectors(index, sheet.select("query", "vector", F.col("max_sources").alias("k")), 0)[0]


def ingest_vectors(store: VersionedTables, new: DataFrame, batches: int = 10, rebuild: bool = False) -> Version:
    """K7: add the vectors of new keys in batches, each a version of its own; a key keeps its
    first vector, and of rows that share a new key one stays.

    A run that dies goes on where it was: what earlier batches have published is there and is
    not taken again.  The pivots are those of the first batch that had vectors.  ``rebuild``
    starts over from ``new`` alone; readers keep the old version until it is published.
    """
    spark = store.spark
    version = store.current()
    base = Version(version.number, {}) if rebuild else version
    rows = new.select("key", "embedding").dropDuplicates(["key"])
    for b in range(batches):
        batch = rows.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b)
        if base.folders:
            batch = batch.join(stored_vectors(store, base).select("key"), "key", "left_anti")
        batch = cut_lineage(batch, "vectors-batch")
        if batch.isEmpty():
            continue
        tables = {}
        if "pivots" in base.folders:
            pivots = np.array([r["pivot"] for r in base.table(spark, "pivots").orderBy("cell").collect()], np.float64)
        else:
            pivots = choose_pivots(batch)
            tables["pivots"] = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "cell int, pivot array<double>").coalesce(1)
        tables[f"vectors-{base.number + 1:06d}"] = deal(batch, pivots)
        base = store.commit(base, tables)
    return base


def stored_vectors(store: VersionedTables, version: Version) -> DataFrame:
    """(key, embedding, cell, away) of all batches of a version."""
    return store.spark.read.parquet(*[f for t, f in sorted(version.folders.items()) if t.startswith("vectors-")])


def stored_cells(store: VersionedTables, version: Version) -> Cells:
    """The index of a version, for ``nearest_vectors``."""
    pivots = np.array([r["pivot"] for r in version.table(store.spark, "pivots").orderBy("cell").collect()], np.float64)
    return Cells(pivots, *with_parts(stored_vectors(store, version)))
