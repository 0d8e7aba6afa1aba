"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.functions.workers import ship

#: A rank by frequency holds at most this many keys; any other key has at most 1/HEAVY of the rows.
HEAVY = 1000
#: A key seen no more often than this is never treated as heavy.
HEAVY_FROM = 64
#: Shards in which keys are sorted into integer names.
SHARDS = 1 << 16

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary
    one where that is unset and the master is local (a single machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-scholion-"))
    return "file://" + _own_dir[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return what was written.

    Cuts the lineage with files that survive the loss of an executor, and fixes the rows
    for all later readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scholion/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def private(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one struct, row, beside the given keys: no column of it can clash with what
    an operator adds.  ``row.*`` gives the columns back."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


_caches: dict[str, Callable[[], None]] = {}


def keep_only(owner: str) -> None:
    """Give up what other operators remember in this Python worker: workers outlive stages."""
    for name, clear in _caches.items():
        if name != owner:
            clear()


def cached(owner: str, clear: Callable[[], None]) -> None:
    """Say how the memory of ``owner`` is given up."""
    _caches[owner] = clear


def give_back() -> None:
    """Return what this Python worker has freed to the system: it waits beside an executor's
    heap for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is far faster than ``translate`` and equal to it on ASCII texts and on texts
    whose other characters have no lower case of their own; only the rest is translated.
    """
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return (
        F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
        .when(F.lower(rest) == rest, F.lower(text))
        .otherwise(F.translate(text, UPPER, UPPER.lower()))
    )


def heavy_keys(df: DataFrame, digest: Column) -> list[int]:
    """Digests of the most frequent keys: at most HEAVY, so the list has a fixed bound, and
    a key left out has at most 1/HEAVY of all rows."""
    counts = df.groupBy(digest.alias("digest")).count().where(F.col("count") > HEAVY_FROM)
    return [r["digest"] for r in counts.orderBy(F.desc("count"), "digest").limit(HEAVY).collect()]


def name_groups(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add an integer column that is equal exactly where the (non-null) keys are equal.

    Keys are dealt to shards, sorted there, and named by shard and rank, so a name depends
    on the data alone.  Heavy keys are reduced on the map side, named by rank below zero
    and joined back by broadcast (at most HEAVY digests), so no task holds a heavy group.
    """
    digest = F.xxhash64(*keys)
    heavy = heavy_keys(df, digest)
    shard = F.pmod(digest, F.lit(SHARDS))
    light = df.where(~digest.isin(heavy)) if heavy else df
    w = Window.partitionBy("name_shard").orderBy(*keys)
    named = (
        light.withColumn("name_shard", shard)
        .withColumn(out, F.shiftleft(F.col("name_shard").cast("long") + 1, 40) + F.dense_rank().over(w))
        .drop("name_shard")
    )
    if heavy:
        rows = df.where(digest.isin(heavy))
        names = rows.select(*keys).distinct().withColumn(out, -F.row_number().over(Window.orderBy(*keys)).cast("long"))
        named = named.unionByName(rows.join(F.broadcast(names), keys).select(named.columns))
    return named


__all__ = ["HEAVY", "SHARDS", "ascii_lower", "cached", "documents", "give_back", "heavy_keys", "keep_only", "materialise", "name_groups", "private", "shared_dir", "ship"]
