"""Incremental passage ingest (A6), as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

from scholion.functions.keys import src_type_of
from scholion.functions.workers import ship
from scholion.operators.resolve import first_of

STORED_TYPES = ("BT", "TN")


def ingest_passages(new: DataFrame, existing: DataFrame | None, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejects) of passages (key, content, ordinal): the first of each new key,
    with its src_type; keys of source types that are not stored reject."""
    typed = new.withColumn("src_type", src_type_of(F.col("key")))
    good = F.coalesce(F.col("src_type").isin(*STORED_TYPES), F.lit(False))
    fresh = first_of(typed.where(good), ["key"], [order])
    if existing is not None:
        fresh = fresh.join(existing.select("key"), "key", "left_anti")
    return fresh, typed.where(~good)


def stored_passages(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None where nothing is stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


class FirstOfKey(StatefulProcessor):
    """Lets the first row of each new key through, by ordinal within a batch; a key is seen
    once it is in the state, from an earlier batch or from the table at the first start."""

    def __init__(self, fields: list[str], order: str):
        self.fields, self.order = fields, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:
                pass
            return
        self.seen.update((True,))
        first = None
        for batch in rows:
            best = batch.sort_values(self.order, kind="stable", na_position="first").head(1)
            if first is None or best[self.order].isna().iloc[0] or best[self.order].iloc[0] < first[self.order].iloc[0]:
                first = best
        yield first[self.fields]

    def close(self) -> None:
        pass


def _started(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream has finished its first batch there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def ingest_stream(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, order: str = "ordinal") -> StreamingQuery:
    """Ingest the JSON-lines files of a folder once each, batch by batch; the checkpoint takes
    the place of a start index, so a stopped run goes on where it was.

    The keys that are stored are state of the stream, kept by key in Spark's state store
    (RocksDB): the table is read once, when a checkpoint has no finished batch, and no later
    batch reads it.  Rows land in folders of their batch, so a batch that runs again writes
    over what it has written.
    """
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).json(source)
    typed = stream.withColumn("src_type", src_type_of(F.col("key"))).where(F.col("src_type").isin(*STORED_TYPES))
    stored = None if _started(spark, checkpoint) else stored_passages(spark, table)
    seen = spark.createDataFrame([], "key string") if stored is None else stored.where("key IS NOT NULL").select("key").distinct()
    first = typed.where("key IS NOT NULL").groupBy("key").transformWithStateInPandas(
        statefulProcessor=FirstOfKey(typed.columns, order), outputStructType=typed.schema, outputMode="Append", timeMode="None", initialState=seen.groupBy("key")
    )

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("ingest", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("src_type", "ingest").parquet(table)

    return first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
