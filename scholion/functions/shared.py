"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a single machine, and
    an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-scholion-"))
    return _own_dir[0]


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/scholion/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where lambdas read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ranked(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """(key, rank): row numbers from 1 in an order over all rows, counted range by range and not in one task."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order).select("key", F.monotonically_increasing_id().alias("at"))
    # the upper bits are the range, the lower 33 the row in it
    stored = cut_lineage(rows, "ranges").selectExpr("key", "shiftright(at, 33) AS range", "at & 8589934591 AS row")
    before = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    starts = stored.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("start"))
    return stored.join(F.broadcast(starts), "range").select("key", (F.col("start") + F.col("row") + 1).alias(name))


def stored_still(df: DataFrame) -> bool:
    """Whether the files of a stored table are there."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()[:1]]
    return all(p.getFileSystem(conf).exists(p) for p in paths)
