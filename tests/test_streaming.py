"""The ingest stream: state in place of reads of the table, restarts, batches that run again."""

import shutil

import pytest
from pyspark.sql import functions as F

from scholion.streaming import ingest
from scholion.streaming.ingest import ingest_stream

SCHEMA = "key string, content string, ordinal int"


@pytest.fixture
def run(spark, tmp_path):
    at = {x: str(tmp_path / x) for x in ("in", "out", "check")}

    def drop(rows, start=True):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(at["in"])
        if start:
            query = ingest_stream(spark, at["in"], SCHEMA, at["out"], at["check"])
            query.awaitTermination()
            return query

    drop.at = at
    drop.stored = lambda: sorted((r.key, r.content) for r in spark.read.parquet(at["out"]).collect())
    return drop


def test_first_of_a_key_wins(spark, run):
    run([("TN_a", "late", 7), ("TN_a", "early", 2), ("TN_a", "mid", 5), ("XX_a", "no", 1), (None, "no", 1)])
    run([("TN_a", "again", 0), ("BT_b", "one", 1)])
    assert run.stored() == [("BT_b", "one"), ("TN_a", "early")]
    assert spark.read.parquet(run.at["out"]).where("src_type = 'BT'").count() == 1


def test_state_is_filled_from_the_table_once(spark, run, monkeypatch):
    spark.createDataFrame([("TN_old", "stored", 1)], SCHEMA).withColumns({"src_type": F.lit("TN"), "ingest": F.lit(-1)}).write.partitionBy("src_type", "ingest").parquet(run.at["out"])
    read = []
    monkeypatch.setattr(ingest, "stored_passages", lambda s, p, real=ingest.stored_passages: read.append(p) or real(s, p))
    run([("TN_old", "new text", 0), ("TN_x", "x", 1)])
    assert run.stored() == [("TN_old", "stored"), ("TN_x", "x")] and len(read) == 1
    query = run([("TN_old", "newer", 0), ("TN_x", "y", 1), ("TN_z", "z", 1)])
    # the second start reads its new file and nothing of the table
    assert run.stored() == [("TN_old", "stored"), ("TN_x", "x"), ("TN_z", "z")] and len(read) == 1
    assert sum(p.numInputRows for p in query.recentProgress) == 3


def test_a_batch_that_runs_again_writes_once(spark, run):
    run([("TN_a", "a", 1)])
    run([("TN_b", "b", 1), ("BT_c", "c", 1)])
    # the run died after its rows were written and before the batch was committed
    for name in ("1", ".1.crc"):
        shutil.os.remove(f"{run.at['check']}/commits/{name}")
    run([("TN_d", "d", 1)])
    assert run.stored() == [("BT_c", "c"), ("TN_a", "a"), ("TN_b", "b"), ("TN_d", "d")]
