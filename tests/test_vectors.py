"""Nearest vectors by pivots against a scan of all pairs, and restartable ingest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.operators import search, vectors
from scholion.sources.versions import VersionedTables


def table(spark, rows):
    return spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in rows], "key long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 20, (12, 8))
    rows = [(k, np.float32(centres[k % 12] + rng.normal(0, 1, 8))) for k in range(1200)]
    # repeats of one vector: ties go by key; and a third of all rows near one centre
    return rows + [(5000 + k, rows[5][1]) for k in range(30)] + [(9000 + k, np.float32(centres[0] + rng.normal(0, 1, 8))) for k in range(600)]


def test_equal_to_a_scan(spark, clustered, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 100)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 25)
    v = table(spark, clustered).cache()
    index = vectors.build_cells(v, 24)
    assert index.vectors.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 170
    q = v.where("key % 40 = 0 OR key = 5003").select(F.col("key").alias("query"), F.col("embedding").alias("vector")).cache()
    assert q.count() > 30
    want = sorted((r.query, r.key, r.rank) for r in search.vector_rank(v, q, 15).collect())
    found, looked = vectors.nearest_vectors(index, q, 15)
    assert sorted((r.query, r.key, r.rank) for r in found.collect()) == want
    shares = [r.scored / r.n for r in looked.collect()]
    assert len(shares) == q.count() and max(shares) <= 1 and np.mean(shares) < 0.5, shares
    # more neighbours than there are vectors
    few = v.where("key < 5")
    assert vectors.nearest_vectors(vectors.build_cells(few), q, 50)[0].count() == 5 * q.count()
    assert vectors.nearest_vectors(index, q.where("false"), 5)[0].count() == 0
    assert vectors.nearest_vectors(vectors.build_cells(v.where("false")), q, 5)[0].count() == 0


def test_ingest_goes_on_after_a_failure(spark, clustered, tmp_path, monkeypatch):
    store = VersionedTables(spark, str(tmp_path))
    v = table(spark, clustered).cache()
    first = v.where("key < 600")
    done = vectors.ingest_vectors(store, first, batches=3)
    assert done.number == 3 and vectors.stored_vectors(store, done).count() == 600
    changed = v.withColumn("embedding", F.when(F.col("key") < 300, F.transform("embedding", lambda x: x + 1)).otherwise(F.col("embedding")))
    calls, commit = [], store.commit

    def dies(base, tables):
        calls.append(base.number)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return commit(base, tables)

    monkeypatch.setattr(store, "commit", dies)
    with pytest.raises(RuntimeError):
        vectors.ingest_vectors(store, changed, batches=4)
    assert store.current().number == 5
    last = vectors.ingest_vectors(store, changed, batches=4)
    assert last.number == 7
    rows = {r.key: r.embedding for r in vectors.stored_vectors(store, last).collect()}
    assert len(rows) == v.count() == vectors.stored_vectors(store, last).count()
    kept = {r.key: r.embedding for r in v.collect()}
    assert all(rows[k] == kept[k] for k in kept)
    q = v.where("key % 200 = 0").select(F.col("key").alias("query"), F.col("embedding").alias("vector"))
    found, _ = vectors.nearest_vectors(vectors.stored_cells(store, last), q, 5)
    assert sorted((r.query, r.key) for r in found.collect()) == sorted((r.query, r.key) for r in search.vector_rank(v, q, 5).collect())
    # nothing new is no new version; a rebuild starts from what is given alone
    assert vectors.ingest_vectors(store, first).number == 7
    again = vectors.ingest_vectors(store, first.limit(10), batches=1, rebuild=True)
    assert again.number == 8 and vectors.stored_vectors(store, again).count() == 10 and vectors.stored_vectors(store, last).count() == v.count()
