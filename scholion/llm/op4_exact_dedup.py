"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes.  Distinct blocks
are sorted into integer names; then adjacent pairs of names are sorted into names of their
own, level by level, until each document has one name.  Two documents of the same number
of levels have the same last name exactly if their texts are equal: names come from sorted
whole keys, never from a hash, so there are no collisions.

Built-in Spark functions only.  Normalised text is written once, so that later passes need
not normalise it again, and shuffled once (for the first names); every later level moves
rows of a few integers, half as many each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import ascii_lower, documents, materialise, name_groups, private

#: Bytes in a block.
BLOCK_BYTES = 1024


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, norm, text_sha256), written to the shared folder.  tkey only tells rows
    of one id with different texts apart."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    return materialise(rows.withColumn("tkey", F.xxhash64("norm")).withColumn("text_sha256", F.sha2("norm", 256)), "op4-rows")


def document_names(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, tkey, levels, name) of rows as ``normalised`` gives them: equal (levels, name)
    exactly for equal texts."""
    raw = rows.select("doc_id", "tkey", F.col("norm").cast("binary").alias("raw"), F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block_bytes)).alias("n"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("raw"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes)))
    blocks = raw.select("doc_id", "tkey", "n", F.posexplode(cut).alias("i", "block"))
    named = name_groups(blocks, ["block"], "name").select("doc_id", "tkey", "n", F.col("i").cast("long").alias("i"), "name")
    level = materialise(named, "op4-level0")
    widest = level.agg(F.max("n")).first()[0] or 0
    levels = 0
    done = level.where("n = 1").select("doc_id", "tkey", F.lit(0).alias("levels"), "name")
    while widest > 1:
        levels += 1
        pairs = (
            level.where("n > 1")
            .groupBy("doc_id", "tkey", F.shiftright("i", 1).alias("j"))
            .agg(
                F.max("n").alias("n"),
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"),
            )
        )
        pairs = materialise(pairs, f"op4-pairs{levels}")
        level = materialise(
            name_groups(pairs, ["left", "right"], "name").select("doc_id", "tkey", F.shiftright(F.col("n") + 1, 1).alias("n"), F.col("j").alias("i"), "name"),
            f"op4-level{levels}",
        )
        done = done.unionByName(level.where("n = 1").select("doc_id", "tkey", F.lit(levels).alias("levels"), "name"))
        widest = (widest + 1) // 2
    return done


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, tkey (64 bits
    that tell rows of one id with different texts apart).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty.
    Of equal texts the largest id stays.  Rows that repeat an id and its text are copies of
    each other with the same flags (``drop_exact_duplicates`` keeps one of them).  A null id
    is smaller than any other; a group of null ids only has a null keep_id and stays.
    """
    rows = normalised(docs, id_col, text_col)
    names = document_names(rows, block_bytes).dropDuplicates(["doc_id", "tkey"])
    n = names.select(F.col("doc_id").alias("n_id"), F.col("tkey").alias("n_tkey"), "levels", "name")
    named = materialise(
        rows.drop("norm").join(n, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("tkey") == F.col("n_tkey"))).select("doc_id", "tkey", "text_sha256", "levels", "name"),
        "op4-named",
    )
    groups = materialise(named.groupBy("levels", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "op4-groups")
    return named.join(groups, ["levels", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "tkey"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group of equal texts; columns as before.

    Null texts are one group with the empty ones.  Of rows that repeat an id and its text, one
    stays, whichever.  An empty table stays empty.
    """
    keep = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("tkey").alias("keep_tkey")).distinct()
    keyed = private(docs, own_id=F.col(id_col), own_tkey=F.xxhash64(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))))
    same = F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_tkey") == F.col("keep_tkey"))
    return keyed.join(keep, same, "left_semi").dropDuplicates(["own_id", "own_tkey"]).select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).drop("tkey")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
