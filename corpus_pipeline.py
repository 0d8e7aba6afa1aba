"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import op1_packing, op4_exact_dedup, op5_language, op6_mixing, op7_minhash
from scholion.llm.common import documents, materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a language that the model knows; ``und`` (a text that is null or has no
    letter) is rejected.  The language predicted takes the place of a missing one only.  Rows
    are judged one by one: repeats and null ids stay or go with their text; without a labelled
    row nothing can be told, and nothing stays."""
    model = op5_language.fit(docs.where(~op5_language.held_out()))
    kept = op5_language.predict(docs, model).where(F.col("found.lang_pred") != op5_language.UNKNOWN)
    return kept.select(*[F.coalesce("row.lang", "found.lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts: that of the largest id.  Null texts are
    one group with the empty ones; an id and text that repeat are kept once."""
    return op4_exact_dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates on shingles of five words: that of the
    smallest id.  Texts without words and rows of a null id stay."""
    return op7_minhash.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin out over-represented domains; no document is repeated.  Domains without a label are
    not thought of, and without any label all documents stay."""
    return op6_mixing.mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents that are left; a null or empty text is its end token alone."""
    return op1_packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language mixtures, MinHash candidates and tokenizers have no SQL form; tests/llm compares
#: each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
