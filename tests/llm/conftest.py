import pytest
from pyspark.sql import functions as F

LONG = "word and another, " * 4000
TEXTS = [
    (1, None, "en", None, None), (2, "", None, "s", 0), (3, "   \n\t ", "en", "s", 5), (4, LONG, "en", "s", None), (5, "The cat sat on the mat by the door today.", "en", "s", 1),
    (5, "The cat sat on the mat by the door today.", "en", "s", 1), (6, "the CAT sat on the mat by the door today.", "en", "s", 1), (7, "The cat sat on the mat by the door today", "en", "t", 1),
    (None, "The cat sat on the mat by the door today.", "en", None, 1), (None, None, None, None, None), (8, "ÉCOLE été İstanbul ẞ Σ 中文 <|endoftext|> \\n", "fr", "s", 1),
    (9, "MIT  License; cc\nby GNU General\nPublic License and Apache-License", "en", "s", 1), (10, "12345 !!! ...", "en", "s", 1), (11, "a", "de", "s", 1), (12, "A", "de", "s", 1), (13, LONG + "x", "en", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, null ids and columns of clashing names."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(7) for c in ("name", "block", "n", "i", "tokens", "p", "rate", "key", "levels", "tkey", "bucket", "part", "low", "component_id", "learn", "digest", "kept", "score", "formatted")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
