"""Language ID by multilingual mixture inference.

Training counts the byte trigrams of every labelled training text by language.  A document
is a bag of trigrams drawn from a mixture of languages: expectation-maximisation estimates
the proportions, and languages are removed one at a time while the likelihood, penalised by
half the logarithm of the number of trigrams for each language, does not fall.  The document
is given the language of the largest remaining proportion, which is also its score.

Counting is a Spark aggregation of (language, trigram bucket) rows that are summed within
each task first; each language's sums become one row.  The model is a table of languages by
BUCKETS numbers (128 KB for each value of lang), whatever the corpus, and is the only thing
that the driver holds and sends.  Every value of lang is learned; a column of more values than
MOST_LANGUAGES is taken to be no language and raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import documents, give_back, keep_only, ship

#: Buckets that trigrams are hashed to.
BUCKETS = 1 << 15
#: Added to every count.
SMOOTH = 0.5
#: Rounds of expectation-maximisation for each language set.
ROUNDS = 12
#: Values of lang that a model can have: all living languages.  Bounds the model at 1 GB.
MOST_LANGUAGES = 8192
UNKNOWN = "und"


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text between two spaces."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    h = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(17)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keep_only("op5")
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if len(text):
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                totals[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


def _likelihood(rows: pd.DataFrame) -> pd.DataFrame:
    """The likelihood of every bucket in one language: at most BUCKETS rows come in."""
    n = np.full(BUCKETS, SMOOTH)
    n[rows["bucket"].to_numpy(np.int64)] += rows["n"].to_numpy(np.int64)
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "likelihood": [(n / n.sum()).astype(np.float32).tobytes()]})


class Model:
    """Log-likelihood of each bucket in each language."""

    def __init__(self, languages: list[str], likelihood: np.ndarray):
        self.languages, self.likelihood = languages, likelihood

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(language, score, proportions of the selected languages) of a whole text."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, {}
        buckets, n = np.unique(trigrams(text), return_counts=True)
        total = int(n.sum())
        like = self.likelihood[:, buckets].astype(np.float64)
        penalty = 0.5 * np.log(total)
        chosen = np.arange(len(self.languages))
        share, fit = _em(like, n, np.full(len(chosen), 1 / len(chosen)))
        while len(chosen) > 1:
            # all languages of a negligible share go at once, else the smallest
            rest = share > 1e-3
            if rest.all():
                rest[share.argmin()] = False
            trial, trial_fit = _em(like[chosen[rest]], n, share[rest] / share[rest].sum())
            if trial_fit + penalty * (len(chosen) - rest.sum()) < fit:
                break
            chosen, share, fit = chosen[rest], trial, trial_fit
        best = int(share.argmax())
        return self.languages[chosen[best]], float(share[best]), {self.languages[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def _em(like: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    total = n.sum()
    if len(share) == 1:
        return share, float(np.log(like[0]) @ n)
    for _ in range(ROUNDS):
        mix = share @ like
        share = share * (like @ (n / mix)) / total
    return share, float(np.log(share @ like) @ n)


def fit(labelled: DataFrame) -> Model:
    """Learn from (text, lang) rows; rows of a null text or lang are left out.  Without rows the
    model has no language."""
    ship(labelled.sparkSession)
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").applyInPandas(_likelihood, "lang string, likelihood binary").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    languages = [r["lang"] for r in found]
    return Model(languages, np.stack([np.frombuffer(r["likelihood"], np.float32) for r in found]) if found else np.empty((0, BUCKETS), np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Two columns for each row of ``docs``: row, a struct of all its columns, and found, a
    struct of lang_pred, score and lang_shares (language to proportion).

    A null text, a text without a letter, or a model without languages gives ``und``, score
    0 and no shares.  Of languages of equal proportion the first by name is taken.  Only the
    text is read, and all of it, so other nulls, repeated rows and clashing names do not
    matter.  An empty table gives no row.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.likelihood))

    @F.pandas_udf("lang_pred string, score double, lang_shares map<string,double>")
    def infer(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keep_only("op5")
        own = Model(*sent.value)
        for series in texts:
            yield pd.DataFrame([own.infer(t) for t in series], columns=["lang_pred", "score", "lang_shares"])
            series = None
        give_back()

    return docs.select(F.struct("*").alias("row"), infer(F.col(text_col)).alias("found"))


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 0 by 5 are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "found.lang_pred", "found.score")
