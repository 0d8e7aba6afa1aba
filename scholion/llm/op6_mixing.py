"""Soft-membership mixing to target weights.

A table of labels (quality, toxic) trains a naive Bayes classifier of four domains on binned
features of the text; every document gets the posterior of each domain.  Rates of documents
are then fitted by projected-gradient least squares: the expected tokens of a domain are the
sum over documents of rate times tokens times posterior, and the residuals to the target
totals are driven down by steps along the (preconditioned) gradient, with rates projected to
be nonnegative after every step.

A step changes each rate by a linear form of its own posteriors, so the history of steps is a
short list of vectors and rates are computed from it in one expression: an iteration is one
aggregation over a table of a few numbers for each document, and nothing but sums of domains
reaches the driver.  Built-in Spark functions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm.common import documents, materialise, private

DOMAINS = ("good", "good_toxic", "poor", "poor_toxic")
#: Share of all mixed tokens that each domain is to have.
TARGETS = {"good": 0.87, "good_toxic": 0.03, "poor": 0.09, "poor_toxic": 0.01}
#: Words in the list of telling words, and the labelled rows that it is learned from at most.
LEXICON, LEXICON_ROWS = 64, 20_000
#: Upper ends of the bins of each feature.
BINS = {
    "symbols": (0.0, 0.002, 0.01, 0.02, 0.04, 0.08, 0.16),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0),
    "digits": (0.0, 0.005, 0.02, 0.05, 0.1),
    "capitals": (0.02, 0.05, 0.1, 0.3, 0.5),
    "variety": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8),
    "telling": (0.0, 1.0, 2.0, 4.0, 8.0),
}
STEPS = 30
TOLERANCE = 1e-6


def _domain(quality: Column, toxic: Column) -> Column:
    return F.when(quality >= 1, F.when(toxic >= 1, 1).otherwise(0)).otherwise(F.when(toxic >= 1, 3).otherwise(2))


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, domain): contradicting rows count as poor and as toxic; rows with a null are
    left out."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .select("label_id", _domain(F.col("q"), F.col("t")).alias("domain"))
    )


def telling_words(texts: DataFrame, labels: DataFrame, size: int = LEXICON, rows: int = LEXICON_ROWS) -> list[str]:
    """Words that tell toxic rows: highest smoothed log ratio of document frequencies times
    frequency, in the ``rows`` labelled rows of the smallest id hashes (so few that they are broadcast)."""
    chosen = labels.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    toxic = F.col("domain").isin(1, 3)
    words = joined.select(toxic.alias("toxic"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    n = joined.agg(F.count_if(toxic), F.count_if(~toxic)).first()
    yes, no = n[0] or 0, n[1] or 0
    counts = words.groupBy("word").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).where("a > 1")
    weight = F.col("a") * F.log((F.col("a") + 0.5) / (yes + 1.0) * (no + 1.0) / (F.col("b") + 0.5))
    return [r["word"] for r in counts.where((F.col("a") + 0.5) / (yes + 1.0) > 4 * (F.col("b") + 0.5) / (no + 1.0)).orderBy(F.desc(weight), "word").limit(size).collect()]


def features(texts: DataFrame, lexicon: list[str]) -> DataFrame:
    """(doc_id, tokens, bin_*) of (doc_id, text); tokens are white-space words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.char_length(text), F.lit(1))
    tokens = F.regexp_count(text, F.lit(r"\S+"))
    found = F.array_intersect(F.split(F.lower(text), r"[^\p{L}]+"), F.array(*map(F.lit, lexicon))) if lexicon else None
    values = {
        "symbols": F.regexp_count(text, F.lit(r"[|#$%&*<>{}=_~^\\]")) / n,
        "word_length": F.char_length(text) / F.greatest(tokens, F.lit(1)),
        "digits": F.regexp_count(text, F.lit(r"[0-9]")) / n,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / n,
        "variety": F.size(F.array_distinct(F.split(text, r"\s+"))) / F.greatest(tokens, F.lit(1)),
        "telling": F.size(found).cast("double") if lexicon else F.lit(0.0),
    }

    def binned(value: Column, ends: tuple[float, ...]) -> Column:
        out = F.lit(len(ends))
        for k in range(len(ends) - 1, -1, -1):
            out = F.when(value <= ends[k], k).otherwise(out)
        return out

    raw = texts.select("doc_id", tokens.cast("long").alias("tokens"), *[v.alias(f"value_{k}") for k, v in values.items()])
    return raw.select("doc_id", "tokens", *[binned(F.col(f"value_{k}"), BINS[k]).alias(f"bin_{k}") for k in BINS])


def _alike(domain: int, feature: str) -> tuple[int, int]:
    """Domains that share the distribution of a feature: telling words depend on toxicity alone,
    the style of a text on its quality alone.  So the rarest domain, poor and toxic, is told by
    what many other rows show."""
    toxic, poor = domain % 2, domain // 2
    return (toxic, toxic + 2) if feature == "telling" else (2 * poor, 2 * poor + 1)


def posteriors(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Add p: the posterior of each of DOMAINS, by naive Bayes over the bins.  A domain of no
    labelled row has 0, unless none has any: then all are alike."""
    labelled = feats.join(labels, F.col("doc_id") == F.col("label_id"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"bin_{k}").alias("bin")) for k in BINS]))
    counted = labelled.select("domain", pairs.alias("x")).groupBy("domain", "x.feature", "x.bin").count().collect()  # domains x bins rows
    n: dict[tuple[int, str, int], int] = {}
    sizes = [0] * len(DOMAINS)
    for r in counted:
        for d in _alike(r["domain"], r["feature"]):
            n[d, r["feature"], r["bin"]] = n.get((d, r["feature"], r["bin"]), 0) + r["count"]
        if r["feature"] == next(iter(BINS)):
            sizes[r["domain"]] += r["count"]
    scores = []
    for d, size in enumerate(sizes):
        score = F.lit(math.log((size + 1) / (sum(sizes) + len(DOMAINS))))
        for f, ends in BINS.items():
            rows = sum(n.get((d, f, b), 0) for b in range(len(ends) + 1))
            logs = [math.log((n.get((d, f, b), 0) + 0.5) / (rows + 0.5 * (len(ends) + 1))) for b in range(len(ends) + 1)]
            score = score + F.element_at(F.array(*map(F.lit, logs)), F.col(f"bin_{f}") + 1)
        scores.append(score if size or not sum(sizes) else F.lit(float("-inf")))
    with_scores = feats.withColumn("scores", F.array(*scores))
    scaled = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")))
    total = F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x)
    return with_scores.withColumn("scaled", scaled).withColumn("p", F.transform("scaled", lambda x: x / total)).select("doc_id", "tokens", "p")


def _rate(steps: list[tuple[float, list[float]]], max_rate: float | None) -> Column:
    """The rate after the steps (momentum, gradient), each projected, from 1."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.struct(F.lit(m).alias("momentum"), F.array(*map(F.lit, g)).alias("g")) for m, g in steps])

    def move(at: Column, step: Column) -> Column:
        ahead = at["rate"] + step["momentum"] * (at["rate"] - at["old"])
        moved = ahead - F.aggregate(F.zip_with("p", step["g"], lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        kept = F.greatest(F.lit(0.0), moved)
        return F.struct((kept if max_rate is None else F.least(F.lit(max_rate), kept)).alias("rate"), at["rate"].alias("old"))

    return F.aggregate(moves, F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("old")), move, lambda at: at["rate"])


def fit_rates(soft: DataFrame, targets: Mapping[str, float], max_rate: float | None = None, total: float | None = None) -> tuple[Column, dict[str, float]]:
    """(rate as an expression over p, token totals by domain) for (tokens, p) rows.

    ``total`` is the number of tokens to mix, by default as many as there are; the shares are
    the targets over the domains that have tokens.  Without a ``max_rate`` residuals are
    driven to 0, at rates above 1 in domains in short supply.  With one they need not reach 0:
    the sum of their squares, each over the tokens of its domain, is made least within the
    bounds by accelerated projected gradients.
    """
    d = range(len(DOMAINS))
    sums = soft.agg(*[F.sum(F.col("tokens") * F.col("p")[k]) for k in d], *[F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]) for i in d for j in d]).first()
    if sums[0] is None:
        return F.lit(1.0), dict.fromkeys(DOMAINS, 0.0)
    have = np.array(sums[: len(DOMAINS)], float)
    curve = np.array(sums[len(DOMAINS) :], float).reshape(len(DOMAINS), -1)
    w = np.where(have > 0, [targets[k] for k in DOMAINS], 0.0)
    if not w.sum():
        return F.lit(1.0), dict(zip(DOMAINS, map(float, have), strict=True))
    goal = w / w.sum() * (total if total is not None else float(have.sum()))
    # the steps' scale: whole Newton steps, or (a row of curve adds up to have) steps that
    # never overshoot
    scale = np.linalg.pinv(curve) if max_rate is None else np.diag(np.divide(1.0, have, out=np.zeros(len(have)), where=have > 0))
    least = TOLERANCE * max(1.0, goal.sum())
    steps: list[tuple[float, list[float]]] = []
    got = old = have
    for turn in range(STEPS):
        if np.abs(got - goal).max() <= least:
            break
        momentum = 0.0 if max_rate is None else max(0, turn - 1) / (turn + 2)
        g = scale @ (got + momentum * (got - old) - goal)
        if np.abs(g).max() <= TOLERANCE:
            break
        steps.append((momentum, [float(x) for x in g]))
        rate = _rate(steps, max_rate)
        old, got = got, np.array(soft.agg(*[F.sum(rate * F.col("tokens") * F.col("p")[k]) for k in d]).first(), float)
        if max_rate is not None and np.abs(got - old).max() <= least:
            break
    return _rate(steps, max_rate), dict(zip(DOMAINS, map(float, got), strict=True))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, max_rate: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, tokens, p (posterior of each of DOMAINS), rate, copies.

    ``copies`` is the rate rounded up or down by a fixed hash of the id, so that its mean is
    the rate.  A null text is empty: no tokens, and a posterior from its empty features.
    Without labels all domains are alike and all rates are 1.  Null ids take no labels;
    repeated rows are mixed as rows of their own.  A very long text counts as its tokens do.
    An empty table gives no row.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = _labels(labels, id_col)
    feats = materialise(features(texts, telling_words(texts, known)), "op6-features")
    soft = materialise(posteriors(feats, known), "op6-soft")
    rate, _ = fit_rates(soft, targets, max_rate)
    share = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return soft.withColumn("rate", F.round(rate, 9)).withColumn("copies", F.floor(F.col("rate") + share).cast("long"))


def mix_report(rates: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """(domain, have, goal, reached, residual): expected tokens of each domain in the corpus, those
    that the targets ask for, and those that the rates of ``mixing_rates`` give.  Residuals above
    a millionth of all tokens are what bounds on the rates, or a fit that has not converged, leave."""
    sums = lambda c: [F.sum(c * F.col("tokens") * F.col("p")[k]) for k in range(len(DOMAINS))]
    one = rates.agg(F.array(*sums(F.lit(1.0))).alias("have"), F.array(*sums(F.col("rate"))).alias("reached"))
    rows = one.select(F.posexplode(F.arrays_zip("have", "reached"))).select("pos", F.coalesce("col.have", F.lit(0.0)).alias("have"), F.coalesce("col.reached", F.lit(0.0)).alias("reached"))
    share = F.when(F.col("have") > 0, F.element_at(F.array(*[F.lit(float(targets[d])) for d in DOMAINS]), F.col("pos") + 1)).otherwise(0.0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = F.coalesce(F.try_divide(F.col("share"), F.sum("share").over(every)), F.lit(0.0)) * F.sum("have").over(every)
    out = rows.withColumn("share", share).withColumn("goal", goal)
    return out.select(F.element_at(F.array(*map(F.lit, DOMAINS)), F.col("pos") + 1).alias("domain"), "have", "goal", "reached", (F.col("reached") - F.col("goal")).alias("residual"))


def mix_documents(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, max_rate: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says; with a ``max_rate`` of 1, no row is
    repeated, rows of domains in short supply all stay, and only what other domains have above
    their share of all tokens goes.  Rows that repeat an id, and those of a null id, all take the
    largest number of copies among them.  Empty texts have no tokens and stay by their domain's
    rate; an empty table stays empty."""
    rates = mixing_rates(docs, labels, targets, max_rate, id_col, text_col).groupBy(F.col("doc_id").alias("mix_id")).agg(F.max("copies").alias("mix_copies"))
    out = private(docs, own_id=F.col(id_col)).join(rates, F.col("own_id").eqNullSafe(F.col("mix_id"))).where("mix_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = mixing_rates(documents(spark, sf_dir), labels)
    return out.select("doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")
