"""Corpus quality and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion import dims
from scholion.functions.text import word_count

MEASURES = ("mean", "median", "p20", "p80", "min", "max", "std", "total", "valid")


def empty_field_failures(df: DataFrame) -> DataFrame:
    """L1: (key, check) for each empty English, Hebrew, key or summary field there is."""
    blank = lambda c: c.isNull() | (c == "")
    checks = []
    if "content" in df.columns:
        checks += [("en_empty", blank(F.try_element_at("content", F.lit(1)))), ("heb_empty", blank(F.try_element_at("content", F.lit(2))))]
    if "key" in df.columns:
        checks.append(("key_empty", blank(F.col("key"))))
    checks += [(f"{c}_empty", blank(F.col(c))) for c in ("summary_en", "summary_heb") if c in df.columns]
    found = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in checks]))
    return df.select("key", F.explode(found).alias("check"))


def invalid_keys(df: DataFrame) -> DataFrame:
    """L2: keys that are not four non-empty parts."""
    return df.where(F.coalesce(~F.rlike("key", F.lit("^[^_]+_[^_]+_[^_]+_[^_]+$")), F.lit(True))).select("key")


def row_counts(df: DataFrame, by: str) -> DataFrame:
    """L3."""
    return df.groupBy(by).agg(F.count("*").alias("n"))


def _stats(value: Column) -> list[Column]:
    return [
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        F.percentile(value, F.lit(0.2)).alias("p20"),
        F.percentile(value, F.lit(0.8)).alias("p80"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
        F.stddev_pop(value).alias("std"),
        F.count("*").cast("double").alias("total"),
        F.count(value).cast("double").alias("valid"),
    ]


def word_stats(df: DataFrame, text: str, by: str) -> DataFrame:
    """L4: measures of the number of words by group, the number of documents (total) and of
    those with a text (valid).  Percentiles are exact: they count distinct lengths, which are
    few, on the map side."""
    words = F.when(F.col(text).isNotNull(), word_count(F.col(text)))
    return df.select(by, words.alias("v")).groupBy(by).agg(*_stats(F.col("v")))


def char_stats(df: DataFrame, text: str, by: str) -> DataFrame:
    """Measures of the number of characters by group."""
    return df.select(by, F.char_length(text).alias("v")).groupBy(by).agg(*_stats(F.col("v")))


def length_histogram(df: DataFrame, value: Column, by: str) -> DataFrame:
    """(by, v, n): how many rows of each group have each length, a null one too.  Histograms of
    old and new rows are merged by ``merge_histograms``; lengths are few, so they stay small."""
    return df.select(by, value.cast("long").alias("v")).groupBy(by, "v").agg(F.count("*").alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """One histogram of several, as if their rows had been counted together."""
    by = parts[0].columns[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(by, "v").agg(F.sum("n").alias("n"))


def histogram_stats(hist: DataFrame) -> DataFrame:
    """L3-L5 from a histogram: the measures of word_stats and char_stats, percentiles exact."""
    by = hist.columns[0]
    v, n, known = F.col("v"), F.col("n"), F.when(F.col("v").isNotNull(), F.col("n"))
    sums = hist.groupBy(by).agg(
        (F.sum(v * n) / F.sum(known)).alias("mean"),
        *[F.percentile(v, F.lit(q), n).alias(name) for name, q in (("median", 0.5), ("p20", 0.2), ("p80", 0.8))],
        F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"), F.sum(n).cast("double").alias("total"), F.coalesce(F.sum(known), F.lit(0)).cast("double").alias("valid"),
    )
    apart = hist.join(sums.select(by, "mean"), by).groupBy(by).agg(F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum(known)).alias("std"))
    return sums.join(apart, by).select(by, *MEASURES)


def histogram_warnings(hist: DataFrame) -> DataFrame:
    """L7 from a histogram: (by, mean, std, wide, outliers)."""
    by = hist.columns[0]
    stats = histogram_stats(hist).select(by, "mean", "std")
    far = hist.join(stats, by).groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("v") > F.col("mean") + 3 * F.col("std"), F.col("n"))), F.lit(0)).alias("outliers"))
    return stats.join(far, by).select(by, "mean", "std", "outliers", (F.col("std") > 2 * F.col("mean")).alias("wide"))


def length_sketch(df: DataFrame, value: Column, by: str) -> DataFrame:
    """(by, sketch): mergeable quantile sketches, where lengths are too many for a histogram."""
    return df.select(by, value.cast("long").alias("v")).groupBy(by).agg(F.kll_sketch_agg_bigint("v").alias("sketch"))


def sketch_percentiles(*sketches: DataFrame) -> DataFrame:
    """(by, median, p20, p80), approximate, of one or several tables of sketches together."""
    by = sketches[0].columns[0]
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    merged = out.groupBy(by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(by, *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(name) for name, q in (("median", 0.5), ("p20", 0.2), ("p80", 0.8))])


def length_warnings(df: DataFrame, text: str, key: str = "key") -> DataFrame:
    """(key, warning): no or few words or characters, much white space."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, c = word_count(t), F.char_length(t)
    white = F.char_length(F.regexp_replace(t, r"\S+", "")) / F.greatest(c, F.lit(1))
    found = F.array_compact(
        F.array(
            F.when(w == 0, F.lit("no_words")).when(w < 10, F.lit("few_words")),
            F.when(c == 0, F.lit("no_chars")).when(c < 50, F.lit("few_chars")),
            F.when(white > 0.3, F.lit("whitespace")),
        )
    )
    return df.select(F.col(key), F.explode(found).alias("warning"))


def distribution_warnings(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, mean, std, wide, outliers): whether std is over twice the mean, and values
    above mean + 3 std.  One row a group is joined back."""
    stats = df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return (
        df.select(by, value).join(stats, by).groupBy(by)
        .agg(F.first("mean").alias("mean"), F.first("std").alias("std"), F.count_if(F.col(value) > F.col("mean") + 3 * F.col("std")).alias("outliers"))
        .withColumn("wide", F.col("std") > 2 * F.col("mean"))
    )


def content_issues(df: DataFrame, text: str, key: str = "key") -> DataFrame:
    """(key, issues): the rules that a text breaks, sorted; a null text is unreadable, and an
    empty one breaks none."""
    t, n = F.col(text), F.char_length(text)
    more_than = lambda pattern, ratio: (n > 0) & (F.regexp_count(t, F.lit(pattern)) / n > ratio)
    # what is left without runs of usual characters: a search for each other one costs six times as much
    special = F.char_length(F.regexp_replace(t, rf"[a-zA-Z0-9{dims.WHITE}.,!?;:'\"-]++", ""))
    rules = {
        "unreadable": t.isNull(),
        "html": F.rlike(t, F.lit("[<>]|&(?:nbsp|lt|gt|amp);")),
        "special_chars": (n > 0) & (special / n > 0.05),
        "control_chars": F.rlike(t, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")),
        "whitespace_run": F.rlike(t, F.lit(f"[{dims.WHITE}]{{5,}}")),
        "non_ascii": more_than(r"[^\x00-\x7F]", 0.1),
        "null_bytes": F.contains(t, F.lit("\x00")),
        "no_sentence_end": (n > 0) & ~F.rlike(t, F.lit("[.!?]")),
        "long_words": (word_count(t) > 0) & (n / F.greatest(word_count(t), F.lit(1)) > 20),
    }
    return df.select(F.col(key), F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in sorted(rules.items())])).alias("issues"))


def health_summary(issues: DataFrame) -> DataFrame:
    """(total, clean, issue_rate, status)."""
    s = issues.agg(F.count("*").alias("total"), F.count_if(F.size("issues") == 0).alias("clean"))
    rate = F.coalesce(F.try_divide(F.col("total") - F.col("clean"), F.col("total")), F.lit(0.0)).cast("double")
    return s.withColumn("issue_rate", rate).withColumn("status", F.when(F.col("issue_rate") < 0.05, "healthy").when(F.col("issue_rate") > 0.1, "alert").otherwise("warning"))


def unpivot_stats(stats: DataFrame, by: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    return stats.unpivot([by], list(measures), "metric", "value")


def compare_baseline(stats: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """(by, metric, value, expected, ok) over both sides; values may differ by 0.1, whole
    ones by nothing; a metric of one side only is not ok."""
    whole = (F.col("expected") == F.floor("expected")) & (F.col("value") == F.floor("value"))
    near = F.when(whole, F.col("value") == F.col("expected")).otherwise(F.abs(F.col("value") - F.col("expected")) <= 0.1)
    return stats.join(expected, [by, "metric"], "full").withColumn("ok", F.coalesce(near, F.lit(False)))
