"""Passage keys: parts, canonical order, citations, and ordered results.

A key is ``SRC_book_chapter_section``.  All of this is built-in expressions; the book
registry is a table of fixed size and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion import dims

SORT_COLS = ("sort_priority", "sort_book", "sort_section")


def _part(key: Column, n: int) -> Column:
    return F.try_element_at(F.split(key, "_"), F.lit(n))


def src_type_of(key: Column) -> Column:
    """The two-letter prefix where it names a source type, else null."""
    prefix = F.substring(key, 1, 2)
    return F.when(prefix.isin([s for s, _, _ in dims.SOURCE_TYPES]), prefix)


def with_key_parts(df: DataFrame, key: str = "key") -> DataFrame:
    """Add src_type, book, chapter, section; missing parts are null, '', 0 and ''."""
    k = F.col(key)
    return (
        df.withColumn("src_type", src_type_of(k))
        .withColumn("book", F.coalesce(_part(k, 2), F.lit("")))
        .withColumn("chapter", F.coalesce(_part(k, 3).try_cast("int"), F.lit(0)))
        .withColumn("section", F.coalesce(_part(k, 4), F.lit("")))
    )


def compose_key(src_type: Column, book: Column, chapter: Column, section: Column) -> Column:
    """A key from its parts; empty parts become 'no book', 0 and 'no section'."""
    filled = lambda c, other: F.when(c.isNull() | (c == ""), F.lit(other)).otherwise(c)
    return F.concat_ws("_", src_type, filled(book, "no book"), F.coalesce(chapter, F.lit(0)).cast("string"), filled(section, "no section"))


def section_start(section: Column) -> Column:
    """The text before the first dash of any width."""
    return F.trim(F.substring_index(F.translate(section, "–—", "--"), "-", 1))


def folio_key(section: Column) -> Column:
    """[page, 0 for a or 1 for b, line] of ``14b:5-8``; zeros where it does not parse."""
    start = section_start(section)
    good = F.rlike(start, F.lit(r"^\d+[ab]"))
    number = lambda group: F.coalesce(F.regexp_extract(start, r"^(\d+)([ab])(?::(\d+))?", group).try_cast("int"), F.lit(0))
    side = (F.regexp_extract(start, r"^(\d+)([ab])", 2) == "b").cast("int")
    return F.when(good, F.array(number(1), side, number(3))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))


def verse_key(section: Column) -> Column:
    """C4: [chapter, verse] of ``5:13-6:27``; a bare number is a verse; else zeros."""
    start = section_start(section)
    parts = F.split(start, ":")
    chapter, verse = (F.try_element_at(parts, F.lit(k)).try_cast("int") for k in (1, 2))
    pair = F.when(F.contains(start, F.lit(":")), F.array(chapter, verse)).otherwise(F.array(F.lit(0), start.try_cast("int")))
    return F.when(F.exists(pair, lambda x: x.isNull()), F.array(F.lit(0), F.lit(0))).otherwise(pair)


def digits_key(section: Column) -> Column:
    """All digit runs in order, or [0]."""
    runs = F.transform(F.regexp_extract_all(F.translate(section, "–—", "--"), F.lit(r"\d+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.when(F.size(runs) > 0, runs).otherwise(F.array(F.lit(0)))


def section_key(src_type: Column, section: Column) -> Column:
    """The section as an orderable array of ints, in the style of its source type."""
    return F.when(src_type.isin("BT", "JT"), folio_key(section)).when(src_type.isin("TN", "MS", "RM"), verse_key(section)).otherwise(digits_key(section))


def with_sort_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Add the key's parts, the book's names and category, and SORT_COLS."""
    spark = df.sparkSession
    parts = with_key_parts(df, key)
    b = dims.books(spark).select("book_order", "en_name", "heb_name", F.col("db_name").alias("book"), F.col("category").alias("book_category"))
    priority = F.lit(dims.OTHER_PRIORITY)
    for src, _, p in dims.SOURCE_TYPES:
        priority = F.when(F.col("src_type") == src, p).otherwise(priority)
    return (
        parts.join(F.broadcast(b), "book", "left")
        .withColumn("sort_priority", priority)
        .withColumn("sort_book", F.coalesce("book_order", F.lit(0)))
        .withColumn("sort_section", section_key(F.col("src_type"), F.col("section")))
    )


def order_canonical(df: DataFrame, key: str = "key") -> DataFrame:
    """Display order; ties by key."""
    return with_sort_key(df, key).orderBy(*SORT_COLS, key)


def order_import(df: DataFrame, key: str = "key") -> DataFrame:
    """Import order, which takes no heed of the source type."""
    return with_sort_key(df, key).orderBy("sort_book", "sort_section", key)


def with_citation(df: DataFrame, key: str = "key") -> DataFrame:
    """Add citation_en and citation_heb: book, category in brackets, location (the
    section, else the chapter if it is not 0)."""
    d = with_sort_key(df, key)
    location = F.when(F.col("section") != "", F.col("section")).when(F.col("chapter") != 0, F.col("chapter").cast("string")).otherwise("")
    category = F.when(F.col("book_category").isNotNull(), F.concat(F.lit(" ("), "book_category", F.lit(")"))).otherwise("")
    en, heb = F.coalesce("en_name", "book"), F.coalesce("heb_name", "book")
    return d.withColumn("citation_en", F.trim(F.concat(en, category, F.lit(" "), location))).withColumn("citation_heb", F.trim(F.concat(location, F.lit(" "), heb, category)))


def order_numeric_first(df: DataFrame, col: str) -> DataFrame:
    """Numbers by value, then the rest as text."""
    number = F.col(col).try_cast("double")
    return df.orderBy(number.isNull(), number, col)


def order_by_unit(df: DataFrame, unit: str = "unit") -> DataFrame:
    """Rows with a unit first, by the unit in lower case."""
    return df.orderBy(F.col(unit).isNull() | (F.col(unit) == ""), F.lower(unit))


def category_counts(occ: DataFrame, col: str = "category") -> DataFrame:
    """C11: every number category with its count (0 where absent) and its ordinal."""
    counts = occ.groupBy(F.col(col).alias("category")).agg(F.count("*").alias("n"))
    return F.broadcast(dims.number_categories(occ.sparkSession)).join(counts, "category", "left").select("category", "ordinal", F.coalesce("n", F.lit(0)).alias("n"))


def top_issues(df: DataFrame, n: int = 10, order: str = "key") -> DataFrame:
    """The first ``n`` issues with the number of those not shown."""
    total = df.agg(F.count("*").alias("total"))
    shown = df.orderBy(order).limit(n)
    return shown.crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.lit(0), F.col("total") - n)).drop("total")
