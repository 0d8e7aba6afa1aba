"""Passage assembly from references and landed segments.

References are rows (ref_id, type, full_ref, ref_list); segments are rows (book, unit, ordinal,
en, heb), the unit being a folio such as ``13b`` or a chapter number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.keys import with_sort_key

FOLIO_TYPES = ("mishnah", "sugya")
VERSE_TYPES = ("biblical story",)
_ONE = r"^(.+?) (\d+[ab]):(\d+)$"
_SAME = r"^(.+?) (\d+[ab]):(\d+)-(\d+)$"
_TWO = r"^(.+?) (\d+[ab]):(\d+)-(\d+[ab]):(\d+)$"


def parse_folio_refs(refs: DataFrame, middle_folios: bool = True) -> tuple[DataFrame, DataFrame]:
    """(spans, rejects): (ref_id, full_ref, folio_pos, book, folio, first, last) rows.

    A single segment, a range in a folio, or a range over folios; a null ``last`` is open.
    Folios between the two ends are whole spans unless ``middle_folios`` is off.
    """
    ref = F.translate(F.trim("full_ref"), "–—", "--")
    g = lambda rx, k: F.regexp_extract(ref, rx, k)
    n = lambda rx, k: g(rx, k).try_cast("int")
    span = lambda book, folio, a, b: F.struct(book.alias("book"), folio.alias("folio"), a.alias("first"), b.alias("last"))
    open_end = F.lit(None).cast("int")
    number = lambda folio: F.regexp_extract(folio, r"^(\d+)", 1).try_cast("int") * 2 + F.when(F.endswith(folio, F.lit("b")), 1).otherwise(0)
    start, stop = number(g(_TWO, 2)), number(g(_TWO, 4))
    name = lambda k: F.concat(F.floor(k / 2).cast("string"), F.when(k % 2 == 1, "b").otherwise("a"))
    between = F.when(stop - start > 1, F.transform(F.sequence(start + 1, stop - 1), lambda k: span(g(_TWO, 1), name(k), F.lit(1), open_end)))
    empty = F.array().cast("array<struct<book:string,folio:string,first:int,last:int>>")
    two = F.concat(
        F.array(span(g(_TWO, 1), g(_TWO, 2), n(_TWO, 3), open_end)), F.coalesce(between, empty) if middle_folios else empty, F.array(span(g(_TWO, 1), g(_TWO, 4), F.lit(1), n(_TWO, 5)))
    )
    spans = (
        F.when(F.rlike(ref, F.lit(_TWO)), two)
        .when(F.rlike(ref, F.lit(_SAME)), F.array(span(g(_SAME, 1), g(_SAME, 2), n(_SAME, 3), n(_SAME, 4))))
        .when(F.rlike(ref, F.lit(_ONE)), F.array(span(g(_ONE, 1), g(_ONE, 2), n(_ONE, 3), n(_ONE, 3))))
    )
    parsed = refs.withColumn("spans", spans)
    good = parsed.where("spans IS NOT NULL").select("ref_id", "full_ref", F.posexplode("spans").alias("folio_pos", "s")).select("ref_id", "full_ref", "folio_pos", "s.book", "s.folio", "s.first", "s.last")
    return good, parsed.where("spans IS NULL").drop("spans")


def chapter_ranges(refs: DataFrame) -> DataFrame:
    """(ref_id, chapter, first, last) of each reference's verse list."""
    v = refs.select("ref_id", F.explode("ref_list").alias("ref"))
    part = lambda k: F.regexp_extract("ref", r"(\d+):(\d+)$", k).try_cast("int")
    v = v.select("ref_id", part(1).alias("chapter"), part(2).alias("verse")).where("chapter IS NOT NULL AND verse IS NOT NULL")
    return v.groupBy("ref_id", "chapter").agg(F.min("verse").alias("first"), F.max("verse").alias("last"))


def _joined(col: str, order: list[str], sep: str) -> Column:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(col, F.lit("")).alias("t")))), lambda x: x["t"])
    return F.array_join(parts, sep)


def assemble_folio(spans: DataFrame, segments: DataFrame, sep: str = "") -> DataFrame:
    """(ref_id, en, heb): segments of each span in order, put together without separator.
    The folio is an equi-join key, so the range is tested within a folio's few segments."""
    s = segments.select("book", F.col("unit").alias("folio"), "ordinal", "en", "heb")
    hit = spans.join(s, ["book", "folio"]).where((F.col("ordinal") >= F.col("first")) & (F.col("last").isNull() | (F.col("ordinal") <= F.col("last"))))
    return hit.groupBy("ref_id").agg(_joined("en", ["folio_pos", "ordinal"], sep).alias("en"), _joined("heb", ["folio_pos", "ordinal"], sep).alias("heb"))


def assemble_verses(refs: DataFrame, segments: DataFrame, sep: str = "") -> DataFrame:
    """(ref_id, en, heb): verses joined by a space within a chapter, chapters by ``sep``;
    the book is the text before the first digit of the full reference."""
    book = refs.select("ref_id", F.trim(F.regexp_extract("full_ref", r"^([^\d]*)", 1)).alias("book"))
    s = segments.select("book", F.col("unit").try_cast("int").alias("chapter"), "ordinal", "en", "heb")
    hit = chapter_ranges(refs).join(book, "ref_id").join(s, ["book", "chapter"]).where("ordinal BETWEEN first AND last")
    chapters = hit.groupBy("ref_id", "chapter").agg(_joined("en", ["ordinal"], " ").alias("en"), _joined("heb", ["ordinal"], " ").alias("heb"))
    return chapters.groupBy("ref_id").agg(_joined("en", ["chapter"], sep).alias("en"), _joined("heb", ["chapter"], sep).alias("heb"))


def assemble_passages(refs: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E5: (passages, rejects): each reference by its type."""
    kind = F.lower("type")
    folio, bad = parse_folio_refs(refs.where(kind.isin(*FOLIO_TYPES)))
    verse = refs.where(kind.isin(*VERSE_TYPES))
    other = refs.where(F.coalesce(~kind.isin(*FOLIO_TYPES, *VERSE_TYPES), F.lit(True)))
    return assemble_folio(folio, segments).unionByName(assemble_verses(verse, segments)), bad.unionByName(other)


def validate_passages(df: DataFrame) -> DataFrame:
    """Add ``errors``: what is wrong with each passage; rows of a null key have all errors
    of the key."""
    rows = df.select(F.struct("*").alias("given"), "key", "content")
    d = with_sort_key(rows)
    chapter = F.try_element_at(F.split("key", "_"), F.lit(3)).try_cast("int")
    checks = {
        "unknown book": F.col("book_order").isNull(),
        "bad chapter": F.coalesce(chapter < 0, F.lit(True)),
        "no section": F.coalesce(F.trim("section") == "", F.lit(True)),
        "no content": ~F.coalesce(F.exists("content", lambda c: F.trim(c) != ""), F.lit(False)),
    }
    return d.select("given.*", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])).alias("errors"))
