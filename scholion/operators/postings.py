"""Postings of passages: facets and reverse lookups without a scan of arrays.

Passages are numbered in buckets of BUCKET places.  A posting is what one bucket has of one
value of a facet: the places, and where they are many also their bitmap.  Values within a
facet are or-ed, facets are and-ed, bucket by bucket, with Spark's bitmap aggregates; passages
are fetched by testing their bit.  Rows of one value are split by bucket, so a value that a third of
all passages have is as many rows as there are buckets, and none is larger than a bucket.

Files of stored postings are sorted by facet and value: a filter on both skips row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.keys import SORT_COLS, src_type_of, with_citation
from scholion.functions.shared import cut_lineage

#: Bits of Spark's bitmaps, and how many passages a bucket has on average.
BUCKET, FILL = 32768, 12288
#: Postings of so many places or more have a bitmap.
DENSE = 512
#: Groups of passages that a task gathers values of, at most.
GROUPS = 8


def _groups(meta: DataFrame) -> int:
    return max(1, -(-meta.count() // FILL))


def _group(by: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(groups))


def number_passages(meta: DataFrame, by: str = "key") -> DataFrame:
    """Add bucket and place to rows of distinct keys (``by``).

    Keys are dealt to groups by hash and ranked there; a group of FILL keys on average has
    room for two buckets, so that none is overfull.
    """
    dealt = meta.withColumn("group", _group(by, _groups(meta)))
    ranked = dealt.withColumn("rank", F.dense_rank().over(Window.partitionBy("group").orderBy(by)) - 1)
    room = F.when(F.col("rank") < 2 * BUCKET, F.col("rank")).otherwise(F.raise_error(F.lit("a group of passages has more than two buckets")).cast("int"))
    placed = ranked.withColumn("rank", room).withColumn("bucket", (2 * F.col("group") + F.floor(F.col("rank") / BUCKET)).cast("long"))
    return placed.withColumn("place", (F.col("rank") % BUCKET).cast("int")).drop("group", "rank")


def source_and_book(key: Column) -> tuple[Column, Column]:
    return src_type_of(key), F.try_element_at(F.split(key, "_"), F.lit(2))


def facet_pairs(meta: DataFrame) -> DataFrame:
    """(key, facet, value) of metadata: passage types, entities, rels, source type, book."""
    part = lambda facet, values: meta.select("key", F.lit(facet).alias("facet"), values.alias("value"))
    arrays = [part(facet, F.explode(F.array_distinct(c))) for facet, c in (("type", "passage_types"), ("entity", "entity_keys"), ("rel", "rel_keys"))]
    source, book = source_and_book(F.col("key"))
    pairs = part("source", source).unionByName(part("book", book))
    for p in arrays:
        pairs = pairs.unionByName(p)
    return pairs.where("value IS NOT NULL")


def _bits_of(places: Column) -> Column:
    """The bitmap of sorted distinct places: zeros between ones, eight of them a byte, the lowest bit first."""
    ones = F.transform(places, lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1), F.lit("1")))
    octets = F.regexp_extract_all(F.rpad(F.array_join(ones, ""), BUCKET, "0"), F.lit(".{8}"), F.lit(0))
    return F.unhex(F.array_join(F.transform(octets, lambda o: F.lpad(F.conv(F.reverse(o), 2, 16), 2, "0")), ""))


def build_postings(pairs: DataFrame, numbered: DataFrame, by: str = "key", items: Column | None = None) -> DataFrame:
    """(facet, value, bucket, n, places, bits) of (key, facet, value) and all numbered passages.

    Rows go to the group of their passage, where they meet its number and values are gathered: one exchange for all.
    Where rows are more than pairs, ``items`` makes an array of (facet, value) of each after that exchange, from its
    columns; numbered passages are then such rows too, so what a passage has by itself is not shuffled a second time.
    """
    groups = _groups(numbered)
    own = numbered if items is not None else numbered.select(by, "bucket", "place")
    items = F.array(F.struct("facet", "value")) if items is None else items
    rows = pairs.unionByName(own, allowMissingColumns=True).where(F.col(by).isNotNull()).withColumn("group", _group(by, groups))
    # more groups in a task would not fit its memory
    usual, parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // GROUPS
    rows = rows.repartition(parts, "group") if parts > usual else rows.repartition("group")
    passage = Window.partitionBy("group", by)
    met = rows.withColumns({c: F.max(c).over(passage) for c in ("bucket", "place")}).where("bucket IS NOT NULL")
    right = F.when(F.floor(F.col("bucket") / 2) == F.col("group"), F.col("bucket")).otherwise(F.raise_error(F.lit("not all of the numbered passages")).cast("long"))
    at = met.select("group", right.alias("bucket"), "place", F.inline(items).alias("facet", "value")).where("value IS NOT NULL")
    counted = at.groupBy("group", "facet", "value", "bucket").agg(F.array_sort(F.collect_set("place")).alias("places")).withColumn("n", F.size("places"))
    return counted.select("facet", "value", "bucket", "n", "places", F.when(F.col("n") >= DENSE, _bits_of(F.col("places"))).alias("bits"))


def store_postings(postings: DataFrame, label: str = "postings") -> DataFrame:
    """The postings as a stored table, whose files are sorted by facet and value."""
    return cut_lineage(postings.sortWithinPartitions("facet", "value", "bucket"), label)


def _bitmaps(postings: DataFrame) -> DataFrame:
    """(facet, bucket, bits): the union of the rows of a facet, bucket by bucket."""
    sparse = postings.where("bits IS NULL").select("facet", "bucket", F.explode("places").alias("place"))
    sparse = sparse.groupBy("facet", "bucket").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    return sparse.unionByName(postings.where("bits IS NOT NULL").select("facet", "bucket", "bits")).groupBy("facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def matching(postings: DataFrame, facets: dict[str, Sequence[str] | DataFrame]) -> DataFrame:
    """(bucket, bits) of the passages that have a value of every facet that is asked for."""
    asked = {f: v for f, v in facets.items() if v}
    wanted = F.lit(False)
    for facet, values in asked.items():
        if not isinstance(values, DataFrame):
            wanted = wanted | ((F.col("facet") == facet) & F.col("value").isin(*values))
    kept = postings.where(wanted)
    for facet, values in asked.items():
        if isinstance(values, DataFrame):
            kept = kept.unionByName(postings.where(F.col("facet") == facet).join(values.select("value").distinct(), "value", "left_semi"))
    found = _bitmaps(kept).groupBy("bucket").agg(F.count("*").alias("facets"), F.bitmap_and_agg("bits").alias("bits"))
    return found.where(F.col("facets") == len(asked)).select("bucket", "bits")


def has_bit(bits: Column, place: Column) -> Column:
    """Whether a bitmap has a place: byte place / 8, its lowest bit first."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), place % 8)) != 0


def facet_passages(postings: DataFrame, numbered: DataFrame, **facets: Sequence[str] | DataFrame) -> DataFrame:
    """Numbered passages by type, entity, rel, source and book: any value within a
    facet, every facet that has values; all of them where none has.  Values are a list or, where
    there are many, a table (value), of which every row counts as asked for."""
    if not any(facets.values()):
        return numbered
    hits = matching(postings, facets)
    return numbered.join(hits, "bucket").where(has_bit(F.col("bits"), F.col("place"))).drop("bits")


def places_of(postings: DataFrame, keys: DataFrame, facet: str) -> DataFrame:
    """(value, bucket, place) of each value of ``keys`` (value)."""
    kept = postings.where(F.col("facet") == facet).join(keys.select("value").distinct(), "value", "left_semi")
    return kept.select("value", "bucket", F.explode("places").alias("place"))


def passages_with(postings: DataFrame, numbered: DataFrame, keys: DataFrame, facet: str = "entity") -> DataFrame:
    """(wanted, key): the passages that have each value of ``keys`` (key)."""
    at = places_of(postings, keys.select(F.col("key").alias("value")), facet)
    return at.join(numbered.select("bucket", "place", "key"), ["bucket", "place"]).select(F.col("value").alias("wanted"), "key")


def number_occurrences(postings: DataFrame, numbered: DataFrame, entities: DataFrame, values: DataFrame, lang: str = "en") -> DataFrame:
    """K1: for each value of ``values`` (value), the passages that mention its number entities,
    with category, unit, context, citation, summary and the value's total."""
    lang = "heb" if lang.startswith("he") else "en"
    numbers = entities.where("entityType = 'Number'").select(
        F.col("key").alias("entity_key"), F.col("display_en_name").alias("number"), F.col("numberCategory").alias("category"), F.col(f"{lang}_unit").alias("unit"), F.col(f"{lang}_context").alias("context")
    )
    hits = numbers.join(values.select(F.lower("value").alias("number")).distinct(), "number", "left_semi")
    at = places_of(postings, hits.select(F.col("entity_key").alias("value")), "entity").withColumnRenamed("value", "entity_key")
    occ = at.join(hits, "entity_key").join(numbered.select("bucket", "place", "key", F.col(f"summary_{lang}").alias("summary")), ["bucket", "place"])
    total = occ.groupBy("number").agg(F.count("*").alias("total"))
    occ = with_citation(occ.join(total, "number")).withColumn("citation", F.col(f"citation_{lang}"))
    return occ.select(F.col("number").alias("value"), "total", "category", "unit", "context", "citation", "summary", "key", *SORT_COLS)


def search_passages(postings: DataFrame, numbered: DataFrame, max_sources: int, ranking: DataFrame | None = None, **facets: Sequence[str]) -> DataFrame:
    """Faceted search; by similarity where a ranking (key, rank) is given, else in
    canonical order; at most ``max_sources`` rows, none for 0."""
    kept = with_citation(facet_passages(postings, numbered, **facets))
    if ranking is None:
        return kept.orderBy(*SORT_COLS, "key").limit(max_sources)
    return kept.join(ranking.select("key", "rank"), "key", "left").orderBy(F.col("rank").asc_nulls_last(), *SORT_COLS, "key").limit(max_sources)
