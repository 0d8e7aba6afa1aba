"""Search: numbers, facets with similarity, batches, options."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.keys import SORT_COLS, order_numeric_first, with_citation
from scholion.operators.lookup import bridge, facet_filter


def number_occurrences(entities: DataFrame, meta: DataFrame, values: DataFrame, lang: str = "en") -> DataFrame:
    """K1: for each value of ``values`` (value), the passages that mention its number
    entities, with category, unit, context, citation, summary and the value's total."""
    lang = "heb" if lang.startswith("he") else "en"
    numbers = entities.where("entityType = 'Number'").select(
        F.col("key").alias("entity_key"), F.col("display_en_name").alias("value"), F.col("numberCategory").alias("category"), F.col(f"{lang}_unit").alias("unit"), F.col(f"{lang}_context").alias("context")
    )
    hits = numbers.join(values.select(F.lower("value").alias("value")).distinct(), "value", "left_semi")
    occ = bridge(meta, "entity_keys", "entity_key").join(hits, "entity_key").join(meta.select("key", F.col(f"summary_{lang}").alias("summary")), "key")
    occ = with_citation(occ).withColumn("citation", F.col(f"citation_{lang}"))
    total = F.count("*").over(Window.partitionBy("value"))
    return occ.withColumn("total", total).select("value", "total", "category", "unit", "context", "citation", "summary", "key", *SORT_COLS)


def normalize_query_values(df: DataFrame, col: str = "raw") -> DataFrame:
    """K2: add ``value``, the canonical text of a whole number or one-slash fraction (six
    decimals, as stored numbers have), and ``error``: empty, negative, decimal, zero or slash."""
    raw = F.trim(F.coalesce(F.col(col), F.lit("")))
    slashes = F.char_length(raw) - F.char_length(F.replace(raw, F.lit("/"), F.lit("")))
    over, under = (F.trim(F.try_element_at(F.split(raw, "/"), F.lit(k))).try_cast("double") for k in (1, 2))
    digits = F.rlike(raw, F.lit(r"^\d+$"))
    fraction = F.rlike(raw, F.lit(r"^\d+\s*/\s*\d+$"))
    error = (
        F.when(raw == "", "empty")
        .when(F.contains(raw, F.lit("-")), "negative")
        .when(F.contains(raw, F.lit(".")), "decimal")
        .when((slashes > 1) | (F.contains(raw, F.lit("/")) & ~fraction) | (fraction & (under == 0)), "slash")
        .when(~digits & ~fraction, "slash")
        .when((digits & (raw.try_cast("double") == 0)) | (fraction & (over == 0)), "zero")
    )
    number = F.when(digits, raw.try_cast("double")).otherwise(F.try_divide(over, under))
    text = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", number), r"\.?0+$", ""))
    return df.withColumn("error", error).withColumn("value", F.when(error.isNull(), text))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared L2 distance in double."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


#: Query vectors that one pass ranks; more are ranked in blocks of this many.
QUERY_BLOCK = 1000


def vector_rank(vectors: DataFrame, queries: DataFrame, k: int = 100_000) -> DataFrame:
    """K4: (query, key, distance, rank) of the k nearest vectors of each query, ties by key.

    Every query meets every vector: the queries are a stated set, sent as one array of at
    most QUERY_BLOCK vectors at a time, so vectors are scanned in place and only each
    partition's best k rows of a query are shuffled (the rank is cut before the exchange).
    """
    n = queries.count()
    if n == 0:
        return vectors.select(F.lit(0).alias("query"), "key", F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where(F.lit(False))
    blocks = -(-n // QUERY_BLOCK)
    parts = []
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) if blocks > 1 else queries
        sent = block.agg(F.collect_list(F.struct("query", "vector")).alias("asked"))
        parts.append(vectors.crossJoin(F.broadcast(sent)).select("key", F.col("embedding"), F.explode("asked").alias("q")).select(F.col("q.query").alias("query"), "key", squared_distance(F.col("embedding"), F.col("q.vector")).alias("distance")))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(rows: DataFrame, ranking: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """K5: add the rank of each row (null where it has none); order by rank, nulls last."""
    return rows.join(ranking.select(*by, "rank"), list(by), "left").orderBy(F.col("rank").asc_nulls_last(), *by)


def search_passages(meta: DataFrame, max_sources: int, ranking: DataFrame | None = None, **facets: Sequence[str]) -> DataFrame:
    """Faceted search; by similarity where a ranking (key, rank) is given, else in
    canonical order; at most ``max_sources`` rows, none for 0."""
    kept = with_citation(facet_filter(meta, **facets))
    if ranking is None:
        return kept.orderBy(*SORT_COLS, "key").limit(max_sources)
    return kept.join(ranking.select("key", "rank"), "key", "left").orderBy(F.col("rank").asc_nulls_last(), *SORT_COLS, "key").limit(max_sources)


def answer(found: DataFrame, passages: DataFrame, entities: DataFrame) -> DataFrame:
    """K6: search rows with the passage text and the names of the entities they mention."""
    named = bridge(found, "entity_keys", "entity_key").join(entities.select(F.col("key").alias("entity_key"), F.col("display_en_name").alias("name")), "entity_key")
    names = named.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("entity_names"))
    return found.join(passages.select("key", "content"), "key", "left").join(names, "key", "left")


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """K7: the vectors there are and those of new keys; a key keeps its first vector."""
    fresh = new.dropDuplicates(["key"]).join(vectors.select("key"), "key", "left_anti")
    return vectors.select("key", "embedding").unionByName(fresh.select("key", "embedding"))


def run_query_sheet(sheet: DataFrame, vectors: DataFrame) -> DataFrame:
    """K8: (query, key, distance, rank): each query of (query, vector, max_sources) ranked
    and cut at its own number."""
    most = sheet.agg(F.max("max_sources")).first()[0] or 0
    ranked = vector_rank(vectors, sheet.select("query", "vector"), most)
    return ranked.join(F.broadcast(sheet.select("query", "max_sources")) if sheet.count() <= QUERY_BLOCK else sheet.select("query", "max_sources"), "query").where("rank <= max_sources").drop("max_sources")


#: Further option columns of each entity type and their defaults.
OPTION_FIELDS = {
    "Person": {"timePeriod": "No Time Period", "isWoman": False, "isNonJew": False, "isGroup": False},
    "Place": {"placeType": "Other"},
    "Symbol": {"symbolType": "Other"},
}


def select_options(entities: DataFrame, entity_type: str) -> DataFrame:
    """K9: key, names and the type's own fields with defaults."""
    own = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in OPTION_FIELDS.get(entity_type, {}).items()]
    rows = entities.where(F.col("entityType") == entity_type)
    return rows.select("key", "display_en_name", F.coalesce("display_heb_name", F.lit("")).alias("display_heb_name"), *own)


def number_options(entities: DataFrame) -> DataFrame:
    """One option for each number, with all its entity keys; numbers in order."""
    options = (
        entities.where("entityType = 'Number'")
        .groupBy("display_en_name")
        .agg(F.array_sort(F.collect_set("key")).alias("entity_keys"), F.min("key").alias("key"))
    )
    return order_numeric_first(options, "display_en_name")


def expand_selection(options: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, entity_key) of chosen labels; a number's label stands for many keys."""
    keys = F.coalesce(F.col("entity_keys"), F.array("key")) if "entity_keys" in options.columns else F.array("key")
    return options.join(labels.select("label").distinct(), "label").select("label", F.explode(keys).alias("entity_key"))


def with_option_label(df: DataFrame, rtl: bool = False) -> DataFrame:
    """The name of the language with the other in brackets."""
    first, second = ("display_heb_name", "display_en_name") if rtl else ("display_en_name", "display_heb_name")
    a, b = (F.coalesce(F.trim(F.col(c)), F.lit("")) for c in (first, second))
    return df.withColumn("label", F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit(" ("), b, F.lit(")"))))


def book_tree(books: DataFrame) -> DataFrame:
    """(src_type, category, books in canonical order)."""
    listed = F.array_sort(F.collect_list(F.struct("book_order", "en_name")))
    return books.groupBy("src_type", "category").agg(F.transform(listed, lambda b: b["en_name"]).alias("books"), F.min("book_order").alias("first_order")).orderBy("src_type", "first_order")


def rollup_selection(books: DataFrame, selected: DataFrame) -> DataFrame:
    """(src_type, level, label): a fully chosen source type or category is one label,
    other chosen books stand for themselves."""
    chosen = books.join(selected.select("db_name").distinct().withColumn("on", F.lit(1)), "db_name", "left").withColumn("on", F.coalesce("on", F.lit(0)))
    whole = lambda *cols: F.min("on").over(Window.partitionBy(*cols)) == 1
    marked = chosen.withColumn("whole_type", whole("src_type")).withColumn("whole_category", whole("src_type", "category"))
    level = F.when(F.col("whole_type"), "source").when(F.col("whole_category"), "category").otherwise("book")
    label = F.when(F.col("whole_type"), F.col("src_type")).when(F.col("whole_category"), F.col("category")).otherwise(F.col("en_name"))
    return marked.where("on = 1").select("src_type", level.alias("level"), label.alias("label")).distinct()


def selected_source_types(books: DataFrame, selected: DataFrame) -> DataFrame:
    """Source types of the chosen books."""
    return books.join(selected.select("db_name"), "db_name", "left_semi").select("src_type").distinct()

