"""Queries on passages: keys, text, sources, quality (A, C, D, E, L)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion import dims
from scholion.functions import keys, text
from scholion.functions.shared import shared_dir
from scholion.operators import assemble, quality
from scholion.plans.derived import derive, tables
from scholion.plans.registry import query
from scholion.sources import io
from scholion.streaming.ingest import ingest_passages

BOOK_VALUES = ", ".join("(" + ", ".join(("'" + str(x).replace("'", "''") + "'") if isinstance(x, str) else str(x) for x in b) + ")" for b in dims.BOOKS)
#: (VALUES of the registry) AS b(...) for DuckDB.
BOOKS_SQL = f"(VALUES {BOOK_VALUES}) AS b(src_type, book_order, en_name, heb_name, db_name, category)"
WORDS_SQL = "len(string_split_regex(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "passages").withColumn("content", F.array("en_html", "heb_html", F.lit("")))


@query("a2_scan_passages", "SELECT key, en_html AS en FROM passages WHERE text IS NOT NULL")
def a2(spark, sf_dir):
    path = f"{shared_dir(spark)}/a2-{uuid.uuid4().hex}"
    passages(spark, sf_dir).select("key", "content").write.parquet(path)
    return io.scan_passages(spark, path).select("key", F.col("content")[0].alias("en"))


@query("a5_query_sheet", "SELECT CAST(item_id AS STRING) AS query_name, trim(text) AS query_content, 1 + item_id % 5 AS max_sources FROM benchmark WHERE item_id % 3 <> 0 AND trim(text) <> ''")
def a5(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    raw = b.select(
        F.when(F.col("item_id") % 3 != 0, " 1").otherwise("0").alias("BT"), F.lit("x").alias("TN"), F.col("item_id").cast("string").alias("query_name"), F.col("text").alias("query_content"),
        F.lit("a, b").alias("entities"), F.lit("").alias("rels"), (1 + F.col("item_id") % 5).cast("string").alias("max_sources"),
    )
    return io.query_rows(raw).select("query_name", "query_content", F.col("max_sources").cast("long").alias("max_sources"))


@query("a6_ingest", "SELECT key, min(doc_id) AS doc_id, substring(key, 1, 2) AS src_type FROM passages WHERE substring(key, 1, 2) IN ('BT', 'TN') AND doc_id % 3 <> 0 GROUP BY key")
def a6(spark, sf_dir):
    p = passages(spark, sf_dir).withColumn("ordinal", F.col("doc_id"))
    rows, _ = ingest_passages(p.unionByName(p), p.where("doc_id % 3 = 0"))
    return rows.select("key", "doc_id", "src_type")


@query("a7_snapshot", "SELECT coll, count(*) AS n FROM (SELECT 'nation' AS coll FROM nation UNION ALL SELECT 'customer' FROM customer) GROUP BY coll")
def a7(spark, sf_dir):
    return io.snapshot_tables(tables(spark, sf_dir, "nation", "customer")).where("data LIKE '{%}'").groupBy("coll").agg(F.count("*").alias("n"))


@query("a4_merge_lists", "SELECT CASE c_custkey % 3 WHEN 0 THEN 'person_to_merge.csv' ELSE 'place_to_merge.csv' END AS list, CASE c_custkey % 3 WHEN 0 THEN 'Person' ELSE 'Place' END AS entity_type, c_name AS final_name, c_name || '|' || CAST(c_custkey AS STRING) AS names, count(*) AS n FROM customer WHERE c_custkey % 3 < 2 GROUP BY ALL")
def a4(spark, sf_dir):
    """Lists with a header, blank rows and a file of no type, from customers; a row twice is two."""
    c = tables(spark, sf_dir, "customer")["customer"]
    name = F.element_at(F.array(F.lit("person_to_merge.csv"), F.lit("Place_to_merge.csv"), F.lit("other.csv")), (F.col("c_custkey") % 3 + 1).cast("int"))
    line = F.concat("c_name", F.lit(","), "c_name", F.lit("|"), "c_custkey", F.lit(",\n,,\n"))
    files = c.select(name.alias("list"), line.alias("line")).groupBy("list").agg(F.concat(F.lit("final_display_name,display_names_to_join,merged\r\n"), F.array_join(F.collect_list("line"), "")).alias("value"))
    rows, _ = io.parse_merge_lists(files)
    return rows.groupBy(F.lower("list").alias("list"), "entity_type", "final_name", "names").agg(F.count("*").alias("n"))


@query("a9_append", "SELECT n_nationkey, n_name, 2 AS n FROM nation")
def a9(spark, sf_dir):
    path = f"{shared_dir(spark)}/a9-{uuid.uuid4().hex}"
    nation = tables(spark, sf_dir, "nation")["nation"]
    for _ in range(2):
        io.append_rows(nation, path, ("n_regionkey",))
    return spark.read.parquet(path).groupBy("n_nationkey", "n_name").agg(F.count("*").alias("n"))


@query("a8_glossary", "SELECT DISTINCT lower(p_name) AS term, '' AS translation, '' AS notes FROM part")
def a8(spark, sf_dir):
    return io.glossary(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower("p_name").alias("term")))


@query("c1_key_parts", "SELECT key, substring(key, 1, 2) AS src_type, split_part(key, '_', 2) AS book, CAST(split_part(key, '_', 3) AS INTEGER) AS chapter, split_part(key, '_', 4) AS section FROM passages")
def c1(spark, sf_dir):
    return keys.with_key_parts(passages(spark, sf_dir)).select("key", "src_type", "book", "chapter", "section")


@query("c1_compose_key", "SELECT key, CASE WHEN split_part(key, '_', 4) = '' THEN key || '_no section' ELSE key END AS composed FROM passages")
def c1b(spark, sf_dir):
    p = keys.with_key_parts(passages(spark, sf_dir))
    return p.select("key", keys.compose_key(F.col("src_type"), F.col("book"), F.col("chapter"), F.col("section")).alias("composed"))


SECTION_SQL = """
WITH p AS (SELECT key, substring(key, 1, 2) AS src_type, split_part(key, '_', 2) AS book, split_part(split_part(key, '_', 4), '-', 1) AS start FROM passages),
k AS (SELECT key, src_type, book,
  CASE WHEN src_type = 'BT' THEN CAST(regexp_extract(start, '^(\\d+)', 1) AS INTEGER)
       WHEN src_type = 'TN' THEN CAST(split_part(start, ':', 1) AS INTEGER) ELSE 0 END AS s1,
  CASE WHEN src_type = 'BT' THEN CASE WHEN contains(start, 'b') THEN 1 ELSE 0 END WHEN src_type = 'TN' THEN CAST(split_part(start, ':', 2) AS INTEGER) ELSE 0 END AS s2,
  CASE WHEN src_type = 'BT' THEN CAST(split_part(start, ':', 2) AS INTEGER) ELSE -1 END AS s3 FROM p),
o AS (SELECT k.*, CASE k.src_type WHEN 'TN' THEN 0 WHEN 'BT' THEN 2 ELSE 3 END AS priority, coalesce(b.book_order, 0) AS book_order
  FROM k LEFT JOIN BOOKS ON k.book = b.db_name)
""".replace("BOOKS", BOOKS_SQL)


@query("c2_canonical_order", SECTION_SQL + "SELECT key, priority AS sort_priority, book_order AS sort_book, s1, s2 FROM o")
def c2(spark, sf_dir):
    d = keys.with_sort_key(passages(spark, sf_dir))
    return d.select("key", "sort_priority", "sort_book", F.col("sort_section")[0].alias("s1"), F.col("sort_section")[1].alias("s2"))


@query("c2_first_passages", SECTION_SQL + "SELECT key FROM o ORDER BY priority, book_order, s1, s2, s3, key LIMIT 100")
def c2b(spark, sf_dir):
    return keys.order_canonical(passages(spark, sf_dir)).limit(100).select("key")


@query("c6_import_order", SECTION_SQL + "SELECT key FROM o ORDER BY book_order, s1, s2, s3, key LIMIT 100")
def c6(spark, sf_dir):
    return keys.order_import(passages(spark, sf_dir)).limit(100).select("key")


@query(
    "c7_citations",
    f"""SELECT p.key, trim(coalesce(b.en_name, split_part(p.key, '_', 2)) || coalesce(' (' || b.category || ')', '') || ' ' ||
      CASE WHEN split_part(p.key, '_', 4) <> '' THEN split_part(p.key, '_', 4) WHEN split_part(p.key, '_', 3) <> '0' THEN split_part(p.key, '_', 3) ELSE '' END) AS citation_en,
      trim(CASE WHEN split_part(p.key, '_', 4) <> '' THEN split_part(p.key, '_', 4) WHEN split_part(p.key, '_', 3) <> '0' THEN split_part(p.key, '_', 3) ELSE '' END || ' ' ||
      coalesce(b.heb_name, split_part(p.key, '_', 2)) || coalesce(' (' || b.category || ')', '')) AS citation_heb
    FROM passages p LEFT JOIN {BOOKS_SQL} ON split_part(p.key, '_', 2) = b.db_name""",
)
def c7(spark, sf_dir):
    return keys.with_citation(passages(spark, sf_dir)).select("key", "citation_en", "citation_heb")


@query("c9_numeric_first", "SELECT DISTINCT display_en_name AS value FROM entities WHERE key LIKE 'P%' ORDER BY TRY_CAST(value AS DOUBLE) IS NULL, TRY_CAST(value AS DOUBLE), value LIMIT 60")
def c9(spark, sf_dir):
    e = derive(spark, sf_dir, "entities").where("key LIKE 'P%'").select(F.col("display_en_name").alias("value")).distinct()
    return keys.order_numeric_first(e, "value").limit(60)


@query("c10_unit_order", "SELECT DISTINCT coalesce(en_unit, '') AS unit FROM entities WHERE entityType = 'Number'")
def c10(spark, sf_dir):
    e = derive(spark, sf_dir, "entities").where("entityType = 'Number'").select(F.coalesce("en_unit", F.lit("")).alias("unit")).distinct()
    return keys.order_by_unit(e)


CATEGORY_VALUES = ", ".join(f"('{c}', {k + 1})" for k, c in enumerate(dims.NUMBER_CATEGORIES))


@query("c11_category_counts", f"SELECT c.category, c.ordinal, count(e.key) AS n FROM (VALUES {CATEGORY_VALUES}) AS c(category, ordinal) LEFT JOIN (SELECT * FROM entities WHERE entityType = 'Number') e ON e.numberCategory = c.category GROUP BY c.category, c.ordinal")
def c11(spark, sf_dir):
    return keys.category_counts(derive(spark, sf_dir, "entities").where("entityType = 'Number'"), "numberCategory")


@query("c12_top_issues", "WITH i AS (SELECT key FROM passages WHERE NOT regexp_matches(key, '^[^_]+_[^_]+_[^_]+_[^_]+$')) SELECT key, greatest(0, (SELECT count(*) FROM i) - 10) AS more FROM i ORDER BY key LIMIT 10")
def c12(spark, sf_dir):
    return keys.top_issues(quality.invalid_keys(passages(spark, sf_dir)))


@query("d1_clean_english")
def d1(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.clean_english(F.col("html")).alias("clean_en"))


@query("d2_clean_hebrew", "SELECT key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(chr(9) || heb_html || ' ' || en_html || ' ' || chr(10), '</?(small|b)>', '', 'g'), '<[^>]+>', ' ', 'g'), ' +', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS clean_heb FROM passages")
def d2(spark, sf_dir):
    return passages(spark, sf_dir).select("key", text.clean_hebrew(F.concat(F.lit("\t"), "heb_html", F.lit(" "), "en_html", F.lit(" \n"))).alias("clean_heb"))


@query("d3_tag_inventory", "SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '</?([a-zA-Z0-9]+)', 1)) AS tag FROM pages) GROUP BY lower(tag)")
def d3(spark, sf_dir):
    return text.tag_inventory(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html")


@query("d4_italic_terms", "SELECT DISTINCT trim(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')) AS term FROM (SELECT unnest(regexp_extract_all(replace(replace(html, '<h1', '<i'), '</h1>', '</i>'), '<i\\b[^>]*>((?:.|\\n)*?)</i>', 1)) AS t FROM pages) WHERE trim(regexp_replace(t, '<[^>]+>', '', 'g')) <> ''")
def d4(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.replace(F.replace("html", F.lit("<h1"), F.lit("<i")), F.lit("</h1>"), F.lit("</i>")).alias("html"))
    return text.italic_terms(pages, "html")


@query("d5_drop_third", "SELECT key, en_html || '|' || heb_html || CASE WHEN doc_id % 5 = 1 THEN '|four' ELSE '' END AS content, doc_id % 5 < 2 AS changed FROM passages")
def d5(spark, sf_dir):
    more = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(""))).when(F.col("doc_id") % 5 == 1, F.array(F.lit(""), F.lit("four"))).otherwise(F.array().cast("array<string>"))
    given = passages(spark, sf_dir).withColumn("content", F.concat(F.array("en_html", "heb_html"), more))
    return text.drop_third_content(given).select("key", F.array_join("content", "|").alias("content"), "changed")


@query("d6_bilingual", "SELECT key, 'English:' || chr(10) || en_html || chr(10) || chr(10) || 'Hebrew:' || chr(10) || heb_html AS passage FROM passages")
def d6(spark, sf_dir):
    return passages(spark, sf_dir).select("key", text.bilingual_passage(F.col("en_html"), F.col("heb_html")).alias("passage"))


@query("d7_update_field", "SELECT key, CASE WHEN lang = 'fr' THEN '' ELSE heb_html END AS heb_html, lang = 'fr' AS changed FROM passages")
def d7(spark, sf_dir):
    return text.update_field(passages(spark, sf_dir), F.col("lang") == "fr", {"heb_html": F.lit("")}).select("key", "heb_html", "changed")


def _segments(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.lit("Book").alias("book"), F.concat((1 + F.floor(F.col("conv_id") / 2)).cast("string"), F.when(F.col("conv_id") % 2 == 0, "a").otherwise("b")).alias("unit"), (F.col("turn") + 1).cast("int").alias("ordinal"), F.col("text").alias("en"), F.col("role").alias("heb"))


@query("e1_folio_refs", "SELECT DISTINCT conv_id AS ref_id, 'Book' AS book, CAST(1 + conv_id // 2 AS STRING) || CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS folio, 1 AS first, 2 AS last FROM conversations")
def e1(spark, sf_dir):
    return assemble.parse_folio_refs(_refs(spark, sf_dir))[0].select("ref_id", "book", "folio", "first", "last")


def _refs(spark, sf_dir):
    return _segments_ids(spark, sf_dir).select(F.col("conv_id").alias("ref_id"), F.lit("Sugya").alias("type"), F.concat(F.lit("Book "), "unit", F.lit(":1–2")).alias("full_ref"))


def _segments_ids(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    return c.withColumn("unit", F.concat((1 + F.floor(F.col("conv_id") / 2)).cast("string"), F.when(F.col("conv_id") % 2 == 0, "a").otherwise("b")))


@query("e3_assemble_folio", "SELECT conv_id AS ref_id, string_agg(text, '' ORDER BY turn, text) AS en, string_agg(role, '' ORDER BY turn, role) AS heb FROM conversations WHERE turn < 2 GROUP BY conv_id")
def e3(spark, sf_dir):
    spans, _ = assemble.parse_folio_refs(_refs(spark, sf_dir))
    return assemble.assemble_folio(spans, _segments(spark, sf_dir))


# All three forms of a reference, one of verses, and two that are rejected; folios of a
# conversation are its id, then the next one's.
FORMS_SQL = """SELECT DISTINCT conv_id AS ref_id, conv_id % 6 AS form, 1 + conv_id // 2 AS page, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM conversations"""


def _formed_refs(spark, sf_dir):
    c = _segments_ids(spark, sf_dir)
    form, nxt = F.col("conv_id") % 6, F.col("conv_id") + 2
    later = F.concat((1 + F.floor(nxt / 2)).cast("string"), F.when(nxt % 2 == 0, "a").otherwise("b"))
    book = lambda *parts: F.concat(F.lit("Book "), *parts)
    one, same, two = book("unit", F.lit(":2")), book("unit", F.lit(":1-2")), book("unit", F.lit(":2—"), later, F.lit(":1"))
    ref = F.when(form == 0, one).when(form == 1, same).when(form == 2, two).when(form == 3, F.lit("Book without place")).otherwise(book("conv_id"))
    kind = F.when(form == 4, "Biblical Story").when(form == 5, "Poem").when(form == 0, "MISHNAH").otherwise("sugya")
    verses = F.when(form == 4, F.array(F.lit("Book 1:1"), F.lit("Book 1:2"), F.lit("Book 3:2"))).otherwise(F.array().cast("array<string>"))
    return c.select(F.col("conv_id").alias("ref_id"), kind.alias("type"), ref.alias("full_ref"), verses.alias("ref_list"))


@query("e1_reference_forms", f"""WITH c AS ({FORMS_SQL}), s AS (SELECT ref_id, form, page || side AS folio, 0 AS pos, CASE form WHEN 1 THEN 1 ELSE 2 END AS first, CASE form WHEN 2 THEN NULL ELSE 2 END AS last FROM c WHERE form < 3
    UNION ALL SELECT ref_id, form, CASE side WHEN 'a' THEN page || 'b' ELSE (page + 1) || 'a' END, 1, 1, NULL FROM c WHERE form = 2 UNION ALL SELECT ref_id, form, (page + 1) || side, 2, 1, 1 FROM c WHERE form = 2)
    SELECT ref_id, folio, pos AS folio_pos, first, last FROM s""")
def e1b(spark, sf_dir):
    """One segment, a range in a folio, a range over folios with the folio between."""
    spans, _ = assemble.parse_folio_refs(_formed_refs(spark, sf_dir).where("type IN ('sugya', 'MISHNAH')"))
    return spans.select("ref_id", "folio", "folio_pos", "first", "last")


@query("e5_forms", f"""WITH c AS ({FORMS_SQL}), t AS (SELECT conv_id, turn + 1 AS n, role FROM conversations),
  h AS (SELECT c.ref_id, 0 AS pos, n, role FROM c JOIN t ON t.conv_id = c.ref_id WHERE (form IN (0, 1, 2) AND n >= CASE form WHEN 1 THEN 1 ELSE 2 END AND (form = 2 OR n <= 2))
    UNION ALL SELECT c.ref_id, 1, n, role FROM c JOIN t ON t.conv_id = c.ref_id + 1 WHERE form = 2 UNION ALL SELECT c.ref_id, 2, n, role FROM c JOIN t ON t.conv_id = c.ref_id + 2 WHERE form = 2 AND n = 1)
  SELECT ref_id, 'passage' AS part, string_agg(role, '' ORDER BY pos, n, role) AS heb FROM h GROUP BY ref_id
  UNION ALL SELECT ref_id, 'reject', NULL FROM c WHERE form IN (3, 5)""")
def e5b(spark, sf_dir):
    """Folios and their rejects: a reference of no form, a type that is not assembled."""
    refs = _formed_refs(spark, sf_dir)
    found, rejects = assemble.assemble_passages(refs.where("type <> 'Biblical Story'"), _segments(spark, sf_dir))
    return found.select("ref_id", F.lit("passage").alias("part"), "heb").unionByName(rejects.select("ref_id", F.lit("reject").alias("part"), F.lit(None).cast("string").alias("heb")))


def _verse_refs(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    refs = F.collect_list(F.concat(F.lit("Book "), (1 + F.col("conv_id")).cast("string"), F.lit(":"), (F.col("turn") + 1).cast("string")))
    return c.groupBy(F.col("conv_id").alias("ref_id")).agg(refs.alias("ref_list")).select("ref_id", F.lit("Biblical Story").alias("type"), F.concat(F.lit("Book "), "ref_id").alias("full_ref"), "ref_list")


@query("e2_chapter_ranges", "SELECT conv_id AS ref_id, 1 + conv_id AS chapter, min(turn) + 1 AS first, max(turn) + 1 AS last FROM conversations GROUP BY conv_id")
def e2(spark, sf_dir):
    return assemble.chapter_ranges(_verse_refs(spark, sf_dir)).select("ref_id", F.col("chapter").cast("long").alias("chapter"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("e4_assemble_verses", "SELECT conv_id AS ref_id, string_agg(text, ' ' ORDER BY turn, text) AS en FROM conversations GROUP BY conv_id")
def e4(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    seg = c.select(F.lit("Book").alias("book"), (1 + F.col("conv_id")).cast("string").alias("unit"), (F.col("turn") + 1).cast("int").alias("ordinal"), F.col("text").alias("en"), F.col("role").alias("heb"))
    return assemble.assemble_verses(_verse_refs(spark, sf_dir), seg).select("ref_id", "en")


@query("e5_assemble_passages", "SELECT conv_id AS ref_id, string_agg(role, '' ORDER BY turn, role) AS heb FROM conversations WHERE turn < 2 GROUP BY conv_id")
def e5(spark, sf_dir):
    return assemble.assemble_passages(_refs(spark, sf_dir).withColumn("ref_list", F.array().cast("array<string>")), _segments(spark, sf_dir))[0].select("ref_id", "heb")


@query("e6_validate", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE key END AS key, CASE WHEN doc_id % 7 = 0 THEN 'unknown book,bad chapter,no section' WHEN key LIKE 'RM%' THEN 'unknown book,no section' ELSE '' END AS errors FROM passages")
def e6(spark, sf_dir):
    given = passages(spark, sf_dir).withColumn("key", F.when(F.col("doc_id") % 7 != 0, F.col("key")))
    return assemble.validate_passages(given).select("doc_id", "key", F.array_join("errors", ",").alias("errors"))


@query("l1_empty_fields", "SELECT key, 'heb_empty' AS \"check\" FROM passages WHERE heb_html = '' UNION ALL SELECT key, 'en_empty' FROM passages WHERE en_html IS NULL OR en_html = ''")
def l1(spark, sf_dir):
    return quality.empty_field_failures(passages(spark, sf_dir))


@query("l2_invalid_keys", "SELECT key FROM passages WHERE NOT regexp_matches(key, '^[^_]+_[^_]+_[^_]+_[^_]+$')")
def l2(spark, sf_dir):
    return quality.invalid_keys(passages(spark, sf_dir))


@query("l3_row_counts", "SELECT substring(key, 1, 2) AS coll, count(*) AS n FROM passages GROUP BY 1")
def l3(spark, sf_dir):
    return quality.row_counts(passages(spark, sf_dir).withColumn("coll", F.substring("key", 1, 2)), "coll")


STATS_SQL = """SELECT lang, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.2), 4) AS p20, round(quantile_cont(v, 0.8), 4) AS p80,
  CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max, round(stddev_pop(v), 4) AS std, CAST(count(*) AS DOUBLE) AS total, CAST(count(v) AS DOUBLE) AS valid
FROM (SELECT lang, {0} AS v FROM documents) GROUP BY lang"""


def _rounded(df):
    return df.select(*[F.round(c, 4).alias(c) if c in ("mean", "median", "p20", "p80", "std") else c for c in df.columns])


@query("l4_word_stats", STATS_SQL.format(WORDS_SQL.format("text")))
def l4(spark, sf_dir):
    return _rounded(quality.word_stats(docs(spark, sf_dir), "text", "lang"))


@query("l4_merged_stats", STATS_SQL.format(WORDS_SQL.format("text")))
def l4b(spark, sf_dir):
    """Statistics of an old and a new batch, merged from their histograms."""
    d, words = docs(spark, sf_dir), F.when(F.col("text").isNotNull(), text.word_count(F.col("text")))
    parts = [quality.length_histogram(d.where(f"doc_id % 3 {op} 0"), words, "lang") for op in ("=", "<>")]
    return _rounded(quality.histogram_stats(quality.merge_histograms(*parts)))


@query("l5_char_stats", STATS_SQL.format("length(text)"))
def l5(spark, sf_dir):
    return _rounded(quality.char_stats(docs(spark, sf_dir), "text", "lang"))


@query(
    "l6_length_warnings",
    f"""WITH d AS (SELECT doc_id, length(text) AS c, {WORDS_SQL.format('text')} AS w, length(regexp_replace(text, '\\S+', '', 'g')) AS s FROM documents)
    SELECT doc_id, 'few_words' AS warning FROM d WHERE w < 10 AND w > 0 UNION ALL SELECT doc_id, 'few_chars' FROM d WHERE c < 50 AND c > 0 UNION ALL SELECT doc_id, 'whitespace' FROM d WHERE s / greatest(c, 1) > 0.3""",
)
def l6(spark, sf_dir):
    return quality.length_warnings(docs(spark, sf_dir), "text", "doc_id")


L7_SQL = "WITH s AS (SELECT lang, avg(n_chars) AS mean, stddev_pop(n_chars) AS std FROM documents GROUP BY lang) SELECT s.lang, round(mean, 4) AS mean, round(std, 4) AS std, std > 2 * mean AS wide, count(*) FILTER (n_chars > mean + 3 * std) AS outliers FROM documents d JOIN s ON d.lang = s.lang GROUP BY s.lang, mean, std"


@query("l7_merged_distribution", L7_SQL)
def l7b(spark, sf_dir):
    d = docs(spark, sf_dir)
    parts = [quality.length_histogram(d.where(f"doc_id % 3 {op} 0"), F.col("n_chars"), "lang") for op in ("=", "<>")]
    found = quality.histogram_warnings(quality.merge_histograms(*parts))
    return found.select("lang", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "wide", "outliers")


@query("l7_distribution", "WITH s AS (SELECT lang, avg(n_chars) AS mean, stddev_pop(n_chars) AS std FROM documents GROUP BY lang) SELECT s.lang, round(mean, 4) AS mean, round(std, 4) AS std, std > 2 * mean AS wide, count(*) FILTER (n_chars > mean + 3 * std) AS outliers FROM documents d JOIN s ON d.lang = s.lang GROUP BY s.lang, mean, std")
def l7(spark, sf_dir):
    d = quality.distribution_warnings(docs(spark, sf_dir), "n_chars", "lang")
    return d.select("lang", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "wide", "outliers")


# every third document gets what a rule looks for
ISSUE_TEXT = "CASE doc_id % 12 WHEN 0 THEN text || ' a < b' WHEN 3 THEN replace(text, 'e', '_') WHEN 6 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') WHEN 9 THEN text || chr(127) || '&lt;' ELSE text END"
ISSUES_SQL = f"""WITH t AS (SELECT doc_id, {ISSUE_TEXT} AS text FROM documents), u AS (SELECT doc_id, text, length(text) AS n, {WORDS_SQL.format('text')} AS w FROM t),
i AS (SELECT doc_id, concat_ws(',',
  CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'control_chars' END,
  CASE WHEN contains(text, '<') OR contains(text, '>') OR contains(text, '&nbsp;') OR contains(text, '&lt;') OR contains(text, '&gt;') OR contains(text, '&amp;') THEN 'html' END,
  CASE WHEN trim(text) <> '' AND n / w > 20 THEN 'long_words' END,
  CASE WHEN text <> '' AND NOT regexp_matches(text, '[.!?]') THEN 'no_sentence_end' END,
  CASE WHEN n > 0 AND len(regexp_extract_all(text, '[^\\x00-\\x7F]')) / n > 0.1 THEN 'non_ascii' END,
  CASE WHEN n > 0 AND len(regexp_extract_all(text, '[^a-zA-Z0-9\\s.,!?;:''"-]')) / n > 0.05 THEN 'special_chars' END,
  CASE WHEN regexp_matches(text, '\\s{{5,}}') THEN 'whitespace_run' END) AS issues FROM u)
"""


def _with_issues(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", F.expr(ISSUE_TEXT))


@query("l8_content_issues", ISSUES_SQL + "SELECT doc_id, issues FROM i")
def l8(spark, sf_dir):
    return quality.content_issues(_with_issues(spark, sf_dir), "text", "doc_id").select("doc_id", F.array_join("issues", ",").alias("issues"))


@query("l9_health", ISSUES_SQL + ", s AS (SELECT count(*) AS total, count(*) FILTER (issues = '') AS clean, (count(*) - count(*) FILTER (issues = '')) / count(*) AS r FROM i) SELECT total, clean, round(r, 6) AS issue_rate, CASE WHEN r < 0.05 THEN 'healthy' WHEN r > 0.1 THEN 'alert' ELSE 'warning' END AS status FROM s")
def l9(spark, sf_dir):
    return quality.health_summary(quality.content_issues(_with_issues(spark, sf_dir), "text", "doc_id")).withColumn("issue_rate", F.round("issue_rate", 6))


@query("l10_compare_baseline", "SELECT lang, 'max' AS metric, CAST(max(n_chars) AS DOUBLE) AS value, CAST(max(n_chars) AS DOUBLE) + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS expected, lang <> 'fr' AS ok FROM documents GROUP BY lang UNION ALL SELECT lang, 'total', CAST(count(*) AS DOUBLE), NULL, FALSE FROM documents GROUP BY lang")
def l10(spark, sf_dir):
    d = docs(spark, sf_dir)
    stats = quality.unpivot_stats(quality.char_stats(d, "text", "lang"), "lang", ["max", "total"])
    expected = d.groupBy("lang").agg((F.max("n_chars") + F.when(F.col("lang") == "fr", 1).otherwise(0)).cast("double").alias("expected")).withColumn("metric", F.lit("max"))
    return quality.compare_baseline(stats, expected, "lang")
