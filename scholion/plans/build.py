"""Queries that build, merge and enrich the graph (F, G, H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F


from scholion.functions import text
from scholion.functions.shared import cut_lineage
from scholion.operators import enrich, extract, merge, resolve
from scholion.plans.derived import derive, meta
from scholion.plans.registry import query

# Extraction rows with faults at fixed intervals, from lineitem and part.
NAME_SQL = "CASE l_linenumber % 4 WHEN 0 THEN 'supplier ' || CAST(l_suppkey AS STRING) WHEN 1 THEN p_name WHEN 2 THEN 'king' ELSE 'dan' END"
MENTION_SQL = f"""SELECT CAST(l_orderkey AS STRING) AS passage, CASE l_linenumber % 4 WHEN 0 THEN 'Person' WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'Symbol' ELSE 'Plant' END WHEN 2 THEN 'Person' ELSE 'TribeOfIsrael' END AS category,
  l_linenumber AS ordinal, {NAME_SQL} AS name FROM lineitem JOIN part ON p_partkey = l_partkey"""
REL_SQL = """SELECT CAST(l_orderkey AS STRING) AS passage, CASE l_partkey % 3 WHEN 0 THEN 'spokeWith' WHEN 1 THEN 'disagreedWith' ELSE 'EnemyOf' END AS rel_field,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ordinal,
  'S' || CAST(l_suppkey % 5 AS STRING) AS term1, 'S' || CAST(l_partkey % 5 AS STRING) AS term2 FROM lineitem"""


def _sql(spark, sf_dir, sql):
    import re

    used = sorted(set(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)))
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", sql), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in used})


def mentions(spark, sf_dir):
    return _sql(spark, sf_dir, MENTION_SQL)


def rel_rows(spark, sf_dir):
    return _sql(spark, sf_dir, REL_SQL)


def _extractions(spark, sf_dir):
    """Extraction documents put together from the mention and rel rows."""
    m = mentions(spark, sf_dir).groupBy("passage", "category").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("items"))
    item = lambda x: F.struct(x["name"].alias("en_name"), F.lit(None).cast("string").alias("number_category"), F.lit(None).cast("string").alias("en_unit"), F.lit(None).cast("string").alias("en_context"))
    e = m.groupBy("passage").agg(F.map_from_entries(F.collect_list(F.struct("category", F.transform("items", item)))).alias("Entities"))
    r = rel_rows(spark, sf_dir).groupBy("passage", "rel_field").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "term1", "term2"))), lambda x: F.struct(x["term1"].alias("term1"), x["term2"].alias("term2"))).alias("items"))
    r = r.groupBy("passage").agg(F.map_from_entries(F.collect_list(F.struct("rel_field", "items"))).alias("Rel"))
    return e.join(r, "passage").withColumnRenamed("passage", "key")


@query("f1_flatten_entities", f"SELECT passage, category, row_number() OVER (PARTITION BY passage, category ORDER BY ordinal, name) - 1 AS ordinal, name FROM ({MENTION_SQL})")
def f1(spark, sf_dir):
    return extract.flatten_entities(_extractions(spark, sf_dir)).select("passage", "category", F.col("ordinal").cast("long").alias("ordinal"), "name")


@query("f2_flatten_rels", f"SELECT passage, rel_field, row_number() OVER (PARTITION BY passage, rel_field ORDER BY ordinal, term1, term2) - 1 AS ordinal, term1, term2 FROM ({REL_SQL})")
def f2(spark, sf_dir):
    return extract.flatten_rels(_extractions(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("f3_rel_types", f"SELECT passage, CASE rel_field WHEN 'EnemyOf' THEN 'enemyOf' ELSE rel_field END AS rel_type, count(*) AS n FROM ({REL_SQL}) GROUP BY 1, 2")
def f3(spark, sf_dir):
    return extract.resolve_rel_type(rel_rows(spark, sf_dir))[0].groupBy("passage", "rel_type").agg(F.count("*").alias("n"))


@query("f4_title_case", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name FROM part")
def f4(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.title_case(F.col("p_name")).alias("name"))


@query("f5_numbers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size AS STRING) || '.5' WHEN 2 THEN '37' ELSE NULL END AS number FROM part")
def f5(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.col("p_size") * 3, F.lit("/3"))).when(k == 1, F.concat("p_size", F.lit(" 1/2"))).when(k == 2, F.lit("Thirty-seven")).otherwise(F.concat("p_name", F.lit("!")))
    return text.normalize_numbers(p.withColumn("raw", raw), "raw").select("p_partkey", "number")


@query("f6_categories", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Money' WHEN c_custkey % 3 = 1 THEN 'Misc' END AS category FROM customer")
def f6(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, "mONEY").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.normalize_category(raw).alias("category"))


UNIT_NAME = "p_name || CASE p_partkey % 6 WHEN 0 THEN 's' WHEN 1 THEN 'ses' WHEN 2 THEN 'zes' WHEN 3 THEN 'ss' WHEN 4 THEN 'ches' ELSE '' END"


@query("f7_units", f"SELECT DISTINCT CASE WHEN regexp_matches(u, '[sz]es$') THEN u[:-2] WHEN regexp_matches(u, 'es$') THEN u[:-3] WHEN regexp_matches(u, '[^s]s$') THEN u[:-2] ELSE u END AS unit FROM (SELECT {UNIT_NAME} AS u FROM part)")
def f7(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(text.normalize_unit(F.upper(F.expr(UNIT_NAME))).alias("unit")).distinct()


@query("f8_contexts", "SELECT doc_id, CASE WHEN len(string_split_regex(trim(text), '\\s+')) <= 6 AND trim(text) <> '' THEN lower(trim(text)) END AS context FROM documents")
def f8(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.check_context(F.col("text")).alias("context"))


TRIBES_SQL = f"SELECT passage, CASE WHEN ordinal % 2 = 0 THEN 'TribeOfIsrael' ELSE category END AS category, ordinal, name FROM ({MENTION_SQL})"


@query("f9_tribes", f"SELECT * FROM ({TRIBES_SQL}) WHERE category <> 'TribeOfIsrael' OR name = 'dan'")
def f9(spark, sf_dir):
    return extract.filter_tribes(_sql(spark, sf_dir, TRIBES_SQL))


@query("f10_demonyms", "SELECT c_custkey AS passage, CASE c_custkey % 3 WHEN 0 THEN 'Egypt' WHEN 1 THEN 'Moab' ELSE c_mktsegment END AS name FROM customer")
def f10(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.when(F.col("c_custkey") % 3 == 0, "egyptians").when(F.col("c_custkey") % 3 == 1, " Moabite").otherwise(F.col("c_mktsegment"))
    return extract.map_demonyms(c.select(F.col("c_custkey").alias("passage"), F.lit("Nation").alias("category"), name.alias("name"))).drop("category")


@query("f11_generic", f"SELECT passage, category, ordinal, name FROM ({MENTION_SQL}) WHERE NOT (category = 'Person' AND name = 'king')")
def f11(spark, sf_dir):
    return extract.drop_generic(mentions(spark, sf_dir))


@query("f12_symbols", f"WITH m AS ({MENTION_SQL}) SELECT * FROM m WHERE NOT (category = 'Symbol' AND EXISTS (SELECT 1 FROM m o WHERE o.passage = m.passage AND o.category = 'Plant' AND lower(o.name) = lower(m.name)))")
def f12(spark, sf_dir):
    return extract.exclude_symbols(mentions(spark, sf_dir))


@query("f13_tribe_persons", f"WITH m AS ({MENTION_SQL}) SELECT passage, category, name FROM m UNION ALL SELECT passage, 'Person', name FROM m WHERE category = 'TribeOfIsrael'")
def f13(spark, sf_dir):
    return extract.add_tribe_persons(mentions(spark, sf_dir)).select("passage", "category", "name")


@query("f14_dedup_entities", f"SELECT passage, category, lower(name) AS name, min(ordinal) AS ordinal FROM ({MENTION_SQL}) GROUP BY passage, category, lower(name)")
def f14(spark, sf_dir):
    return extract.dedup_entities(mentions(spark, sf_dir)).select("passage", "category", F.lower("name").alias("name"), "ordinal")


TERM_ENTS = "SELECT CAST(o_orderkey AS STRING) AS passage, 'Person' AS category, 1 AS ordinal, 'S1' AS name FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT CAST(o_orderkey AS STRING), 'Place', 2, 'S2' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT CAST(o_orderkey AS STRING), 'Person', 3, 'S3' FROM orders WHERE o_orderkey % 4 = 0"


@query(
    "f16_validate_rels",
    f"""WITH e AS ({TERM_ENTS}), r AS ({REL_SQL}), p AS (SELECT DISTINCT passage FROM e)
    SELECT r.passage, r.rel_field, r.ordinal, r.term1, r.term2,
      CASE WHEN p.passage IS NULL THEN NULL WHEN r.term1 = r.term2 THEN 'self_relation' WHEN a.name IS NULL THEN 'missing_term1' WHEN b.name IS NULL THEN 'missing_term2'
           WHEN a.category = 'Place' OR b.category = 'Place' THEN 'type_mismatch' END AS reason
    FROM r LEFT JOIN p ON p.passage = r.passage LEFT JOIN e a ON a.passage = r.passage AND a.name = r.term1 LEFT JOIN e b ON b.passage = r.passage AND b.name = r.term2""",
)
def f16(spark, sf_dir):
    rels = rel_rows(spark, sf_dir)
    known = _sql(spark, sf_dir, TERM_ENTS)
    # terms in other case and in the plural are matched all the same
    plural = lambda c: F.concat(F.lower(c), F.lit("s"))
    out = extract.validate_rels(rels.withColumn("term1", plural("term1")).withColumn("term2", plural("term2")), known)
    back = lambda c: F.upper(F.regexp_replace(c, "s$", ""))
    return out.withColumn("term1", back("term1")).withColumn("term2", back("term2"))


@query("f17_dedup_rels", f"SELECT passage, rel_field, term1, term2, min(ordinal) AS ordinal FROM ({REL_SQL}) GROUP BY ALL")
def f17(spark, sf_dir):
    return extract.dedup_rels(rel_rows(spark, sf_dir))


@query("f18_symmetric", f"SELECT passage, rel_field, least(term1, term2) AS a, greatest(term1, term2) AS b, min(ordinal) AS ordinal FROM ({REL_SQL}) GROUP BY ALL")
def f18(spark, sf_dir):
    return extract.dedup_symmetric(rel_rows(spark, sf_dir)).select("passage", "rel_field", F.least("term1", "term2").alias("a"), F.greatest("term1", "term2").alias("b"), "ordinal")


def _renamed_fields(spark, sf_dir, names):
    k = F.col("ordinal") % len(names)
    field = F.lit(names[0])
    for n, name in enumerate(names):
        field = F.when(k == n, F.lit(name)).otherwise(field)
    return rel_rows(spark, sf_dir).withColumn("rel_field", field)


def _renamed_sql(names):
    cases = " ".join(f"WHEN {n} THEN '{name}'" for n, name in enumerate(names))
    return f"SELECT passage, CASE ordinal % {len(names)} {cases} END AS rel_field, ordinal, term1, term2 FROM ({REL_SQL})"


@query("f19_descendants", f"WITH r AS ({_renamed_sql(['descendantOf', 'childOfFather'])}) SELECT * FROM r WHERE NOT (rel_field = 'descendantOf' AND EXISTS (SELECT 1 FROM r o WHERE o.passage = r.passage AND o.rel_field = 'childOfFather' AND o.term1 = r.term1 AND o.term2 = r.term2))")
def f19(spark, sf_dir):
    return extract.drop_redundant_descendants(_renamed_fields(spark, sf_dir, ["descendantOf", "childOfFather"]))


@query("f20_disagreed", f"WITH r AS ({REL_SQL}) SELECT * FROM r WHERE NOT (rel_field = 'disagreedWith' AND EXISTS (SELECT 1 FROM r o WHERE o.passage = r.passage AND o.rel_field = 'spokeWith' AND ((o.term1 = r.term1 AND o.term2 = r.term2) OR (o.term1 = r.term2 AND o.term2 = r.term1))))")
def f20(spark, sf_dir):
    return extract.drop_overlap_disagreed(rel_rows(spark, sf_dir))


@query("f21_places", f"WITH r AS ({_renamed_sql(['associatedWithPlace', 'visited'])}) SELECT * FROM r WHERE NOT (rel_field = 'associatedWithPlace' AND EXISTS (SELECT 1 FROM r o WHERE o.passage = r.passage AND o.rel_field = 'visited' AND o.term1 = r.term1 AND o.term2 = r.term2))")
def f21(spark, sf_dir):
    return extract.drop_covered_places(_renamed_fields(spark, sf_dir, ["associatedWithPlace", "visited"]))


@query("f22_summaries", "SELECT CAST(item_id AS STRING) AS key, len(string_split_regex(trim(text), '\\s+')) BETWEEN 4 AND 10 AS summary_ok FROM benchmark")
def f22(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("key"), F.col("text").alias("en_summary"), F.col("text").alias("heb_summary"))
    return extract.check_summaries(b).select("key", "summary_ok")


@query("f23_passage_types", "SELECT key, passage_type || CASE WHEN passage_type = 'LAW' THEN '' ELSE ',LAW' END AS types FROM passage_rows")
def f23(spark, sf_dir):
    rows = derive(spark, sf_dir, "passage_rows").select("key", F.array(F.lower("passage_type"), F.lit("no type"), F.lit("law"), F.lit("LAW")).alias("passage_types"))
    return extract.map_passage_types(rows).select("key", F.array_join("passage_types", ",").alias("types"))


@query("f24_stop_nouns", f"SELECT passage, category, ordinal, name FROM ({MENTION_SQL}) WHERE NOT (category = 'Symbol' AND name IN (SELECT p_name FROM part WHERE p_partkey < 20))")
def f24(spark, sf_dir):
    stop = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 20").select(F.lit("Symbol").alias("category"), F.col("p_name").alias("word"))
    return extract.drop_stop_nouns(mentions(spark, sf_dir), stop)


def _long_mentions(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return m.withColumn("import_order", F.col("passage").cast("long")).withColumns({c: F.lit(None).cast("string") for c in ("number_category", "en_unit", "en_context")})


@query("g1_identities", f"SELECT category, lower(name) AS name, count(*) AS mentions FROM ({MENTION_SQL}) GROUP BY category, lower(name)")
def g1(spark, sf_dir):
    return resolve.build_entities(_long_mentions(spark, sf_dir)).select("category", F.lower("name").alias("name"), "mentions")


@query("g3_family_context", "SELECT passage, person, coalesce(string_agg(DISTINCT father, ',' ORDER BY father), '') AS fathers, coalesce(string_agg(DISTINCT mother, ',' ORDER BY mother), '') AS mothers, coalesce(string_agg(DISTINCT spouse, ',' ORDER BY spouse), '') AS spouses FROM (SELECT 'p' AS passage, lower(term1) AS person, lower(term2) AS father, NULL AS mother, NULL AS spouse FROM rels WHERE rel_type = 'childOfFather' UNION ALL SELECT 'p', lower(term1), NULL, lower(term2), NULL FROM rels WHERE rel_type = 'childOfMother' UNION ALL SELECT 'p', lower(term1), NULL, NULL, lower(term2) FROM rels WHERE rel_type = 'spouseOf' UNION ALL SELECT 'p', lower(term2), NULL, NULL, lower(term1) FROM rels WHERE rel_type = 'spouseOf') GROUP BY passage, person")
def g3(spark, sf_dir):
    c = resolve.family_context(derive(spark, sf_dir, "rels").withColumn("passage", F.lit("p")))
    return c.select("passage", "person", *[F.array_join(k, ",").alias(k) for k in ("fathers", "mothers", "spouses")])


@query("g4_stored_context", "WITH named AS (SELECT * FROM rels WHERE rel_type IN ('childOfFather', 'childOfMother', 'spouseOf') AND term1 IN (SELECT key FROM entities) AND term2 IN (SELECT key FROM entities)), both_ways AS (SELECT term1 AS key, rel_type, term2 AS other FROM named UNION ALL SELECT term2, rel_type, term1 FROM named WHERE rel_type = 'spouseOf') SELECT r.key, string_agg(DISTINCT b.display_en_name, ',' ORDER BY b.display_en_name) FILTER (r.rel_type = 'childOfFather') AS fathers, string_agg(DISTINCT b.display_en_name, ',' ORDER BY b.display_en_name) FILTER (r.rel_type = 'childOfMother') AS mothers, string_agg(DISTINCT b.display_en_name, ',' ORDER BY b.display_en_name) FILTER (r.rel_type = 'spouseOf') AS spouses FROM both_ways r JOIN entities b ON b.key = r.other GROUP BY r.key")
def g4(spark, sf_dir):
    c = resolve.stored_family_context(derive(spark, sf_dir, "rels"), derive(spark, sf_dir, "entities"))
    return c.select("key", *[F.nullif(F.array_join(k, ","), F.lit("")).alias(k) for k in ("fathers", "mothers", "spouses")])


def _named_persons(spark, sf_dir):
    """Persons of whom many share a name, with their families."""
    e = derive(spark, sf_dir, "entities").where("key LIKE 'C%'")
    number = F.substring("key", 2, 20).cast("long")
    return e.withColumn("display_en_name", F.concat(F.lit("name "), number % 50))


@query("g5_resolve_persons", """WITH p AS (SELECT key, 'name ' || CAST(CAST(substring(key, 2) AS BIGINT) % 50 AS STRING) AS name FROM entities WHERE key LIKE 'C%'),
  f AS (SELECT r.term1 AS key, b.name AS father FROM rels r JOIN p a ON a.key = r.term1 JOIN p b ON b.key = r.term2 WHERE r.rel_type = 'childOfFather'),
  fam AS (SELECT r.term1 AS key FROM rels r JOIN p a ON a.key = r.term1 JOIN p b ON b.key = r.term2 WHERE r.rel_type = 'childOfFather')
  SELECT n.name, min(p.key) FILTER (f.father = 'name 3' OR p.key NOT IN (SELECT key FROM fam)) AS key FROM (SELECT DISTINCT name FROM p) n JOIN p ON p.name = n.name LEFT JOIN f ON f.key = p.key GROUP BY n.name""")
def g5(spark, sf_dir):
    e = _named_persons(spark, sf_dir)
    empty = F.array().cast("array<string>")
    new = e.select(F.col("display_en_name").alias("name")).distinct().select("name", F.array(F.lit("name 3")).alias("fathers"), empty.alias("mothers"), empty.alias("spouses"))
    return resolve.resolve_persons(new, e, derive(spark, sf_dir, "rels").where("rel_type = 'childOfFather'"))


ORDER_SQL = "5000000 - CAST(substring(key, 2) AS BIGINT) * 7 % 1000"


@query("g5_stored_order", f"""WITH p AS (SELECT key, 'name ' || CAST(CAST(substring(key, 2) AS BIGINT) % 50 AS STRING) AS name, {ORDER_SQL} AS place FROM entities WHERE key LIKE 'C%') SELECT name, arg_min(key, (place, key)) AS key FROM p GROUP BY name""")
def g5b(spark, sf_dir):
    """Mentions without a family are the person of their name that was stored first."""
    e = _named_persons(spark, sf_dir).withColumn("stored_at", F.expr(ORDER_SQL))
    empty = F.array().cast("array<string>")
    new = e.select(F.col("display_en_name").alias("name")).distinct().select("name", empty.alias("fathers"), empty.alias("mothers"), empty.alias("spouses"))
    return resolve.resolve_persons(new, e, derive(spark, sf_dir, "rels"), "stored_at")


@query("g6_tied_by_marriage", """WITH p AS (SELECT CAST(substring(key, 2) AS BIGINT) AS k, key, display_en_name AS name FROM entities WHERE key LIKE 'C%')
  SELECT a.name, a.key FROM p a JOIN p h ON h.k = CAST(floor(a.k / 3.0) AS BIGINT) + 2 WHERE a.k > 3 AND CAST(floor(a.k / 3.0) AS BIGINT) % 2 = 1""")
def g6(spark, sf_dir):
    """Persons by a father who is no stored parent, but the spouse of the stored mother."""
    e = derive(spark, sf_dir, "entities").where("key LIKE 'C%'")
    number = F.substring("key", 2, 20).cast("long")
    father = F.format_string("customer#%09d", F.floor(number / 3) + 2)
    new = e.where(number > 3).select(F.col("display_en_name").alias("name"), F.array(father).alias("fathers"), F.array().cast("array<string>").alias("mothers"), F.array().cast("array<string>").alias("spouses"))
    rels = derive(spark, sf_dir, "rels").where("rel_type IN ('childOfMother', 'spouseOf')")
    return resolve.resolve_persons(new, e, rels).where("key IS NOT NULL")


GRAPH_RELS = """SELECT CAST(l_orderkey AS STRING) AS passage, 'comparedTo' AS rel_field, l_linenumber AS ordinal, 'supplier ' || CAST(l_suppkey AS STRING) AS term1, p_name AS term2, 'comparedTo' AS rel_type
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 4 = 0"""


def _graph(spark, sf_dir):
    m = _long_mentions(spark, sf_dir)
    passages = m.select(F.col("passage").alias("key")).distinct()
    return resolve.build_graph(passages, m, _sql(spark, sf_dir, GRAPH_RELS))


@query(
    "g8_term_keys",
    f"WITH m AS ({MENTION_SQL}), r AS ({GRAPH_RELS}) SELECT DISTINCT passage, term2 AS term, TRUE AS found FROM r WHERE EXISTS (SELECT 1 FROM m WHERE m.name = r.term2)",
)
def g8(spark, sf_dir):
    m = _long_mentions(spark, sf_dir)
    e = cut_lineage(resolve.build_entities(m), "term-entities")
    terms = _sql(spark, sf_dir, GRAPH_RELS).select("passage", F.col("term2").alias("term"))
    keyed = resolve.resolve_term_keys(terms, m, e)
    return keyed.where("key IS NOT NULL").select("passage", "term", F.lit(True).alias("found"))


@query("g9_build_rels", f"WITH r AS ({GRAPH_RELS}), m AS ({MENTION_SQL}) SELECT count(DISTINCT (term1, term2, CASE WHEN EXISTS (SELECT 1 FROM m p WHERE p.passage = r.passage AND p.name = r.term2 AND p.category = 'Symbol') THEN 'Symbol' WHEN EXISTS (SELECT 1 FROM m p WHERE p.passage = r.passage AND p.name = r.term2 AND p.category = 'Plant') THEN 'Plant' WHEN EXISTS (SELECT 1 FROM m p WHERE p.name = r.term2 AND p.category = 'Symbol') THEN 'Symbol' ELSE 'Plant' END)) AS rels FROM r WHERE EXISTS (SELECT 1 FROM m WHERE m.name = r.term2)")
def g9(spark, sf_dir):
    return _graph(spark, sf_dir)["rels"].agg(F.count("*").alias("rels"))


KEYED_SQL = f"""m AS ({MENTION_SQL}), r AS ({GRAPH_RELS}), ids AS (SELECT passage, category, lower(name) AS name, 'e' || substring(sha256(lower(category) || chr(31) || lower(name)), 1, 24) AS key, CASE category WHEN 'Person' THEN 0 WHEN 'TribeOfIsrael' THEN 2 WHEN 'Symbol' THEN 4 ELSE 8 END AS rank FROM m),
  own AS (SELECT passage, name, arg_min(key, (rank, key)) AS key FROM ids GROUP BY passage, name), every AS (SELECT name, arg_min(key, (rank, key)) AS key FROM ids GROUP BY name),
  keyed AS (SELECT r.passage, r.rel_type, r.term1, r.term2, coalesce(a.key, b.key) AS key1, coalesce(c.key, d.key) AS key2 FROM r LEFT JOIN own a ON a.passage = r.passage AND a.name = lower(term1) LEFT JOIN every b ON b.name = lower(term1) LEFT JOIN own c ON c.passage = r.passage AND c.name = lower(term2) LEFT JOIN every d ON d.name = lower(term2))"""


@query("g8_keys", f"WITH {KEYED_SQL} SELECT passage, term1 AS term, key1 AS key FROM keyed UNION SELECT passage, term2, key2 FROM keyed")
def g8b(spark, sf_dir):
    m = _long_mentions(spark, sf_dir)
    rels = _sql(spark, sf_dir, GRAPH_RELS)
    terms = rels.select("passage", F.col("term1").alias("term")).unionByName(rels.select("passage", F.col("term2").alias("term")))
    return resolve.resolve_term_keys(terms, m, cut_lineage(resolve.build_entities(m), "term-entities"))


@query("g9_rels", f"WITH {KEYED_SQL} SELECT DISTINCT 'r' || substring(sha256(rel_type || chr(31) || key1 || chr(31) || key2), 1, 24) AS key, rel_type, key1 AS term1, key2 AS term2 FROM keyed WHERE key1 IS NOT NULL AND key2 IS NOT NULL")
def g9b(spark, sf_dir):
    return _graph(spark, sf_dir)["rels"]


@query("g10_build_meta", f"SELECT passage AS key, string_agg(DISTINCT category || ':' || lower(name), '|' ORDER BY category || ':' || lower(name)) AS entities FROM ({MENTION_SQL}) GROUP BY passage")
def g10(spark, sf_dir):
    g = _graph(spark, sf_dir)
    named = g["entities"].select(F.col("key").alias("entity_key"), F.concat_ws(":", "category", F.lower("name")).alias("name"))
    seen = g["meta"].select("key", F.explode("entity_keys").alias("entity_key")).join(named, "entity_key")
    return seen.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("entities"))


STORED_SQL = """SELECT 'S' || CAST(s_suppkey AS STRING) AS key, 'Person' AS entityType, 'supplier ' || CAST(s_suppkey AS STRING) AS display_en_name, NULL AS numberCategory, NULL AS en_unit, NULL AS en_context FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'T' || CAST(min(r_regionkey) AS STRING), 'TribeOfIsrael', 'Dan', NULL, NULL, NULL FROM region"""
STORED_RELS_SQL = """SELECT 'k' || CAST(s_suppkey AS STRING) AS key, 'childOfFather' AS rel_type, 'S' || CAST(s_suppkey AS STRING) AS term1, 'S2' AS term2 FROM supplier WHERE s_suppkey % 4 = 0"""


@query(
    "g11_build_graph",
    f"""WITH m AS ({MENTION_SQL}), o AS ({STORED_SQL}), f AS ({STORED_RELS_SQL})
    SELECT DISTINCT m.category, lower(m.name) AS name, o.key, o.key IS NULL AS is_new FROM m LEFT JOIN o ON o.entityType = m.category AND lower(o.display_en_name) = lower(m.name)""",
)
def g11(spark, sf_dir):
    """The build beside stored entities: half the suppliers (some with a stored father) and a
    tribe.  Mentions without a family are the first of their name."""
    m = _long_mentions(spark, sf_dir)
    passages = m.select(F.col("passage").alias("key")).distinct()
    g = resolve.build_graph(passages, m, _sql(spark, sf_dir, GRAPH_RELS), _sql(spark, sf_dir, STORED_SQL), _sql(spark, sf_dir, STORED_RELS_SQL))
    return g["entities"].select("category", F.lower("name").alias("name"), F.when(~F.col("is_new"), F.col("key")).alias("key"), "is_new")


NUMBER_SQL = "SELECT p_name AS name, 'Number' AS category, p_brand AS en_unit, p_type AS en_context, CASE WHEN p_partkey % 2 = 0 THEN 'Money' END AS number_category, CAST(p_partkey AS STRING) AS passage, p_partkey AS import_order, 0 AS ordinal FROM part"


@query("g2_number_identity", f"""SELECT 'default' AS kind, lower(en_unit) || '|' || lower(en_context) || '|' || coalesce(lower(number_category), '') AS number, count(*) AS mentions FROM ({NUMBER_SQL}) GROUP BY 2
  UNION ALL SELECT 'strict', lower(en_unit) || '|' || lower(en_context) || '|' || coalesce(lower(number_category), '') || '|' || lower(name), count(*) FROM ({NUMBER_SQL}) GROUP BY 2""")
def g2(spark, sf_dir):
    n = _sql(spark, sf_dir, NUMBER_SQL)
    parts = [F.lower("en_unit"), F.lower("en_context"), F.coalesce(F.lower("number_category"), F.lit(""))]
    both = [resolve.build_entities(n, strict=strict).select(F.lit(kind).alias("kind"), F.concat_ws("|", *parts, *([F.lower("name")] if strict else [])).alias("number"), "mentions") for kind, strict in (("default", False), ("strict", True))]
    return both[0].unionByName(both[1])


@query("g13_deleted", "SELECT count(*) AS deleted FROM entities WHERE placeType = 'City'")
def g13b(spark, sf_dir):
    e = derive(spark, sf_dir, "entities")
    return resolve.deleted_count(e, resolve.delete_where(e, F.col("placeType") == "City"))


@query("g12_upsert", "SELECT key, CASE WHEN CAST(substring(key, 2) AS BIGINT) % 2 = 0 THEN 'new' ELSE display_en_name END AS display_en_name, CASE WHEN CAST(substring(key, 2) AS BIGINT) % 2 = 0 THEN 'updated' ELSE 'kept' END AS op FROM entities WHERE key LIKE 'C%' UNION ALL SELECT 'X' || key, 'new', 'inserted' FROM entities WHERE key LIKE 'S%'")
def g12(spark, sf_dir):
    e = derive(spark, sf_dir, "entities").select("key", "display_en_name", "timePeriod")
    base = e.where("key LIKE 'C%'")
    delta = base.where("CAST(substring(key, 2) AS BIGINT) % 2 = 0").unionByName(e.where("key LIKE 'S%'").withColumn("key", F.concat(F.lit("X"), "key")))
    return resolve.upsert(base, delta.select("key", F.lit("new").alias("display_en_name"))).select("key", "display_en_name", "op")


@query("g13_delete", "SELECT key FROM entities WHERE NOT coalesce(placeType = 'City', FALSE) AND key NOT IN (SELECT term2 FROM rels)")
def g13(spark, sf_dir):
    kept = resolve.delete_where(derive(spark, sf_dir, "entities"), F.col("placeType") == "City")
    return resolve.delete_keys(kept, derive(spark, sf_dir, "rels").select(F.col("term2").alias("key"))).select("key")


def _merge_rows(spark, sf_dir):
    """Lists that join each even customer with the next, with faults at intervals."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 0")
    nxt = F.format_string("Customer#%09d", F.col("c_custkey") + 1)
    return c.select(
        F.lit("person_to_merge.csv").alias("list"), F.col("c_custkey").alias("row"), F.lit("Person").alias("entity_type"),
        F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_name")).alias("final_name"), F.concat_ws("|", F.col("c_name"), F.lit(" "), nxt, F.col("c_name")).alias("names"),
        F.when(F.col("c_custkey") % 8 == 0, "true").alias("merged"),
    )


PLAN_SQL = """SELECT c.c_custkey AS row, CASE WHEN c.c_custkey % 8 = 0 THEN 'merged_already' WHEN c.c_custkey % 10 = 0 THEN 'error' WHEN d.c_custkey IS NULL THEN 'nothing' ELSE 'merge' END AS status
  FROM customer c LEFT JOIN customer d ON d.c_custkey = c.c_custkey + 1 WHERE c.c_custkey % 2 = 0"""


@query("h1_merge_names", "SELECT c_custkey AS row, lower(c_name) AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'customer#' || lpad(CAST(c_custkey + 1 AS STRING), 9, '0') FROM customer WHERE c_custkey % 2 = 0")
def h1(spark, sf_dir):
    return merge.parse_merge_names(_merge_rows(spark, sf_dir)).select("row", "name")


@query("h2_merge_plan", PLAN_SQL)
def h2(spark, sf_dir):
    return merge.plan_merge(_merge_rows(spark, sf_dir), derive(spark, sf_dir, "entities")).select("row", "status")


MAP_SQL = f"m AS (SELECT 'C' || CAST(row + 1 AS STRING) AS dup_key, 'C' || CAST(row AS STRING) AS target_key FROM ({PLAN_SQL}) WHERE status = 'merge')"


@query("h3_merge_targets", f"WITH {MAP_SQL} SELECT * FROM m")
def h3(spark, sf_dir):
    return merge.merge_targets(_merge_rows(spark, sf_dir), derive(spark, sf_dir, "entities")).select("dup_key", "target_key")


@query(
    "h4_fold_entities",
    f"""WITH {MAP_SQL} SELECT e.key, e.isWoman OR coalesce(d.isWoman, FALSE) AS isWoman, CASE WHEN d.key IS NULL THEN '' ELSE d.key END AS alias_keys,
      CASE WHEN coalesce(e.timePeriod, '') = '' THEN d.timePeriod ELSE e.timePeriod END AS timePeriod
    FROM entities e LEFT JOIN m ON m.target_key = e.key LEFT JOIN entities d ON d.key = m.dup_key WHERE e.key NOT IN (SELECT dup_key FROM m)""",
)
def h4(spark, sf_dir):
    e = derive(spark, sf_dir, "entities")
    folded = merge.fold_entities(e, merge.merge_targets(_merge_rows(spark, sf_dir), e))
    return folded.select("key", "isWoman", F.array_join("alias_keys", ",").alias("alias_keys"), "timePeriod")


REPOINT_SQL = f"""WITH {MAP_SQL}, r AS (SELECT r.key, r.rel_type, coalesce(a.target_key, r.term1) AS term1, coalesce(b.target_key, r.term2) AS term2, a.target_key IS NOT NULL OR b.target_key IS NOT NULL AS changed
  FROM rels r LEFT JOIN m a ON a.dup_key = r.term1 LEFT JOIN m b ON b.dup_key = r.term2),
k AS (SELECT *, first_value(key) OVER (PARTITION BY rel_type, term1, term2 ORDER BY changed, key) AS kept FROM r)
"""


@query("h5_repoint_rels", REPOINT_SQL + "SELECT key, rel_type, term1, term2 FROM k WHERE term1 <> term2 AND key = kept")
def h5(spark, sf_dir):
    e = derive(spark, sf_dir, "entities")
    return merge.repoint_rels(derive(spark, sf_dir, "rels"), merge.merge_targets(_merge_rows(spark, sf_dir), e))[0]


@query("h6_repoint_meta", f"WITH {MAP_SQL} SELECT p.key, string_agg(DISTINCT coalesce(m.target_key, p.entity_key), ',' ORDER BY coalesce(m.target_key, p.entity_key)) AS entities FROM passage_entity p LEFT JOIN m ON m.dup_key = p.entity_key GROUP BY p.key")
def h6(spark, sf_dir):
    e = derive(spark, sf_dir, "entities")
    mapping = merge.merge_targets(_merge_rows(spark, sf_dir), e)
    _, rel_map = merge.repoint_rels(derive(spark, sf_dir, "rels"), mapping)
    return merge.repoint_meta(meta(spark, sf_dir), mapping, rel_map).select("key", F.array_join("entity_keys", ",").alias("entities"))


def _chained_rows(spark, sf_dir):
    """The rows above, and after them rows that join every third target with the next one: they
    meet what the first rows left."""
    rows = _merge_rows(spark, sf_dir)
    nxt = F.format_string("customer#%09d", F.col("row") + 2)
    name = F.format_string("customer#%09d", F.col("row"))
    late = rows.where("row % 6 = 2").select("list", (F.col("row") + 1_000_000_000).alias("row"), "entity_type", name.alias("final_name"), F.concat_ws("|", nxt, name).alias("names"), F.lit(None).cast("string").alias("merged"))
    return rows.unionByName(late)


CHAIN_SQL = f"""WITH p AS ({PLAN_SQL}), late AS (SELECT a.c_custkey AS k, b.c_custkey AS nxt FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 2 WHERE a.c_custkey % 6 = 2),
gone AS (SELECT row + 1 AS k FROM p WHERE status = 'merge' UNION ALL SELECT nxt FROM late WHERE nxt IS NOT NULL)
"""


@query("h7_apply_merge", CHAIN_SQL + "SELECT row, CASE WHEN status = 'merge' OR status = 'merged_already' THEN 'true' END AS merged FROM p UNION ALL SELECT k + 1000000000, CASE WHEN nxt IS NOT NULL THEN 'true' END FROM late")
def h7(spark, sf_dir):
    done = merge.apply_merge(derive(spark, sf_dir, "entities"), derive(spark, sf_dir, "rels"), meta(spark, sf_dir), _chained_rows(spark, sf_dir))
    return done["rows"].select("row", "merged")


@query(
    "h7_merged_entities",
    CHAIN_SQL
    + """SELECT e.key, CASE WHEN l.nxt IS NULL THEN CASE WHEN p.row IS NULL THEN '' ELSE 'C' || CAST(p.row + 1 AS STRING) END
        ELSE concat_ws(',', 'C' || CAST(p.row + 1 AS STRING), 'C' || CAST(q.row + 1 AS STRING), 'C' || CAST(l.nxt AS STRING)) END AS alias_keys
      FROM entities e LEFT JOIN p ON e.key = 'C' || CAST(p.row AS STRING) AND p.status = 'merge' LEFT JOIN late l ON e.key = 'C' || CAST(l.k AS STRING)
      LEFT JOIN p q ON q.row = l.nxt AND q.status = 'merge' WHERE e.key NOT IN (SELECT 'C' || CAST(k AS STRING) FROM gone)""",
)
def h7b(spark, sf_dir):
    done = merge.apply_merge(derive(spark, sf_dir, "entities"), derive(spark, sf_dir, "rels"), meta(spark, sf_dir), _chained_rows(spark, sf_dir))
    return done["entities"].select("key", F.array_join("alias_keys", ",").alias("alias_keys"))


@query("h8_tallies", f"SELECT 'person_to_merge.csv' AS list, status, count(*) AS n FROM ({PLAN_SQL}) GROUP BY status UNION ALL SELECT 'person_to_merge.csv', NULL, count(*) FROM ({PLAN_SQL}) UNION ALL SELECT NULL, NULL, count(*) FROM ({PLAN_SQL})")
def h8(spark, sf_dir):
    return merge.merge_tallies(merge.plan_merge(_merge_rows(spark, sf_dir), derive(spark, sf_dir, "entities")))


@query("h8_run_tallies", CHAIN_SQL + """, s AS (SELECT row, CASE WHEN status = 'merge' THEN 'merge' ELSE status END AS status FROM p UNION ALL SELECT k + 1000000000, CASE WHEN nxt IS NOT NULL THEN 'merge' ELSE 'nothing' END FROM late)
    SELECT 'person_to_merge.csv' AS list, status, count(*) AS n FROM s GROUP BY status UNION ALL SELECT 'person_to_merge.csv', NULL, count(*) FROM s UNION ALL SELECT NULL, NULL, count(*) FROM s""")
def h8b(spark, sf_dir):
    """Tallies of a run whose later rows meet what the first ones left."""
    return merge.merge_tallies(merge.replay_merge(_chained_rows(spark, sf_dir), derive(spark, sf_dir, "entities"))[0])


def _patches(spark, sf_dir):
    """Enrichment patches for customers, from labelled documents."""
    d = spark.read.parquet(f"{sf_dir}/labels.parquet")
    none = F.lit(None).cast("string")
    return d.select(
        F.concat(F.lit("p"), "doc_id").alias("passage"), F.col("doc_id").alias("import_order"), F.lit(0).alias("ordinal"), F.concat(F.lit("C"), F.col("doc_id") % 400).alias("key"),
        F.when(F.col("quality") == 1, F.concat(F.lit("heb "), "doc_id")).otherwise("").alias("display_heb_name"), F.when(F.col("doc_id") % 2 == 0, "TANACH").otherwise("nothing").alias("timePeriod"),
        (F.col("toxic") == 1).alias("isWoman"), F.lit(None).cast("boolean").alias("isNonJew"), F.lit(None).cast("boolean").alias("isGroup"), F.array(F.lit("king"), F.lit("cook")).alias("roles"),
        none.alias("heb_unit"), none.alias("heb_context"), none.alias("placeType"), none.alias("symbolType"),
    )


@query("i1_match_enums", "SELECT 'p' || CAST(doc_id AS STRING) AS passage, 'roles' AS field, 'cook' AS value FROM labels UNION ALL SELECT 'p' || CAST(doc_id AS STRING), 'timePeriod', 'nothing' FROM labels WHERE doc_id % 2 = 1")
def i1(spark, sf_dir):
    return enrich.match_enums(_patches(spark, sf_dir))[1].select("passage", "field", "value")


@query(
    "i2_apply_enrichment",
    """WITH l AS (SELECT 'C' || CAST(doc_id % 400 AS STRING) AS key, max(doc_id) FILTER (quality = 1) AS last_name, max(doc_id) FILTER (doc_id % 2 = 0) IS NOT NULL AS tanach, arg_max(toxic = 1, doc_id) AS woman FROM labels GROUP BY 1)
    SELECT e.key, coalesce('heb ' || CAST(l.last_name AS STRING), e.display_heb_name) AS display_heb_name, CASE WHEN l.tanach THEN 'Tanach' ELSE e.timePeriod END AS timePeriod, coalesce(l.woman, e.isWoman) AS isWoman,
      CASE WHEN l.key IS NULL OR e.role = 'King' THEN e.role ELSE e.role || ',King' END AS roles FROM entities e LEFT JOIN l ON l.key = e.key WHERE e.key LIKE 'C%'""",
)
def i2(spark, sf_dir):
    clean, _ = enrich.match_enums(_patches(spark, sf_dir))
    out = enrich.apply_enrichment(derive(spark, sf_dir, "entities").where("key LIKE 'C%'"), clean)
    return out.select("key", "display_heb_name", "timePeriod", "isWoman", F.array_join("roles", ",").alias("roles"))


@query(
    "i3_tally",
    """WITH p AS (SELECT doc_id, 'C' || CAST(doc_id % 400 AS STRING) AS key, CASE WHEN quality = 1 THEN 'heb ' || CAST(doc_id AS STRING) END AS value FROM labels),
    b AS (SELECT p.*, e.key AS known, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY p.key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e.display_heb_name) AS before FROM p LEFT JOIN entities e ON e.key = p.key)
    SELECT CASE WHEN known IS NULL THEN 'missing' WHEN value IS NULL OR value IS NOT DISTINCT FROM before THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM b GROUP BY 1""",
)
def i3(spark, sf_dir):
    return enrich.enrichment_tally(derive(spark, sf_dir, "entities"), _patches(spark, sf_dir))


@query(
    "i3_states",
    """WITH p AS (SELECT doc_id, 'C' || CAST(doc_id % 400 AS STRING) AS key, CASE WHEN quality = 1 THEN 'heb ' || CAST(doc_id AS STRING) END AS heb, CASE WHEN doc_id % 2 = 0 THEN 'Tanach' END AS period, toxic = 1 AS woman FROM labels),
    w AS (SELECT p.*, e.key AS known, e.role, coalesce(last_value(heb IGNORE NULLS) OVER b, e.display_heb_name) AS heb0, coalesce(last_value(period IGNORE NULLS) OVER b, e.timePeriod) AS period0, coalesce(last_value(woman IGNORE NULLS) OVER b, e.isWoman) AS woman0,
      row_number() OVER (PARTITION BY p.key ORDER BY doc_id) AS n FROM p LEFT JOIN entities e ON e.key = p.key WINDOW b AS (PARTITION BY p.key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, CASE WHEN known IS NULL THEN '' ELSE concat_ws(',', CASE WHEN heb IS NOT NULL AND heb IS DISTINCT FROM heb0 THEN 'display_heb_name' END, CASE WHEN period IS NOT NULL AND period IS DISTINCT FROM period0 THEN 'timePeriod' END,
      CASE WHEN woman IS NOT NULL AND woman IS DISTINCT FROM woman0 THEN 'isWoman' END, CASE WHEN n = 1 AND role <> 'King' THEN 'roles' END) END AS changed FROM w)
    SELECT 'p' || CAST(doc_id AS STRING) AS passage, CASE WHEN known IS NULL THEN 'missing' WHEN changed = '' THEN 'unchanged' ELSE 'updated' END AS status, changed FROM c""",
)
def i3b(spark, sf_dir):
    """What each patch changes, all fields, flags and roles, given the patches before it."""
    states = enrich.enrichment_states(derive(spark, sf_dir, "entities"), enrich.match_enums(_patches(spark, sf_dir))[0])
    return states.select("passage", "status", F.array_join("changed", ",").alias("changed"))


@query("i4_display_names", "SELECT 'p' || CAST(doc_id AS STRING) AS passage, e.display_en_name FROM labels LEFT JOIN entities e ON e.key = 'C' || CAST(doc_id % 400 AS STRING)")
def i4(spark, sf_dir):
    return enrich.add_display_names(_patches(spark, sf_dir), derive(spark, sf_dir, "entities")).select("passage", "display_en_name")


@query("i5_worklist", "SELECT DISTINCT p.key FROM passage_entity p JOIN entities e ON e.key = p.entity_key WHERE e.entityType = 'Person' AND (e.display_heb_name = '' OR e.timePeriod IS NULL) OR e.entityType = 'Number' AND (e.display_heb_name = '' OR e.heb_unit = '') OR e.entityType = 'Symbol' AND (e.display_heb_name = '' OR e.symbolType IS NULL)")
def i5(spark, sf_dir):
    work = enrich.enrichment_worklist(meta(spark, sf_dir), derive(spark, sf_dir, "entities"))
    return work.where("todo LIKE '[{%'").select("key")


@query("i6_usage", "WITH u AS (SELECT event_type AS provider, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in, CAST(floor(value) AS BIGINT) AS tokens_out FROM events) SELECT provider, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum((tokens_in * 0.075 + tokens_out * 0.3) / 1e6), 6) AS cost FROM u GROUP BY ROLLUP (provider)")
def i6(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    usage = e.select(F.col("event_type").alias("provider"), F.get_json_object("props", "$.k").cast("long").alias("tokens_in"), F.floor("value").cast("long").alias("tokens_out"))
    prices = usage.select("provider").distinct().select("provider", F.lit(0.075).alias("price_in"), F.lit(0.3).alias("price_out"))
    return enrich.usage_rollup(usage, prices).withColumn("cost", F.round("cost", 6))


