"""Engine tables derived from the given star-schema tables, in SQL that Spark and DuckDB share.

People are customers and suppliers, numbers and symbols are parts, nations and regions are
nations and places; foreign keys and key arithmetic give the rels; orders are passages that
mention their customer, suppliers and parts; documents are passages with text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PK = """CASE o_orderkey % 3
  WHEN 0 THEN 'BT_Shabbat_0_' || CAST(2 + o_orderkey % 100 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END || ':' || CAST(o_orderkey AS STRING)
  WHEN 1 THEN 'TN_Genesis_0_' || CAST(1 + o_orderkey % 50 AS STRING) || ':' || CAST(o_orderkey AS STRING) || '-' || CAST(o_orderkey + 3 AS STRING)
  ELSE 'TN_Exodus_0_' || CAST(1 + o_orderkey % 40 AS STRING) || ':' || CAST(o_orderkey AS STRING) END"""

DERIVED = {
    "entities": """
SELECT 'C' || CAST(c_custkey AS STRING) AS key, 'Person' AS entityType, lower(c_name) AS display_en_name,
       CASE WHEN c_custkey % 3 = 0 THEN 'heb ' || CAST(c_custkey AS STRING) ELSE '' END AS display_heb_name,
       CASE c_custkey % 4 WHEN 0 THEN 'Tanach' WHEN 1 THEN 'Tanaim' WHEN 2 THEN 'Amoraim' ELSE NULL END AS timePeriod,
       c_custkey % 2 = 1 AS isWoman, c_acctbal < 0 AS isNonJew, c_custkey % 10 = 0 AS isGroup,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'King' WHEN 'BUILDING' THEN 'Prophet' WHEN 'AUTOMOBILE' THEN 'Judge' ELSE 'Kohen' END AS role,
       CAST(NULL AS STRING) AS numberCategory, CAST(NULL AS STRING) AS en_unit, CAST(NULL AS STRING) AS en_context,
       CAST(NULL AS STRING) AS heb_unit, CAST(NULL AS STRING) AS heb_context, CAST(NULL AS STRING) AS placeType, CAST(NULL AS STRING) AS symbolType
FROM customer
UNION ALL
SELECT 'S' || CAST(s_suppkey AS STRING), 'Person', lower(s_name), '', 'Tanach', FALSE, s_acctbal < 0, FALSE, 'Tanna', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
UNION ALL
SELECT 'N' || CAST(n_nationkey AS STRING), 'Nation', lower(n_name), 'heb', NULL, FALSE, FALSE, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
UNION ALL
SELECT 'R' || CAST(r_regionkey AS STRING), 'Place', lower(r_name), '', NULL, FALSE, FALSE, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN r_regionkey % 2 = 0 THEN 'City' ELSE NULL END, NULL FROM region
UNION ALL
SELECT 'P' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 4 THEN 'Symbol' ELSE 'Number' END,
       CASE WHEN p_partkey % 5 = 4 THEN p_name || ' ' || CAST(p_partkey AS STRING) ELSE CAST(p_size AS STRING) END,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'heb' END, NULL, FALSE, FALSE, FALSE, NULL,
       CASE p_partkey % 6 WHEN 0 THEN 'Time' WHEN 1 THEN 'People' WHEN 2 THEN 'Measurement' WHEN 3 THEN 'Sacrifice' WHEN 4 THEN 'Money' ELSE NULL END,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE lower(p_brand) END, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'u' ELSE '' END, 'c', NULL, CASE WHEN p_partkey % 2 = 0 THEN 'Weapon' ELSE NULL END
FROM part""",
    "rels": """
SELECT 'b' || CAST(c_custkey AS STRING) AS key, 'personBelongsToNation' AS rel_type, 'C' || CAST(c_custkey AS STRING) AS term1, 'N' || CAST(c_nationkey AS STRING) AS term2 FROM customer
UNION ALL SELECT 'd' || CAST(s_suppkey AS STRING), 'personBelongsToNation', 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING) FROM supplier
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'placeToNation', 'R' || CAST(n_regionkey AS STRING), 'N' || CAST(n_nationkey AS STRING) FROM nation
UNION ALL SELECT 'f' || CAST(c_custkey AS STRING), 'childOfFather', 'C' || CAST(c_custkey AS STRING), 'C' || CAST(CAST(floor(c_custkey / 3.0) AS BIGINT) AS STRING) FROM customer WHERE c_custkey > 3
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'childOfMother', 'C' || CAST(c_custkey AS STRING), 'C' || CAST(CAST(floor(c_custkey / 3.0) AS BIGINT) + 1 AS STRING) FROM customer WHERE c_custkey > 3
UNION ALL SELECT 's' || CAST(c_custkey AS STRING), 'spouseOf', 'C' || CAST(c_custkey AS STRING), 'C' || CAST(c_custkey + 1 AS STRING) FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'v' || CAST(c_custkey AS STRING), 'spokeWith', 'C' || CAST(c_custkey AS STRING), 'S' || CAST(c_custkey % 10 AS STRING) FROM customer WHERE c_custkey % 5 = 0""",
    "passage_rows": f"""
SELECT {PK} AS key, 'order ' || CAST(o_orderkey AS STRING) AS summary_en, 'heb order ' || CAST(o_orderkey AS STRING) AS summary_heb,
       CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'LAW' WHEN '2' THEN 'STORY' WHEN '3' THEN 'PHILOSOPHIC' WHEN '4' THEN 'GENEALOGY' ELSE 'PROPHECY' END AS passage_type,
       'b' || CAST(o_custkey AS STRING) AS rel_key
FROM orders""",
    "passage_entity": f"""
SELECT {PK} AS key, 'C' || CAST(o_custkey AS STRING) AS entity_key FROM orders
UNION SELECT {PK}, 'S' || CAST(l_suppkey AS STRING) FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION SELECT {PK}, 'P' || CAST(l_partkey AS STRING) FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "passages": """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'TN_Genesis_0_' || CAST(1 + doc_id % 50 AS STRING) || ':' || CAST(doc_id AS STRING) || '-' || CAST(doc_id + 3 AS STRING)
  WHEN 1 THEN 'BT_Shabbat_0_' || CAST(2 + doc_id % 150 AS STRING) || CASE WHEN doc_id % 8 < 4 THEN 'a' ELSE 'b' END || ':' || CAST(doc_id AS STRING)
  WHEN 2 THEN 'BT_Sotah_0_' || CAST(2 + doc_id % 40 AS STRING) || 'b:' || CAST(doc_id AS STRING)
  ELSE 'RM_Unknown_' || CAST(doc_id AS STRING) END AS key,
  '<p>' || text || '</p>' AS en_html, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<b>' || lang || '</b>' END AS heb_html, text, lang, source
FROM documents""",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; entities get their array columns."""
    sql = DERIVED[name]
    used = sorted(set(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)))
    df = spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", sql), **tables(spark, sf_dir, *used))
    if name == "entities":
        df = df.withColumns({"roles": F.array_compact(F.array("role")), "all_en_names": F.array("display_en_name"), "all_heb_names": F.array_compact(F.array(F.nullif("display_heb_name", F.lit("")))), "alias_keys": F.array().cast("array<string>")}).drop("role")
    return df


MENTIONS = f"""
SELECT {PK} AS key, explode(array('S' || CAST(l_suppkey AS STRING), 'P' || CAST(l_partkey AS STRING))) AS entity_key FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT {PK}, 'C' || CAST(o_custkey AS STRING) FROM orders"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage_entity with repeats, from one join and without a DISTINCT: for those who take sets."""
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", MENTIONS), **tables(spark, sf_dir, "orders", "lineitem"))


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage_rows with the keys of order and customer in place of their rel."""
    sql = DERIVED["passage_rows"].replace("SELECT", "SELECT o_orderkey AS id, o_custkey,", 1)
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), **tables(spark, sf_dir, "orders")).drop("rel_key")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage_meta: (key, source_type, summary_en, summary_heb, passage_types, entity_keys, rel_keys)."""
    ents = mentions(spark, sf_dir).groupBy("key").agg(F.array_sort(F.collect_set("entity_key")).alias("entity_keys"))
    rows = derive(spark, sf_dir, "passage_rows")
    return rows.join(ents, "key").select(
        "key", F.substring("key", 1, 2).alias("source_type"), "summary_en", "summary_heb", F.array("passage_type").alias("passage_types"), "entity_keys", F.array("rel_key").alias("rel_keys")
    )


def with_derived(sql: str) -> str:
    """The SQL with the derived tables that it names in front, for DuckDB."""
    need: list[str] = []
    for n in DERIVED:
        if re.search(rf"\b{n}\b", sql):
            need.append(f"{n} AS ({DERIVED[n]})")
    body = sql.strip()
    if not need:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(need) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(need) + ", " + body[4:]
    return "WITH " + ", ".join(need) + " " + body
