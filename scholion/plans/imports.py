"""The import of extraction documents as one query."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.shared import cut_lineage
from scholion.operators import imports
from scholion.plans.derived import PK
from scholion.plans.registry import query
from scholion.sources import io

# One extraction document an order, its entities and rels from the order's lines, with faults at
# fixed intervals.
LINES = f"""SELECT {PK.replace('o_orderkey', 'l_orderkey')} AS passage, l_orderkey, l_partkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn, l_suppkey % 9 AS f, 'supplier ' || CAST(l_suppkey % 3 AS STRING) AS who FROM lineitem"""
ENT_COLS = """  CASE (l_orderkey + rn) % 10 WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'Plant' ELSE 'Symbol' END WHEN 3 THEN 'TribeOfIsrael' WHEN 4 THEN 'Nation' WHEN 5 THEN 'Number' WHEN 6 THEN CASE WHEN l_partkey % 2 = 0 THEN 'TribeOfIsrael' ELSE 'Junk' END WHEN 7 THEN 'Animal' WHEN 9 THEN 'Symbol' ELSE 'Person' END AS category,
  CASE (l_orderkey + rn) % 10 WHEN 0 THEN who WHEN 1 THEN 'fig tree' WHEN 2 THEN 'King' WHEN 3 THEN 'dan' WHEN 4 THEN 'egyptians' WHEN 5 THEN CASE l_partkey % 4 WHEN 0 THEN 'many' WHEN 1 THEN '3/4' WHEN 2 THEN 'thirty seven' ELSE '1,000' END
    WHEN 6 THEN 'atlantis' WHEN 7 THEN ' ' WHEN 8 THEN 'DAN''s son' ELSE 'FIG tree' END AS raw,
  CASE l_partkey % 3 WHEN 0 THEN 'mONEY' WHEN 1 THEN 'People' ELSE 'what' END AS number_category, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'cubits' END AS en_unit,
  CASE WHEN l_partkey % 7 = 0 THEN 'a b c d e f g' ELSE 'Yard ' || CAST(l_partkey % 4 AS STRING) END AS en_context"""
REL_COLS = """  CASE f WHEN 0 THEN 'spokeWith' WHEN 1 THEN 'spokeWith' WHEN 2 THEN 'disagreedWith' WHEN 4 THEN 'associatedWithPlace' WHEN 5 THEN 'oddRel' WHEN 7 THEN 'EnemyOf' WHEN 8 THEN 'childOfFather' ELSE 'comparedTo' END AS rel_field,
  CASE f WHEN 0 THEN upper(who) WHEN 1 THEN 'dan' WHEN 3 THEN 'fig trees' WHEN 6 THEN '' WHEN 8 THEN 'dan' ELSE who END AS term1, CASE f WHEN 1 THEN who WHEN 3 THEN 'egypt' WHEN 4 THEN 'egypt' WHEN 7 THEN 'egypt' ELSE 'dan' END AS term2"""
ENTS, RELS = (f"""SELECT passage, l_orderkey, rn,
{columns} FROM ({LINES})""" for columns in (ENT_COLS, REL_COLS))

IMPORT_SQL = f"""
WITH readable AS (SELECT DISTINCT passage, l_orderkey FROM ({LINES}) WHERE l_orderkey % 13 <> 0),
e0 AS (SELECT passage, rn, category, raw, CASE category WHEN 'Number' THEN CASE raw WHEN '3/4' THEN '0.75' WHEN 'thirty seven' THEN '37' WHEN '1,000' THEN '1000' END ELSE CASE raw WHEN 'egyptians' THEN 'Egypt' WHEN 'fig tree' THEN 'Fig Tree' WHEN 'FIG tree' THEN 'Fig Tree' WHEN 'dan' THEN 'Dan' WHEN 'DAN''s son' THEN 'Dan''s Son' ELSE upper(raw[1]) || raw[2:] END END AS name,
    CASE number_category WHEN 'mONEY' THEN 'Money' WHEN 'People' THEN 'People' ELSE 'Misc' END AS ncat, en_unit, lower(en_context) AS ctx FROM ({ENTS}) WHERE l_orderkey % 13 <> 0 AND l_orderkey % 11 <> 0),
e1 AS (SELECT *, CASE WHEN category = 'Junk' OR trim(raw) = '' THEN 'F1' WHEN category = 'Number' AND name IS NULL THEN 'F5' WHEN category = 'Number' AND en_unit = '' THEN 'F7' WHEN category = 'Number' AND ctx LIKE 'a%' THEN 'F8' WHEN raw = 'atlantis' THEN 'F9' WHEN raw = 'King' THEN 'F11'
    WHEN category = 'Symbol' AND EXISTS (SELECT 1 FROM e0 o WHERE o.passage = e0.passage AND o.category = 'Plant') THEN 'F12' END AS rule FROM e0),
e2 AS (SELECT *, CASE WHEN rule IS NULL AND row_number() OVER (PARTITION BY passage, category, lower(name), rule ORDER BY rn) > 1 THEN 'F14' ELSE rule END AS final FROM e1),
live AS (SELECT passage, category, name, ncat, ctx FROM e2 WHERE final IS NULL UNION ALL SELECT passage, 'Person', name, NULL, NULL FROM e2 WHERE final IS NULL AND category = 'TribeOfIsrael'),
named AS (SELECT passage, name, list(category) AS cats FROM live GROUP BY passage, name),
r0 AS (SELECT r.passage, rn, rel_field, CASE rel_field WHEN 'EnemyOf' THEN 'enemyOf' ELSE rel_field END AS rel_type, term1 || ' -> ' || term2 AS raw, r.passage IN (SELECT passage FROM live) AS peopled,
    CASE WHEN rel_field = 'oddRel' THEN 'F3' WHEN term1 = '' THEN 'F2' END AS rule, CASE WHEN term1 = 'fig trees' THEN CASE WHEN r.passage IN (SELECT passage FROM named WHERE name = 'Fig Tree') THEN 'Fig Tree' ELSE 'Fig Trees' END ELSE upper(term1[1]) || lower(term1[2:]) END AS t1, upper(term2[1]) || lower(term2[2:]) AS t2
  FROM ({RELS}) r WHERE l_orderkey % 13 <> 0 AND l_orderkey % 11 <> 0),
r1 AS (SELECT r0.*, a.cats AS c1, b.cats AS c2, CASE WHEN rule IS NOT NULL OR NOT peopled THEN NULL WHEN t1 = t2 THEN 'self_relation' WHEN a.cats IS NULL THEN 'missing_term1' WHEN b.cats IS NULL THEN 'missing_term2' WHEN rel_field = 'associatedWithPlace' THEN 'type_mismatch' END AS reason
  FROM r0 LEFT JOIN named a ON a.passage = r0.passage AND a.name = t1 LEFT JOIN named b ON b.passage = r0.passage AND b.name = t2),
r2 AS (SELECT *, coalesce(rule, CASE WHEN reason IS NOT NULL THEN 'F16' END) AS rule2 FROM r1),
r3 AS (SELECT *, CASE WHEN rule2 IS NULL AND row_number() OVER (PARTITION BY passage, rel_field, t1, t2, rule2 ORDER BY rn) > 1 THEN 'F17' ELSE rule2 END AS rule3 FROM r2),
r4 AS (SELECT *, CASE WHEN rule3 IS NULL AND rel_field NOT IN ('associatedWithPlace', 'childOfFather') AND row_number() OVER (PARTITION BY passage, rel_field, least(t1, t2), greatest(t1, t2), rule3 ORDER BY rn) > 1 THEN 'F18' ELSE rule3 END AS rule4 FROM r3),
r5 AS (SELECT *, CASE WHEN rule4 IS NULL AND rel_field = 'disagreedWith' AND EXISTS (SELECT 1 FROM r4 o WHERE o.passage = r4.passage AND o.rel_field = 'spokeWith' AND o.rule4 IS NULL AND ((o.t1 = r4.t1 AND o.t2 = r4.t2) OR (o.t1 = r4.t2 AND o.t2 = r4.t1))) THEN 'F20' ELSE rule4 END AS rule5 FROM r4),
ids AS (SELECT passage, category, name, CASE WHEN category = 'Number' THEN ncat || '|cubit|' || ctx ELSE '' END AS number FROM live),
ents AS (SELECT category, name, number, count(*) AS n FROM ids GROUP BY ALL),
ranks AS (SELECT * FROM (VALUES ('Person', 0), ('Place', 1), ('TribeOfIsrael', 2), ('Nation', 3), ('Symbol', 4), ('Plant', 8)) AS t(category, rank)),
global AS (SELECT name, min_by(e.category, rank) AS category FROM ents e JOIN ranks USING (category) GROUP BY name),
local AS (SELECT passage, name, min_by(i.category, rank) AS category FROM ids i JOIN ranks USING (category) GROUP BY passage, name),
keyed AS (SELECT r5.*, coalesce(la.category, ga.category) AS k1, coalesce(lb.category, gb.category) AS k2 FROM r5 LEFT JOIN local la ON la.passage = r5.passage AND la.name = t1 LEFT JOIN local lb ON lb.passage = r5.passage AND lb.name = t2 LEFT JOIN global ga ON ga.name = t1 LEFT JOIN global gb ON gb.name = t2 WHERE rule5 IS NULL),
tied AS (SELECT passage, rel_type, k1 || ':' || t1 AS a, k2 || ':' || t2 AS b FROM keyed WHERE k1 IS NOT NULL AND k2 IS NOT NULL)
SELECT 'entity' AS part, '' AS passage, category AS a, name AS b, number AS c, n FROM ents
UNION ALL SELECT DISTINCT 'rel', '', rel_type, a, b, 1 FROM tied
UNION ALL SELECT 'meta', p.passage, 'this is order ' || CAST(p.l_orderkey AS STRING) || ' / ' || CASE WHEN p.l_orderkey % 2 = 0 THEN 'LAW' ELSE 'STORY' END,
    coalesce((SELECT string_agg(DISTINCT category || ':' || name || number, ',' ORDER BY category || ':' || name || number) FROM ids i WHERE i.passage = p.passage), ''),
    coalesce((SELECT string_agg(DISTINCT rel_type || ' ' || a || ' ' || b, ',' ORDER BY rel_type || ' ' || a || ' ' || b) FROM tied r WHERE r.passage = p.passage), ''), 1
  FROM readable p WHERE p.l_orderkey % 11 <> 0
UNION ALL SELECT 'reject', passage, 'entity/' || category, raw, final, count(*) FROM e2 WHERE final IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'reject', passage, 'rel/' || rel_field, raw, rule5 || coalesce('/' || reason, ''), count(*) FROM r5 WHERE rule5 IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'reject', passage, 'rel/' || rel_field, t1 || ' -> ' || t2, 'G9', count(*) FROM keyed WHERE k1 IS NULL OR k2 IS NULL GROUP BY ALL
UNION ALL SELECT 'reject', passage, 'passage_type/', 'nothing', 'F23', 1 FROM readable WHERE l_orderkey % 2 = 0 AND l_orderkey % 11 <> 0
UNION ALL SELECT 'reject', passage, 'passage/', 'too short | this is order ' || CAST(l_orderkey AS STRING), 'F22', 1 FROM readable WHERE l_orderkey % 11 = 0
UNION ALL SELECT DISTINCT 'reject', passage, 'document/', '', 'A1', 1 FROM ({LINES}) WHERE l_orderkey % 13 = 0
"""


def documents(spark, sf_dir):
    """(key, text): JSON documents, some in an envelope, some written as a JSON string, some cut off."""
    lines = {"lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet")}
    sql = re.sub(r"\bFROM lineitem", "FROM {lineitem}", f"SELECT passage, l_orderkey, rn, {ENT_COLS}, {REL_COLS} FROM ({LINES})")
    fields = ("category", "raw", "number_category", "en_unit", "en_context", "rel_field", "term1", "term2")
    # an order's lines are together already, from the window: nothing else is shuffled
    orders = spark.sql(sql, **lines).groupBy("l_orderkey", "passage").agg(F.sort_array(F.collect_list(F.struct("rn", *fields))).alias("lines"))

    def by(name: str, item) -> Column:
        """The items of each value of a field, in the order of the lines."""
        of = lambda v: F.struct(v, F.transform(F.filter("lines", lambda x: x[name] == v), item))
        return F.map_from_entries(F.transform(F.array_distinct(F.col(f"lines.{name}")), of))

    entity = lambda x: F.struct(x["raw"].alias("en_name"), x["number_category"].alias("number_category"), x["en_unit"].alias("en_unit"), x["en_context"].alias("en_context"))
    rel = lambda x: F.struct(x["term1"].alias("term1"), x["term2"].alias("term2"))
    maps = orders.select("passage", "l_orderkey", by("category", entity).alias("Entities"), by("rel_field", rel).alias("Rel"))
    k = F.col("l_orderkey")
    summary = F.concat(F.lit("this is order "), k.cast("string"))
    types = F.when(k % 2 == 0, F.array(F.lit("law"), F.lit("nothing"), F.lit("LAW"))).otherwise(F.array(F.lit("Story")))
    res = F.to_json(F.struct(F.when(k % 11 == 0, "too short").otherwise(summary).alias("en_summary"), summary.alias("heb_summary"), types.alias("passage_types"), "Entities", "Rel"))
    body = F.when(k % 3 == 0, F.concat(F.lit('{"res":'), res, F.lit("}"))).otherwise(res)
    # a JSON document may be written as a JSON string
    quoted = F.concat(F.lit('"'), F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.when(k % 13 == 0, F.substring(body, 1, 40)).when(k % 5 == 0, quoted).otherwise(body)
    return maps.select(F.col("passage").alias("key"), text.alias("text"))


@query("g11_import", IMPORT_SQL)
def import_documents(spark, sf_dir):
    """All four tables of an import: entities, rels, metadata and rejects."""
    # what is read more than once is worked out once
    g = imports.import_graph(*io.parse_keyed(documents(spark, sf_dir), io.EXTRACTION_FILE, stored=True))
    g |= {t: cut_lineage(g[t], f"import-{t}") for t in ("rels", "meta")}
    number = F.when(F.col("category") == "Number", F.concat_ws("|", "number_category", "en_unit", "en_context")).otherwise("")
    ents = g["entities"].select("key", "category", "name", number.alias("number"), "mentions")
    label = F.concat("category", F.lit(":"), "name")
    side = lambda n: ents.select(F.col("key").alias(f"term{n}"), label.alias("ab"[n - 1]))
    rels = g["rels"].join(side(1), "term1").join(side(2), "term2")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    of_ents = g["meta"].select("key", F.explode("entity_keys").alias("e")).join(ents.select(F.col("key").alias("e"), F.concat(label, "number").alias("name")), "e").groupBy("key").agg(joined("name").alias("b"))
    of_rels = g["meta"].select("key", F.explode("rel_keys").alias("r")).join(rels.select(F.col("key").alias("r"), F.concat_ws(" ", "rel_type", "a", "b").alias("name")), "r").groupBy("key").agg(joined("name").alias("c"))
    meta = g["meta"].join(of_ents, "key", "left").join(of_rels, "key", "left")
    bare = F.when(F.col("rule") == "F16", F.concat_ws("/", "rule", "reason")).otherwise(F.col("rule"))
    item = F.when(F.col("rule") == "A1", "").otherwise(F.col("item"))
    rejects = g["rejects"].groupBy("passage", F.concat("kind", F.lit("/"), F.coalesce("field", F.lit(""))).alias("a"), item.alias("b"), bare.alias("c")).agg(F.count("*").alias("n"))
    one, none = F.lit(1).cast("long").alias("n"), F.lit("").alias("passage")
    parts = [
        ents.select(F.lit("entity").alias("part"), none, F.col("category").alias("a"), F.col("name").alias("b"), F.col("number").alias("c"), F.col("mentions").alias("n")),
        rels.select(F.lit("rel").alias("part"), none, F.col("rel_type").alias("a"), F.col("a").alias("b"), F.col("b").alias("c"), one),
        meta.select(F.lit("meta").alias("part"), F.col("key").alias("passage"), F.concat("summary_heb", F.lit(" / "), F.array_join("passage_types", ",")).alias("a"), F.coalesce("b", F.lit("")).alias("b"), F.coalesce("c", F.lit("")).alias("c"), one),
        rejects.select(F.lit("reject").alias("part"), "passage", "a", "b", "c", "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
