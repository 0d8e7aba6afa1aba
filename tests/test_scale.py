"""Steps whose cost must grow no faster than their input."""

import random
import re

from pyspark.sql import functions as F

from scholion.functions import shared, text
from scholion.functions.shared import cut_lineage
from scholion.operators import extract, graph, lookup, merge, postings, quality, resolve
from scholion.operators import imports as imports_
from scholion.plans import derived, explore, imports


def shown_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_dense_postings_carry_no_list(spark):
    """a list of n places in each of n rows is n times n."""
    keys = spark.range(3000).selectExpr("concat('BT_Shabbat_0_2a:', id) AS key")
    numbered = postings.number_passages(keys).cache()
    built = postings.build_postings(keys.selectExpr("key", "'type' AS facet", "'LAW' AS value"), numbered)
    row = built.where("bits IS NOT NULL").selectExpr("n", "places", "bitmap_count(bits) AS held").collect()
    assert [(r.n, r.held, r.places) for r in row] == [(3000, 3000, list(range(3000)))]
    assert "first(places" not in shown_plan(built)


def test_postings_take_one_exchange(spark, monkeypatch):
    """Pairs are not shuffled to their passage and then again to their value; rows of many pairs are shuffled as they are."""
    monkeypatch.setattr(postings, "FILL", 300)
    monkeypatch.setattr(postings, "GROUPS", 1)
    rows = spark.range(3000).selectExpr("id", "concat('BT_Shabbat_0_2a:', id) AS key", "IF(id % 3 < 2, 'LAW', NULL) AS type").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS STRING) AS key, 'LAW' AS type"))
    numbered = postings.number_passages(rows, "id").cache()
    assert numbered.where("id IS NOT NULL").select("bucket", "place").distinct().count() == 3000
    # lines without an order or without a passage are left out
    lines = spark.range(12000).selectExpr("IF(id % 12 = 0, NULL, id % 4000) AS id", "IF(id % 5 = 0, NULL, id % 7) AS supplier")
    pair = lambda facet, value: F.array(F.struct(F.lit(facet).alias("facet"), value.alias("value")))
    items = F.when(F.col("key").isNull(), pair("entity", F.concat(F.lit("S"), "supplier"))).otherwise(pair("type", F.col("type")))
    built = postings.build_postings(lines, numbered.select("id", "bucket", "place", "key", "type"), "id", items)
    plain = lines.join(rows, "id").selectExpr("key", "'entity' AS facet", "concat('S', supplier) AS value").unionByName(rows.selectExpr("key", "'type' AS facet", "type AS value")).where("value IS NOT NULL")
    want = plain.where("key IS NOT NULL").distinct()
    by_key = postings.number_passages(rows.select("key")).cache()
    for made, passages in ((built, numbered), (postings.build_postings(plain, by_key), by_key)):
        plan = shown_plan(made)
        assert plan.count("RepartitionByExpression") == 1 and plan.count("Join") == (passages is by_key)  # that of the pairs themselves
        got = made.selectExpr("facet", "value", "bucket", "explode(places) AS place").join(passages, ["bucket", "place"]).select("key", "facet", "value")
        assert got.exceptAll(want).isEmpty() and made.agg(F.sum("n")).first()[0] == want.count()


def test_bitmaps_of_places(spark, monkeypatch):
    """The bitmap of a list of places is the one that Spark's aggregate makes."""
    for places in ([0], [32767], [0, 7, 8, 9, 32766, 32767], list(range(32768)), list(range(3, 32768, 7))):
        df = spark.createDataFrame([(places,)], "places array<int>").withColumn("bits", postings._bits_of(F.col("places")))
        want = df.select(F.explode("places").alias("p")).agg(F.bitmap_construct_agg(F.col("p").cast("long")).alias("bits")).first().bits
        assert df.first().bits == want and len(want) == 4096


def test_ranks_without_one_task(spark):
    """ranks over all rows come from ranges, nulls last; k3_ranked has no window of all rows."""
    df = spark.range(5000).selectExpr("CAST(id AS STRING) AS key", "IF(id = 7, NULL, concat('order ', id)) AS summary")
    want = {r.key: r.n for r in df.selectExpr("key", "row_number() OVER (ORDER BY summary DESC) AS n").collect()}
    got = shared.ranked(df.repartition(7), F.desc("summary"))
    assert {r.key: r.rank for r in got.collect()} == want
    assert "row_number" not in shown_plan(explore.k3b(spark, "/root/testdata/sf0.001"))


def test_facet_of_a_table_of_values(spark):
    """all values of a table count, also beyond 2,000."""
    keys = spark.range(2500).selectExpr("concat('BT_Shabbat_0_2a:', id) AS key", "concat('S', id) AS supplier")
    numbered = postings.number_passages(keys.select("key")).cache()
    pairs = keys.selectExpr("key", "'entity' AS facet", "supplier AS value").unionByName(keys.selectExpr("key", "'type' AS facet", "'LAW' AS value"))
    built = postings.build_postings(pairs, numbered).cache()
    assert postings.facet_passages(built, numbered, type=["LAW"], entity=keys.selectExpr("supplier AS value")).count() == 2500


def test_merge_components_share_groups(spark, monkeypatch):
    """One call of Python for many components, with the result of one for each."""
    rows = spark.range(300).selectExpr("'l' AS list", "id AS row", "'Person' AS entity_type", "concat('n', 2 * id) AS final_name", "concat('n', 2 * id, '|n', 2 * id + 1) AS names", "CAST(NULL AS STRING) AS merged")
    people = spark.range(600).selectExpr("concat('k', id) AS key", "'Person' AS entityType", "concat('N', id) AS display_en_name")
    # names of another type are other names, also in the same group
    places = people.selectExpr("concat('p', key) AS key", "'Place' AS entityType", "display_en_name")
    seen, usual = {}, merge.ROWS
    for size in (50, usual):
        monkeypatch.setattr(merge, "ROWS", size)
        statuses, steps = merge.replay_merge(rows, people.unionByName(places))
        seen[size] = sorted(map(str, statuses.select("list", "row", "status").collect())), sorted(map(str, steps.collect()))
        assert {r.status for r in statuses.collect()} == {"merge"}
    assert seen[50] == seen[usual] and len(seen[50][1]) == 900


def test_trigrams_are_made_without_grouping(spark):
    """a task's distinct pairs must not be held in a hash table that grows with its files."""
    e = spark.sql("SELECT 'C1' AS key, 'Person' AS entityType, 'King Kin' AS display_en_name, cast(null AS string) AS display_heb_name, array('king', 'ki') AS all_en_names, cast(null AS array<string>) AS all_heb_names")
    grams = lookup.name_trigrams(e)
    assert "Aggregate" not in shown_plan(grams)
    assert sorted(r.trigram for r in grams.collect()) == sorted({"kin", "ing", "ng ", "g k", " ki"})


def test_metadata_without_distinct(spark, sf_dir):
    """sets of entity keys need no DISTINCT of all mentions first."""
    plan = shown_plan(derived.meta(spark, sf_dir))
    assert plan.count("Aggregate") == 1 and plan.count("Join") == 2
    want = derived.derive(spark, sf_dir, "passage_entity").groupBy("key").agg(F.array_sort(F.collect_set("entity_key")).alias("entity_keys"))
    assert derived.meta(spark, sf_dir).select("key", "entity_keys").exceptAll(want).isEmpty()


def test_common_entities_are_met_by_broadcast(spark, monkeypatch):
    """mentions of one entity of very many are not sent to one task for its key."""
    m = spark.range(4000).selectExpr("CAST(id AS STRING) AS passage", "id AS import_order", "'Person' AS category", "CASE WHEN id % 4 < 3 THEN 'King' ELSE concat('p', id) END AS name", "1 AS ordinal")
    m = m.withColumns({c: F.lit(None).cast("string") for c in ("number_category", "en_unit", "en_context")})
    e = resolve.build_entities(m).cache()
    rows = resolve.with_identity(m).select("passage", "identity").unionByName(spark.sql("SELECT 'x' AS passage, CAST(NULL AS STRING) AS identity"))
    keyed = resolve.with_entity_keys(rows, e)
    assert keyed.join(e.select("key", "identity"), ["key", "identity"], "left_semi").count() == 4000 and keyed.where("key IS NULL").count() == 1
    terms = m.selectExpr("passage", "upper(name) AS term").unionByName(spark.sql("SELECT '7' AS passage, 'p3' AS term UNION ALL SELECT '7', 'nobody'"))
    got = resolve.resolve_term_keys(terms, m, e)
    assert got.where("key IS NOT NULL").count() == 4001 and [r.term for r in got.where("key IS NULL").collect()] == ["nobody"]
    rows = sorted(map(str, got.collect()))
    monkeypatch.setattr(resolve, "MENTIONS", 100)
    assert sorted(map(str, resolve.resolve_term_keys(terms, m, e).collect())) == rows
    plan = shown_plan(got)
    # mentions are narrowed to the terms of their passage before they meet entities
    assert plan.index("common_key") < plan.index("Join LeftOuter, ((passage")


def test_terms_of_rels_are_matched_by_passage(spark):
    """one join by passage finds both terms and whether the passage has entities."""
    rels = spark.sql("SELECT * FROM VALUES ('a', 'spokeWith', 1, 'kings', 'Dan'), ('a', 'spokeWith', 2, 'ladies', 'x'), ('b', 'spokeWith', 1, 'kings', 'Dan'), ('c', 'spokeWith', 1, 'King', 'Dan') AS t(passage, rel_field, ordinal, term1, term2)")
    ents = spark.sql("SELECT * FROM VALUES ('a', 'Person', 1, 'King'), ('a', 'Person', 2, 'DAN'), ('a', 'Person', 3, 'Lady'), ('c', 'Person', 1, CAST(NULL AS STRING)) AS t(passage, category, ordinal, name)")
    out = extract.validate_rels(rels, ents)
    assert shown_plan(out).count("Join") == 2
    got = {(r.passage, r.ordinal): (r.term1, r.term2, r.reason) for r in out.collect()}
    assert got == {("a", 1): ("King", "DAN", None), ("a", 2): ("Lady", "x", "missing_term2"), ("b", 1): ("kings", "Dan", None), ("c", 1): ("King", "Dan", "missing_term1")}


def test_family_nodes_keep_no_edges(spark, tmp_path, monkeypatch):
    """nodes alone store no edge, and edges are not stored a second time."""
    e = spark.range(6).selectExpr("concat('c', id) AS key", "'Person' AS entityType", "concat('n', id) AS display_en_name", "false AS isWoman")
    rels = spark.sql("SELECT * FROM VALUES ('f1', 'childOfFather', 'c1', 'c0'), ('f2', 'childOfFather', 'c2', 'c0'), ('m1', 'childOfMother', 'c1', 'c5'), ('m2', 'childOfMother', 'c2', 'c5'), ('f3', 'childOfFather', 'c3', 'c1'), ('x', 'childOfFather', 'c4', 'c0') AS t(key, rel_type, term1, term2)")
    stored = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, label: (stored.append((label, df.columns)), cut_lineage(df, label))[1])
    nodes = graph.family_nodes(e, rels, e.select("key"), 2)
    assert not any("rel_key" in columns for _, columns in stored)
    stored.clear()
    both, edges = graph.family_graph(e, rels, e.select("key"), 2)
    assert "all-edges" not in [label for label, _ in stored]
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(nodes) == shown(both)
    found = shown(edges)
    # pairs within one row of a class are those of the join of large classes
    monkeypatch.setattr(graph, "MEMBERS", 1)
    assert shown(graph.family_graph(e, rels, e.select("key"), 2)[1]) == found and len(found) == len(set(found))
    of = {(r.source, r.target) for r in edges.where("center = 'c3' AND kind = 'sibling'").collect()}
    assert of == set() and edges.where("center = 'c1' AND kind = 'sibling'").count() == 3


def test_special_characters_are_what_runs_leave(spark):
    """special characters are counted by taking out runs of the others, as a search for each would count."""
    texts = ["", "\n".join(["plain text, 'quoted' - \"done\"!"] * 5), "é" * 6 + "a" * 100, "é" * 5 + "a" * 95, "\U0001F600" * 6 + "b" * 94, "\U0001F600" * 5 + "b" * 95, "[" * 3000, "a" * 300000 + "#", " " * 4 + "_"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key int, text string")
    out = quality.content_issues(df, "text")
    # only the count of non-ASCII characters searches for each; with another one there were more in the plan
    assert out._jdf.queryExecution().optimizedPlan().toJSON().count("expressions.RegExpExtractAll") < 3
    white = "\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
    want = {k: len(re.findall(rf"[^a-zA-Z0-9{white}.,!?;:'\"-]", t)) > 0.05 * len(t) for k, t in enumerate(texts)}
    assert {r.key: "special_chars" in r.issues for r in out.collect()} == want and set(want.values()) == {True, False}


def test_import_works_documents_out_once(spark, sf_dir):
    """documents are made and parsed once for rows and rejects, from one shuffle of their lines; stored results are read."""
    docs = imports.documents(spark, sf_dir)
    assert docs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plan = imports.import_documents(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "from_json" not in plan


def test_title_case_of_plain_texts(spark):
    """texts that initcap may write are those that it writes as the rule does."""
    chars = random.Random(7)
    texts = ["".join(chars.choices("aBcZ'' 1-é\t", k=chars.randrange(1, 9))) for _ in range(4000)] + ["", "DAN's son", "o'brien 12 X", "1st", "it's' a", "a  b", "ǆ ab"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.title_case(F.col("t")).alias("cased"), F.rlike(F.trim("t"), F.lit(text.PLAIN)).alias("plain")).collect()
    part = lambda p: p[:1].upper() + p[1:].lower()
    for r in got:
        assert r.cased == "".join(map(part, re.findall(r"[^\W\d_](?:[^\W\d_]|'(?=[^\W\d_]))*|(?:[\W\d_])+", r.t.strip(" ")))) or "ǆ" in r.t
    assert 200 < sum(r.plain for r in got) < 3000


def test_import_rules_take_few_steps(spark):
    """a number is split into words once, and passes of rules are left out where a passage's fields have nothing for them."""
    df = spark.createDataFrame([("thirty seven",), ("two  thirds",), ("1,000",), ("many",)], "v string")
    out = df.select("v", text.number_text(F.col("v")).alias("n"))
    assert out._jdf.queryExecution().optimizedPlan().toJSON().count("expressions.StringSplit") <= 2
    assert {r.v: r.n for r in out.collect()} == {"thirty seven": "37", "two  thirds": "0.666667", "1,000": "1000", "many": None}
    item, pair = "named_struct('en_name', '{0}', 'number_category', '', 'en_unit', '', 'en_context', '')", "named_struct('term1', '{0}', 'term2', '{1}')"
    ents = lambda **of: "map(" + ", ".join(f"'{c}', array({', '.join(map(item.format, names))})" for c, names in of.items()) + ")"
    rels = lambda **of: "map(" + ", ".join(f"'{c}', array({', '.join(pair.format(*p) for p in pairs)})" for c, pairs in of.items()) + ")"
    rows = spark.sql(f"""SELECT 'plain' AS passage, {ents(Person=["dan"], Symbol=["fig"])} AS given_entities, {rels(AliasOf=[("dan", "fig")])} AS given_rels
      UNION ALL SELECT 'full', {ents(Person=["dan", "DAN"], Symbol=["fig", "FIG", "ark"], Plant=["Fig"], TribeOfIsrael=["gad", "dan"])}, {rels(comparedTo=[("dan", "ark"), ("ark", "Dan"), ("dan", "ark")], visited=[("dan", "ark")])}""")
    cleaned = imports_.clean_rels(imports_.clean_entities(rows))
    plan = cleaned._jdf.queryExecution().analyzed().toString()
    assert "map_contains_key(given_entities" in plan and "map_contains_key(given_rels" in plan
    got = {r.passage: r for r in cleaned.collect()}
    of = lambda items, *fields: [tuple(x[f] for f in fields) for x in items]
    assert of(got["plain"].entities, "name", "rule") == [("Dan", None), ("Fig", None)] and of(got["plain"].rels, "term1", "term2", "rule") == [("Dan", "Fig", None)]
    # F12 before F14; a tribe that is a person already is not added again
    assert of(got["full"].entities, "category", "name", "rule") == [
        ("Person", "Dan", None), ("Person", "Dan", "F14"), ("Symbol", "Fig", "F12"), ("Symbol", "Fig", "F12"), ("Symbol", "Ark", None), ("Plant", "Fig", None), ("TribeOfIsrael", "Gad", None), ("TribeOfIsrael", "Dan", None), ("Person", "Gad", None),
    ]
    assert of(got["full"].rels, "rel_field", "rule", "reason") == [("comparedTo", None, None), ("comparedTo", "F18", None), ("comparedTo", "F17", None), ("visited", "F16", "type_mismatch")]
