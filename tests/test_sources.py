import json

from pyspark.sql import functions as F

from scholion.operators import enrich, extract, graph, merge, resolve, search
from scholion.sources import io
from scholion.streaming.ingest import ingest_stream


def test_keyed_json(spark, tmp_path):
    doc = {"res": {"en_summary": "a b c d", "Entities": {"Person": [{"en_name": "dan"}]}, "Rel": {"spokeWith": [{"term1": "dan", "term2": "gad"}]}}}
    (tmp_path / "TN_Genesis_0_1;1-2.json").write_text("﻿" + json.dumps(doc))
    (tmp_path / "TN_Genesis_0_2;1.json").write_text("﻿" + json.dumps(json.dumps(doc)))
    (tmp_path / "bad file.json").write_text("[1, 2")
    rows, rejects = io.read_keyed_json(spark, str(tmp_path), io.EXTRACTION_FILE)
    assert sorted(r.key for r in rows.collect()) == ["TN_Genesis_0_1:1-2", "TN_Genesis_0_2:1"]
    assert [r.key for r in rejects.collect()] == ["bad file"]
    assert {r.name for r in extract.flatten_entities(rows).collect()} == {"dan"}
    assert extract.flatten_rels(rows).count() == 2


def test_merge_list(spark, tmp_path):
    (tmp_path / "person_to_merge.csv").write_text("final_display_name,display_names_to_join,merged\nDan,dan|daniel|,\n\n")
    (tmp_path / "place_to_merge.csv").write_text("Ai,ai|hai,true\n")
    (tmp_path / "other.csv").write_text("x,y,\n")
    rows, rejects = io.read_merge_list(spark, str(tmp_path))
    assert sorted((r.entity_type, r.final_name) for r in rows.collect()) == [("Person", "Dan"), ("Place", "Ai")]
    assert rejects.count() == 1


def test_snapshot_glossary_append(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("a",)], "term string")
    io.write_glossary(df, str(tmp_path / "g"))
    assert [r.term for r in spark.read.csv(str(tmp_path / "g"), header=True).orderBy("term").collect()] == ["a", "b"]
    io.write_snapshot({"t": df}, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("coll = 't'").count() == 3
    io.append_rows(df, str(tmp_path / "p"))
    io.append_rows(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6


def test_stream_resumes(spark, tmp_path):
    source, table, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "key string, content string, ordinal int"

    def drop(n, keys):
        spark.createDataFrame([(k, "x", n) for k in keys], schema).coalesce(1).write.mode("append").json(source)
        ingest_stream(spark, source, schema, table, check).awaitTermination()

    drop(1, ["TN_a_0_1", "BT_b_0_1", "XX_c_0_1"])
    drop(2, ["TN_a_0_1", "TN_d_0_1"])
    assert sorted((r.key, r.ordinal) for r in spark.read.parquet(table).collect()) == [("BT_b_0_1", 1), ("TN_a_0_1", 1), ("TN_d_0_1", 2)]


PERSON = "key string, entityType string, display_en_name string, isWoman boolean"


def test_resolve_persons_by_family(spark):
    e = spark.createDataFrame([("1", "Person", "dan", None), ("2", "Person", "dan", None), ("3", "Person", "abe", None), ("4", "Person", "eve", None), ("5", "Person", "gil", None), ("6", "Person", "lea", None)], PERSON)
    rels = spark.createDataFrame([("r1", "childOfFather", "1", "3"), ("r2", "childOfMother", "2", "4"), ("r3", "spouseOf", "5", "4")], "key string, rel_type string, term1 string, term2 string")
    new = spark.createDataFrame([("Dan", ["gil"], [], []), ("Lea", ["abe"], [], []), ("Zed", [], [], [])], "name string, fathers array<string>, mothers array<string>, spouses array<string>")
    got = {r.name: r.key for r in resolve.resolve_persons(new, e, rels).collect()}
    # gil is the spouse of the second Dan's mother; Lea has no stored family; Zed is new
    assert got == {"dan": "2", "lea": "6", "zed": None}
    assert {r.name: r.key for r in resolve.resolve_persons(new.where("name = 'Dan'").withColumn("fathers", F.array(F.lit("abe"))), e, rels).collect()} == {"dan": "1"}


def test_family_graph_and_levels(spark):
    people = [(k, "Person", k, k in "bd") for k in "abcdef"]
    e = spark.createDataFrame(people, PERSON)
    rels = spark.createDataFrame(
        [("1", "childOfFather", "c", "a"), ("2", "childOfMother", "c", "b"), ("3", "childOfFather", "d", "a"), ("4", "spouseOf", "a", "b"), ("5", "spouseOf", "b", "a"), ("6", "childOfFather", "e", "c"), ("7", "spouseOf", "c", "zz")],
        "key string, rel_type string, term1 string, term2 string",
    )
    nodes, edges = graph.family_graph(e, rels, e.where("key = 'c'").unionByName(e.where("key = 'c'").withColumn("key", F.lit("nobody"))), 1)
    assert {r.key for r in nodes.collect()} == {"a", "b", "c", "d", "e"}
    got = {(r.source, r.target, r.label) for r in edges.collect()}
    assert ("c", "d", "Sibling") in got and ("c", "zz", "Spouse") in got and ("c", "a", "Father") in got
    levels = {r.key: (r.level, r.role) for r in graph.generation_levels(nodes, edges).collect()}
    assert levels == {"c": (0, "center"), "a": (-1, "parent"), "b": (-1, "parent"), "d": (0, "sibling"), "e": (1, "child")}


def test_query_values(spark):
    given = ["", "7", "-3", "1.5", "3/4", "6/2", "1/0", "1/2/3", "0", "x", "1/12"]
    df = spark.createDataFrame(list(enumerate(given)), "k int, raw string")
    got = [(r.value, r.error) for r in search.normalize_query_values(df).orderBy("k").collect()]
    assert got == [(None, "empty"), ("7", None), (None, "negative"), (None, "decimal"), ("0.75", None), ("3", None), (None, "slash"), (None, "slash"), (None, "zero"), (None, "slash"), ("0.083333", None)]


def test_vector_rank_of_nothing(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0])], "key string, embedding array<float>")
    assert search.vector_rank(v, v.where("false").select(F.col("key").alias("query"), F.col("embedding").alias("vector"))).count() == 0


def test_merge_ambiguous_and_shared(spark):
    e = spark.createDataFrame([("1", "Person", "dan"), ("2", "Person", "dan"), ("3", "Person", "gad"), ("4", "Person", "asher"), ("5", "Person", "levi")], "key string, entityType string, display_en_name string")
    rows = spark.createDataFrame([("l", 1, "Person", "Dan", "dan|gad", None), ("l", 2, "Person", "Levi", "asher|levi|ghost", None), ("l", 3, "Person", "Gad", "levi|gad", None)], "list string, row int, entity_type string, final_name string, names string, merged string")
    assert {r.row: r.status for r in merge.plan_merge(rows, e).collect()} == {1: "ambiguous", 2: "merge", 3: "merge"}
    assert [(r.dup_key, r.target_key) for r in merge.merge_targets(rows, e).collect()] == [("4", "5")]


def test_usage_without_price(spark):
    u = spark.createDataFrame([("x", 1_000_000, 0), ("y", 5, 5)], "provider string, tokens_in long, tokens_out long")
    p = spark.createDataFrame([("x", 0.5, 1.0)], "provider string, price_in double, price_out double")
    assert {r.provider: r.cost for r in enrich.usage_rollup(u, p).collect()} == {"x": 0.5, "y": 0.0, None: 0.5}
