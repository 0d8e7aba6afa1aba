"""Import of extraction files, postings and versioned tables."""

import json

import pytest
from pyspark.sql import functions as F

from scholion.operators import imports, lookup, postings
from scholion.sources import io, versions

NUMBER = {"en_name": "thirty seven", "number_category": "tIME", "en_unit": "uses", "en_context": "a b"}
DOC = {
    "en_summary": "a b c d", "heb_summary": "a b c d e", "passage_types": ["law", "x", "LAW"],
    "Entities": {
        "Person": [{"en_name": "moses"}, {"en_name": "king"}, {"en_name": "MOSES"}, {"en_name": " "}, None],
        "TribeOfIsrael": [{"en_name": "dan"}, {"en_name": "foo"}, {"en_name": "gad"}], "Nation": [{"en_name": "egyptians"}, {"en_name": "people"}], "Place": [{"en_name": "mount sinai"}],
        "Symbol": [{"en_name": "ark"}, {"en_name": "fig"}], "Plant": [{"en_name": "fig"}],
        "Number": [NUMBER, {"en_name": "7", "en_unit": "x", "en_context": "a b c d e f g"}, {"en_name": "many", "en_unit": "x", "en_context": "a"}, {"en_name": "8", "en_context": "a"}],
        "Junk": [{"en_name": "q"}], "Animal": None,
    },
    "Rel": {
        "spokeWith": [{"term1": "moses", "term2": "dans"}, {"term1": "dan", "term2": "Moses"}, {"term1": "dan", "term2": "Dan"}],
        "disagreedWith": [{"term1": "Moses", "term2": "Dan"}], "visited": [{"term1": "Moses", "term2": "nowhere"}, {"term1": "Moses", "term2": "Egypt"}, {"term1": "Moses", "term2": "Mount Sinai"}],
        "associatedWithPlace": [{"term1": "Moses", "term2": "Mount Sinai"}, {"term1": "Dan", "term2": "Mount Sinai"}],
        "childOfFather": [{"term1": "gad", "term2": "moses"}], "descendantOf": [{"term1": "gad", "term2": "moses"}, {"term1": "dan", "term2": "moses"}],
        "hm": [{"term1": "a", "term2": "b"}], "comparedTo": [{"term1": "", "term2": "b"}, {"term1": "figs", "term2": "ark"}, {"term1": "figs", "term2": "ark"}], "AliasOf": None,
    },
}
REJECTS = {
    ("entity", "Person", "king", "F11"), ("entity", "Person", "MOSES", "F14"), ("entity", "Person", " ", "F1"), ("entity", "TribeOfIsrael", "foo", "F9"), ("entity", "Nation", "people", "F11"),
    ("entity", "Symbol", "fig", "F12"), ("entity", "Number", "7", "F8"), ("entity", "Number", "many", "F5"), ("entity", "Number", "8", "F7"), ("entity", "Junk", "q", "F1"),
    ("rel", "spokeWith", "dan -> Moses", "F18"), ("rel", "spokeWith", "dan -> Dan", "F16"), ("rel", "disagreedWith", "Moses -> Dan", "F20"), ("rel", "visited", "Moses -> nowhere", "F16"), ("rel", "visited", "Moses -> Egypt", "F16"),
    ("rel", "associatedWithPlace", "Moses -> Mount Sinai", "F21"), ("rel", "descendantOf", "gad -> moses", "F19"), ("rel", "hm", "a -> b", "F3"), ("rel", "comparedTo", " -> b", "F2"), ("rel", "comparedTo", "figs -> ark", "F17"),
    ("passage_type", None, "x", "F23"),
}


@pytest.fixture
def files(tmp_path):
    """A1: one document a file, plain, in an envelope, as a JSON string, and unreadable."""
    put = lambda name, text: (tmp_path / f"{name}.json").write_text("﻿" + text)
    put("TN_Genesis_0_2;1", json.dumps({"res": DOC}))
    put("TN_Genesis_0_1;1-2", json.dumps(json.dumps({**DOC, "Entities": {"Person": [{"en_name": "aaron"}], "Number": [{**NUMBER, "en_name": "5", "en_unit": "year"}]}, "Rel": {"comparedTo": [{"term1": "aaron", "term2": "zed"}]}})))
    put("TN_Exodus_0_1;1", json.dumps({**DOC, "en_summary": "too short"}))
    put("BT_Sotah_0_2a;1", json.dumps({"en_summary": "a b c d", "heb_summary": "a b c d", "Rel": {"comparedTo": [{"term1": "aaron", "term2": "moses"}, {"term1": "aaron", "term2": "nobody"}]}}))
    put("bad", "[1, 2")
    return str(tmp_path)


def test_import_of_files(spark, files):
    g = imports.import_graph(*io.read_keyed_json(spark, files, io.EXTRACTION_FILE))
    rejects = g["rejects"].collect()
    of = lambda p: {(r.kind, r.field, r.item, r.rule) for r in rejects if r.passage == p}
    assert of("TN_Genesis_0_2:1") == REJECTS
    reasons = {(r.item, r.reason) for r in rejects if r.rule == "F16" and r.passage == "TN_Genesis_0_2:1"}
    assert reasons == {("dan -> Dan", "self_relation"), ("Moses -> nowhere", "missing_term2"), ("Moses -> Egypt", "type_mismatch")}
    assert of("TN_Exodus_0_1:1") == {("passage", None, "too short | a b c d e", "F22")} and {k for k, *_ in of("bad")} == {"document"}
    # without entities nothing is validated; terms are then looked for in all passages
    assert of("BT_Sotah_0_2a:1") == {("rel", "comparedTo", "Aaron -> Nobody", "G9")}
    ents = {r.key: (r.category, r.name) for r in g["entities"].collect()}
    assert sorted(ents.values()) == sorted(
        [("Person", n) for n in ("Moses", "Dan", "Gad", "Aaron")] + [("TribeOfIsrael", "Dan"), ("TribeOfIsrael", "Gad"), ("Nation", "Egypt"), ("Place", "Mount Sinai"), ("Symbol", "Ark"), ("Plant", "Fig"), ("Number", "37"), ("Number", "5")]
    )
    rels = {r.key: (r.rel_type, ents[r.term1], ents[r.term2]) for r in g["rels"].collect()}
    person = lambda n: ("Person", n)
    assert sorted(rels.values()) == sorted([
        ("spokeWith", person("Moses"), person("Dan")), ("visited", person("Moses"), ("Place", "Mount Sinai")), ("associatedWithPlace", person("Dan"), ("Place", "Mount Sinai")), ("childOfFather", person("Gad"), person("Moses")),
        ("descendantOf", person("Dan"), person("Moses")), ("comparedTo", ("Plant", "Fig"), ("Symbol", "Ark")), ("comparedTo", person("Aaron"), person("Moses")),
    ])
    meta = {r.key: r for r in g["meta"].collect()}
    assert set(meta) == {"TN_Genesis_0_2:1", "TN_Genesis_0_1:1-2", "BT_Sotah_0_2a:1"} and meta["TN_Genesis_0_2:1"].passage_types == ["LAW"]
    assert {ents[k] for k in meta["TN_Genesis_0_1:1-2"].entity_keys} == {person("Aaron"), ("Number", "5")} and meta["BT_Sotah_0_2a:1"].entity_keys == []
    assert [rels[k][0] for k in meta["BT_Sotah_0_2a:1"].rel_keys] == ["comparedTo"]


def test_rules_of_a_passage_need_no_exchange(spark, files):
    rows, _ = io.read_keyed_json(spark, files, io.EXTRACTION_FILE)
    plan = imports.clean_extractions(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_import_of_nothing(spark, files):
    rows, bad = io.read_keyed_json(spark, files, io.EXTRACTION_FILE)
    g = imports.import_graph(rows.where("false"), bad.where("false"))
    assert [df.count() for df in g.values()] == [0, 0, 0, 0]


def test_runs_into_versions(spark, files, tmp_path_factory):
    """A second run keeps the keys of the first, adds what is new and leaves old versions readable."""
    store = versions.VersionedTables(spark, str(tmp_path_factory.mktemp("store")))
    rows, bad = io.read_keyed_json(spark, files, io.EXTRACTION_FILE)
    one = imports.import_into(store, rows.where("key LIKE 'TN%'"), bad)
    two = imports.import_into(store, rows.where("key LIKE 'BT%' OR key LIKE 'TN_Genesis%'"))
    assert (one.number, two.number) == (1, 2) and store.current() == two
    keys = lambda v, t: {r.key for r in v.table(spark, t).select("key").collect()}
    assert keys(one, "entities") == keys(two, "entities") and keys(one, "rels") < keys(two, "rels") and len(keys(two, "rels")) == len(keys(one, "rels")) + 1
    assert keys(one, "meta") < keys(two, "meta") and two.table(spark, "meta").count() == len(keys(two, "meta"))
    assert one.table(spark, "rejects").where("rule = 'A1'").count() == 1 and two.table(spark, "rejects").where("rule = 'A1'").count() == 0


def test_versions(spark, tmp_path):
    store = versions.VersionedTables(spark, str(tmp_path))
    df = lambda n: spark.range(n).withColumnRenamed("id", "key")
    assert store.current() == versions.Version(0, {})
    first = store.commit(store.current(), {"a": df(3), "b": df(5)})
    # a run that dies between its tables: nothing of it is seen
    store.write({"a": df(9)})
    assert store.current() == first and first.table(spark, "a").count() == 3
    # a reader during a write keeps its version
    reading = store.current().table(spark, "a")
    second = store.commit(first, {"a": df(4)})
    assert reading.count() == 3 and second.table(spark, "a").count() == 4 and second.folders["b"] == first.folders["b"]
    # a second writer on the old version fails, and leaves no draft
    with pytest.raises(versions.Conflict):
        store.commit(first, {"a": df(7)})
    assert store.numbers() == [1, 2] and store.current() == second and list((tmp_path / "drafts").glob("[!.]*")) == []
    third = store.commit(second, {"b": df(6)})
    assert store.expire(keep=1) == [1, 2] and store.numbers() == [3]
    assert third.table(spark, "a").count() == 4 and third.table(spark, "b").count() == 6 and not (tmp_path / "published/1").exists()


def test_versions_of_writers_at_once(spark, tmp_path):
    """Of many writers that publish the same version at once exactly one succeeds."""
    from concurrent.futures import ThreadPoolExecutor

    store = versions.VersionedTables(spark, str(tmp_path))
    base = store.commit(store.current(), {"a": spark.range(1)})

    def writer(n):
        try:
            return store.publish(base, {"b": f"folder{n}"}).folders["b"]
        except versions.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(writer, range(8)) if x]
    assert len(won) == 1 and store.current().folders["b"] == won[0] and store.numbers() == [1, 2]


META = [
    ("TN_Genesis_0_1:1", ["LAW"], ["a", "b"], ["r"]), ("TN_Genesis_0_2:1", ["LAW", "STORY"], ["b", "b", "c"], []), ("BT_Sotah_0_2a:1", [], ["a"], ["r", "s"]), ("RM_x", None, None, None), ("BT_Shabbat_0_2a:1", ["STORY"], [], []),
]


@pytest.mark.parametrize("dense", [1, 2, 100])
def test_postings_equal_array_facets(spark, monkeypatch, dense):
    monkeypatch.setattr(postings, "DENSE", dense)
    many = [(f"TN_Exodus_0_1:{k}", [["LAW"], ["STORY"], []][k % 3], [f"e{k % 7}", "a"][: k % 3], [f"r{k % 2}"]) for k in range(300)]
    meta = spark.createDataFrame(META + many, "key string, passage_types array<string>, entity_keys array<string>, rel_keys array<string>").cache()
    numbered = postings.number_passages(meta.select("key")).cache()
    stored = postings.store_postings(postings.build_postings(postings.facet_pairs(meta), numbered))
    assert numbered.select("bucket", "place").distinct().count() == meta.count()
    for asked in ({}, {"type": ["LAW"]}, {"type": ["LAW", "STORY"], "entity": ["a", "e3"]}, {"entity": ["zz"]}, {"rel": ["r1", "s"], "source": ["TN", "BT"], "book": ["Exodus", "Sotah"]}, {"type": ["STORY"], "rel": ["r"]}):
        named = {"type": "passage_types", "entity": "entity_keys", "rel": "rel_keys", "source": "src_types", "book": "books"}
        want = {r.key for r in lookup.facet_filter(meta, **{named[k]: v for k, v in asked.items()}).collect()}
        assert {r.key for r in postings.facet_passages(stored, numbered, **asked).collect()} == want
    wanted = spark.createDataFrame([("a",), ("e3",), ("a",), ("none",)], "key string")
    got = sorted(map(tuple, postings.passages_with(stored, numbered, wanted).collect()))
    assert got == sorted(map(tuple, lookup.passages_with(meta, wanted).collect())) and len(got) > 100
    assert postings.search_passages(stored, numbered, 0, type=["LAW"]).count() == 0


def test_postings_plan(spark, tmp_path):
    """The facets reach the scan, and no array of metadata is read."""
    meta = spark.createDataFrame(META, "key string, passage_types array<string>, entity_keys array<string>, rel_keys array<string>")
    numbered = postings.number_passages(meta.select("key")).cache()
    stored = postings.store_postings(postings.build_postings(postings.facet_pairs(meta), numbered))
    plan = postings.facet_passages(stored, numbered, entity=["a"])._jdf.queryExecution().toString()
    assert "arrays_overlap" not in plan and "PushedFilters: [EqualTo(facet,entity)" in plan.replace("IsNotNull(facet), IsNotNull(value), ", "").replace("IsNotNull(value), IsNotNull(facet), ", "")
    assert numbered.where(F.col("place") < 0).count() == 0
