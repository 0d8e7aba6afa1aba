"""Value tables: nested italics, units, patches in order, sibling classes, statistics, name search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.functions import text
from scholion.operators import enrich, graph, lookup, quality, resolve

ITALICS = [
    ("<i>a<i>b</i>c</i>", {"abc", "b"}),
    ("x <I class='t'> Two <b>bold</b> words </I> y <i></i><i> </i>", {"Two bold words"}),
    ("<i>never closed <i>inner</i> end", {"never closed inner end", "inner"}),
    ("</i>stray<i>one</i></i><i>two</i>", {"one", "two"}),
    ("<i>a &amp;lt; b &#39;q&#x27; &quot;z&quot; &unknown; &</i>", {"a &lt; b 'q' \"z\" &unknown; &"}),
    ("<i>&nbsp;pad&nbsp;</i><i>א&#1488;</i><i>a < b</i>", {"pad", "אא", "a < b"}),
    ("<img src=x><item>no</item>", set()),
    (None, set()),
    ("", set()),
    ("<i>" * 12 + "deep" + "</i>" * 12, {"deep"}),
]


@pytest.mark.parametrize("html, want", ITALICS)
def test_nested_italics(spark, html, want):
    assert {r.term for r in text.italic_terms(spark.createDataFrame([(html,)], "h string"), "h").collect()} == want


def test_units(spark):
    given = {"uses": "use", "Buzzes": "buzze", "boxes": "box", "cities": "citi", "yes": "ye", "as": "as", "glass": "glass", "incense": "incense", "bronze": "bronze", "bulls": "bull", "oxen ": "oxen", " ": None, "es": "es", "s": "s", "ases": "ase"}
    rows = spark.createDataFrame(list(given.items()), "u string, want string").select("u", "want", text.normalize_unit(F.col("u")).alias("got")).collect()
    assert {r.u: r.got for r in rows} == given


def test_patches_in_order(spark):
    """Each entry against the entity as the entries before it left it, by a plain replay."""
    rng = random.Random(2)
    kinds = {"a": "Person", "b": "Place", "c": "Number", "d": "Person"}
    ents = [(k, t, "h0" if k != "d" else None, "Tanach", False, None, None, ["King"] if k == "a" else [], "u0", "c0", "City", None) for k, t in kinds.items()]
    e = spark.createDataFrame(ents, "key string, entityType string, display_heb_name string, timePeriod string, isWoman boolean, isNonJew boolean, isGroup boolean, roles array<string>, heb_unit string, heb_context string, placeType string, symbolType string")
    pick = lambda *xs: rng.choice(xs)
    rows = [(f"p{n}", n // 3, n % 3, pick("a", "b", "c", "d", "zz"), pick("h0", "h1", "", None), pick("Tanach", "Amoraim", None), pick(True, False, None), None, None, pick([], ["King"], ["Judge", "King"], None), pick("u0", "u1", None), None, pick("City", "Desert", None), None) for n in range(120)]
    fields = ["display_heb_name", "timePeriod", "isWoman", "isNonJew", "isGroup", "roles", "heb_unit", "heb_context", "placeType", "symbolType"]
    p = spark.createDataFrame(rows, "passage string, import_order long, ordinal int, key string, display_heb_name string, timePeriod string, isWoman boolean, isNonJew boolean, isGroup boolean, roles array<string>, heb_unit string, heb_context string, placeType string, symbolType string")
    state = {x[0]: dict(zip(["key", "entityType", "display_heb_name", "timePeriod", "isWoman", "isNonJew", "isGroup", "roles", "heb_unit", "heb_context", "placeType", "symbolType"], x, strict=True)) for x in ents}
    want = {}
    for r in rows:
        patch, entity = dict(zip(["passage", "o", "n", "key", *fields], r, strict=True)), state.get(r[3])
        changed = set()
        for f in fields if entity else []:
            types, value = (("Person",) if f == "roles" else enrich.FIELDS[f]), patch[f]
            if types is not None and entity["entityType"] not in types or value in (None, "", []):
                continue
            if f == "roles":
                new = [x for x in value if x not in entity["roles"]]
                changed |= {"roles"} if new else set()
                entity["roles"] = entity["roles"] + new
            elif value != entity[f]:
                changed.add(f)
                entity[f] = value
        want[r[0]] = ("missing" if entity is None else "updated" if changed else "unchanged", changed)
    got = {r.passage: (r.status, set(r.changed)) for r in enrich.enrichment_states(e, p).collect()}
    assert got == want and {s for s, _ in got.values()} == {"missing", "updated", "unchanged"}


def test_a_parent_of_very_many_children(spark):
    """100,000 children are 100,000 members in bounded rows; pairs only for who is asked for."""
    links = spark.range(100_000).select(F.concat(F.lit("c"), "id").alias("self"), F.lit("p").alias("parent")).unionByName(spark.createDataFrame([("c7", "q"), ("x", "q"), ("x", "q"), ("only", "r")], "self string, parent string"))
    classes = graph.sibling_classes(links)
    rows = classes.select("parent", "n", F.size("members").alias("m")).collect()
    assert sum(r.m for r in rows if r.parent == "p") == 100_000 and max(r.m for r in rows) < 2 * graph.MEMBERS and {r.n for r in rows if r.parent == "q"} == {2}
    asked = links.where("self IN ('x', 'only')")
    assert [tuple(r) for r in graph.expand_classes(classes, asked).collect()] == [("x", "c7")]
    assert graph.expand_classes(classes, links.where("self = 'c7'")).count() == 100_000
    counts = {(r.self, r.parent): r.siblings for r in graph.sibling_counts(classes, links.where("self IN ('c7', 'x', 'only')")).collect()}
    assert counts == {("c7", "p"): 99_999, ("c7", "q"): 1, ("x", "q"): 1, ("only", "r"): 0}


def test_statistics_merge(spark):
    rng = np.random.default_rng(6)
    rows = [(str(g), int(n) if n < 90 else None) for g, n in zip(rng.integers(0, 3, 600), rng.integers(0, 100, 600), strict=True)] + [("9", 5), ("8", None)]
    df = spark.createDataFrame(rows, "g string, v int").cache()
    parts = [quality.length_histogram(df.where(cond), F.col("v"), "g") for cond in ("v < 30", "v >= 30", "v IS NULL")]
    whole = {r.g: r for r in df.groupBy("g").agg(*quality._stats(F.col("v"))).collect()}
    merged = {r.g: r for r in quality.histogram_stats(quality.merge_histograms(*parts)).collect()}
    assert set(whole) == set(merged)
    for g, r in whole.items():
        for m in quality.MEASURES:
            assert merged[g][m] == (None if r[m] is None else pytest.approx(r[m])), (g, m)
    warned = {r.g: (r.wide, r.outliers) for r in quality.histogram_warnings(quality.merge_histograms(*parts)).collect()}
    assert warned["9"] == (False, 0) and all(w[1] == 0 for w in warned.values())
    sketches = [quality.length_sketch(df.where(cond), F.col("v"), "g") for cond in ("v < 30", "v >= 30")]
    near = {r.g: r for r in quality.sketch_percentiles(*sketches).collect()}
    assert all(abs(near[g].median - whole[g].median) <= 4 and abs(near[g].p80 - whole[g].p80) <= 4 for g in "012")


PATTERNS = ["RING|er#0+1", "^mos", "o[nm] of", "a.c", "(dan|gad) son", "x*", "", "dan{2}", "(?i)DAN", "a+", "Ébc", "da(n|m)", r"\bdan\b", "[", "abc|z", "d(a(n s)o)n"]


def test_name_search_by_trigrams(spark):
    names = ["Moses", "son of dan", "dan son", "GAD SON", "a-c", "earring", "er#0001", "ébc", "Ébcd", "xx", None, "", "dann", "abc", "xabcx"]
    e = spark.createDataFrame([(f"k{n}", "Person" if n % 2 else "Place", x, None, [x, "gad son"] if n == 3 else None, [] if n else ["mosaic"]) for n, x in enumerate(names)], "key string, entityType string, display_en_name string, display_heb_name string, all_en_names array<string>, all_heb_names array<string>").cache()
    grams = lookup.name_trigrams(e).cache()
    keys = lambda df: sorted(r.key for r in df.collect())
    for pattern in PATTERNS:
        for literal in (True, False) if pattern != "[" else (True,):
            for kind in (None, "Person"):
                assert keys(lookup.search_names_indexed(e, grams, pattern, kind, literal)) == keys(lookup.search_names(e, pattern, kind, literal)), (pattern, literal)
    assert lookup.required_texts("RING|er#0+1") == [{"rin", "ing"}, {"er#"}] and lookup.required_texts("a.c") is None and lookup.required_texts("d(a(n s)o)n") == [{"n s"}]
    assert lookup.required_texts("(foo|bar)+ baz") == [{"foo", " ba", "baz"}, {"bar", " ba", "baz"}] and lookup.required_texts("[") is None
    plan = lookup.search_names_indexed(e, grams, "moses")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and re.search("trigram", plan)


def test_stored_order_of_persons(spark):
    e = spark.createDataFrame([("z1", "Person", "dan", 1), ("a2", "Person", "dan", 2)], "key string, entityType string, display_en_name string, stored_at int")
    rels = spark.createDataFrame([], "key string, rel_type string, term1 string, term2 string")
    new = spark.createDataFrame([("Dan", [], [], [])], "name string, fathers array<string>, mothers array<string>, spouses array<string>")
    assert resolve.resolve_persons(new, e, rels, "stored_at").first().key == "z1" and resolve.resolve_persons(new, e, rels).first().key == "a2"
