"""Import of extraction documents (A1, F1-F23, G1-G11) as one plan.

A passage is one document, so all rules that hold within a passage are folds over arrays of
its row: no join, no shuffle.  Every entity and rel is carried along to the end with the rule
that rejected it, if any; what is left is exploded once for the graph build, and the rest is
the ledger of rejects.  The first exchange is the one of the identity step.

A passage's arrays are one extraction document; lookups among them are linear scans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion import dims
from scholion.functions import keys, text
from scholion.functions.shared import cut_lineage, let
from scholion.operators import extract, resolve
from scholion.sources.versions import Version, VersionedTables

ENTITY = ("category", "ordinal", "name", "number_category", "en_unit", "en_context", "raw", "rule")
REL = ("rel_field", "ordinal", "term1", "term2", "rel_type", "raw", "rule", "reason")
ITEMS = "map<string,array<struct<en_name:string,number_category:string,en_unit:string,en_context:string>>>"
PAIRS = "map<string,array<struct<term1:string,term2:string>>>"
REASONS = {
    "F1": "no known category or no name",
    "F2": "blank term",
    "F3": "unknown rel type",
    "F5": "no number",
    "F7": "no unit",
    "F8": "no context of 1 to 6 words",
    "F9": "no tribe",
    "F11": "generic word",
    "F12": "named in another category",
    "F14": "repeated name",
    "F17": "repeated pair",
    "F18": "repeated pair, turned",
    "F19": "said by a parent link",
    "F20": "said by spokeWith",
    "F21": "said by a closer link",
    "F22": "summary length",
    "F23": "unknown passage type",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _with(x: Column, fields: Sequence[str], **new: Column) -> Column:
    return F.struct(*[(new[f] if f in new else x[f]).alias(f) for f in fields])


def _reject(items: Column, fields: Sequence[str], rule: str, bad: Callable[[Column], Column]) -> Column:
    """Items that are live and bad take the rule's name."""
    return F.transform(items, lambda x: F.when(x["rule"].isNull() & F.coalesce(bad(x), F.lit(False)), _with(x, fields, rule=F.lit(rule))).otherwise(x))


def _live(items: Column) -> Column:
    return F.filter(items, lambda x: x["rule"].isNull())


def _has(given: Column, *fields: str) -> Column:
    """Whether a map of items has one of these fields: what a rule needs to find anything at all."""
    out = F.lit(False)
    for f in fields:
        out = out | F.map_contains_key(given, F.lit(f))
    return F.coalesce(out, F.lit(False))


def _several(given: Column) -> Column:
    """Whether a field of a map has more than one item, or stands there twice: without that nothing repeats."""
    twice = F.size(F.array_distinct(F.map_keys(given))) < F.size(F.map_keys(given))
    return F.coalesce(twice | F.exists(F.map_values(given), lambda items: F.size(items) > 1), F.lit(False))


def _items(given: Column) -> Column:
    """The items of a field, which may be null and hold nulls."""
    return F.filter(F.coalesce(given, F.array()), lambda x: x.isNotNull())


def _repeats(keys: Column) -> Column:
    """Whether a key is there twice; null keys are none."""
    return let(F.array_compact(keys), lambda k: F.size(F.array_distinct(k)) < F.size(k))


def _late(keys: Column, i: Column) -> Column:
    """Whether the key at a place (from 0) stands before it already; null for a null key."""
    return F.array_position(keys, F.get(keys, i)) <= i


def _marked(items: Column, fields: Sequence[str], rule: str, keys: Column) -> Column:
    """Items whose key stands before them take the rule's name."""
    return F.transform(items, lambda x, i: F.when(_late(keys, i), _with(x, fields, rule=F.lit(rule))).otherwise(x))


def clean_entities(rows: DataFrame) -> DataFrame:
    """F1, F4-F14 over the column ``given_entities``, a map of categories to items: adds ``entities``, an
    array of ENTITY structs, rejected ones too."""
    low = lambda x: F.lower(x["name"])
    nations = _map(dict(dims.DEMONYMS))
    none = F.lit(None).cast("string")

    def flat(e: Column) -> Column:
        """The rules that look at one item, in one pass for each kind of category."""
        category = e["key"]

        def entity(x: Column, i: Column, name: Column, rule: Column, number: Sequence[Column] = (none, none, none)) -> Column:
            fields = (category, i, name, *number, x["en_name"], rule)
            return F.struct(*[c.alias(f) for f, c in zip(ENTITY, fields, strict=True)])

        def named(bad: Column | None = None, by: str | None = None) -> Column:
            """Entities by name; lower names of ``bad`` are rejects of rule ``by``."""
            rule = lambda n: F.when(F.coalesce(n, F.lit("")) == "", "F1") if by is None else F.when(F.coalesce(n, F.lit("")) == "", "F1").when(bad(n), by)
            return F.transform(_items(e["value"]), lambda x, i: let(text.title_case(x["en_name"]), lambda n: entity(x, i, n, rule(n))))

        def nation(n: Column) -> Column:
            return F.coalesce(F.try_element_at(nations, F.lower(n)), n)

        def nation_rule(n: Column) -> Column:
            return F.when(F.coalesce(n, F.lit("")) == "", "F1").when(F.lower(n).isin(*dims.GENERIC_NATIONS), "F11")

        def number(x: Column, i: Column) -> Column:
            def judged(m: Column) -> Column:
                rule = F.when(F.coalesce(F.trim(x["en_name"]), F.lit("")) == "", "F1").when(m["name"].isNull(), "F5").when(m["en_unit"].isNull(), "F7").when(m["en_context"].isNull(), "F8")
                return entity(x, i, m["name"], rule, (m["number_category"], m["en_unit"], m["en_context"]))

            return let(F.struct(
                text.number_text(x["en_name"]).alias("name"), text.normalize_category(x["number_category"]).alias("number_category"),
                text.normalize_unit(x["en_unit"]).alias("en_unit"), text.check_context(x["en_context"]).alias("en_context"),
            ), judged)

        return (
            F.when(category == "Number", F.transform(_items(e["value"]), number))
            .when(category == "Person", named(lambda n: F.lower(n).isin(*dims.GENERIC_PERSONS), "F11"))
            .when(category == "TribeOfIsrael", named(lambda n: ~F.lower(n).isin(*dims.TRIBES), "F9"))
            .when(category == "Nation", F.transform(_items(e["value"]), lambda x, i: let(nation(text.title_case(x["en_name"])), lambda n: entity(x, i, n, nation_rule(n)))))
            .when(category.isin(*dims.ENTITY_TYPES), named())
            .otherwise(F.transform(_items(e["value"]), lambda x, i: entity(x, i, F.trim(x["en_name"]), F.lit("F1"))))
        )

    others = F.transform(F.filter(_live(F.col("items")), lambda x: x["category"].isin("Animal", "Food", "Plant")), low)
    no_symbols = let(others, lambda names: _reject(F.col("items"), ENTITY, "F12", lambda x: (x["category"] == "Symbol") & F.array_contains(names, low(x))))
    persons = F.transform(F.filter(_live(F.col("items")), lambda x: x["category"] == "Person"), low)
    tribes = lambda have: F.filter(_live(F.col("items")), lambda x: (x["category"] == "TribeOfIsrael") & ~F.array_contains(have, low(x)))
    as_persons = let(persons, lambda have: F.transform(tribes(have), lambda x: _with(x, ENTITY, category=F.lit("Person"), ordinal=x["ordinal"] + 1_000_000)))
    given = F.col("given_entities")
    step = lambda df, when, then: df.withColumn("items", F.when(when, then).otherwise(F.col("items")))
    out = rows.withColumn("items", F.flatten(F.transform(F.map_entries(F.coalesce(given, F.create_map().cast(ITEMS))), flat)))
    out = step(out, _has(given, "Symbol") & _has(given, "Animal", "Food", "Plant"), no_symbols)
    keys = F.transform("items", lambda x: F.when(x["rule"].isNull(), F.concat_ws("\x1f", x["category"], low(x))))
    out = step(out, _several(given), let(keys, lambda ks: F.when(_repeats(ks), _marked(F.col("items"), ENTITY, "F14", ks)).otherwise(F.col("items"))))
    return step(out, _has(given, "TribeOfIsrael"), F.concat("items", as_persons)).withColumnRenamed("items", "entities")


def _names(entities: Column) -> Column:
    """Lower name -> (name, categories) of the live entities of a passage."""

    def table(a: Column) -> Column:
        entry = lambda k: let(F.filter(a, lambda x: F.lower(x["name"]) == k), lambda same: F.struct(k.alias("key"), F.struct(F.get(same, F.lit(0))["name"].alias("name"), F.transform(same, lambda x: x["category"]).alias("categories")).alias("value")))
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(a, lambda x: F.lower(x["name"]))), entry))

    return let(_live(entities), table)


def _matched(term: Column, names: Column) -> Column:
    """the name that a term means: as it stands but for case, else without s, es, or ies."""
    low = F.lower(term)
    cut = lambda n: F.substring(low, F.lit(1), F.char_length(low) - n)
    at = lambda k: F.try_element_at(names, k)
    ends = lambda e: F.endswith(low, F.lit(e))
    return F.coalesce(at(low), F.when(ends("s"), at(cut(1))), F.when(ends("es"), at(cut(2))), F.when(ends("ies"), at(F.concat(cut(3), F.lit("y")))))


def clean_rels(rows: DataFrame) -> DataFrame:
    """F2-F4, F15-F21 over the columns ``given_rels``, a map of rel fields to items, and
    ``entities``, as clean_entities leaves them: adds ``rels``, an array of REL structs, rejected
    ones too."""
    none = F.lit(None).cast("string")
    types = _map({t.lower(): t for t in dims.REL_TYPES})
    allowed = {f: [(a, b) for g, a, b in dims.REL_CONSTRAINTS if g == f] for f, _, _ in dims.REL_CONSTRAINTS}
    rules = F.create_map(*[c for f, pairs in allowed.items() for c in (F.lit(f), F.array(*[F.struct(F.lit(a).cast("string").alias("type1"), F.lit(b).cast("string").alias("type2")) for a, b in pairs]))])

    def flat(e: Column) -> Column:
        blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""

        def fields(x: Column, i: Column, kind: Column) -> Column:
            rule = F.when(kind.isNull(), "F3").when(blank(x["term1"]) | blank(x["term2"]), "F2")
            raw = F.concat(F.coalesce(x["term1"], F.lit("")), F.lit(" -> "), F.coalesce(x["term2"], F.lit("")))
            return F.struct(e["key"].alias("rel_field"), i.alias("ordinal"), text.title_case(x["term1"]).alias("term1"), text.title_case(x["term2"]).alias("term2"), kind.alias("rel_type"), raw.alias("raw"), rule.alias("rule"), none.alias("reason"))

        return let(F.try_element_at(types, F.lower(e["key"])), lambda kind: F.transform(_items(e["value"]), lambda x, i: fields(x, i, kind)))

    def validated(x: Column, names: Column) -> Column:
        """F16 with the terms as F15 finds them."""

        def judge(m: Column) -> Column:
            a, b = m["a"], m["b"]
            term1, term2 = F.coalesce(a["name"], x["term1"]), F.coalesce(b["name"], x["term2"])
            fits = F.exists(F.try_element_at(rules, x["rel_field"]), lambda p: (p["type1"].isNull() | F.array_contains(a["categories"], p["type1"])) & (p["type2"].isNull() | F.array_contains(b["categories"], p["type2"])))
            checked = x["rule"].isNull() & (F.size(names) > 0) & F.try_element_at(rules, x["rel_field"]).isNotNull()
            reason = F.when(checked, F.when(term1 == term2, "self_relation").when(a.isNull(), "missing_term1").when(b.isNull(), "missing_term2").when(~fits, "type_mismatch"))
            return _with(x, REL, term1=term1, term2=term2, rule=F.when(reason.isNotNull(), "F16").otherwise(x["rule"]), reason=reason)

        return let(F.struct(_matched(x["term1"], names).alias("a"), _matched(x["term2"], names).alias("b")), judge)

    pair = lambda x: F.concat_ws("\x1f", x["term1"], x["term2"])
    turned = lambda x: F.concat_ws("\x1f", x["term2"], x["term1"])

    step = lambda df, when, then: df.withColumn("items", F.when(when, then).otherwise(F.col("items")))

    def firsts(df: DataFrame, rule: str, when: Column, key: Callable[[Column], Column]) -> DataFrame:
        keys = F.transform("items", lambda x: F.when(x["rule"].isNull(), key(x)))
        return step(df, when, let(keys, lambda ks: F.when(_repeats(ks), _marked(F.col("items"), REL, rule, ks)).otherwise(F.col("items"))))

    def covered(df: DataFrame, rule: str, of: str, by: Sequence[str], both_ways: bool = False) -> DataFrame:
        seen = F.filter(_live(F.col("items")), lambda x: x["rel_field"].isin(*by))
        pairs = let(seen, lambda a: F.concat(F.transform(a, pair), F.transform(a, turned))) if both_ways else F.transform(seen, pair)
        reject = let(pairs, lambda ps: _reject(F.col("items"), REL, rule, lambda x: (x["rel_field"] == of) & F.array_contains(ps, pair(x))))
        return step(df, _has(given, of) & _has(given, *by), reject)

    given = F.col("given_rels")
    items = F.flatten(F.transform(F.map_entries(F.coalesce(given, F.create_map().cast(PAIRS))), flat))
    out = rows.withColumn("items", let(_names(F.col("entities")), lambda names: F.transform(items, lambda x: validated(x, names))))
    out = firsts(out, "F17", _several(given), lambda x: F.concat_ws("\x1f", x["rel_field"], pair(x)))
    symmetric = lambda x: F.when(x["rel_field"].isin(*dims.SYMMETRIC_RELS), F.concat_ws("\x1f", x["rel_field"], F.least(pair(x), turned(x))))
    out = firsts(out, "F18", _several(given) & _has(given, *dims.SYMMETRIC_RELS), symmetric)
    out = covered(out, "F19", "descendantOf", ("childOfFather", "childOfMother"))
    out = covered(out, "F20", "disagreedWith", ("spokeWith",), both_ways=True)
    return covered(out, "F21", "associatedWithPlace", dims.SPECIFIC_PLACE_RELS).withColumnRenamed("items", "rels")


def clean_extractions(extr: DataFrame) -> DataFrame:
    """One row per passage: passage, source_type, summary_en, summary_heb, passage_types,
    entities (ENTITY), rels (REL), kept (F22), unknown_types (F23).  Narrow: nothing is shuffled.

    Without an entity or rel map a passage has none.  A row of F13 that repeats a person is not
    added.  Numbers keep their canonical text as name.
    """
    rows = extract.check_summaries(extract.unwrap(extr))
    known = {k.lower(): name for name, label in dims.PASSAGE_TYPES for k in (name, label)}
    given = F.coalesce("passage_types", F.array().cast("array<string>"))
    kind = lambda t: F.try_element_at(_map(known), F.lower(F.trim(t)))
    out = rows.select(
        F.col("key").alias("passage"), F.substring("key", 1, 2).alias("source_type"), F.col("en_summary").alias("summary_en"), F.col("heb_summary").alias("summary_heb"),
        F.array_distinct(F.array_compact(F.transform(given, kind))).alias("passage_types"), F.filter(given, lambda t: kind(t).isNull()).alias("unknown_types"),
        F.col("Entities").alias("given_entities"), F.col("Rel").alias("given_rels"), F.col("summary_ok").alias("kept"),
    )
    return clean_rels(clean_entities(out)).drop("given_entities", "given_rels")


def ledger(cleaned: DataFrame) -> DataFrame:
    """(passage, kind, field, item, rule, reason) of everything that a rule took out.  A passage
    that is rejected is one row, whatever it holds."""
    table = _map(REASONS)
    text_ = lambda c: c.cast("string")
    line = lambda kind, field, item, rule, reason: F.struct(F.lit(kind).alias("kind"), text_(field).alias("field"), text_(item).alias("item"), rule.alias("rule"), reason.alias("reason"))
    dropped = lambda c: F.filter(c, lambda x: x["rule"].isNotNull())
    of_entities = F.transform(dropped(F.col("entities")), lambda x: line("entity", x["category"], x["raw"], x["rule"], F.try_element_at(table, x["rule"])))
    of_rels = F.transform(dropped(F.col("rels")), lambda x: line("rel", x["rel_field"], x["raw"], x["rule"], F.coalesce(x["reason"], F.try_element_at(table, x["rule"]))))
    of_types = F.transform("unknown_types", lambda t: line("passage_type", F.lit(None), t, F.lit("F23"), F.lit(REASONS["F23"])))
    whole = F.array(line("passage", F.lit(None), F.concat_ws(" | ", "summary_en", "summary_heb"), F.lit("F22"), F.lit(REASONS["F22"])))
    return cleaned.select("passage", F.explode(F.when(F.col("kept"), F.concat(of_entities, of_rels, of_types)).otherwise(whole)).alias("r")).select("passage", "r.*")


def import_graph(extr: DataFrame, unreadable: DataFrame | None = None, entities: DataFrame | None = None, stored_rels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Entities, rels, meta and rejects of extraction documents (key and fields), beside stored
    entities and rels if given.

    ``unreadable`` (key, text) are documents that the reader could not parse; they are rejects
    of rule A1, as rels whose terms have no entity are of rule G9.
    """
    cleaned = cut_lineage(clean_extractions(extr), "import-passages")
    kept = cleaned.where("kept")
    order = keys.with_sort_key(kept.select(F.col("passage").alias("key"), "entities"), "key").select(F.col("key").alias("passage"), F.struct("sort_book", "sort_section", "key").alias("import_order"), "entities")
    mentions = order.select("passage", "import_order", F.explode(_live(F.col("entities"))).alias("e")).select("passage", "import_order", *[f"e.{c}" for c in ENTITY if c not in ("raw", "rule")])
    rels = kept.select("passage", F.explode(_live(F.col("rels"))).alias("r")).select("passage", *[f"r.{c}" for c in REL if c not in ("raw", "rule", "reason")])
    passages = kept.select(F.col("passage").alias("key"), "source_type", "summary_en", "summary_heb", "passage_types")
    graph = resolve.build_graph(passages, mentions, rels, entities, stored_rels)
    lost = graph["rejects"].select("passage", F.lit("rel").alias("kind"), F.col("rel_field").alias("field"), F.concat("term1", F.lit(" -> "), "term2").alias("item"), F.lit("G9").alias("rule"), F.lit("term without an entity").alias("reason"))
    rejects = ledger(cleaned).unionByName(lost)
    if unreadable is not None:
        rejects = rejects.unionByName(unreadable.select(F.col("key").alias("passage"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("field"), F.col("text").alias("item"), F.lit("A1").alias("rule"), F.lit("no extraction document").alias("reason")))
    return {"entities": graph["entities"], "rels": graph["rels"], "meta": graph["meta"], "rejects": rejects}


def import_into(store: VersionedTables, extr: DataFrame, unreadable: DataFrame | None = None) -> Version:
    """Import documents on top of the current version and publish entities, rels, meta and this
    run's rejects together.  A passage that is there already is replaced; entities and rels keep
    their keys.  Fails with a Conflict where another run has published meanwhile."""
    base = store.current()
    old = {t: base.table(store.spark, t) if base.number else None for t in ("entities", "rels", "meta")}
    g = import_graph(extr, unreadable, old["entities"], old["rels"])
    named = {"entityType": "category", "display_en_name": "name", "numberCategory": "number_category", "en_unit": "en_unit", "en_context": "en_context"}
    new = {
        "entities": g["entities"].where("is_new").select("key", *[F.col(b).alias(a) for a, b in named.items()]),
        "rels": g["rels"],
        "meta": cut_lineage(g["meta"], "import-meta"),
    }
    if base.number:
        new["entities"] = old["entities"].unionByName(new["entities"])
        new["rels"] = old["rels"].unionByName(new["rels"])
        new["meta"] = old["meta"].join(new["meta"].select("key"), "key", "left_anti").unionByName(new["meta"])
    return store.commit(base, new | {"rejects": g["rejects"]})
