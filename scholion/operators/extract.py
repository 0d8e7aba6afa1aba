"""Extraction rows: flattening, normalisation and validation.

Entities are rows (passage, category, ordinal, name, ...), rels rows (passage, rel_field,
ordinal, term1, term2).  Rules hold within a passage, so every join is keyed by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion import dims
from scholion.functions.text import title_case, word_count


def unwrap(extr: DataFrame) -> DataFrame:
    """the extraction's fields from the optional ``res`` envelope."""
    fields = ("en_summary", "heb_summary", "passage_types", "Entities", "Rel")
    if "res" not in extr.columns:
        return extr
    return extr.select("key", *[F.coalesce(F.col(f"res.{f}"), F.col(f)).alias(f) for f in fields])


def flatten_entities(extr: DataFrame) -> DataFrame:
    """(passage, category, ordinal, name, number_category, en_unit, en_context)."""
    by_category = unwrap(extr).select(F.col("key").alias("passage"), F.explode("Entities").alias("category", "items"))
    rows = by_category.select("passage", "category", F.posexplode("items").alias("ordinal", "e"))
    return rows.select("passage", "category", "ordinal", F.col("e.en_name").alias("name"), "e.number_category", "e.en_unit", "e.en_context")


def flatten_rels(extr: DataFrame) -> DataFrame:
    """(passage, rel_field, ordinal, term1, term2) without blank terms."""
    by_field = unwrap(extr).select(F.col("key").alias("passage"), F.explode("Rel").alias("rel_field", "items"))
    rows = by_field.select("passage", "rel_field", F.posexplode("items").alias("ordinal", "r")).select("passage", "rel_field", "ordinal", "r.term1", "r.term2")
    return rows.where("trim(term1) <> '' AND trim(term2) <> ''")


def resolve_rel_type(rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with rel_type, rejects): the rel type of the field's name in any case."""
    types = dims.rel_types(rels.sparkSession).select("rel_type", F.lower("rel_type").alias("low"))
    found = rels.withColumn("low", F.lower("rel_field")).join(F.broadcast(types), "low", "left").drop("low")
    return found.where("rel_type IS NOT NULL"), found.where("rel_type IS NULL").drop("rel_type")


def filter_tribes(ents: DataFrame) -> DataFrame:
    """tribe rows must be one of the tribes."""
    return ents.where((F.col("category") != "TribeOfIsrael") | F.lower("name").isin(*dims.TRIBES))


def map_demonyms(ents: DataFrame) -> DataFrame:
    """nation rows that name a people get the nation's name."""
    d = dims.demonyms(ents.sparkSession).select(F.lit("Nation").alias("category"), F.col("demonym").alias("low"), "nation")
    return ents.withColumn("low", F.lower(F.trim("name"))).join(F.broadcast(d), ["category", "low"], "left").withColumn("name", F.coalesce("nation", "name")).drop("low", "nation").select(*ents.columns)


def drop_generic(ents: DataFrame) -> DataFrame:
    """generic words are no persons or nations."""
    g = dims.generic_words(ents.sparkSession).select("category", F.col("word").alias("low"))
    return ents.withColumn("low", F.lower("name")).join(F.broadcast(g), ["category", "low"], "left_anti").select(*ents.columns)


def exclude_symbols(ents: DataFrame) -> DataFrame:
    """a symbol that is an animal, food or plant in its passage goes."""
    other = ents.where(F.col("category").isin("Animal", "Food", "Plant")).select("passage", F.lower("name").alias("low"), F.lit("Symbol").alias("category")).distinct()
    return ents.withColumn("low", F.lower("name")).join(other, ["passage", "low", "category"], "left_anti").select(*ents.columns)


def add_tribe_persons(ents: DataFrame) -> DataFrame:
    """each tribe of a passage is also a person there, after the passage's own."""
    tribes = ents.where("category = 'TribeOfIsrael'").withColumn("category", F.lit("Person")).withColumn("low", F.lower("name"))
    persons = ents.where("category = 'Person'").select("passage", F.lower("name").alias("low"))
    new = tribes.join(persons, ["passage", "low"], "left_anti").withColumn("ordinal", F.col("ordinal") + 1_000_000)
    return ents.unionByName(new.select(*ents.columns))


def dedup_entities(ents: DataFrame) -> DataFrame:
    """the first row of each name (in any case) of a category of a passage."""
    w = Window.partitionBy("passage", "category", F.lower("name")).orderBy("ordinal")
    return ents.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def _names(ents: DataFrame) -> DataFrame:
    """(passage, low, name, categories): the first spelling of each name."""
    return ents.groupBy("passage", F.lower("name").alias("low")).agg(F.min_by("name", F.struct("ordinal", "name")).alias("name"), F.collect_set("category").alias("categories"))


def _tables(ents: DataFrame) -> DataFrame:
    """(passage, names): the names of each passage as one map, low -> (name, categories); the
    map is empty where a passage has entities without a name only."""
    entry = F.when(F.col("low").isNotNull(), F.struct("low", F.struct("name", "categories")))
    return _names(ents.repartition("passage")).groupBy("passage").agg(F.map_from_entries(F.collect_list(entry)).alias("names"))


def _matched(term: Column, names: Column) -> Column:
    """(name, categories) of a term: as it stands but for case, then without s, es, ies; null
    where the names have none of them."""
    low = F.lower(F.trim(term))
    cut = lambda n: F.substring(low, F.lit(1), F.char_length(low) - n)
    at = lambda k: F.try_element_at(names, k)
    ends = lambda e: F.endswith(low, F.lit(e))
    return F.coalesce(at(low), F.when(ends("s"), at(cut(1))), F.when(ends("es"), at(cut(2))), F.when(ends("ies"), at(F.concat(cut(3), F.lit("y")))))


def match_terms(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """each term becomes the passage's name that it matches best (as written but for case,
    else a singular); ``categories1/2`` are that name's, null where nothing matches; ``peopled``
    says whether the passage has any entity.  Both tables are shuffled once, by passage."""
    out = rels.join(_tables(ents), "passage", "left").withColumn("peopled", F.col("names").isNotNull())
    for side in ("1", "2"):
        term = f"term{side}"
        out = out.withColumn("best", _matched(F.col(term), F.col("names"))).withColumn(term, F.coalesce("best.name", term)).withColumn(f"categories{side}", F.col("best.categories")).drop("best")
    return out.drop("names")


def validate_rels(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """F16: matched rels with ``reason``: null where valid, else self_relation,
    missing_term1, missing_term2 or type_mismatch, the first that holds.  Passages without any
    entity, and fields without a constraint, pass."""
    rules = dims.rel_constraints(rels.sparkSession).groupBy("rel_field").agg(F.collect_list(F.struct("type1", "type2")).alias("allowed"))
    m = match_terms(rels, ents).join(F.broadcast(rules), "rel_field", "left")
    fits = F.exists("allowed", lambda p: (p["type1"].isNull() | F.array_contains("categories1", p["type1"])) & (p["type2"].isNull() | F.array_contains("categories2", p["type2"])))
    reason = (
        F.when(~F.col("peopled") | F.col("allowed").isNull(), F.lit(None).cast("string"))
        .when(F.lower("term1") == F.lower("term2"), "self_relation")
        .when(F.col("categories1").isNull(), "missing_term1")
        .when(F.col("categories2").isNull(), "missing_term2")
        .when(~fits, "type_mismatch")
    )
    return m.withColumn("reason", reason).select(*rels.columns, "reason")


def dedup_rels(rels: DataFrame) -> DataFrame:
    """the first of equal pairs of a field of a passage."""
    w = Window.partitionBy("passage", "rel_field", "term1", "term2").orderBy("ordinal")
    return rels.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def dedup_symmetric(rels: DataFrame) -> DataFrame:
    """of a symmetric field, (A, B) and (B, A) are one; the first stays."""
    a, b = F.lower("term1"), F.lower("term2")
    symmetric = F.col("rel_field").isin(*dims.SYMMETRIC_RELS)
    key = F.when(symmetric, F.concat_ws("\x00", F.least(a, b), F.greatest(a, b))).otherwise(F.concat_ws("\x01", "rel_field", "term1", "term2", F.col("ordinal").cast("string")))
    w = Window.partitionBy("passage", "rel_field", key).orderBy("ordinal")
    return rels.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def _pairs(rels: DataFrame, fields: tuple[str, ...], of: str, both_ways: bool = False) -> DataFrame:
    p = rels.where(F.col("rel_field").isin(*fields)).select("passage", F.lower("term1").alias("a"), F.lower("term2").alias("b"))
    if both_ways:
        p = p.unionByName(p.select("passage", F.col("b").alias("a"), F.col("a").alias("b")))
    return p.distinct().withColumn("rel_field", F.lit(of))


def _without(rels: DataFrame, pairs: DataFrame) -> DataFrame:
    keyed = rels.withColumn("a", F.lower("term1")).withColumn("b", F.lower("term2"))
    return keyed.join(pairs, ["passage", "rel_field", "a", "b"], "left_anti").select(*rels.columns)


def drop_redundant_descendants(rels: DataFrame) -> DataFrame:
    """descendantOf that a father or mother link says already."""
    return _without(rels, _pairs(rels, ("childOfFather", "childOfMother"), "descendantOf"))


def drop_overlap_disagreed(rels: DataFrame) -> DataFrame:
    """disagreedWith of two that spoke with each other."""
    return _without(rels, _pairs(rels, ("spokeWith",), "disagreedWith", both_ways=True))


def drop_covered_places(rels: DataFrame) -> DataFrame:
    """associatedWithPlace where a closer link to the place exists."""
    return _without(rels, _pairs(rels, dims.SPECIFIC_PLACE_RELS, "associatedWithPlace"))


def check_summaries(extr: DataFrame) -> DataFrame:
    """add ``summary_ok``: both summaries have 4 to 10 words."""
    least, most = dims.SUMMARY_WORDS
    ok = lambda c: word_count(F.col(c)).between(least, most)
    return extr.withColumn("summary_ok", F.coalesce(ok("en_summary") & ok("heb_summary"), F.lit(False)))


def map_passage_types(extr: DataFrame) -> DataFrame:
    """(key, passage_types): names of the types given by name or label, in order, without
    repeats and unknown ones."""
    known = {k.lower(): name for name, label in dims.PASSAGE_TYPES for k in (name, label)}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    mapped = F.transform(F.coalesce("passage_types", F.array().cast("array<string>")), lambda t: F.try_element_at(table, F.lower(F.trim(t))))
    return extr.select("key", F.array_distinct(F.array_compact(mapped)).alias("passage_types"))


def drop_stop_nouns(ents: DataFrame, stop: DataFrame) -> DataFrame:
    """rows whose (category, lower name) is in ``stop`` (category, word)."""
    s = stop.select("category", F.lower("word").alias("low")).distinct()
    return ents.withColumn("low", F.lower("name")).join(s, ["category", "low"], "left_anti").select(*ents.columns)


def clean_entities(ents: DataFrame) -> DataFrame:
    """F4 and F9-F14 in the order in which they build on one another."""
    named = ents.withColumn("name", title_case(F.col("name"))).where("name <> ''")
    return dedup_entities(add_tribe_persons(exclude_symbols(drop_generic(map_demonyms(filter_tribes(named))))))


def clean_rels(rels: DataFrame, ents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rels, rejects with reason)."""
    titled = rels.withColumn("term1", title_case(F.col("term1"))).withColumn("term2", title_case(F.col("term2")))
    checked = validate_rels(titled, ents)
    valid = dedup_symmetric(dedup_rels(checked.where("reason IS NULL").drop("reason")))
    return drop_covered_places(drop_overlap_disagreed(drop_redundant_descendants(valid))), checked.where("reason IS NOT NULL")
