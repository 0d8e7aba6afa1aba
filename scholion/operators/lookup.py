"""Lookups, filters and facets."""

from __future__ import annotations

import re
import re._parser as _sre
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion import dims
from scholion.functions.keys import order_canonical, src_type_of


def lookup_by_key(df: DataFrame, key: str) -> DataFrame:
    """B1: rows of one key.  A table with a src_type column is also filtered on the key's
    prefix, so that only that partition is read; an unknown prefix raises."""
    if "src_type" in df.columns:
        if key[:2] not in {s for s, _, _ in dims.SOURCE_TYPES}:
            raise ValueError(f"no source type in key {key!r}")
        df = df.where(F.col("src_type") == key[:2])
    return df.where(F.col("key") == key)


def lookup_by_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """B2: rows whose key is in ``keys``; missing keys are left out."""
    return df.join(keys.select("key"), "key", "left_semi")


def entities_of_type(entities: DataFrame, entity_type: str) -> DataFrame:
    """B3."""
    return entities.where(F.col("entityType") == entity_type)


def _type_is(entity_type: str | None) -> Column:
    return F.lit(True) if entity_type is None else F.col("entityType") == entity_type


def entities_by_name(entities: DataFrame, name: str, entity_type: str | None = None) -> DataFrame:
    """Stored display names are lower case."""
    return entities.where((F.col("display_en_name") == name.strip().lower()) & _type_is(entity_type))


def numbers_by_value(entities: DataFrame, value: str) -> DataFrame:
    """B5."""
    return entities_by_name(entities, value, "Number")


def search_names(entities: DataFrame, pattern: str, entity_type: str | None = None, literal: bool = False) -> DataFrame:
    """Any of the names matches the pattern in any case (a regex, unless ``literal``)."""
    rx = "(?i)" + (r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E" if literal else pattern)
    hit = F.lit(False)
    for c in ("display_en_name", "display_heb_name"):
        hit = hit | F.coalesce(F.rlike(F.col(c), F.lit(rx)), F.lit(False))
    for c in ("all_en_names", "all_heb_names"):
        hit = hit | F.coalesce(F.exists(c, lambda x: F.rlike(x, F.lit(rx))), F.lit(False))
    return entities.where(hit & _type_is(entity_type))


NAME_COLUMNS, NAME_LISTS = ("display_en_name", "display_heb_name"), ("all_en_names", "all_heb_names")
#: Combinations of branches that are told apart; a pattern of more is scanned for.
BRANCHES = 64


def _small(text: Column) -> Column:
    """A-Z in lower case: what a pattern in any case makes no difference between."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Entities whose trigrams one task makes.
NAMED = 100_000


def name_trigrams(entities: DataFrame) -> DataFrame:
    """(trigram, key): all runs of three characters of an entity's names, once for each row.

    A row's runs are made distinct within the row, so nothing is grouped, and a task has NAMED
    rows, however few files hold them.
    """
    empty = F.array().cast("array<string>")
    names = F.concat(F.array(*NAME_COLUMNS), *[F.coalesce(c, empty) for c in NAME_LISTS])
    dealt = entities.select("key", F.array_distinct(F.transform(F.array_compact(names), _small)).alias("names")).repartition(max(1, -(-entities.count() // NAMED)), "key")
    grams = lambda name: F.transform(F.sequence(F.lit(1), F.char_length(name) - 2), lambda i: F.substr(name, i, F.lit(3)))
    long = F.filter("names", lambda name: F.char_length(name) >= 3)
    return dealt.select(F.explode(F.array_distinct(F.flatten(F.transform(long, grams)))).alias("trigram"), "key")


def required_texts(pattern: str) -> list[set[str]] | None:
    """Trigrams that a match must hold, as alternatives of which one has all of its own; None
    where a match may do without."""
    try:
        parsed = _sre.parse(pattern)
    except re.error:
        return None

    def runs(items) -> list[list[str]] | None:
        """Alternatives of literal runs of a sequence, None if there are too many."""
        found: list[list[str]] = [[""]]
        cut = lambda: [[*a, ""] for a in found]
        for op, arg in items:
            kind = str(op)
            if kind == "LITERAL":
                letter = chr(arg)
                found = [[*a[:-1], a[-1] + (letter.lower() if letter.isascii() else letter)] for a in found]
                continue
            inner = None
            if kind == "SUBPATTERN":
                inner = runs(arg[-1])
            elif kind == "BRANCH":
                parts = [runs(b) for b in arg[1]]
                inner = None if None in parts else [a for p in parts for a in p]
            elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                inner = runs(arg[2])
            elif kind == "AT":
                continue
            found = cut()
            if inner is not None:
                found = [[*a, *b, ""] for a in found for b in inner]
            if len(found) > BRANCHES:
                return None
        return found

    alternatives = runs(parsed)
    grams = [{t[i : i + 3] for t in a for i in range(len(t) - 2)} for a in alternatives or [[]]]
    return grams if all(grams) else None


def search_names_indexed(entities: DataFrame, trigrams: DataFrame, pattern: str, entity_type: str | None = None, literal: bool = False) -> DataFrame:
    """B6 by ``name_trigrams``: literal parts of the pattern choose candidates, the pattern
    confirms them.  A pattern without three literal characters in a row is scanned for.  Inline
    flags are not looked into: such patterns are scanned for, too."""
    needed = required_texts(re.escape(pattern) if literal else pattern) if literal or "(?" not in pattern else None
    if needed is None:
        return search_names(entities, pattern, entity_type, literal)
    hits = None
    for grams in needed:
        own = trigrams.where(F.col("trigram").isin(*sorted(grams))).groupBy("key").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(grams)).select("key")
        hits = own if hits is None else hits.unionByName(own)
    return search_names(entities.join(hits, "key", "left_semi"), pattern, entity_type, literal)


def rels_touching(rels: DataFrame, keys: DataFrame) -> DataFrame:
    """Rels with either end in ``keys``: two equi-joins and one row for each rel."""
    k = keys.select(F.col("key").alias("touched")).distinct()
    one = rels.join(k, F.col("term1") == F.col("touched"), "left_semi")
    two = rels.join(k, F.col("term2") == F.col("touched"), "left_semi")
    return one.unionByName(two).dropDuplicates(["key"])


def family_rels(rels: DataFrame, keys: DataFrame) -> DataFrame:
    """B8."""
    return rels_touching(rels.where(F.col("rel_type").isin(*dims.FAMILY_RELS)), keys)


def ends(rels: DataFrame, direction: str = "both") -> DataFrame:
    """(self, other, rel_type, rel_key, side) for each end of each rel that is looked from."""
    out = rels.select(F.col("term1").alias("self"), F.col("term2").alias("other"), "rel_type", F.col("key").alias("rel_key"), F.lit(1).alias("side"))
    back = rels.select(F.col("term2").alias("self"), F.col("term1").alias("other"), "rel_type", F.col("key").alias("rel_key"), F.lit(2).alias("side"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def neighbours(rels: DataFrame, entities: DataFrame, keys: DataFrame, rel_types: Sequence[str], direction: str = "both") -> DataFrame:
    """(self, other, rel_type, name) of the other ends that exist as entities."""
    near = ends(rels.where(F.col("rel_type").isin(*rel_types)), direction)
    near = near.join(keys.select(F.col("key").alias("self")).distinct(), "self", "left_semi")
    names = entities.select(F.col("key").alias("other"), F.col("display_en_name").alias("name"))
    return near.join(names, "other").select("self", "other", "rel_type", "name").distinct()


def bridge(meta: DataFrame, col: str, out: str) -> DataFrame:
    """(key, out): one row for each element of an array column."""
    return meta.select("key", F.explode(F.array_distinct(col)).alias(out))


def passages_with(meta: DataFrame, keys: DataFrame, col: str = "entity_keys") -> DataFrame:
    """(wanted, key): passages that mention each key of ``keys``."""
    return bridge(meta, col, "wanted").join(keys.select(F.col("key").alias("wanted")).distinct(), "wanted", "left_semi")


def _overlaps(col: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(col), F.array(*map(F.lit, values))), F.lit(False))


def facet_filter(
    meta: DataFrame,
    passage_types: Sequence[str] = (),
    entity_keys: Sequence[str] = (),
    rel_keys: Sequence[str] = (),
    src_types: Sequence[str] = (),
    books: Sequence[str] = (),
) -> DataFrame:
    """Any value within a facet, every facet that has values."""
    for col, values in (("passage_types", passage_types), ("entity_keys", entity_keys), ("rel_keys", rel_keys)):
        if values:
            meta = meta.where(_overlaps(col, values))
    if src_types:
        meta = meta.where(src_type_of(F.col("key")).isin(*src_types))
    if books:
        meta = meta.where(F.try_element_at(F.split("key", "_"), F.lit(2)).isin(*books))
    return meta


def passages_of_book(passages: DataFrame, src_type: str, book: str) -> DataFrame:
    """A book's passages in canonical order; the prefix reaches the scan as StartsWith."""
    return order_canonical(passages.where(F.startswith(F.col("key"), F.lit(f"{src_type}_{book}_"))))


def exists_flags(df: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, exists) for each key asked for."""
    have = df.select(F.col("key")).distinct().withColumn("exists", F.lit(True))
    return keys.select("key").join(have, "key", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def person_facets(df: DataFrame, faith: str = "all", gender: str = "all", group: str = "all", roles: Sequence[str] | None = None) -> DataFrame:
    """Faith all/jew/nonjew, gender all/man/woman, group all/individual/group; roles
    None is all, an empty list is nothing."""
    for col, choice, yes in (("isNonJew", faith, "nonjew"), ("isWoman", gender, "woman"), ("isGroup", group, "group")):
        if choice != "all":
            df = df.where(F.coalesce(F.col(col), F.lit(False)) == (choice == yes))
    if roles is None:
        return df
    return df.where(_overlaps("roles", roles)) if roles else df.where(F.lit(False))


def type_facet(df: DataFrame, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """None is all."""
    return df if values is None else df.where(F.col(col).isin(*values))


def unit_facet(occ: DataFrame, unit: str | None = None, no_unit: bool = False) -> DataFrame:
    """All rows, those of one unit, or those without."""
    blank = F.col("unit").isNull() | (F.col("unit") == "")
    return occ.where(blank) if no_unit else occ if unit is None else occ.where(F.col("unit") == unit)


def unit_values(occ: DataFrame) -> DataFrame:
    """Units there are, by their lower case."""
    return occ.where("unit <> ''").select("unit").distinct().orderBy(F.lower("unit"), "unit")


def has_metadata(prefix: str = "") -> Column:
    """Whether an entity row has been enriched, by its type."""
    full = lambda c: F.coalesce(F.trim(F.col(prefix + c)) != "", F.lit(False))
    t = F.col(prefix + "entityType")
    extra = (
        F.when(t == "Number", full("heb_unit") & full("heb_context"))
        .when(t == "Place", full("placeType"))
        .when(t == "Symbol", full("symbolType"))
        .when(t == "Person", full("timePeriod"))
        .otherwise(F.lit(True))
    )
    return full("display_heb_name") & extra


def unenriched_entities(meta: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, entity_key) of entities that lack metadata, for each passage."""
    todo = entities.where(~has_metadata()).select(F.col("key").alias("entity_key"))
    return bridge(meta, "entity_keys", "entity_key").join(todo, "entity_key", "left_semi").select("key", "entity_key")


def find(df: DataFrame, predicate: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a predicate, all or the first few by key."""
    out = df if predicate is None else df.where(predicate)
    return out if limit is None else out.orderBy("key").limit(limit)


def count(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """(n)."""
    return find(df, predicate).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, field: str, predicate: Column | None = None) -> DataFrame:
    """Distinct values of a field, of the elements of an array field."""
    kept = find(df, predicate)
    value = F.explode(field) if dict(df.dtypes)[field].startswith("array") else F.col(field)
    return kept.select(value.alias("value")).distinct()


def merge_filters(*templates: dict[str, str]) -> dict[str, str]:
    """Named filter templates; a later one of the same name wins."""
    return {name: text for t in templates for name, text in t.items()}


