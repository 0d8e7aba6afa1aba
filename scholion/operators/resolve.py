"""Entity resolution and graph build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion import dims
from scholion.functions.shared import cut_lineage


def identity(strict: bool = False, prefix: str = "") -> Column:
    """The text that two mentions of one entity share: type and lower name; for
    numbers type, category, unit and context (with the value too where ``strict``)."""
    c = lambda name: F.coalesce(F.lower(F.col(prefix + name)), F.lit(""))
    number = [c("category"), c("number_category"), c("en_unit"), c("en_context")] + ([c("name")] if strict else [])
    return F.when(F.col(prefix + "category") == "Number", F.concat_ws("\x1f", *number)).otherwise(F.concat_ws("\x1f", c("category"), c("name")))


def with_identity(ents: DataFrame, strict: bool = False) -> DataFrame:
    return ents.withColumn("identity", identity(strict))


def family_context(rels: DataFrame) -> DataFrame:
    """(passage, person, fathers, mothers, spouses) in lower case, from rels by name."""
    t1, t2 = F.lower("term1"), F.lower("term2")
    looks = [
        rels.where("rel_type = 'childOfFather'").select("passage", t1.alias("person"), F.lit("father").alias("kind"), t2.alias("other")),
        rels.where("rel_type = 'childOfMother'").select("passage", t1.alias("person"), F.lit("mother").alias("kind"), t2.alias("other")),
        rels.where("rel_type = 'spouseOf'").select("passage", t1.alias("person"), F.lit("spouse").alias("kind"), t2.alias("other")),
        rels.where("rel_type = 'spouseOf'").select("passage", t2.alias("person"), F.lit("spouse").alias("kind"), t1.alias("other")),
    ]
    both = looks[0]
    for more in looks[1:]:
        both = both.unionByName(more)
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("other")))).alias(f"{kind}s")
    return both.groupBy("passage", "person").agg(of("father"), of("mother"), of("spouse"))


def stored_family_context(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, fathers, mothers, spouses) of stored persons, as lower names."""
    names = entities.select("key", F.lower("display_en_name").alias("name"))
    named = (
        rels.where(F.col("rel_type").isin(*dims.FAMILY_RELS))
        .join(names.select(F.col("key").alias("term1"), F.col("name").alias("name1")), "term1")
        .join(names.select(F.col("key").alias("term2"), F.col("name").alias("name2")), "term2")
    )
    looks = named.select(F.col("term1").alias("key"), "rel_type", F.col("name2").alias("other")).unionByName(
        named.where("rel_type = 'spouseOf'").select(F.col("term2").alias("key"), "rel_type", F.col("name1").alias("other"))
    )
    of = lambda rel, out: F.array_sort(F.collect_set(F.when(F.col("rel_type") == rel, F.col("other")))).alias(out)
    return looks.groupBy("key").agg(of("childOfFather", "fathers"), of("childOfMother", "mothers"), of("spouseOf", "spouses"))


def resolve_persons(new: DataFrame, entities: DataFrame, rels: DataFrame, order: str | None = None) -> DataFrame:
    """(name, key): the stored person that each new person (name, fathers, mothers,
    spouses) is, or null for a new one.

    Without a family the first of the name matches.  Else the first whose stored family is
    empty or shares a father, mother or spouse, or who is tied by marriage: a father of one is
    the spouse of a mother of the other.  Candidates come in the order of the column ``order`` of
    the entities (when they were stored), without one in that of their keys.
    """
    place = F.lit(0) if order is None else F.col(order)
    persons = entities.where("entityType = 'Person'").select("key", F.lower("display_en_name").alias("name"), F.struct(place.alias("place"), F.col("key").alias("key")).alias("place"))
    empty = F.array().cast("array<string>")
    stored = persons.join(stored_family_context(rels, entities), "key", "left").select(
        "key", "name", "place", *[F.coalesce(c, empty).alias(f"old_{c}") for c in ("fathers", "mothers", "spouses")]
    )
    cand = new.select(F.lower("name").alias("name"), *[F.coalesce(c, empty).alias(c) for c in ("fathers", "mothers", "spouses")]).join(stored, "name")
    shares = F.lit(False)
    for c in ("fathers", "mothers", "spouses"):
        shares = shares | F.arrays_overlap(c, f"old_{c}")
    no_family = (F.size("fathers") == 0) & (F.size("mothers") == 0) & (F.size("spouses") == 0)
    no_stored = (F.size("old_fathers") == 0) & (F.size("old_mothers") == 0) & (F.size("old_spouses") == 0)

    first = persons.groupBy("name").agg(F.min_by("key", "place").alias("first_key"))
    couples = rels.where("rel_type = 'spouseOf'").select("term1", "term2")
    couples = couples.unionByName(couples.select(F.col("term2").alias("term1"), F.col("term1").alias("term2"))).distinct()
    pairs = cand.select("name", "key", F.explode("fathers").alias("he"), "old_mothers").select("name", "key", "he", F.explode("old_mothers").alias("she")).unionByName(
        cand.select("name", "key", F.explode("old_fathers").alias("he"), "mothers").select("name", "key", "he", F.explode("mothers").alias("she"))
    )
    in_law = (
        pairs.join(first.select(F.col("name").alias("he"), F.col("first_key").alias("term1")), "he")
        .join(first.select(F.col("name").alias("she"), F.col("first_key").alias("term2")), "she")
        .join(couples, ["term1", "term2"], "left_semi").select("name", "key").distinct().withColumn("in_law", F.lit(True))
    )
    good = cand.join(in_law, ["name", "key"], "left").where(no_family | no_stored | shares | F.coalesce("in_law", F.lit(False)))
    return new.select(F.lower("name").alias("name")).distinct().join(good.groupBy("name").agg(F.min_by("key", "place").alias("key")), "name", "left")


def entity_key(identity_col: Column) -> Column:
    """A key that depends on the identity alone, so a second run makes the same one."""
    return F.concat(F.lit("e"), F.substring(F.sha2(identity_col, 256), 1, 24))


def build_entities(ents: DataFrame, existing: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One row for each identity of the mentions, from its first (whose ``passage`` it has) in import order
    (``import_order``, any orderable column); ``is_new`` unless ``existing`` (identity, key)
    has it."""
    rank = F.struct("import_order", "category", "ordinal")
    fields = ["category", "name", "number_category", "en_unit", "en_context", "passage"]
    built = with_identity(ents, strict).groupBy("identity").agg(F.min_by(F.struct(*fields), rank).alias("first"), F.count("*").alias("mentions"))
    out = built.select("identity", "first.*", "mentions")
    if existing is None:
        return out.withColumn("key", entity_key(F.col("identity"))).withColumn("is_new", F.lit(True))
    old = existing.select("identity", F.col("key").alias("old_key"))
    return out.join(old, "identity", "left").withColumn("is_new", F.col("old_key").isNull()).withColumn("key", F.coalesce("old_key", entity_key(F.col("identity")))).drop("old_key")


def with_entity_keys(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows with an ``identity`` (which may be null) and the ``key`` of its entity, null without one.

    Entities of more than a thousandth of all mentions (fewer than 1,000) are met by a
    broadcast, and their rows spread by passage: else one task would get all rows of one entity.
    """
    total = entities.agg(F.sum("mentions").alias("total"))
    common = entities.crossJoin(F.broadcast(total)).where("mentions * 1000 > total").select("identity", F.col("key").alias("common_key"))
    met = mentions.join(F.broadcast(common), "identity", "left")
    at = F.coalesce(F.when(F.col("common_key").isNull(), F.col("identity")), F.concat(F.lit("\x1f"), F.coalesce("passage", F.lit(""))))
    rare = entities.select(F.col("identity").alias("at"), F.col("key").alias("rare_key"))
    return met.withColumn("at", at).join(rare, "at", "left").withColumn("key", F.coalesce("common_key", "rare_key")).drop("at", "common_key", "rare_key")


#: Mentions that one task of resolve_term_keys joins, about.
MENTIONS = 500_000


def resolve_term_keys(terms: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(passage, term, key) for (passage, term): the passage's own mention first, by
    category order, else any entity of the name by category order; numbers are found by their
    passage only.  Null where nothing has the name.  Only mentions that a term of their passage
    names get a key."""
    rank = F.broadcast(dims.entity_types(terms.sparkSession).select(F.col("entity_type").alias("category"), F.col("ordinal").alias("rank")))
    low = terms.select("passage", "term", F.lower("term").alias("low")).distinct()
    own = with_identity(mentions).join(rank, "category").select("passage", F.lower("name").alias("low"), "identity", "rank")
    at = ["passage", "low"]
    # tasks of a bounded number of rows; fewer than the usual partitions would be shuffled again
    spark = terms.sparkSession
    parts = (entities.agg(F.sum("mentions")).first()[0] or 0) // MENTIONS
    if parts > spark.sparkContext.defaultParallelism:
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
        low, own = low.repartition(parts, *at), own.repartition(parts, *at)
    named = low.join(own, at, "left")
    local = with_entity_keys(named, entities).groupBy("passage", "term", "low").agg(F.min_by("key", F.struct("rank", "key")).alias("local_key"))
    by_name = entities.where("category <> 'Number'").join(rank, "category").groupBy(F.lower("name").alias("low")).agg(F.min_by("key", F.struct("rank", "key")).alias("any_key"))
    return local.join(by_name, "low", "left").select("passage", "term", F.coalesce("local_key", "any_key").alias("key"))


def build_rels(rels: DataFrame, term_keys: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rels, passage rels, rejects).  Rels have one row for each (type, term1, term2); a
    passage keeps its tie to a rel that another passage had first; unresolved terms reject."""
    side = lambda n: term_keys.select("passage", F.col("term").alias(f"term{n}"), F.col("key").alias(f"key{n}"))
    # all three results read it
    keyed = cut_lineage(rels.join(side(1), ["passage", "term1"], "left").join(side(2), ["passage", "term2"], "left"), "keyed-rels")
    rejects = keyed.where("key1 IS NULL OR key2 IS NULL").select(*rels.columns)
    natural = F.concat_ws("\x1f", "rel_type", "key1", "key2")
    good = keyed.where("key1 IS NOT NULL AND key2 IS NOT NULL").withColumn("made", F.concat(F.lit("r"), F.substring(F.sha2(natural, 256), 1, 24)))
    if existing is not None:
        old = existing.select("rel_type", F.col("term1").alias("key1"), F.col("term2").alias("key2"), F.col("key").alias("old_key"))
        good = good.join(old, ["rel_type", "key1", "key2"], "left").withColumn("key", F.coalesce("old_key", "made"))
    else:
        good = good.withColumn("key", F.col("made")).withColumn("old_key", F.lit(None).cast("string"))
    new = good.where("old_key IS NULL").select("key", "rel_type", F.col("key1").alias("term1"), F.col("key2").alias("term2")).dropDuplicates(["key"])
    return new, good.select("passage", F.col("key").alias("rel_key")).distinct(), rejects


def build_meta(passages: DataFrame, mentions: DataFrame, entities: DataFrame, passage_rels: DataFrame) -> DataFrame:
    """Passages (key, ...) with the sorted sets of their entity and rel keys, empty for
    passages that mention nothing."""
    empty = F.array().cast("array<string>")
    ek = with_entity_keys(with_identity(mentions).select("passage", "identity").distinct(), entities).groupBy(F.col("passage").alias("p")).agg(F.array_sort(F.collect_set("key")).alias("entity_keys"))
    rk = passage_rels.groupBy(F.col("passage").alias("q")).agg(F.array_sort(F.collect_set("rel_key")).alias("rel_keys"))
    out = passages.join(ek, F.col("key") == F.col("p"), "left").join(rk, F.col("key") == F.col("q"), "left").drop("p", "q")
    return out.withColumn("entity_keys", F.coalesce("entity_keys", empty)).withColumn("rel_keys", F.coalesce("rel_keys", empty))


def resolve_stored(built: DataFrame, rels: DataFrame, entities: DataFrame, stored_rels: DataFrame) -> DataFrame:
    """(identity, old_key): the stored entity of each built one that has one.  Persons are told
    apart by their families in the passage that mentions them first; others by identity."""
    families = family_context(rels).select("passage", F.col("person").alias("name"), "fathers", "mothers", "spouses")
    empty = F.array().cast("array<string>")
    persons = built.where("category = 'Person'").select("identity", "passage", F.lower("name").alias("name")).join(families, ["passage", "name"], "left")
    persons = persons.select("identity", "name", *[F.coalesce(c, empty).alias(c) for c in ("fathers", "mothers", "spouses")])
    known = resolve_persons(persons, entities, stored_rels).where("key IS NOT NULL")
    columns = {"category": "entityType", "name": "display_en_name", "number_category": "numberCategory"}
    old = entities.where("entityType <> 'Person'").select("key", "en_unit", "en_context", *[F.col(b).alias(a) for a, b in columns.items()])
    others = with_identity(old).groupBy("identity").agg(F.min("key").alias("old_key"))
    return persons.select("identity", "name").join(known, "name").select("identity", F.col("key").alias("old_key")).unionByName(others)


def build_graph(passages: DataFrame, mentions: DataFrame, rels: DataFrame, entities: DataFrame | None = None, stored_rels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Entities, rels, passage metadata and rejects of cleaned mentions (with
    import_order) and rels (with rel_type).

    With stored ``entities`` and ``stored_rels``, what is there already keeps its key: entities
    say so in ``is_new``, and only new rels are returned.  A new person whose key a stored
    namesake has takes one that its first passage is part of.
    """
    built = build_entities(mentions)
    if entities is not None:
        made = entity_key(F.col("identity"))
        taken = entities.select(F.col("key").alias("taken_key")).distinct()
        found = built.drop("key", "is_new").join(resolve_stored(built, rels, entities, stored_rels), "identity", "left").join(taken, made == F.col("taken_key"), "left")
        own = F.when(F.col("taken_key").isNull(), made).otherwise(entity_key(F.concat_ws("\x1f", "identity", "passage")))
        built = found.withColumn("is_new", F.col("old_key").isNull()).withColumn("key", F.coalesce("old_key", own)).drop("old_key", "taken_key")
    built = cut_lineage(built, "graph-entities")
    terms = rels.select("passage", F.col("term1").alias("term")).unionByName(rels.select("passage", F.col("term2").alias("term")))
    made, tied, rejects = build_rels(rels, resolve_term_keys(terms, mentions, built), stored_rels)
    return {"entities": built, "rels": made, "meta": build_meta(passages, mentions, built, tied), "rejects": rejects}


def upsert(base: DataFrame, delta: DataFrame, key: str = "key", ignore_null: bool = True) -> DataFrame:
    """Base with delta's rows put in; ``op`` is inserted, updated or kept.  A null in the
    delta leaves the stored value alone unless ``ignore_null`` is off.  The last of the delta's
    rows of one key is not defined, so the delta must have one row a key."""
    cols = [c for c in base.columns if c != key]
    d = delta.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in cols if c in delta.columns], F.lit(True).alias("in_delta"))
    joined = base.withColumn("in_base", F.lit(True)).join(d, key, "full")

    def value(c: str) -> Column:
        if c not in delta.columns:
            return F.col(c)
        return F.coalesce(f"new_{c}", c) if ignore_null else F.when(F.col("in_delta"), F.col(f"new_{c}")).otherwise(F.col(c))

    op = F.when(F.col("in_base").isNull(), "inserted").when(F.col("in_delta"), "updated").otherwise("kept")
    return joined.select(key, *[value(c).alias(c) for c in cols], op.alias("op"))


def deleted_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """(deleted): how many rows went."""
    n = before.agg(F.count("*").alias("n")).unionByName(after.agg((-F.count("*")).alias("n")))
    return n.agg(F.sum("n").alias("deleted"))


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that stay; a predicate that is null deletes nothing."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, cols: Sequence[str] = ("key",)) -> DataFrame:
    """G13."""
    return df.join(keys.select(*cols), list(cols), "left_anti")


def insert_if_absent(base: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Base and the rows of new keys."""
    return base.unionByName(new.dropDuplicates([key]).join(base.select(key), key, "left_anti").select(*base.columns))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")
