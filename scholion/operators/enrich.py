"""Enrichment.

Patches are rows (passage, import_order, ordinal, key, display_heb_name, timePeriod, isWoman,
isNonJew, isGroup, roles, heb_unit, heb_context, placeType, symbolType).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion import dims
from scholion.functions.text import match_fixed
from scholion.operators.lookup import bridge, has_metadata

ENUMS = {"timePeriod": dims.TIME_PERIODS, "placeType": dims.PLACE_TYPES, "symbolType": dims.SYMBOL_TYPES}
#: Fields that a patch may set, by the entity types that have them; None is every type.
FIELDS = {
    "display_heb_name": None,
    "timePeriod": ("Person",),
    "isWoman": ("Person",),
    "isNonJew": ("Person",),
    "isGroup": ("Person",),
    "heb_unit": ("Number",),
    "heb_context": ("Number",),
    "placeType": ("Place",),
    "symbolType": ("Symbol",),
}


def match_enums(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches with fixed spellings, rejects): values of no enumeration become null (or
    leave the role list) and are listed as (passage, key, field, value)."""
    clean = patches
    bad = [F.when(F.col(c).isNotNull() & match_fixed(F.col(c), allowed).isNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c, allowed in ENUMS.items()]
    wrong_roles = F.transform(F.filter(F.coalesce("roles", F.array().cast("array<string>")), lambda r: match_fixed(r, dims.ROLE_TYPES).isNull()), lambda r: F.struct(F.lit("roles").alias("field"), r.alias("value")))
    rejects = patches.select("passage", "key", F.explode(F.concat(F.array_compact(F.array(*bad)), wrong_roles)).alias("x")).select("passage", "key", "x.field", "x.value")
    for c, allowed in ENUMS.items():
        clean = clean.withColumn(c, match_fixed(F.col(c), allowed))
    return clean.withColumn("roles", F.array_compact(F.transform("roles", lambda r: match_fixed(r, dims.ROLE_TYPES)))), rejects


def _valid(patches: DataFrame, c: str):
    return F.col(c).isNotNull() if dict(patches.dtypes)[c] == "boolean" else F.trim(F.col(c)) != ""


def apply_enrichment(entities: DataFrame, patches: DataFrame) -> DataFrame:
    """Entities with the last non-blank value of each field of their type, roles united;
    ``changed`` marks rows that differ."""
    order = F.struct("import_order", "ordinal")
    last = patches.groupBy("key").agg(
        *[F.max_by(F.when(_valid(patches, c), F.col(c)), F.when(_valid(patches, c), order)).alias(f"new_{c}") for c in FIELDS],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("new_roles"),
    )
    out = entities.join(last, "key", "left")
    changed = F.lit(False)
    values = {}
    for c, types in FIELDS.items():
        own = F.lit(True) if types is None else F.col("entityType").isin(*types)
        values[c] = F.when(own, F.coalesce(f"new_{c}", c)).otherwise(F.col(c))
    empty = F.array().cast("array<string>")
    values["roles"] = F.when(F.col("entityType") == "Person", F.array_union(F.coalesce("roles", empty), F.coalesce("new_roles", empty))).otherwise(F.col("roles"))
    for c, v in values.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in entities.columns], changed.alias("changed"))


def enrichment_tally(entities: DataFrame, patches: DataFrame, field: str = "display_heb_name") -> DataFrame:
    """(status, n): each patch entry in order against what the ones before it left of a
    field: missing (no entity), updated, unchanged."""
    stored = entities.select("key", F.col(field).alias("stored"), F.lit(True).alias("known"))
    w = Window.partitionBy("key").orderBy("import_order", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    p = patches.select("key", "import_order", "ordinal", F.when(_valid(patches, field), F.col(field)).alias("value")).join(stored, "key", "left")
    before = F.coalesce(F.last("value", ignorenulls=True).over(w), F.col("stored"))
    status = F.when(F.col("known").isNull(), "missing").when(F.col("value").isNull() | F.col("value").eqNullSafe(F.col("before")), "unchanged").otherwise("updated")
    return p.withColumn("before", before).withColumn("status", status).groupBy("status").agg(F.count("*").alias("n"))


def enrichment_states(entities: DataFrame, patches: DataFrame) -> DataFrame:
    """Each patch entry with what it changes, given what the entries before it left:
    (passage, import_order, ordinal, key, status, changed).

    status is missing (no entity), updated or unchanged; changed lists the fields of the
    entity's type that take another value, and roles where a role is new.  The state before an
    entry is the last valid value of each field, from one sorted pass by key; a role is new at
    its first entry, so no set of roles is carried along.
    """
    order = F.struct("import_order", "ordinal")
    fields = [c for c in FIELDS if c in patches.columns and c in entities.columns]
    stored = entities.select("key", "entityType", F.coalesce("roles", F.array().cast("array<string>")).alias("old_roles"), *[F.col(c).alias(f"old_{c}") for c in fields])
    before = Window.partitionBy("key").orderBy("import_order", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    p = patches.select("passage", "import_order", "ordinal", "key", "roles", *[F.when(_valid(patches, c), F.col(c)).alias(c) for c in fields])
    firsts = p.select("key", order.alias("at"), F.explode("roles").alias("role")).groupBy("key", "role").agg(F.min("at").alias("at")).groupBy("key", "at").agg(F.collect_set("role").alias("first_roles"))
    held = p.select("*", *[F.last(c, ignorenulls=True).over(before).alias(f"before_{c}") for c in fields])
    joined = held.withColumn("at", order).join(firsts, ["key", "at"], "left").join(stored, "key", "left")

    def differs(c: str) -> Column:
        own = F.lit(True) if FIELDS[c] is None else F.col("entityType").isin(*FIELDS[c])
        return own & F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.coalesce(f"before_{c}", f"old_{c}"))

    roles = (F.col("entityType") == "Person") & (F.size(F.array_except("first_roles", "old_roles")) > 0)
    changed = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in fields], F.when(roles, F.lit("roles"))))
    status = F.when(F.col("entityType").isNull(), "missing").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    return joined.select("passage", "import_order", "ordinal", "key", status.alias("status"), F.when(F.col("entityType").isNotNull(), changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def add_display_names(patches: DataFrame, entities: DataFrame) -> DataFrame:
    """I4."""
    return patches.drop("display_en_name").join(entities.select("key", "display_en_name"), "key", "left")


def enrichment_worklist(meta: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, todo): passages with entities to enrich, and these as JSON in key order."""
    lacking = entities.where(~has_metadata()).select(F.col("key").alias("entity_key"), "display_en_name", "entityType")
    todo = bridge(meta, "entity_keys", "entity_key").join(lacking, "entity_key")
    return todo.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("entity_key", "display_en_name", "entityType")))).alias("todo"))


def usage_rollup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of usage (provider, tokens_in, tokens_out) by provider, and in all
    (null provider); prices are for a million tokens."""
    priced = usage.join(prices, "provider", "left")
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1e6
    return priced.withColumn("cost", cost).rollup("provider").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))
