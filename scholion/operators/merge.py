"""Alias merge (H1-H8).

A merge list row names an entity's final name and the names to join; rows are (list, row,
entity_type, final_name, names, merged).
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.components import components
from scholion.functions.shared import cut_lineage
from scholion.functions.workers import ship


def parse_merge_names(rows: DataFrame) -> DataFrame:
    """H1: (list, row, entity_type, ordinal, name): names between bars, trimmed, in lower case,
    without blanks and repeats, in order."""
    names = F.array_distinct(F.filter(F.transform(F.split("names", r"\|"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return rows.select("list", "row", "entity_type", F.posexplode(names).alias("ordinal", "name"))


def _hits(rows: DataFrame, entities: DataFrame) -> DataFrame:
    e = entities.select(F.col("entityType").alias("entity_type"), F.lower("display_en_name").alias("name"), "key")
    return parse_merge_names(rows).join(e, ["entity_type", "name"])


def plan_merge(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """H2: rows with ``status``: merged_already, error (no final name), ambiguous (a name of
    several entities), nothing (fewer than two entities) or merge."""
    hits = _hits(rows, entities)
    per_name = hits.groupBy("list", "row", "name").agg(F.count("*").alias("n"))
    per_row = per_name.groupBy("list", "row").agg(F.max("n").alias("most"), F.sum("n").alias("found"))
    done = F.lower(F.trim(F.coalesce("merged", F.lit("")))).isin("true", "yes", "1")
    status = (
        F.when(done, "merged_already")
        .when(F.trim(F.coalesce("final_name", F.lit(""))) == "", "error")
        .when(F.col("most") > 1, "ambiguous")
        .when(F.coalesce("found", F.lit(0)) < 2, "nothing")
        .otherwise("merge")
    )
    return rows.join(per_row, ["list", "row"], "left").withColumn("status", status).drop("most", "found")


def merge_targets(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """H3: (list, row, dup_key, target_key, final_name): the entity of the final name, else the
    first in list order, is the target of the others.

    Of rows that share an entity, only the first has targets here: the others depend on what it
    leaves (``apply_merge`` takes them in turn)."""
    todo = plan_merge(rows, entities).where("status = 'merge'")
    hits = _hits(todo, entities).join(todo.select("list", "row", "final_name"), ["list", "row"])
    first_row = F.min(F.struct("list", "row")).over(Window.partitionBy("key"))
    hits = hits.withColumn("clash", first_row != F.struct("list", "row"))
    hits = hits.withColumn("held", F.max("clash").over(Window.partitionBy("list", "row"))).where("NOT held")
    rank = F.row_number().over(Window.partitionBy("list", "row").orderBy((F.col("name") != F.lower(F.trim("final_name"))).cast("int"), "ordinal"))
    ranked = hits.withColumn("rank", rank)
    target = ranked.where("rank = 1").select("list", "row", F.col("key").alias("target_key"))
    return ranked.where("rank > 1").join(target, ["list", "row"]).select("list", "row", F.col("key").alias("dup_key"), "target_key", "final_name", "rank")


def fold_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """H4: targets with the fields of their duplicates folded in, by the order of their ranks;
    other entities as they are."""
    e = F.lit("entity").alias("kind")
    once = mapping.select("target_key", F.lit(1).alias("pos"), e, F.col("target_key").alias("key"), F.lit(None).cast("string").alias("final_name")).distinct()
    dups = mapping.select("target_key", F.explode(F.array(F.struct((F.col("rank") * 2).alias("pos"), e, F.col("dup_key").alias("key"), F.lit(None).cast("string").alias("final_name")), F.struct((F.col("rank") * 2 + 1).alias("pos"), F.lit("merged").alias("kind"), F.col("dup_key").alias("key"), F.col("final_name")))).alias("s"))
    return fold_steps(entities, once.unionByName(dups.select("target_key", "s.*")))


def fold_steps(entities: DataFrame, steps: DataFrame) -> DataFrame:
    """H4: each target after all that was folded into it, directly or through its duplicates.

    ``steps`` (target_key, pos, kind, key, final_name) are in the order in which one list grows:
    an ``entity`` step adds what the entity of the key has, a ``merged`` step notes that the
    duplicate of the key went into another under the final name.  Names, aliases (with the
    duplicates' keys) and lists are united in that order without repeats in any case, flags
    OR-ed, other fields filled where empty by the first that has one; the last final name is
    the target's.  Entities without steps stay as they are.
    """
    lists = [c for c, t in entities.dtypes if t == "array<string>"]
    flags = [c for c, t in entities.dtypes if t == "boolean"]
    plain = [c for c, t in entities.dtypes if t == "string" and c not in ("key", "entityType", "display_en_name")]
    rows = steps.where("kind = 'entity'").join(entities, "key").unionByName(steps.where("kind = 'merged'"), allowMissingColumns=True)
    noted = {"alias_keys": F.array("key"), "all_en_names": F.array("final_name")}

    def united(c: str) -> Column:
        added = F.when(F.col("kind") == "merged", noted.get(c, F.array().cast("array<string>"))).otherwise(F.col(c))
        grown = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(added, F.array().cast("array<string>")).alias("v"))))
        return F.flatten(F.transform(grown, lambda x: x["v"]))

    full = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    agg = rows.groupBy("target_key").agg(
        F.max_by("final_name", F.when(F.col("final_name").isNotNull(), F.col("pos"))).alias("final_name"),
        F.min_by("entityType", F.when(F.col("entityType").isNotNull(), F.col("pos"))).alias("entityType"),
        *[united(c).alias(c) for c in lists],
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in flags],
        *[F.min_by(full(c), F.when(full(c).isNotNull(), F.col("pos"))).alias(c) for c in plain],
    )

    def once(a: Column) -> Column:
        """The first of each text in any case, without blanks."""
        low = F.transform(a, F.lower)
        return F.filter(F.transform(F.arrays_zip(a.alias("v"), low.alias("low")), lambda x, i: F.when((x["v"] != "") & (F.array_position(low, x["low"]) == i + 1), x["v"])), lambda x: x.isNotNull())

    for c in lists:
        agg = agg.withColumn(c, once(F.col(c)))
    folded = agg.withColumn("display_en_name", F.lower(F.trim("final_name"))).withColumn("key", F.col("target_key")).select(*entities.columns)
    return entities.join(steps.where("kind = 'entity'").select("key").distinct(), "key", "left_anti").unionByName(folded)


def repoint_rels(rels: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H5: (rels, rel map): ends moved to targets, self-loops gone, one rel for each natural key
    (one that did not move before one that did, then the smallest key).  The map gives each
    old key's new one, null where the rel is gone."""
    side = lambda n: mapping.select(F.col("dup_key").alias(f"term{n}"), F.col("target_key").alias(f"to{n}")).distinct()
    moved = rels.join(side(1), "term1", "left").join(side(2), "term2", "left")
    moved = moved.select("key", "rel_type", F.coalesce("to1", "term1").alias("term1"), F.coalesce("to2", "term2").alias("term2"), (F.col("to1").isNotNull() | F.col("to2").isNotNull()).alias("changed"))
    kept = F.min_by("key", F.struct("changed", "key")).over(Window.partitionBy("rel_type", "term1", "term2"))
    named = moved.withColumn("new_key", F.when(F.col("term1") != F.col("term2"), kept))
    return named.where("key = new_key").select("key", "rel_type", "term1", "term2"), named.select(F.col("key").alias("old_key"), "new_key")


def repoint_meta(meta: DataFrame, mapping: DataFrame, rel_map: DataFrame) -> DataFrame:
    """H6: metadata with entity keys moved to targets and rel keys to what is left of them."""
    e = meta.select("key", F.explode("entity_keys").alias("dup_key")).join(mapping.select("dup_key", "target_key").distinct(), "dup_key", "left")
    e = e.groupBy("key").agg(F.array_sort(F.collect_set(F.coalesce("target_key", "dup_key"))).alias("new_entities"))
    r = meta.select("key", F.explode("rel_keys").alias("old_key")).join(rel_map.withColumn("known", F.lit(True)), "old_key", "left")
    r = r.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("known"), F.col("new_key")).otherwise(F.col("old_key")))).alias("new_rels"))
    empty = F.array().cast("array<string>")
    out = meta.join(e, "key", "left").join(r, "key", "left")
    return out.withColumn("entity_keys", F.coalesce("new_entities", empty)).withColumn("rel_keys", F.coalesce("new_rels", empty)).select(*meta.columns)


class _Names:
    """Which entities have which name while a component's rows are worked off."""

    def __init__(self):
        self.of: dict[str, list[str]] = {}
        self.steps: dict[str, list[tuple[str, str, str | None]]] = {}

    def merge(self, final: str, names: list[str]) -> str:
        """The status of a row, after doing what it says."""
        found: dict[str, str] = {}
        for name in names:
            have = self.of.get(name, [])
            if len(have) > 1:
                return "ambiguous"
            if have:
                found[name] = have[0]
        if len(found) < 2:
            return "nothing"
        canonical = final.strip().lower()
        target = found.get(canonical, next(iter(found.values())))
        own = self.steps.setdefault(target, [("entity", target, None)])
        for name, key in found.items():
            self.of[name] = []
            if key != target:
                own += [*self.steps.pop(key, [("entity", key, None)]), ("merged", key, final)]
        self.of[canonical] = [*self.of.get(canonical, []), target][:2]
        return "merge"


_REPLAYED = "list string, row long, status string, target_key string, pos int, kind string, key string, final_name string"


#: Rows that one group works off, on average.
ROWS = 4096


def _replay(rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
    """The rows of some components in order: the status of each, and the steps of each target."""
    states: dict[str, _Names] = defaultdict(_Names)
    for part, name, key in zip(hits["part"], hits["name"], hits["key"], strict=True):
        states[part].of.setdefault(name, []).append(key)
    out = []
    for r in rows.sort_values(["list", "row"]).itertuples():
        out.append((r.list, r.row, states[r.component].merge(r.final_name, list(r.names)), None, None, None, None, None))
    for state in states.values():
        for target, steps in state.steps.items():
            out += [(None, None, None, target, pos, *step) for pos, step in enumerate(steps)]
    columns = ["list", "row", "status", "target_key", "pos", "kind", "key", "final_name"]
    return pd.DataFrame(out, columns=columns).astype({"row": "Int64", "pos": "Int32"})


def replay_merge(rows: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H2, H3, H8 over a whole run: (rows with the status that each has at its own turn, steps).

    Rows depend on each other only through names that they share, their final names among them;
    the components of that graph are found by pointer jumping, so a chain of n rows takes log n
    rounds, and each is worked off in order in one group, together with others of its bin.
    A group holds names and keys of a list that is kept by hand, never entities.  A name of two
    entities stays ambiguous for good, so two keys a name are enough.  A row is at its turn by list, then row.
    """
    ship(rows.sparkSession)
    done = F.lower(F.trim(F.coalesce("merged", F.lit("")))).isin("true", "yes", "1")
    ruled = F.when(done, "merged_already").when(F.trim(F.coalesce("final_name", F.lit(""))) == "", "error")
    rows = cut_lineage(rows.withColumn("ruled", ruled), "merge-rows")
    left = rows.where("ruled IS NULL")
    given = parse_merge_names(left)
    node = F.concat_ws("\x1f", F.lit("row"), "list", "row")
    named = given.select("list", "row", "entity_type", "name").unionByName(left.select("list", "row", "entity_type", F.lower(F.trim("final_name")).alias("name")))
    edges = named.select(node.alias("a"), F.concat_ws("\x1f", F.lit("name"), "entity_type", "name").alias("b"))
    parts = cut_lineage(components(edges), "merge-parts")
    lists = given.groupBy("list", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("names"))
    turns = left.drop("names").join(lists, ["list", "row"], "left").withColumn("node", node).join(parts, "node")
    turns = turns.select("component", "list", "row", "final_name", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    known = entities.groupBy(F.concat_ws("\x1f", F.lit("name"), "entityType", F.lower("display_en_name")).alias("node"), F.lower("display_en_name").alias("name")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    hits = known.join(parts, "node").select(F.col("component").alias("part"), "name", F.explode(F.array_distinct(F.array("low", "high"))).alias("key"))
    # most components are a few rows: many of them share a call of Python, and no call has many rows of others
    groups = max(1, -(-rows.count() // ROWS))
    dealt = lambda df, by: df.withColumn(f"{by}_bin", F.pmod(F.xxhash64(by), F.lit(groups))).repartition(groups, f"{by}_bin").groupBy(f"{by}_bin")
    out = cut_lineage(dealt(turns, "component").cogroup(dealt(hits, "part")).applyInPandas(_replay, _REPLAYED), "merge-replayed")
    own = out.where("status IS NOT NULL").select("list", "row", "status")
    statuses = rows.join(own, ["list", "row"], "left").withColumn("status", F.coalesce("ruled", "status")).drop("ruled")
    return statuses, out.where("kind IS NOT NULL").select("target_key", "pos", "kind", "key", "final_name")


def apply_merge(entities: DataFrame, rels: DataFrame, meta: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """H7: all tables after all merges, and the list with its rows marked and with the status
    that each had at its turn.

    The rows are worked off on names and keys alone; then entities are folded, rels and metadata
    moved to the last targets, once for the whole run.
    """
    statuses, steps = replay_merge(rows, entities)
    mapping = steps.where("kind = 'entity' AND key <> target_key").select(F.col("key").alias("dup_key"), "target_key")
    rels, rel_map = repoint_rels(rels, mapping)
    marked = statuses.withColumn("merged", F.when(F.col("status") == "merge", "true").otherwise(F.col("merged")))
    return {"entities": fold_steps(entities, steps), "rels": rels, "meta": repoint_meta(meta, mapping, cut_lineage(rel_map, "merge-rel-map")), "rows": marked}


def merge_tallies(plan: DataFrame) -> DataFrame:
    """H8: (list, status, n) by list and status, by list, and in all (nulls mark totals), of a
    plan or of the rows of a run."""
    return plan.rollup("list", "status").agg(F.count("*").alias("n"))
