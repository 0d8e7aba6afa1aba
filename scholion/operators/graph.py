"""Profiles and family graphs.

Graphs of many centres grow together: every state row carries its centre, a level is a few
joins, and each level is cut off by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion import dims
from scholion.functions.shared import cut_lineage
from scholion.operators.lookup import ends

MAX_DEPTH = 10


def siblings(rels: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(self, sibling): other children of any father or mother."""
    parents = parent_links(rels)
    mine = parents if keys is None else parents.join(keys.select(F.col("key").alias("self")).distinct(), "self", "left_semi")
    return expand_classes(sibling_classes(parents), mine)


#: Children that one row of a class holds.
MEMBERS = 1000


def sibling_classes(children: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """(group..., parent, n, part, members) of (group..., parent, self): the children of a parent
    as rows of MEMBERS at most, about, and how many there are in all.

    A family of n children is n members, not n times n pairs; pairs are made by
    ``expand_classes`` for those who are asked for.  Parts are dealt by hash, so a parent of
    very many children is spread over tasks.
    """
    keys = [*group, "parent"]
    own = children.select(*keys, "self").distinct()
    counted = own.join(own.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    dealt = counted.withColumn("part", F.pmod(F.xxhash64("self"), F.ceil(F.col("n") / MEMBERS)).cast("int"))
    return dealt.groupBy(*keys, "n", "part").agg(F.array_sort(F.collect_list("self")).alias("members"))


def parent_links(rels: DataFrame) -> DataFrame:
    """(self, parent) of father and mother rels."""
    return rels.where(F.col("rel_type").isin("childOfFather", "childOfMother")).select(F.col("term1").alias("self"), F.col("term2").alias("parent"))


def expand_classes(classes: DataFrame, members: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """(group..., self, sibling): the siblings of the members (group..., parent, self) asked for."""
    keys = [*group, "parent"]
    rows = members.select(*keys, "self").distinct().join(classes, keys)
    return rows.select(*group, "self", F.explode("members").alias("sibling")).where("self <> sibling").distinct()


def sibling_counts(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(self, parent, siblings): how many siblings a member has by each parent, without a pair."""
    sizes = classes.select("parent", "n").distinct()
    return members.select("self", "parent").distinct().join(sizes, "parent").select("self", "parent", (F.col("n") - 1).alias("siblings"))


def profile_links(entities: DataFrame, rels: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(key, field, other, name, type): every related entity of every entity under the
    field that its type, the rel type and its side give; an unknown other end shows its key.
    A rel of an entity with itself counts for its first side only."""
    seen = ends(rels).where("NOT (self = other AND side = 2)")
    if keys is not None:
        seen = seen.join(keys.select(F.col("key").alias("self")).distinct(), "self", "left_semi")
    types = entities.select(F.col("key").alias("self"), F.col("entityType").alias("entity_type"))
    fields = F.broadcast(dims.profile_fields(rels.sparkSession))
    mapped = seen.join(types, "self").join(fields, ["entity_type", "rel_type", "side"]).select("self", "field", "other", "rel_key")
    sib = siblings(rels, keys).join(types.where("entity_type = 'Person'"), "self", "left_semi")
    rows = mapped.unionByName(sib.select("self", F.lit("siblings").alias("field"), F.col("sibling").alias("other"), F.lit("~").alias("rel_key")))
    names = entities.select(F.col("key").alias("other"), "display_en_name", F.col("entityType").alias("type"))
    return rows.join(names, "other", "left").select(F.col("self").alias("key"), "field", "other", F.coalesce("display_en_name", "other").alias("name"), "type", "rel_key")


def entity_profiles(entities: DataFrame, rels: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(key, field, names): distinct names in the order of the rels' keys."""
    first = profile_links(entities, rels, keys).groupBy("key", "field", "name").agg(F.min("rel_key").alias("rel_key"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rel_key", "name"))), lambda x: x["name"])
    return first.groupBy("key", "field").agg(listed.alias("names"))


def navigation_links(entities: DataFrame, rels: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(key, links): map of related name to (key, type); of equal names the last rel wins."""
    last = profile_links(entities, rels, keys).groupBy("key", "name").agg(F.max_by(F.struct(F.col("other").alias("key"), "type"), F.struct("rel_key", "other")).alias("link"))
    return last.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "link")))).alias("links"))


def family_graph(entities: DataFrame, rels: DataFrame, centers: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the sibling classes of ``family_classes`` written out as edges."""
    nodes, edges, classes = family_classes(entities, rels, centers, depth)
    # a class of one row has its pairs within it; only larger ones are joined
    small = classes.where(F.col("n") <= MEMBERS).select("center", "members", F.explode("members").alias("self"))
    small = small.select("center", "self", F.explode(F.filter("members", lambda x: x > F.col("self"))).alias("sibling"))
    large = classes.where(F.col("n") > MEMBERS)
    pairs = expand_classes(large, large.select("center", "parent", F.explode("members").alias("self")), ("center",)).where("self < sibling").unionByName(small).distinct()
    return nodes, edges.unionByName(pairs.select("center", F.col("self").alias("source"), F.col("sibling").alias("target"), F.lit("Sibling").alias("label"), F.lit("sibling").alias("kind")))


def family_nodes(entities: DataFrame, rels: DataFrame, centers: DataFrame, depth: int) -> DataFrame:
    """The nodes of ``family_classes`` alone, without keeping an edge."""
    return _grown(entities, rels, centers, depth, [])[0]


def family_classes(entities: DataFrame, rels: DataFrame, centers: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, sibling classes) within ``depth`` hops (1 to 10) of each centre (key).

    nodes: center, key, hop, name, is_center, is_woman; only entities that exist.
    edges: center, source, target, label, kind; an edge may have an unknown end.  Of rels of one
    type between two nodes the one of the smallest key stays, in its direction.  The centre's
    siblings are always complete, and children of one known parent are one class (center, parent,
    n, part, members).  An unknown centre has no graph.
    """
    nodes_out, nodes, edges = _grown(entities, rels, centers, depth, ["rel_key", "rel_type", "term1", "term2"])
    # an edge that was met twice is one of its pair, as are rels of one type
    pair = Window.partitionBy("center", "rel_type", F.least("term1", "term2"), F.greatest("term1", "term2")).orderBy("rel_key")
    real = edges.withColumn("n", F.row_number().over(pair)).where("n = 1")
    label = F.when(F.col("rel_type") == "childOfFather", "Father").when(F.col("rel_type") == "childOfMother", "Mother").otherwise("Spouse")
    shown = real.select("center", F.col("term1").alias("source"), F.col("term2").alias("target"), label.alias("label"), F.lit("rel").alias("kind"))
    child = edges.where("rel_type <> 'spouseOf'").select("center", F.col("term1").alias("key"), F.col("term2").alias("parent")).distinct().join(nodes.select("center", "key"), ["center", "key"], "left_semi")
    classes = cut_lineage(sibling_classes(child.select("center", "parent", F.col("key").alias("self")), ("center",)), "sibling-classes")
    return nodes_out, shown, classes


def _grown(entities: DataFrame, rels: DataFrame, centers: DataFrame, depth: int, kept: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes of ``family_classes``, as stored (center, key, hop), and the columns ``kept`` of
    the edges met, each as often as it was met."""
    depth = max(1, min(MAX_DEPTH, depth))
    known = entities.where("entityType = 'Person'").select("key", F.col("display_en_name").alias("name"), "isWoman")
    family = rels.where(F.col("rel_type").isin(*dims.FAMILY_RELS)).select(F.col("key").alias("rel_key"), "rel_type", "term1", "term2")
    looks = family.select(F.col("term1").alias("at"), F.col("term2").alias("next"), "rel_key", "rel_type", "term1", "term2").unionByName(
        family.select(F.col("term2").alias("at"), F.col("term1").alias("next"), "rel_key", "rel_type", "term1", "term2")
    )
    exists = known.select("key")
    nodes = cut_lineage(centers.select(F.col("key").alias("center")).distinct().join(exists.select(F.col("key").alias("center")), "center", "left_semi").select("center", F.col("center").alias("key"), F.lit(0).alias("hop")), "nodes")
    edges = None
    frontier = nodes
    for hop in range(1, depth + 1):
        met = cut_lineage(frontier.select("center", F.col("key").alias("at")).join(looks, "at").select("center", "next", *kept), "met")
        edges = met.drop("next") if edges is None else edges.unionByName(met.drop("next"))
        fresh = met.select("center", F.col("next").alias("key")).distinct().join(exists, "key", "left_semi").join(nodes, ["center", "key"], "left_anti")
        frontier = cut_lineage(fresh.select("center", "key", F.lit(hop).alias("hop")), "frontier")
        if frontier.isEmpty():
            break
        nodes = nodes.unionByName(frontier)
    parent_rels = family.where("rel_type <> 'spouseOf'")
    parents = parent_rels.select(F.col("term1").alias("child"), F.col("term2").alias("parent"), "rel_key", "rel_type")
    own = nodes.where("hop = 0").select("center").join(parents.select(F.col("child").alias("center"), "parent"), "center")
    added = own.join(parents, "parent").select("center", F.col("child").alias("key"), "rel_key", "rel_type", F.col("child").alias("term1"), F.col("parent").alias("term2"))
    added = cut_lineage(added.select("center", "key", *kept), "siblings")
    new = added.select("center", "key").distinct().join(exists, "key", "left_semi").join(nodes, ["center", "key"], "left_anti")
    nodes = cut_lineage(nodes.unionByName(new.select("center", "key", F.lit(2).alias("hop"))), "all-nodes")
    nodes_out = nodes.join(known, "key").select("center", "key", "hop", "name", (F.col("key") == F.col("center")).alias("is_center"), F.coalesce("isWoman", F.lit(False)).alias("is_woman"))
    return nodes_out, nodes, edges.unionByName(added.select(*edges.columns))


def generation_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(center, key, level, role): parents are one level up (-1), children one down, spouses
    and siblings level; the first visit counts, smallest level first among equals; nodes that
    are not reached have level 0."""
    step = F.when(F.col("label").isin("Father", "Mother"), -1).otherwise(0)
    # the rounds read what is stored: plans of nodes and edges would run again in each
    nodes = cut_lineage(nodes.select("center", "key", "is_center"), "level-nodes")
    edges = cut_lineage(edges.select("center", "source", "target", "label"), "level-edges")
    moves = edges.select("center", F.col("source").alias("at"), F.col("target").alias("key"), step.alias("step")).unionByName(
        edges.select("center", F.col("target").alias("at"), F.col("source").alias("key"), (-step).alias("step"))
    )
    levels = cut_lineage(nodes.where("is_center").select("center", "key", F.lit(0).alias("level")), "levels")
    frontier = levels
    while True:
        reached = frontier.select("center", F.col("key").alias("at"), "level").join(moves, ["center", "at"])
        fresh = reached.select("center", "key", (F.col("level") + F.col("step")).alias("level")).groupBy("center", "key").agg(F.min("level").alias("level"))
        fresh = fresh.join(nodes.select("center", "key"), ["center", "key"], "left_semi").join(levels, ["center", "key"], "left_anti")
        frontier = cut_lineage(fresh.select("center", "key", "level"), "frontier")
        if frontier.isEmpty():
            break
        levels = levels.unionByName(frontier)
    spouse = edges.where("label = 'Spouse'").select("center", F.when(F.col("source") == F.col("center"), F.col("target")).when(F.col("target") == F.col("center"), F.col("source")).alias("key")).where("key IS NOT NULL").distinct().withColumn("spouse", F.lit(True))
    out = nodes.select("center", "key", "is_center").join(levels, ["center", "key"], "left").withColumn("level", F.coalesce("level", F.lit(0))).join(spouse, ["center", "key"], "left")
    role = (
        F.when(F.col("is_center"), "center").when(F.col("spouse"), "spouse").when(F.col("level") == 0, "sibling")
        .when(F.col("level") == -1, "parent").when(F.col("level") < -1, "ancestor").when(F.col("level") == 1, "child").otherwise("descendant")
    )
    return out.select("center", "key", "level", role.alias("role"))
