"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers are enough for a whole signature: the first maps a
shingle to a number, the second is shifted circularly by 0, 1, 2 ... places, and coordinate
k is the least value that the second permutation, shifted by k, gives to the shingles.
Coordinates are grouped in bands; documents that agree in a band are candidates; candidates
are confirmed on their full shingle sets.

Documents of equal word sequences are reduced to the one of the smallest id before banding.
In a bucket, members are first compared with one centre only (the smallest id, then the
largest); members that end up in one component need no comparison among themselves.  For the
documents of buckets that still hold several components, shingles that no other such document
has are counted: they bound the similarity of every pair from above, exactly, so documents
and pairs out of reach of the threshold leave.  The rest meets a last centre (of the fewest
such shingles).  One less the Jaccard similarity is a metric, so two members whose distances
from the centre differ by more than the threshold allows need no comparison; all others are
compared pair by pair, each pair in one of its buckets.  No link among candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import HEAVY, cached, documents, give_back, keep_only, materialise, private, ship

BANDS = 30
ROWS = 5
#: Words of a shingle, and of those that the query op7_minhash compares.
SHINGLE, QUERY_SHINGLE = 5, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Words whose hashes a Python worker remembers.
CACHE = 200_000
#: Shingles that are permuted at once.
CHUNK = 2048

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _WordHash(dict):
    """64-bit hashes of words, computed once while they are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHash()
cached("op7", _hashes.clear)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``size`` make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h = h * _M3 + w[k : n + k]
    return np.unique(_mix64(h))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a non-empty shingle set."""
    first = ((shingles * _M2) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), CHUNK):
        x = first[at : at + CHUNK, None] + shifts  # wraps: a circular shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    grid = least.reshape(-1, rows).astype(np.uint64)
    h = np.arange(len(grid), dtype=np.uint64) * _M3 + np.uint64(1)
    for k in range(rows):
        h = _mix64(h * _M1 + grid[:, k])
    return h.view(np.int64)


def _signatures(bands: int, rows: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only("op7")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                shingles = shingle_set(words, size)
                low = high = None
                keys = None
                if len(shingles):
                    digest = xxhash.xxh3_128_digest(b" ".join(words))
                    low, high = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
                    keys = band_keys(signature(shingles, bands * rows), rows)
                out.append((doc_id, len(shingles), low, high, keys))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "low", "high", "bands"]).astype(
                {"doc_id": "Int64", "low": "Int64", "high": "Int64"}
            )
            batch = out = None
        give_back()

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(words_of(t), size).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "shingles": sets})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component_id): each end of an edge with the smallest id it can reach.

    Every round gives each node its least neighbour, follows these pointers, and contracts
    the edges to pointers that still differ; rounds grow with the logarithm of a chain.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "op7-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"), "op7-to")
        for _ in range(2):
            on = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = materialise(to.join(on, "to").select("node", F.col("next").alias("to")), "op7-to")
        if labels is None:
            labels = to.select(F.col("node").alias("doc_id"), F.col("to").alias("component_id"))
        else:
            on = to.select(F.col("node").alias("component_id"), F.col("to").alias("next"))
            labels = materialise(
                labels.join(on, "component_id", "left").select("doc_id", F.coalesce("next", "component_id").alias("component_id")), "op7-labels"
            )
        ends = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = materialise(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "op7-edges")
    if labels is None:
        return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
    return labels


def similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the size of each full shingle set and of what they share."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", F.size("s").alias("m"), F.size("t").alias("n"), F.size(F.array_intersect("s", "t")).alias("shared"))


class _Links:
    """Links found so far and the components they make."""

    def __init__(self, spark: SparkSession, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.tested = spark.createDataFrame([], "a long, b long")
        self.parts = spark.createDataFrame([], "doc_id long, component_id long")

    def test(self, pairs: DataFrame) -> None:
        found = materialise(pairs.distinct().join(self.tested, ["a", "b"], "left_anti"), "op7-pairs")
        alike = F.col("shared") * 100 >= (F.col("m") + F.col("n") - F.col("shared")) * self.percent
        links = materialise(similarity(found, self.sets).where(alike).select("a", "b"), "op7-links")
        self.tested = self.tested.unionByName(found)
        self.join(links)

    def join(self, links: DataFrame) -> None:
        """Join components by new links: their ends are contracted to the components they are in,
        so that only links between components are followed."""
        ends = links
        for end in ("a", "b"):
            at = self.parts.select(F.col("doc_id").alias(end), F.col("component_id").alias("at"))
            ends = ends.join(at, end, "left").withColumn(end, F.coalesce("at", end)).drop("at")
        moved = components(ends.where("a <> b"))
        to = moved.select(F.col("doc_id").alias("component_id"), F.col("component_id").alias("to"))
        old = self.parts.join(to, "component_id", "left").select("doc_id", F.coalesce("to", "component_id").alias("component_id"))
        self.parts = materialise(old.unionByName(moved.join(self.parts, "doc_id", "left_anti")), "op7-parts")

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.drop("part").join(self.parts, "doc_id", "left").withColumn("part", F.coalesce("component_id", "doc_id")).drop("component_id")

    def to_centre(self, rows: DataFrame) -> DataFrame:
        """Pairs of a bucket's members with its centre, where they are not in one component."""
        centres = self.parts.select(F.col("doc_id").alias("centre"), F.col("component_id").alias("centre_part"))
        return (
            self.placed(rows).select("doc_id", "part", "centre").distinct().join(centres, "centre", "left")
            .where(F.col("part") != F.coalesce("centre_part", "centre"))
            .select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"))
        )

    def split(self, rows: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components, with the first component's number."""
        rows = materialise(self.placed(rows), "op7-placed")
        several = rows.groupBy("bucket").agg(F.min("part").alias("main"), F.max("part").alias("last")).where("main < last").select("bucket", "main")
        return materialise(rows.drop("main").join(materialise(several, "op7-split"), "bucket"), "op7-open")

    def reachable(self, rows: DataFrame) -> DataFrame:
        """Rows of documents that could still have a link: ``own`` counts the shingles that
        no other document of ``rows`` has, so at most n - own can be shared with any."""
        docs = rows.select("doc_id").distinct()
        shingles = self.sets.join(docs, "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("shingle"))
        single = shingles.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1")
        own = materialise(single.groupBy("doc_id").agg(F.count("*").alias("own_new")), "op7-own")
        counted = rows.drop("own").join(own, "doc_id", "left").withColumn("own", F.coalesce("own_new", F.lit(0))).drop("own_new")
        return counted.where((F.col("n_shingles") - F.col("own")) * 100 >= F.col("n_shingles") * self.percent)

    def away(self, rows: DataFrame) -> DataFrame:
        """Rows of (bucket, centre, doc_id, ...) with what each document shares with the centre
        of its bucket, its distance from it, and the list of its buckets."""
        pairs = rows.select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
        shared = F.col("shared") / (F.col("m") + F.col("n") - F.col("shared"))
        far = materialise(similarity(pairs, self.sets).select(F.col("a").alias("centre"), F.col("b").alias("doc_id"), (1 - shared).alias("away"), "shared"), "op7-away")
        lists = materialise(rows.groupBy("doc_id").agg(F.collect_set("bucket").alias("buckets")), "op7-lists")
        return materialise(rows.join(far, ["centre", "doc_id"]).join(lists, "doc_id"), "op7-rest")

    def across(self, rows: DataFrame) -> DataFrame:
        """Pairs of a bucket's members in different components that the bounds allow, each in
        the least bucket that they share.  Members of the bucket's first component are not
        paired with each other."""
        cols = ["doc_id", "n_shingles", "own", "part", "away", "shared", "buckets"]
        one = rows.where("part <> main").select("bucket", *[F.col(c).alias(f"x_{c}") for c in cols])
        two = rows.select("bucket", (F.col("part") == F.col("main")).alias("is_main"), *[F.col(c).alias(f"y_{c}") for c in cols])
        n = F.col("x_n_shingles") + F.col("y_n_shingles")
        # two sets share at most the lesser of their parts within the centre, and of their parts
        # outside it that others have too
        outside = lambda s: F.greatest(F.col(f"{s}_n_shingles") - F.col(f"{s}_shared") - F.col(f"{s}_own"), F.lit(0))
        most = F.least("x_shared", "y_shared") + F.least(outside("x"), outside("y"))
        near = F.abs(F.col("x_away") - F.col("y_away")) <= 1 - self.percent / 100 + 1e-9
        fits = (F.col("x_part") != F.col("y_part")) & (F.col("is_main") | (F.col("x_doc_id") < F.col("y_doc_id"))) & near & (most * 100 >= (n - most) * self.percent)
        first = F.array_min(F.array_intersect("x_buckets", "y_buckets")) == F.col("bucket")
        return one.join(two, "bucket").where(fits & first).select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b"))


def _placed_in(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """``rows`` with the part of their text.  Texts of more than 1/HEAVY of all rows, fewer than
    HEAVY of them, are broadcast, so no task of the join gets such a group."""
    n = int(whole.agg(F.sum("n_rows")).first()[0] or 0)
    large = (F.col("n_rows") * HEAVY) > n
    tagged = rows.join(F.broadcast(whole.where(large).drop("n_rows")), ["low", "high"], "left")
    rest = tagged.where("part IS NULL").drop("part").join(whole.where(~large).drop("n_rows"), ["low", "high"])
    return tagged.where("part IS NOT NULL").unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.  Shingles have ``size`` words.

    A null text counts as empty; documents without words have no shingles and are linked
    with nothing.  Ids identify documents: rows that repeat an id share one component.  A
    null id is linked with nothing and stays, with a null component.  A very long text is
    one more set; it is never cut.  An empty table gives no row.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(
        texts.mapInPandas(_signatures(bands, rows, size), "doc_id long, n_shingles long, low long, high long, bands array<long>"), "op7-signed"
    )
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = materialise(linkable.groupBy("low", "high").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")), "op7-firsts")
    same = [F.col("low") == F.col("f_low"), F.col("high") == F.col("f_high")]
    rep_rows = linkable.join(
        firsts.select(F.col("low").alias("f_low"), F.col("high").alias("f_high"), "rep"), [*same, F.col("doc_id") == F.col("rep")], "left_semi"
    )
    banded = rep_rows.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = materialise(
        banded.groupBy("bucket").agg(F.min("doc_id").alias("low_id"), F.max("doc_id").alias("high_id")).where("low_id < high_id"), "op7-buckets"
    )
    members = materialise(banded.join(buckets, "bucket"), "op7-members")
    wanted = members.select("doc_id").distinct()
    sets = materialise(
        texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInPandas(_sets(size), "doc_id long, shingles array<long>"), "op7-sets"
    )

    spark = docs.sparkSession
    state = _Links(spark, sets, percent)
    for centre in ("low_id", "high_id"):
        state.test(state.to_centre(members.select("bucket", "doc_id", "n_shingles", F.col(centre).alias("centre"))))
    open_rows = members.select("bucket", "doc_id", "n_shingles")
    for _ in range(2):
        open_rows = state.reachable(state.split(open_rows))
    least = open_rows.groupBy("bucket").agg(F.min_by("doc_id", F.struct("own", "doc_id")).alias("centre"))
    open_rows = materialise(open_rows.join(materialise(least, "op7-centres"), "bucket"), "op7-centred")
    state.test(state.to_centre(open_rows))
    state.test(state.across(state.away(state.split(open_rows))))
    parts = state.parts

    whole = materialise(
        firsts.join(parts.select(F.col("doc_id").alias("rep"), "component_id"), "rep", "left").select("low", "high", "n_rows", F.coalesce("component_id", "rep").alias("part")),
        "op7-whole",
    )
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = _placed_in(linkable.drop("bands"), whole).select("doc_id", "n_shingles", F.col("part").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` with the document of the smallest id of each component only.

    Rows without words and rows of a null id all stay; rows that repeat an id stay or go
    together.  An empty table stays empty.
    """
    gone = near_duplicates(docs, id_col, text_col, size=size).where("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return private(docs, own_id=F.col(id_col).cast("long")).join(gone, F.col("own_id") == F.col("gone_id"), "left_anti").select("row.*")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=QUERY_SHINGLE)
