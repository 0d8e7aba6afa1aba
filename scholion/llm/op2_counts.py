"""Edit-aware token counts.

Each document keeps a segment tree over its text: leaves are runs of white-space-separated
chunks (pre-tokens never cross white space), inner nodes are sums of token counts and of
characters.  An edit goes down the tree by characters to the leaves that it touches, encodes
their new text only (with the next leaf, where the edit takes the white space between them
away), and updates the sums on the way to the root.  The count of the edited document is the
root.

Trees are stored as two arrays (characters and tokens of the leaves) beside the key of their
text; edits arrive as a table.  A filter of the edited ids, of a fixed size, tells which rows
may have edits.  All others are answered from the stored sums, and their text is read where it
stands; only texts that may have edits are shuffled, once, to meet their tree and their edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import documents, materialise, ship
from scholion.llm.tokens import coder

#: Chunks in a leaf.
LEAF = 64
#: Bits of the filter of edited ids: 16 MB, in at most 4096 rows that are broadcast.
FILTER_BITS = 1 << 27
_SPACE = re.compile(r"[\x09-\x0D\x20]+")
_WHITE = "\x09\x0a\x0b\x0c\x0d\x20"


def leaf_sizes(text: str, leaf: int = LEAF) -> list[int]:
    """Characters of the leaves; each leaf but the last ends in white space."""
    ends = [m.end() for m in _SPACE.finditer(text)]
    bounds = [0, *[e for e in ends[leaf - 1 :: leaf] if e < len(text)], len(text)]
    return [b - a for a, b in zip(bounds, bounds[1:], strict=False)]


class Tree:
    """Characters and token counts of the leaves of a text, summed up two binary heaps."""

    def __init__(self, text: str, count, leaf: int = LEAF, stored: tuple[list[int], list[int]] | None = None):
        self.count, self.leaf, self.encoded = count, leaf, 0
        sizes = [int(n) for n in stored[0]] if stored else leaf_sizes(text, leaf)
        self.leaves, at = [], 0
        for n in sizes:
            self.leaves.append(text[at : at + n])
            at += n
        self._build(list(map(int, stored[1])) if stored else [self._encode(x) for x in self.leaves])

    def _build(self, tokens: list[int]) -> None:
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        rest = [0] * (self.width - len(self.leaves))
        self.tokens = [0] * self.width + tokens + rest
        self.chars = [0] * self.width + list(map(len, self.leaves)) + rest
        for node in range(self.width - 1, 0, -1):
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    def _encode(self, text: str) -> int:
        self.encoded += 1
        return self.count(text)

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf, place in it) of a character; the end of the text is in its last leaf."""
        if place >= self.chars[1]:
            last = len(self.leaves) - 1
            while last and not self.leaves[last]:
                last -= 1
            return last, len(self.leaves[last])
        node = 1
        while node < self.width:
            node *= 2
            if place >= self.chars[node]:
                place -= self.chars[node]
                node += 1
        return node - self.width, place

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        node, tokens, chars = self.width + leaf, self._encode(text) if text else 0, len(text)
        by, more = tokens - self.tokens[node], chars - self.chars[node]
        while node:
            self.tokens[node] += by
            self.chars[node] += more
            node //= 2

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` for characters [start, stop); positions are clipped to the text."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        first, a = self._find(start)
        last, b = self._find(stop) if stop > start else (first, a)
        text = self.leaves[first][:a] + new + self.leaves[last][b:]
        # a leaf that lost its white space is joined with the next that has a text
        while text and text[-1] not in _WHITE and last + 1 < len(self.leaves):
            last += 1
            text += self.leaves[last]
        parts = leaf_sizes(text, self.leaf)
        if len(parts) > 2 * (last - first + 1):  # a long insertion makes leaves of its own
            made, at = [], 0
            for n in parts:
                made.append(text[at : at + n])
                at += n
            tokens = self.tokens[self.width : self.width + len(self.leaves)]
            self.leaves[first : last + 1] = made
            tokens[first : last + 1] = [self._encode(x) for x in made]
            self._build(tokens)
            return
        self._set(first, text)
        for k in range(first + 1, last + 1):
            self._set(k, "")


def _counter(tokenizer: str):
    encode = coder(tokenizer).encode
    return lambda text: len(encode(text)) // 4


TREES = "doc_id long, text_key long, chars array<int>, tokens array<int>"
COUNTS = "doc_id long, tokens_before long, tokens_after long, leaves long, leaves_encoded long, edits long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def build_trees(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, chars, tokens) of every row; a null text is empty and has a count of
    0.  Null and repeated ids are rows like any other; an empty table gives no row."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(path)
        for batch in batches:
            trees = [Tree(t, count, leaf) for t in batch["text"]]
            leaves = [(list(map(len, t.leaves)), t.tokens[t.width : t.width + len(t.leaves)]) for t in trees]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_key": batch["text_key"], "chars": [c for c, _ in leaves], "tokens": [n for _, n in leaves]})

    return _texts(docs, id_col, text_col).mapInPandas(run, TREES)


def apply_edits(trees: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Counts before and after the ``edits`` (array<struct<start, stop, new>>, in order) that
    stand beside each tree and its text.  A null array is no edit; a null ``new`` is empty."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    ship(trees.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(path)
        for b in batches:
            out = []
            for doc_id, text, chars, tokens, edits in zip(b["doc_id"], b["text"], b["chars"], b["tokens"], b["edits"], strict=True):
                tree = Tree(text, count, leaf, (chars, tokens))
                before = tree.total
                edits = [] if edits is None else edits
                for e in edits:
                    tree.replace(int(e["start"]), int(e["stop"]), e["new"] or "")
                out.append((doc_id, before, tree.total, len(tree.leaves), tree.encoded, len(edits)))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in COUNTS.split(", ")]).astype({"doc_id": "Int64"})

    return trees.select("doc_id", "text", "chars", "tokens", "edits").mapInPandas(run, COUNTS)


def _bit() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1


def edit_filter(edits: DataFrame) -> DataFrame:
    """(filter_row, bitmap): the bits of the ids that have edits, in rows of 32,768 bits."""
    bits = edits.where("doc_id IS NOT NULL").select(_bit().alias("bit"))
    return bits.groupBy(F.bitmap_bucket_number("bit").alias("filter_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def _flagged(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false where the filter says that doc_id has no edit."""
    place = F.bitmap_bit_position(_bit())
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.when(F.col("doc_id").isNotNull(), F.getbit(byte, (place % 8).cast("int")) == 1)
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(_bit()) == F.col("filter_row"), "left")
    return met.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("filter_row", "bitmap")


def count_with_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row of ``docs``, whose stored ``trees`` are given, before and after the
    rows of ``edits`` (doc_id, seq, start, stop, new).

    The edits of one document are applied in order of seq (ties by place and text) by one task,
    as each depends on the text that the one before left.  Edits of unknown or null ids are
    ignored; rows that repeat an id all take its edits.  Rows without edits get their stored
    sums, empty texts among them without a join (no token, one empty leaf).  Where the filter
    takes an id for an edited one by chance, the row goes the longer way to the same counts.  A
    very long text is one row, as it is in ``docs``.  An empty table gives no row.
    """
    bits = edit_filter(edits)
    texts, stored = _flagged(_texts(docs, id_col, text_col), bits), _flagged(trees, bits)
    same = F.col("doc_id").eqNullSafe(F.col("tree_id")) & (F.col("text_key") == F.col("tree_key"))
    tree_keys = [F.col("doc_id").alias("tree_id"), F.col("text_key").alias("tree_key")]

    listed = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("edit_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "new"))), lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["new"].alias("new"))).alias("edits")
    )
    kept = stored.where("maybe").dropDuplicates(["doc_id", "text_key"]).join(listed, F.col("doc_id") == F.col("edit_id"), "left")
    edited = apply_edits(texts.where("maybe").join(kept.select(*tree_keys, "chars", "tokens", "edits"), same), tokenizer)

    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda n, x: n + x)
    sums = stored.where("NOT maybe").select(*tree_keys, total.alias("total"), F.size("tokens").cast("long").alias("leaves"))
    sums = sums.groupBy("tree_id", "tree_key").agg(F.max("total").alias("total"), F.max("leaves").alias("leaves"))
    plain = texts.where("NOT maybe").select("doc_id", "text_key", (F.col("text") == "").alias("is_empty"))
    none = F.lit(0).cast("long")
    answer = lambda total, leaves: ["doc_id", total.alias("tokens_before"), total.alias("tokens_after"), leaves.alias("leaves"), none.alias("leaves_encoded"), none.alias("edits")]
    summed = plain.where("NOT is_empty").join(sums, same).select(*answer(F.col("total"), F.col("leaves")))
    empty = plain.where("is_empty").select(*answer(none, F.lit(1).cast("long")))
    return edited.unionByName(summed).unionByName(empty)


def edits_of(docs: DataFrame) -> DataFrame:
    """Three edits of each document, at places given by its id: up to 24 characters make way for
    its language and source; a word goes in at the start; one character of the middle goes."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    start = F.pmod(F.crc32(F.col("doc_id").cast("string")), n + 1).cast("int")
    edit = lambda seq, a, b, new: F.struct(F.lit(seq).alias("seq"), a.cast("int").alias("start"), b.cast("int").alias("stop"), new.alias("new"))
    made = F.array(
        edit(0, start, start + 24, F.concat_ws(" ", "lang", "source")),
        edit(1, F.lit(0), F.lit(0), F.concat(F.col("doc_id").cast("string"), F.lit(" "))),
        edit(2, F.floor(n / 2), F.floor(n / 2) + 1, F.lit("")),
    )
    return docs.select("doc_id", F.explode(made).alias("e")).select("doc_id", "e.*")


def op2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document before and after the edits of ``edits_of``, from trees that are written
    first and read back."""
    docs = documents(spark, sf_dir)
    trees = materialise(build_trees(docs), "op2-trees")
    return count_with_edits(docs, trees, edits_of(docs))
