"""Quality rules as a short-circuit cascade.

A text is kept if no rule rejects it, so the order in which rules are asked cannot change the
verdict, only its price.  Each task learns that order for itself: on a sample of its rows (the
first ones, then a few of all that follow) it asks every rule, and notes what each costs and
which rows it rejects.  Rules are ordered by rejections per cost among the rows that the rules
before them let pass; all other rows go through the rules in that order, up to the first that
rejects.  Nothing is collected and no pass over the table is added, and a task that runs again
on another executor gives the same rows.
"""

from __future__ import annotations

import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import documents, give_back, keep_only, ship

#: Rows of a task on which every rule is asked: so many at first, then one in EVERY.
FIRST, EVERY = 128, 64
#: Sampled rows that an order is made from.
RECENT = 512
#: Rows whose texts are Python strings at once.
ROWS = 200
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
#: Words are numbered within a text; three such numbers fit into 63 bits.
NUMBER_BITS = 21


class Reading:
    """A text and what rules ask about it, each found out once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def numbers(self) -> np.ndarray:
        """The words [^\\x20\\x09-\\x0D]+, numbered in the order in which they come."""
        words = self.raw.split()
        number: dict[bytes, int] = {}
        return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))

    @property
    def n_words(self) -> int:
        return len(self.numbers)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that are found twice or more."""
        w = self.numbers
        if len(w) < 4:
            return 0
        if w.max() < 1 << NUMBER_BITS:
            windows = (w[:-2] << 2 * NUMBER_BITS) | (w[1:-1] << NUMBER_BITS) | w[2:]
        else:
            pairs = np.unique((w[:-1] << 32) | w[1:], return_inverse=True)[1]
            windows = (pairs[:-1] << 32) | w[2:]
        order = np.argsort(windows, kind="stable")
        equal = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
        marked = np.zeros(len(w), bool)
        for at in (order[equal], order[equal + 1]):
            marked[at] = marked[at + 1] = marked[at + 2] = True
        return int(marked.sum())

    @cached_property
    def words(self) -> list[str]:
        return self.text.split()

    def fresh(self) -> Reading:
        """The same text with the counts that every row gets anyway, and nothing else."""
        other = Reading(self.text)
        other.__dict__.update({k: v for k, v in self.__dict__.items() if k in COUNTED})
        return other


COUNTED = {"raw", "numbers", "word_chars", "n_symbols", "lines", "n_dup_lines", "n_repeat_words"}


def _upper_case(r: Reading) -> bool:
    upper = sum(map(str.isupper, r.text))
    return upper > 20 and 10 * upper > 7 * sum(map(str.isalpha, r.text))


def _no_letters(r: Reading) -> bool:
    return 10 * sum(any(map(str.isalpha, w)) for w in r.words) < 7 * r.n_words


def _one_word(r: Reading) -> bool:
    return r.n_words >= 50 and 4 * int(np.bincount(r.numbers).max()) > r.n_words


def _compressible(r: Reading) -> bool:
    return len(r.raw) >= 500 and 100 * len(zlib.compress(r.raw, 1)) < 12 * len(r.raw)


def _ends(r: Reading) -> bool:
    return len(r.lines) >= 3 and 10 * sum(line.rstrip(BLANKS).endswith(("...", "…")) for line in r.lines) > 3 * len(r.lines)


def _bullets(r: Reading) -> bool:
    return len(r.lines) >= 3 and 10 * sum(line.lstrip(BLANKS)[0] in "-*•‣▪" for line in r.lines) > 9 * len(r.lines)


def _unprintable(r: Reading) -> bool:
    return 100 * sum(c == "�" or c < " " and c not in BLANKS or "\x7f" <= c < "\xa0" for c in r.text) > max(1, len(r.text))


#: The two rules of the base verdict, and the method's own: true where a text is rejected.
BASE: dict[str, Callable[[Reading], bool]] = {
    "few_words": lambda r: r.n_words < 50,
    "repeated_words": lambda r: 100 * r.n_repeat_words > 50 * r.n_words,
}
RULES: dict[str, Callable[[Reading], bool]] = BASE | {
    "symbols": lambda r: 10 * r.n_symbols > max(10, r.n_words),
    "duplicate_lines": lambda r: 2 * r.n_dup_lines > len(r.lines) >= 4,
    "long_words": lambda r: r.word_chars > 40 * r.n_words,
    "shouting": lambda r: 10 * (r.text.count("!") + r.text.count("?")) > 3 * max(10, r.n_words),
    "upper_case": _upper_case,
    "no_letters": _no_letters,
    "one_word": _one_word,
    "compressible": _compressible,
    "line_ends": _ends,
    "bullets": _bullets,
    "unprintable": _unprintable,
}


def cascade(rejected: np.ndarray, cost: np.ndarray) -> list[int]:
    """Order of rules from a sample (rows by rules): at each step the rule that rejects the most
    per cost of the rows that are left; rules that reject none of them by cost."""
    left = np.ones(len(rejected), bool)
    open_, order = list(range(len(cost))), []
    while open_:
        gain = rejected[left][:, open_].sum(axis=0)
        best = int(np.lexsort((cost[open_], -gain / cost[open_]))[0])
        order.append(open_.pop(best))
        left &= ~rejected[:, order[-1]]
    return order


class Cascade:
    """Verdicts of rules in an order that is learned from sampled rows."""

    def __init__(self, rules: dict[str, Callable[[Reading], bool]]):
        self.rules = list(rules.values())
        self.order = list(range(len(self.rules)))
        self.sample: list[list[bool]] = []
        self.spent = np.ones(len(self.rules))
        self.seen = 0

    def asked(self, r: Reading) -> bool:
        """Ask every rule, and note costs and answers."""
        answers = []
        for k, rule in enumerate(self.rules):
            own, start = r.fresh(), time.perf_counter_ns()
            answers.append(bool(rule(own)))
            self.spent[k] += time.perf_counter_ns() - start
        self.sample = [*self.sample[-RECENT + 1 :], answers]
        if self.seen % 32 == 0 or self.seen > FIRST:
            self.order = cascade(np.array(self.sample, bool), self.spent)
        return any(answers)

    def rejects(self, r: Reading) -> tuple[bool, int]:
        """Whether a rule rejects the text, and how many were asked."""
        self.seen += 1
        if self.seen <= FIRST or self.seen % EVERY == 0:
            return self.asked(r), len(self.rules)
        for n, k in enumerate(self.order, 1):
            if self.rules[k](r):
                return True, n
        return False, len(self.rules)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Callable[[Reading], bool]] | None = None, reasons: bool = False) -> DataFrame:
    """One row per input row: doc_id, the five counts of COLUMNS, kept; with ``reasons`` also
    failed, the names of all rules that reject the text, for which every rule is asked.

    ``rules`` maps names to functions of a Reading (RULES by default).  A null text counts as
    empty: all counts are 0 and it is rejected for its few words.  Null and repeated ids are
    rows like any other, equal texts have equal verdicts, a very long text is read whole, an
    empty table gives no row.
    """
    ship(docs.sparkSession)
    rules = RULES if rules is None else rules
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + (", kept boolean, failed array<string>" if reasons else ", kept boolean")
    kinds = [pa.int64()] * (1 + len(COLUMNS)) + [pa.bool_()] + [pa.list_(pa.string())] * reasons
    names = ["doc_id", *COLUMNS, "kept"] + ["failed"] * reasons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("op13")
        judge = Cascade(rules)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows, out = batch.slice(first, ROWS), []
                for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"], strict=True):
                    r = Reading(text.as_py())
                    row = [doc_id, *[getattr(r, c) for c in COLUMNS]]
                    if reasons:
                        failed = [name for name, rule in rules.items() if rule(r)]
                        row += [not failed, failed]
                    else:
                        row.append(not judge.rejects(r)[0])
                    out.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                rows = out = r = text = None
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Callable[[Reading], bool]] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; the rows of a repeated
    id are judged one by one by their texts.  An empty table stays empty."""
    ship(docs.sparkSession)
    rules = RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("op13")
        judge = Cascade(rules)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([not judge.rejects(Reading(t.as_py()))[0] for t in texts], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality_rules(documents(spark, sf_dir)).select("doc_id", *COLUMNS, few.alias("base_failed"), "kept")
