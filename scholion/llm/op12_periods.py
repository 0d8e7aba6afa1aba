"""Periodic run detection by block convolution.

A run is a longest stretch of words that repeats its first ``period`` words at least three
times.  For each dyadic scale B, every aligned block of B words is compared with the words that
follow it at all distances from B to 2B at once: the sum of squared differences of word
numbers is a correlation, computed exactly modulo a prime by number-theoretic transforms, and
is 0 where the block occurs again.  A run of period q in [B, 2B) holds a whole aligned block
and its copy q words on, so no run is missed.  Each such distance is a seed: it is extended
word by word to the longest stretch with that period, which also refutes sums that are 0 by the
modulus alone.  Above MOST words, the first MOST words of a block stand for it and the
distances are searched window by window, so a text of n words costs about n log n.

A transform of a block serves as the block and as either half of the windows before it.  Texts
are gathered until they fill a slab and share transforms; a longer text is a slab of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import documents, give_back, keep_only, ship

#: A run has at least so many words, and its period so many times.
LEAST, TIMES = 24, 3
#: Words of the smallest and of the largest block.
FIRST, MOST = 8, 1024
#: Words that share transforms, and rows whose texts are Python strings at once.
SLAB, ROWS = 1 << 18, 200
#: Numbers transformed at once: they stay in a core's cache.
CELLS = 1 << 16
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: 11 * 2^21 + 1, a prime, and a generator.  Residues lie within P / 2 of zero, so products of
#: sums of up to 64 of them stay below 2^53 and are exact in doubles.
P, GENERATOR = 23068673, 3

Run = tuple[int, int, int]


def residue(x: np.ndarray) -> np.ndarray:
    """``x`` modulo P, in place, nearest to zero."""
    x -= np.rint(x * (1 / P)) * P
    return x


@cache
def _reversed_bits(n: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    while len(out) < n:
        out = np.concatenate((2 * out, 2 * out + 1))
    return out


@cache
def _roots(half: int, inverse: bool) -> np.ndarray:
    """Root of each of the ``half`` butterfly groups of a level, one to a row."""
    root = pow(GENERATOR, (P - 1) // (2 * half), P)
    root = pow(root, P - 2, P) if inverse else root
    powers = [1]
    while len(powers) < half:
        powers.append(powers[-1] * root % P)
    return residue(np.array(powers, np.float64)[_reversed_bits(half)])[:, None, None]


@cache
def _mirror(n: int) -> np.ndarray:
    """Where the coefficient of -k stands, for the k of each row."""
    at = _reversed_bits(n)
    return at[-at % n]


def transform(blocks: np.ndarray) -> np.ndarray:
    """Transforms of columns of b numbers followed by b zeros; 2b rows, k in reversed bits."""
    b, m = blocks.shape
    x = np.concatenate((blocks, blocks))  # the first level meets zeros only
    groups, span = 2, b
    while span > 1:
        span //= 2
        y = x.reshape(groups, 2, span, m)
        turned = residue(y[:, 1] * _roots(groups, False))
        np.subtract(y[:, 0], turned, out=y[:, 1])
        y[:, 0] += turned
        groups *= 2
    return residue(x)


def inverse(x: np.ndarray) -> np.ndarray:
    """Numbers of transforms of n rows, times n; ``x`` is overwritten."""
    n, m = x.shape
    groups, span, level = n // 2, 1, 0
    while groups:
        y = x.reshape(groups, 2, span, m)
        turned = residue((y[:, 0] - y[:, 1]) * _roots(groups, True))
        y[:, 0] += y[:, 1]
        y[:, 1] = turned
        groups, span, level = groups // 2, span * 2, level + 1
        if level % 4 == 0:
            residue(x)
    return residue(x)


def correlations(block: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sums of block[i] * window[i + d] for d below b, from the transforms of blocks and of both
    halves of their windows."""
    n = len(block)
    window = first.copy()
    window[: n // 2] += second[: n // 2]  # even k
    window[n // 2 :] -= second[n // 2 :]  # odd k: half a turn
    residue(window)
    window *= block[_mirror(n)]
    out = inverse(residue(window))[: n // 2]
    out *= residue(np.array([float(pow(n, P - 2, P))]))[0]
    return residue(out)


class Slab:
    """Word numbers of several texts, one after another, each followed by a number of its own."""

    def __init__(self, texts: list[np.ndarray], n_words: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.stops = np.cumsum(sizes + 1) - 1
        self.starts = self.stops - sizes
        self.words = np.empty(int((sizes + 1).sum()), np.int32)
        for start, stop, t in zip(self.starts, self.stops, texts, strict=True):
            self.words[start:stop] = t
        self.words[self.stops] = n_words + np.arange(len(texts), dtype=np.int32)
        room = -(-len(self.words) // MOST) * MOST + 3 * MOST
        self.padded = np.full(room, n_words + len(texts), np.int32)
        self.padded[: len(self.words)] = self.words
        values = residue(self.padded.astype(np.float64))
        self.values = values
        self.squares = np.concatenate(([0.0], np.cumsum(residue(values * values))))
        self.known: list[tuple[int, int, int]] = []

    def of(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each place."""
        return np.searchsorted(self.stops, at, side="right")

    def probes(self, scale: int, b: int) -> np.ndarray:
        """Aligned places of blocks that lie within a text of three times the scale or more."""
        long = np.flatnonzero(self.stops - self.starts >= TIMES * scale)
        first = -(-self.starts[long] // scale)
        n = np.maximum((self.stops[long] - b) // scale - first + 1, 0)
        at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return at * scale

    def zeros(self, at: np.ndarray, b: int, shifts: range) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances where a block of b words at ``at`` occurs again, modulo P:
        distances from b * shifts[0] up to b * (shifts[-1] + 1)."""
        places, distances = [], []
        step = max(1, CELLS // (2 * b))
        norm = self.squares[b:] - self.squares[:-b]
        for k in range(0, len(at), step):
            block_at = at[k : k + step] // b
            steps = sorted({0, *shifts, shifts[-1] + 1})
            wanted, where = np.unique(np.concatenate([block_at + s for s in steps]), return_inverse=True)
            blocks = self.values.reshape(-1, b)[np.minimum(wanted, len(self.values) // b - 1)].T
            done = transform(np.ascontiguousarray(blocks))
            column = dict(zip(steps, where.reshape(-1, len(block_at)), strict=True))
            own = done[:, column[0]]
            for s in shifts:
                cross = correlations(own, done[:, column[s]], done[:, column[s + 1]])
                begin = (block_at + s) * b
                far = np.minimum(begin + np.arange(b)[:, None], len(norm) - 1)
                d, col = np.nonzero(residue(norm[block_at * b] + norm[far] - 2 * cross) == 0)
                places.append(block_at[col] * b)
                distances.append(s * b + d)
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(distances)

    def stretch(self, i: int, q: int, low: int, high: int) -> tuple[int, int]:
        """The longest [start, stop) around i whose words equal those q further on, within
        places low to high; empty where the word at i does not."""
        w = self.words
        stop, step = i, 64
        while stop + q < high:
            n = min(step, high - q - stop)
            differ = np.flatnonzero(w[stop : stop + n] != w[stop + q : stop + q + n])
            if len(differ):
                stop += int(differ[0])
                break
            stop, step = stop + n, step * 2
        start, step = i, 64
        while start > low:
            n = min(step, start - low)
            differ = np.flatnonzero(w[start - n : start] != w[start - n + q : start + q])
            if len(differ):
                start -= n - 1 - int(differ[-1])
                break
            start, step = start - n, step * 2
        return start, stop

    def extend(self, at: np.ndarray, distance: np.ndarray, b: int) -> None:
        """Add the runs that the seeds belong to.  Seeds go by place, then distance.  One that
        lies in a known run whose period divides the distance can only give that run again."""
        text = self.of(at)
        good = (distance > 0) & (at + distance + b <= self.stops[text])
        order = np.lexsort((distance[good], at[good]))
        at, distance, text = at[good][order], distance[good][order], text[good][order]
        open_ = np.ones(len(at), bool)

        def close(start: int, stop: int, period: int) -> None:
            a, z = np.searchsorted(at, (start, stop))
            open_[a:z] &= (distance[a:z] % period != 0) | (at[a:z] + distance[a:z] + b > stop)

        for run in self.known:
            close(*run)
        k = 0
        while k < len(at):
            if not open_[k]:
                ahead = open_[k : k + 4096].argmax()
                k += int(ahead) if ahead else min(4096, len(at) - k)
                continue
            i, q, t = int(at[k]), int(distance[k]), int(text[k])
            start, stop = self.stretch(i, q, int(self.starts[t]), int(self.stops[t]))
            a, z = np.searchsorted(at, (start, stop))
            open_[a:z] &= distance[a:z] != q
            open_[k] = False
            if stop - start + q >= max(LEAST, TIMES * q):
                self.known.append((start, stop + q, q))
                close(start, stop + q, q)

    def runs(self) -> list[list[Run]]:
        """(start, length, period) of each text's runs by start, then period."""
        longest = int((self.stops - self.starts).max(initial=0))
        scale = FIRST
        while scale == FIRST and longest >= LEAST or longest >= TIMES * scale:
            b = min(scale, MOST)
            shifts = range(0 if scale == FIRST else scale // b, 2 * scale // b)
            at = self.probes(scale, b)
            self.extend(*self.zeros(at, b, shifts), b)
            scale *= 2
        out: list[list[Run]] = [[] for _ in self.starts]
        for start, stop, q in sorted(self.known, key=lambda r: (r[0], r[2])):
            t = int(self.of(np.array([start]))[0])
            out[t].append((start - int(self.starts[t]), stop - start, q))
        return out


class Vocabulary(dict):
    """Numbers of words (as bytes), in the order in which they come."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        """Numbers of the words [^\\x20\\x09-\\x0D]+ of a text, split piece by piece."""
        raw, parts, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
        while at < len(raw):
            stop = at + PIECE
            while stop < len(raw) and raw[stop] not in b" \t\n\v\f\r":
                stop += 1
            words = raw[at:stop].split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at = stop
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def text(self, numbers: np.ndarray) -> str:
        return b" ".join(map(self.words.__getitem__, numbers)).decode("utf-8", "surrogatepass")


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """False for words that a run holds after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrange: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by start, then
    period) and collapsed (the words that no run holds after its first period, one blank apart).

    ``arrange`` may give, for a row's id and number of words, the number of the word that
    stands at each place instead.  A null text has no words; texts without words or runs have
    an empty list.  Null and repeated ids are rows like any other; equal texts have equal runs.
    A very long text is one more slab, never cut.  An empty table gives no row.
    """
    ship(docs.sparkSession)

    def flush(ids: list, texts: list[np.ndarray], words: Vocabulary) -> pa.RecordBatch:
        found = Slab(texts, len(words.words)).runs()
        collapsed = [words.text(t[kept_words(len(t), r)] if r else t) for t, r in zip(texts, found, strict=True)]
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
        columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("op12")
        ids, texts, words, size = [], [], Vocabulary(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"], strict=True):
                    numbers = words.numbers(text.as_py())
                    places = arrange(doc_id, len(numbers)) if arrange is not None else None
                    texts.append(numbers if places is None else numbers[places])
                    ids.append(doc_id)
                    size += len(numbers) + 1
                    if size >= SLAB:
                        yield flush(ids, texts, words)
                        ids, texts, words, size = [], [], Vocabulary(), 0
                rows = text = None
        if ids:
            yield flush(ids, texts, words)
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def repeated_from(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten, the words from one place on give way to the first of them, repeated."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(documents(spark, sf_dir), arrange=repeated_from)

    def order(x, y):
        """The greater length over period comes first, then the smaller start and period."""
        more = x["length"] * y["period"] - y["length"] * x["period"]
        first = F.coalesce(F.nullif(-F.signum(more), F.lit(0.0)), F.nullif(F.signum(x["start"] - y["start"]), F.lit(0.0)), F.signum(x["period"] - y["period"]))
        return first.cast("int")

    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = rows.withColumn("best", F.get(F.array_sort("runs", order), F.lit(0)))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
