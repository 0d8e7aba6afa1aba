"""Language-model scoring by online logistic context mixing.

The text that is scored is the sequence of its lower-cased words, each followed by one space,
and one line feed at the end.  Every byte is written as the bits of a Huffman code of the
training bytes.  For each bit, predictors of different contexts (the last two, four and six
bytes; the word so far) give the log odds of the zeros and ones that training texts had at
that node of the code after that context.  The log odds are added up under weights that belong
to the bit's gate (how many of the two longest contexts have been there before), and the
weights are refined from group of bits to group of bits, through the whole text, by the
gradient of the cost.  The sum of the bits' costs is the text's total; over the bytes, its
bits per byte.

Counts are kept for every context that occurs (byte contexts by their very bytes, the word so
far by 40 bits of a hash, whole words by 56), so what is gathered grows with the corpus:

1. Documents are packed into blocks of about BLOCK bytes, one row each.
2. Each block sends its distinct (context, next byte) keys with their training counts to the
   shards of the contexts' hashes; there are as many shards as blocks.
3. A shard adds up the counts of each key and answers every block with the log odds along the
   code path of each key that it asked for.
4. A block's answers meet its texts, and its texts are scored.

No task holds more than a block or a shard, and the driver only the counts of 256 bytes.  The
end of a word is a key as well, and its count is the word's count in the base model.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import documents, materialise, ship

#: Bytes before the coded byte that make the contexts of the first predictors; the last
#: predictor has the word so far.
ORDERS = (2, 4, 6)
WORD = len(ORDERS)
#: Added to both counts of a node.
SMOOTH = 0.2
#: Log odds are stored in steps of 1 / SCALE.
SCALE = 4.0
#: Starting weights, what is added where the longest context or the word is known, and where
#: both are.
WEIGHTS = ((0.60, 0.60, 0.30, 0.30), (-0.35, -0.20, 0.10, 0.10), (-0.15, -0.15, 0.0, 0.0))
#: Step of the weights' refinement, and (groups, bits in a group) in turn; the last for good.
RATE = 0.0035
GROUPS = ((64, 32), (64, 64), (64, 128), (0, 256))
#: Log odds of a bit are at most this, either way.
MOST = 12.0
#: Bytes of text in a block, sorted at once, and scored at once.
BLOCK, SORTED, BATCH = 12 << 20, 1 << 20, 3 << 19
#: Bytes of text whose records are gathered at once, and bits that are mixed at once.
PART, MIXED = 1 << 18, 1 << 15
END, SPACE = 10, 32
#: Bits below the byte in the word predictor's keys.
TAIL = 16

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.uint64(255)


#: A-Z to a-z, and white space to spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def written(text: str | None) -> bytes:
    """The words of the text, each with a space behind it, and a line feed."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).strip(b" ")
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw + b" \n" if raw else b"\n"


class Code:
    """A Huffman code of the 256 bytes, as one path of nodes and bits for each byte."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        above: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            (m, _, left), (n, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            above[left], above[right] = (node, 0), (node, 1)
            heapq.heappush(heap, (m + n, node, node))
        paths = []
        for b in range(256):
            path, at = [], b
            while at in above:
                path.append(above[at])
                at = above[at][0]
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.int64)
        #: bytes from left to right in the tree: those below a node are neighbours
        self.rank = np.empty(256, np.uint64)
        self.rank[sorted(range(256), key=lambda b: [x for _, x in paths[b]])] = np.arange(256, dtype=np.uint64)
        depth = int(self.length.max())
        self.nodes = np.array([[n for n, _ in p] + [0] * (depth - len(p)) for p in paths], np.int16)
        self.bits = np.array([[b for _, b in p] + [0] * (depth - len(p)) for p in paths], np.int64)
        self.signs, self.length32 = (2 * self.bits - 1).astype(np.int8), self.length.astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


_numbers = [np.arange(1, dtype=np.int32)]


def _places(n: int) -> np.ndarray:
    """0, 1, ... n - 1, kept for the next call."""
    if len(_numbers[0]) < n:
        _numbers[0] = np.arange(n + n // 4, dtype=np.int32)
    return _numbers[0][:n]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in no set order, number of each given key among them).

    Sorts hashes that carry their position in the low bits; where hashes of different keys
    are equal, a key may come up more than once.
    """
    n = len(keys)
    low = np.uint64((1 << n.bit_length()) - 1)
    h = keys * _A
    h &= ~low
    h |= _places(n).view(np.uint32)
    h.sort()
    h &= low
    at = h.view(np.int64)
    found = keys.take(at)
    del keys
    new = np.ones(n, bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    found = found[new]
    number = np.empty(n, np.int32)
    number[at] = np.cumsum(new, dtype=np.int32)
    number -= 1
    return found, number


def byte_of(keys: np.ndarray, kind: int) -> np.ndarray:
    return ((keys >> np.uint64(TAIL if kind == WORD else 0)) & _BYTE).astype(np.int64)


def context_of(keys: np.ndarray, kind: int) -> np.ndarray:
    return keys >> np.uint64(TAIL + 8 if kind == WORD else 8)


def word_keys(so_far: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """40 bits of the hash of the word so far, the byte, and where it ends the word 16 bits
    more, by which words are told apart."""
    h = _mixed(so_far)
    tail = np.where(byte == SPACE, (h >> np.uint64(8)) & np.uint64(0xFFFF), np.uint64(0))
    return (h >> np.uint64(24) << np.uint64(24)) | (byte.astype(np.uint64) << np.uint64(TAIL)) | tail


def byte_keys(texts: list[bytes], before: list[bytes] | None = None) -> np.ndarray:
    """For each byte of the texts, the six bytes before it and itself.  Before a text come
    bytes 0, or the seven bytes given."""
    lead = before or [bytes(7)] * len(texts)
    data = b"".join(x for pair in zip(lead, texts, strict=True) for x in pair)
    windows = np.ndarray(len(data) - 7, ">u8", data, 0, (1,)).astype(np.uint64) if len(data) > 7 else np.empty(0, np.uint64)
    sizes = np.array([len(t) for t in texts])
    if len(texts) > 1:
        own = np.ones(len(windows), bool)
        stops = np.cumsum(sizes + 7)[:-1] - 7
        own[(stops[:, None] + np.arange(7)).ravel()] = False
        windows = windows[own]
    return windows & np.uint64((1 << 56) - 1)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, kept for the next call."""
    if len(_powers[0]) < n:
        for k, x in enumerate((int(_A), pow(int(_A), -1, 1 << 64))):
            p = np.full(n + n // 4, x, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, out=p)
    return _powers[0][:n], _powers[1][:n]


def words_so_far(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the word so far at each byte of written texts, first byte of each word)."""
    x = data.astype(np.uint64)
    power, back = _power_table(len(x))
    starts = np.flatnonzero(np.append(True, (data[:-1] == SPACE) | (data[:-1] == END)))
    runs = np.diff(np.append(starts, len(x)))
    own = (x + np.uint64(1)) * power
    so_far = np.cumsum(own)
    so_far -= own
    so_far -= np.repeat(so_far[starts], runs)
    so_far *= np.repeat(back[starts], runs)
    return so_far, starts[data[starts] != END]


def _slices(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
    """Batches of (numbers, texts, seven bytes before each), longest texts first.  A text of
    more than BATCH bytes comes alone, in slices that end after a space, in turn."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    held: list[int] = []
    size = 0
    for k in order:
        text = texts[k]
        if len(text) > BATCH:
            at = 0
            while at < len(text):
                stop = len(text) if len(text) - at <= BATCH else (text.rfind(b" ", at, at + BATCH) + 1 or text.find(b" ", at) + 1)
                yield [k], [text[at:stop]], [text[max(0, at - 7) : at].rjust(7, b"\0")]
                at = stop
            continue
        held.append(k)
        size += len(text)
        if size >= BATCH:
            yield held, [texts[i] for i in held], [bytes(7)] * len(held)
            held, size = [], 0
    if held:
        yield held, [texts[i] for i in held], [bytes(7)] * len(held)


class Block:
    """The distinct keys of a block of texts, sorted by shard; with their training counts, or
    (without ``learn``) with the numbers of the keys of each byte."""

    def __init__(self, texts: list[bytes], shards: int, learn: np.ndarray | None = None):
        asks = learn is not None
        found, counts, inner = [], [], []  # byte contexts
        hashes, of_words, word_sizes, taught, self.words = [], [], [], [], []
        for numbers, slices, before in _slices(texts):
            raw, sizes = byte_keys(slices, before), [len(s) for s in slices]
            known = np.repeat(learn[numbers], sizes) if asks else None
            for a in range(0, len(raw), SORTED):
                keys, number = distinct(raw[a : a + SORTED])
                found.append(keys)
                if asks:
                    counts.append(np.bincount(number[known[a : a + SORTED]], minlength=len(keys)).astype(np.int32))
                else:
                    inner.append(number)
            # words are told apart by their hashes; one of each gives the keys of its bytes
            data = np.frombuffer(b"".join(slices), np.uint8)
            so_far, starts = words_so_far(data)
            ends = np.flatnonzero(data == SPACE)
            own, number = distinct(_mixed(so_far[ends]))
            one = np.empty(len(own), np.int64)
            one[number] = np.arange(len(ends))
            size = ends[one] - starts[one] + 1
            places = _spread(starts[one], size)
            hashes.append(own)
            of_words.append(word_keys(so_far[places], data[places]))
            word_sizes.append(size)
            if asks:
                taught.append(np.bincount(number[known[ends]], minlength=len(own)))
            else:
                self.words.append(number)
        kinds = [self._word_kind(hashes, of_words, word_sizes, taught, learn)]
        del hashes, of_words, word_sizes, taught
        kinds = self._byte_kinds(found, counts, inner) + kinds
        #: of each predictor: shard, key, count, and its number before sorting
        self.sorted = []
        for kind, (keys, n) in enumerate(kinds):
            order = np.argsort(keys)
            shard = shard_of(keys, kind, shards)[order]
            by_shard = _by_number(shard)
            order = order[by_shard].astype(np.int32)
            self.sorted.append((shard[by_shard] if asks else None, keys[order], n[order].astype(np.int64) if asks else None, order))

    def _word_kind(self, hashes: list, of_words: list, sizes: list, taught: list, learn: np.ndarray | None) -> tuple:
        """Keys of the words so far and counts, from the words of each batch: hash, keys of the
        bytes, size, training count."""
        edges = np.cumsum([0, *map(len, hashes)])
        own, number = distinct(np.concatenate(hashes))
        one = np.empty(len(own), np.int64)
        one[number] = np.arange(len(number))
        # words are numbered in order of the batch that gives their keys
        by_batch = np.argsort(one)
        one, rank = one[by_batch], np.empty(len(own), np.int32)
        rank[by_batch] = np.arange(len(own))
        number = rank[number]
        keys = []
        for k, (part, size) in enumerate(zip(of_words, sizes, strict=True)):
            mine = one[np.searchsorted(one, edges[k]) : np.searchsorted(one, edges[k + 1])] - edges[k]
            keys.append(part[_spread((np.cumsum(size) - size)[mine], size[mine])])
        self.word_size = np.concatenate(sizes)[one]
        self.word_start = np.cumsum(self.word_size) - self.word_size
        keys, row = distinct(np.concatenate([*keys, word_keys(np.zeros(1, np.uint64), np.array([END]))]))
        if learn is None:
            self.word_row = row
            self.words = [number[a : a + len(h)][w] for a, h, w in zip(edges, hashes, self.words, strict=False)]
            return keys, None
        of_word = np.bincount(number, np.concatenate(taught), minlength=len(own))
        return keys, np.bincount(row, np.append(np.repeat(of_word, self.word_size), learn.sum()), minlength=len(keys))

    def _byte_kinds(self, found: list, counts: list, inner: list) -> list[tuple]:
        """Keys and counts of the byte contexts, from the longest's keys of each batch."""
        edges = np.cumsum([0, *map(len, found)])
        every = np.concatenate(found)
        found.clear()
        keys, number = distinct(every)
        del every
        n = np.zeros(len(keys), np.int64) if counts else None
        for a, c in zip(edges, counts, strict=False):
            n += np.bincount(number[a : a + len(c)], c, len(keys)).astype(np.int64)
        self.longest = []
        while inner:  # from the last, and each is given up
            i = inner.pop()
            self.longest.insert(0, number[edges[len(inner)] : edges[len(inner) + 1]][i])
        kinds = [(keys, n)]
        self.shorter: list[np.ndarray] = []
        for order in ORDERS[-2::-1]:
            keys, number = distinct(keys & np.uint64((1 << 8 * (order + 1)) - 1))
            n = np.bincount(number, n, minlength=len(keys)) if counts else None
            self.shorter.insert(0, number)
            kinds.insert(0, (keys, n))
        return kinds

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        """(shard, keys and counts) for every shard that has keys of the block."""
        edges = [np.flatnonzero(np.append(True, s[0][1:] != s[0][:-1])) if len(s[0]) else np.empty(0, np.int64) for s in self.sorted]
        spans: dict[int, list[tuple[int, int]]] = {}
        for kind, (s, edge) in enumerate(zip(self.sorted, edges, strict=True)):
            for a, b in zip(edge, np.append(edge[1:], len(s[0])), strict=True):
                spans.setdefault(int(s[0][a]), [(0, 0)] * len(self.sorted))[kind] = (int(a), int(b))
        for shard, by_kind in spans.items():
            yield shard, packed_keys([(s[1][a:b], s[2][a:b]) for s, (a, b) in zip(self.sorted, by_kind, strict=True)])


def shard_of(keys: np.ndarray, kind: int, shards: int) -> np.ndarray:
    """Keys of one context have one shard."""
    return (((_mixed(context_of(keys, kind) * np.uint64(4) + np.uint64(kind)) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _by_number(x: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 up, 16 bits at a time, as NumPy has a radix sort for these."""
    order, high = np.argsort(x.astype(np.uint16), kind="stable"), x >> 16
    while high.any():
        order = order[np.argsort(high[order].astype(np.uint16), kind="stable")]
        high = high >> 16
    return order


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed_keys(kinds: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Sorted keys as differences, the words' ends, and counts, by byte planes."""
    sizes = np.array([len(k) for k, _ in kinds], np.int64).tobytes()
    words = kinds[WORD][0]
    tails = words[byte_of(words, WORD) == SPACE].astype(np.uint16)
    heads = [*[k for k, _ in kinds[:WORD]], words >> np.uint64(TAIL)]
    keys = b"".join(_planes(np.diff(k, prepend=np.uint64(0))) for k in heads)
    return zstandard.ZstdCompressor(level=1).compress(sizes + keys + _planes(np.concatenate([n for _, n in kinds])) + _planes(tails))


def unpacked_keys(blob: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    head = 8 * (WORD + 1)
    sizes = np.frombuffer(raw[:head], np.int64)
    stops = head + 8 * np.cumsum(sizes)
    keys = [np.cumsum(_from_planes(raw[b - 8 * n : b], np.uint64), dtype=np.uint64) for n, b in zip(sizes, stops, strict=True)]
    keys[WORD] = keys[WORD] << np.uint64(TAIL)
    keys[WORD][byte_of(keys[WORD], WORD) == SPACE] |= _from_planes(raw[stops[-1] + 8 * sizes.sum() :], np.uint16)
    counts = np.split(_from_planes(raw[stops[-1] : stops[-1] + 8 * sizes.sum()], np.int64), np.cumsum(sizes)[:-1])
    return list(zip(keys, counts, strict=True))


def path_odds(context: np.ndarray, byte: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the bits along the code paths of keys sorted by context and rank of the
    byte, for the bit of the path: (first place of each key, values)."""
    length = code.length[byte]
    start = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.int8)
    alive = np.arange(len(byte))
    for depth in range(int(length.max()) if len(byte) else 0):
        alive = alive[length[alive] > depth]
        b, c, n = byte[alive], context[alive], counts[alive]
        node = code.nodes[:, depth].take(b)
        new = np.append(True, (c[1:] != c[:-1]) | (node[1:] != node[:-1]))
        at = np.flatnonzero(new)
        ones = n * code.bits[:, depth].take(b)
        total, one = np.add.reduceat(n, at), np.add.reduceat(ones, at)
        odds = np.clip(np.rint(np.log((one + SMOOTH) / (total - one + SMOOTH)) * SCALE), -120, 120).astype(np.int8)
        out[start[alive] + depth] = odds[np.cumsum(new) - 1] * code.signs[:, depth].take(b)
    return start, out


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each length, one after another."""
    stop = np.cumsum(length)
    return np.repeat(start - (stop - length), length) + _places(int(stop[-1]) if len(stop) else 0)


def answered(blobs: list[bytes], code: Code) -> tuple[list[bytes], int]:
    """The answer to each blob of one shard, and the number of training words that end here.

    An answer holds, for each key in order, the log odds along its path, and then the counts
    of the keys of the word predictor that end a word."""
    asked = [unpacked_keys(b) for b in blobs]
    paths: list[list[np.ndarray]] = [[] for _ in blobs]
    ends: list[np.ndarray] = []
    n_words = 0
    for kind in range(len(ORDERS) + 1):
        given = np.concatenate([a[kind][0] for a in asked])
        byte, context = byte_of(given, kind), context_of(given, kind)
        ranked = context << np.uint64(8) | code.rank[byte]
        if kind == WORD:
            ranked = ranked << np.uint64(TAIL) | given & np.uint64((1 << TAIL) - 1)
        order = np.argsort(ranked)
        new = np.append(True, ranked[order][1:] != ranked[order][:-1])[: len(given)]
        number = np.empty(len(given), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        byte, context = byte[first], context[first]
        counts = np.bincount(number, np.concatenate([a[kind][1] for a in asked]), minlength=len(first)).astype(np.int64)
        start, odds = path_odds(context, byte, counts, code)
        length, ending = code.length[byte], (byte == SPACE) | (byte == END)
        at = 0
        for k, a in enumerate(asked):
            rows = number[at : at + len(a[kind][0])]
            at += len(rows)
            paths[k].append(odds[_spread(start[rows], length[rows])])
            if kind == WORD:
                ends.append(counts[rows[ending[rows]]])
        if kind == WORD:
            n_words = int(np.count_nonzero(counts[ending]))
    pack = zstandard.ZstdCompressor(level=3).compress
    out = []
    for own, end in zip(paths, ends, strict=True):
        sizes = np.array([*map(len, own), len(end)], np.int64)
        out.append(pack(sizes.tobytes() + b"".join(p.tobytes() for p in own) + _planes(end)))
    return out, n_words


class Scorer:
    """Scores the texts of a block from the answers to its keys, in order of shards."""

    def __init__(self, block: Block, answers: list[bytes], code: Code):
        self.block, self.code = block, code
        kinds = len(ORDERS) + 1
        odds: list[list[np.ndarray]] = [[] for _ in range(kinds)]
        ends = []
        for blob in answers:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            sizes = np.frombuffer(raw[: 8 * (kinds + 1)], np.int64)
            at = 8 * (kinds + 1)
            for kind in range(kinds):
                odds[kind].append(np.frombuffer(raw, np.int8, sizes[kind], at))
                at += int(sizes[kind])
            ends.append(_from_planes(raw[at:], np.int64))
        # where the path of each key starts
        paths = []
        for kind, ((_, keys, _, order), parts) in enumerate(zip(block.sorted, odds, strict=True)):
            length = code.length[byte_of(keys, kind)]
            start = np.empty(len(keys), np.int64)
            start[order] = np.cumsum(length) - length
            paths.append((start, np.concatenate(parts)))
        # the longest context's keys have those of the shorter ones: one record for each node
        _, keys, _, order = block.sorted[WORD - 1]
        length = np.empty(len(keys), np.int64)
        length[order] = code.length[byte_of(keys, WORD - 1)]
        self.first = (np.cumsum(length) - length).astype(np.int32)
        self.record = np.zeros((int(length.sum()), 4), np.int8)
        number = np.arange(len(keys), dtype=np.int32)
        for kind in range(WORD - 1, -1, -1):
            if kind < WORD - 1:
                number = block.shorter[kind][number]
            for a in range(0, len(keys), SORTED // 8):
                part = slice(a, a + SORTED // 8)
                own = paths[kind][1][_spread(paths[kind][0][number[part]], length[part])]
                self.record[self.first[a] : self.first[a] + len(own), kind] = own
        self.record = self.record.view(np.uint32).ravel()
        self.word_first, self.word_odds = paths[WORD][0][block.word_row].astype(np.int32), paths[WORD][1]
        # training counts of the words, and last of the end
        _, keys, _, order = block.sorted[WORD]
        byte = byte_of(keys, WORD)
        count = np.zeros(len(keys), np.int64)
        count[order[(byte == SPACE) | (byte == END)]] = np.concatenate(ends)
        block.sorted = None  # not needed any more
        self.seen = count[block.word_row[np.append(block.word_start + block.word_size - 1, len(block.word_row) - 1)]]

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, sum of log10 of count + 1, cost in bits) of each text."""
        tokens, known = np.ones(len(texts), np.int64), np.full(len(texts), int(self.seen[-1] > 0))
        logs, cost = np.full(len(texts), math.log10(self.seen[-1] + 1)), np.zeros(len(texts))
        log_seen, is_known = np.log10(self.seen + 1.0), (self.seen > 0).astype(np.int64)
        longest, weights = iter(self.block.longest), None
        for (numbers, slices, before), ids in zip(_slices(texts), self.block.words, strict=True):
            data = np.frombuffer(b"".join(slices), np.uint8)
            keys = np.concatenate([next(longest) for _ in range(0, len(data), SORTED)])
            row = np.full(len(data), len(self.word_first) - 1)
            row[data != END] = _spread(self.block.word_start[ids], self.block.word_size[ids])
            n = np.array([s.count(b" ") for s in slices])
            owner = np.repeat(np.arange(len(slices)), n)
            tokens[numbers] += n
            known[numbers] += np.bincount(owner, is_known[ids], len(slices)).astype(np.int64)
            logs[numbers] += np.bincount(owner, log_seen[ids], len(slices))
            carried = weights if before[0].strip(b"\0") else None
            bits, weights = mix(*self._records(data, keys, self.word_first[row], np.array([len(s) for s in slices])), carried)
            cost[numbers] += bits
        return tokens, known, logs, cost

    def _records(self, data: np.ndarray, keys: np.ndarray, word_first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Four log odds for each bit, and the bits of each text."""
        length = self.code.length32[data]
        stop = np.cumsum(length, dtype=np.int32)
        cells = np.zeros(int(stop[-1]) + 1, np.uint32)  # the last is of no bit
        fourth = cells.view(np.int8).reshape(-1, 4)[:, WORD]
        at = 0
        for a in range(0, len(data), PART):
            n, end = length[a : a + PART], int(stop[min(a + PART, len(data)) - 1])
            start = stop[a : a + PART] - n - np.int32(at)
            places = _places(end - at)
            cells[at:end] = self.record.take(np.repeat(self.first[keys[a : a + PART]] - start, n) + places)
            fourth[at:end] = self.word_odds.take(np.repeat(word_first[a : a + PART] - start, n) + places)
            at = end
        return cells, np.diff(np.append(0, stop[np.cumsum(sizes) - 1]))


def _groups(most: int, carried: bool) -> Iterator[tuple[int, int]]:
    """(start, bits) of the groups of a text of ``most`` bits."""
    at = 0
    for turns, size in GROUPS[-1:] if carried else GROUPS:
        turn = 0
        while at < most and (turn < turns or not turns):
            yield at, size
            at += size
            turn += 1


def mix(cells: np.ndarray, per_text: np.ndarray, carried: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The cost in bits of each text, and the weights at the end.

    A cell holds four bytes: what each predictor gives for the bit that came, as log odds.
    All texts advance together, group by group; the weights of a text are refined after each
    of its groups.  ``carried`` are the weights after an earlier slice of the text.
    """
    lanes, none = len(per_text), len(cells) - 1
    order = np.argsort(-per_text, kind="stable")  # those that still run are the first lanes
    first, per_text = (np.cumsum(per_text) - per_text)[order], per_text[order]
    plan = _groups(int(per_text.max()), carried is not None)
    if carried is None:
        carried = np.empty((lanes, WORD + 1, len(WEIGHTS)), np.float32)
        carried[:] = np.array(WEIGHTS, np.float32).T
    weights, cost, within = carried, np.zeros(lanes), np.arange(max(g[1] for g in GROUPS))
    third, fourth = (np.uint32(0xFF << 8 * k) for k in (WORD - 1, WORD))
    for at, size in plan:
        n = int(np.searchsorted(-per_text, -at, side="left"))
        short = int(np.searchsorted(-per_text[:n], -(at + size), side="right"))
        rate = np.float32(RATE / SCALE * math.sqrt(GROUPS[0][1] / size))
        for a in range(0, n, MIXED // size):
            b = min(a + MIXED // size, n)
            index = (first[a:b, None] + at) + within[:size]
            if short < b:  # texts that end within the group
                ending = max(a, short)
                over = within[:size] >= (per_text[ending:b, None] - at)
                index[ending - a :][over] = none
                cost[ending:b] -= math.log(2) * over.sum(axis=1)
            found = cells.take(index)
            odds = found.view(np.int8).reshape(b - a, size, WORD + 1).astype(np.float32)
            x, y = (found & third) != 0, (found & fourth) != 0
            gates = (x | y, x & y)
            by_gate = odds @ weights[a:b]
            s = by_gate[..., 1] * gates[0]
            s += by_gate[..., 0]
            s += by_gate[..., 2] * gates[1]
            s *= np.float32(1 / SCALE)
            np.clip(s, -MOST, MOST, out=s)
            np.exp(s, out=s)
            s += 1
            # the probability of the other bit: under every gate, and where the gates are open
            other = np.empty((b - a, len(WEIGHTS), size), np.float32)
            np.divide(1, s, out=other[:, 0])
            for k, gate in enumerate(gates):
                np.multiply(other[:, 0], gate, out=other[:, k + 1])
            p = 1 - other[:, 0]
            cost[a:b] -= np.log(p[:, : size // 2] * p[:, size // 2 :]).sum(axis=1)
            weights[a:b] += ((other @ odds) * rate).transpose(0, 2, 1)
    bits = np.empty(lanes)
    bits[order] = cost / math.log(2)
    return bits, weights


BLOCKS = "block long, doc_ids array<long>, learn array<boolean>, sizes array<int>, packed binary, byte_counts array<long>"


def _packed(size: int):
    """One row for each block of about ``size`` bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        total = 0

        def block(rows: list[tuple]) -> pd.DataFrame:
            data = b"".join(t for _, _, t in rows)
            learnt = np.frombuffer(b"".join(t for _, x, t in rows if x), np.uint8)
            packed = zstandard.ZstdCompressor(level=3).compress(data)
            ids, learn = [None if pd.isna(d) else int(d) for d, _, _ in rows], [bool(x) for _, x, _ in rows]
            one = (number, ids, learn, [len(t) for _, _, t in rows], packed, np.bincount(learnt, minlength=256))
            return pd.DataFrame([one], columns=["block", "doc_ids", "learn", "sizes", "packed", "byte_counts"])

        for batch in batches:
            for doc_id, learn, text in zip(batch["doc_id"], batch["learn"], batch["text"], strict=True):
                held.append((doc_id, learn, written(text)))
                total += len(held[-1][2])
                if total >= size:
                    yield block(held)
                    held, total = [], 0
                    number += 1
        if held:
            yield block(held)

    return run


def _texts(packed: bytes, sizes) -> list[bytes]:
    data, stops = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def _asked(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, learn, sizes, packed in zip(batch["block"], batch["learn"], batch["sizes"], batch["packed"], strict=True):
                blobs = list(Block(_texts(packed, sizes), shards, np.array(learn, bool)).blobs())
                yield pd.DataFrame({"block": number, "shard": [s for s, _ in blobs], "blob": [b for _, b in blobs]})

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, seen double, score double, n_bytes long, n_words long"


def score_texts(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes (of the written text; bits per byte are -score / log10(2) / n_bytes).

    ``learn`` is a condition on the columns of ``docs``: rows to learn from; where it is null,
    a row is held out.  A null or empty text has the end token only.  Null and repeated ids are
    rows like any other; equal texts have equal scores.  With nothing to learn from, all counts
    are 0 and every bit costs 1.  An empty table gives no row.  A very long text is worked on
    in slices, at whose edges contexts and weights go on; only a single word is held whole.
    Words are told apart by 56 bits of their hash.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    blocks = materialise(texts.mapInPandas(_packed(block_bytes), BLOCKS), "op3-blocks")
    shards = max(1, blocks.count())
    byte_counts = np.zeros(256, np.int64)
    for r in blocks.select(F.posexplode("byte_counts").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect():
        byte_counts[r["byte"]] = r["n"]

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        answers, n_words = answered(list(rows["blob"]), Code(byte_counts))
        return pd.DataFrame({"block": rows["block"], "shard": rows["shard"], "blob": answers, "n_words": [n_words, *[0] * (len(rows) - 1)]})

    sent = blocks.select("block", "doc_ids", "learn", "sizes", "packed")
    asked = sent.select("block", "learn", "sizes", "packed").mapInPandas(_asked(shards), "block long, shard int, blob binary")
    answers = asked.groupBy("shard").applyInPandas(answer, "block long, shard int, blob binary, n_words long")

    def score(key: tuple, rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        ids, learn, sizes, packed = rows.iloc[0][["doc_ids", "learn", "sizes", "packed"]]  # a block is one row
        n_words = int(given["n_words"].sum())
        blobs = list(given.sort_values("shard")["blob"])
        del rows, given
        texts = _texts(packed, sizes)
        scorer = Scorer(Block(texts, shards), blobs, Code(byte_counts))
        tokens, known, seen, bits = scorer.scores(texts)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64"),
                "held_out": ~np.array(learn, bool),
                "n_tokens": tokens,
                "n_known": known,
                "seen": seen,
                "score": -bits * math.log10(2),
                "n_bytes": np.array(sizes, np.int64),
                "n_words": [n_words, *[0] * (len(texts) - 1)],
            }
        )

    scored = materialise(sent.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, SCORES), "op3-scores")
    n_all = int(byte_counts[SPACE] + byte_counts[END])  # each training token ends in one of these
    v_all = int(scored.agg(F.sum("n_words")).first()[0] or 0)
    base = F.col("seen") - F.col("n_tokens") * math.log10(n_all + v_all + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes")


def training(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text does not leave 2 by 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 != 2, F.lit(True))


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), training())
