"""Search, periodic runs and quality rules against brute-force versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scholion.llm import op11_search as op11
from scholion.llm import op12_periods as op12
from scholion.llm import op13_quality as op13

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_ranks(docs, items, k=50):
    """(item, rank, doc, score) from (id, text) rows; items maps ids to texts."""
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, n_docs = sum(sum(c.values()) for _, c in counts), len(counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items.items():
        scores = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if s > 0:
                scores.append((-s, math.inf if d is None else d, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda r: r[:2])[:k])]
    return sorted(out)


def test_op11_equals_brute_force(spark, sf_dir, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = sorted(tuple(r) for r in op11.op11_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute_ranks(list(texts.items()), items) and len(got) > 1000


def test_op11_shards_ties_and_blocks(spark, monkeypatch):
    """Many small shards, equal scores, several blocks of queries, a small k."""
    rng = random.Random(3)
    rows = [(d, " ".join(rng.choice("abcdefghij") * rng.choice((1, 1, 2)) for _ in range(rng.randint(0, 30)))) for d in range(400)]
    rows += [(1000 + d, "a b c") for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = {1: "a b c", 2: "aa BB zz", 3: "", 4: None, 5: "zz", 6: "j;i-h g"}
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string")
    monkeypatch.setattr(op11, "PAIRS", 4)
    for k in (1, 7, 50):
        assert sorted(map(tuple, op11.rank_documents(df, asked, k).collect())) == brute_ranks(rows, items, k)


def test_op11_stops_early():
    """The search reads a part of the documents, and nothing above the k-th is left out."""
    rng = np.random.default_rng(5)
    n = 5000
    sizes = rng.integers(20, 60, n).astype(np.int64)
    slots = [np.sort(rng.choice(n, m, replace=False)) for m in (4000, 900, 60)]
    tfs = [rng.integers(1, 9, len(s)) for s in slots]
    weights = np.array([op11.weight(n, len(s)) for s in slots], np.int64)
    shard = op11.Shard(list(range(n)), sizes, np.arange(3), np.array([len(s) for s in slots]), np.concatenate(slots), np.concatenate(tfs), weights, n, int(sizes.sum()))
    got = shard.search([0, 1, 2], 10, [])
    scores = np.zeros(n, np.int64)
    for s, tf, w in zip(slots, tfs, weights, strict=True):
        scores[s] += w * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * sizes[s] * n // int(sizes.sum()))))
    want = sorted((-int(x), d) for d, x in enumerate(scores) if x)[:10]
    assert [r[:2] for r in got] == want and shard.read < n / 2 and not shard.marked.any()


def test_op11_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "cat MAT", 1), (1, "word", 1), (None, "cat", 1), (2, None, 1), (3, "中文", 1)], "item_id long, text string, rank int")
    want = brute_ranks([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], {1: "cat mat word", -1: "cat", 3: "中文"})
    got = [tuple(r) for r in op11.rank_documents(odd, items).select(F.coalesce("item_id", F.lit(-1)), "rank", "doc_id", "score").collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert op11.rank_documents(none, items).count() == 0 and op11.rank_documents(odd, items.where("false")).count() == 0


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        k = 0
        while k < len(w) - q:
            start = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            if k - start + q >= max(24, 3 * q):
                found.setdefault((start, k + q), q)
            k += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    n, w = rng.randint(0, 500), []
    while len(w) < n:
        if rng.random() < 0.4:
            unit = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 25, 31, 33, 40, 60]))]
            w += [unit[i % len(unit)] for i in range(rng.randint(len(unit), len(unit) * 6))]
        else:
            w += [rng.randint(0, rng.choice([2, 30, 1000])) for _ in range(rng.randint(1, 30))]
    return w


def test_op12_runs_equal_brute_force(monkeypatch):
    """Small largest blocks as well: longer scales are then searched window by window."""
    rng = random.Random(1)
    for most in (op12.MOST, 8, 16, 32):
        monkeypatch.setattr(op12, "MOST", most)
        given = [repetitive(rng) for _ in range(60)] + [[0] * 300, [], [1], [0, 1] * 100, [5] * 24, [5] * 23]
        assert op12.Slab([np.array(g, np.int32) for g in given], 1001).runs() == [brute_runs(g) for g in given]


def test_op12_long_period_and_modulus():
    unit = np.random.default_rng(2).integers(0, 9, 5000)
    text = np.concatenate((np.arange(10, 700), np.tile(unit, 3), [8, 9, 10])).astype(np.int32)
    (run,) = op12.Slab([text], 1000).runs()[0]
    assert run[2] == 5000 and run[1] >= 15000 and (text[run[0] : run[0] + run[1] - 5000] == text[run[0] + 5000 : run[0] + run[1]]).all()
    # word numbers that agree modulo the prime are still different words
    assert op12.Slab([np.array([k % 2 * op12.P for k in range(60)], np.int32)], 2 * op12.P).runs() == [[(0, 60, 2)]]
    x = np.random.default_rng(3).integers(0, 9, (16, 5)).astype(float)
    y = np.random.default_rng(4).integers(0, 9, (32, 5)).astype(float)
    got = op12.correlations(*[op12.transform(b.copy()) for b in (x, y[:16], y[16:])])
    assert (got == [[(x[:, c] * y[d : d + 16, c]).sum() for c in range(5)] for d in range(16)]).all()


def brute_periods(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_query_equals_brute_force(spark, sf_dir, texts):
    rows = {r.doc_id: tuple(r) for r in op12.op12_periods(spark, sf_dir).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert sum(r[1] > 0 for r in rows.values()) > 10
    assert rows == {d: brute_periods(d, t) for d, t in texts.items()}


def test_op12_odd(spark, odd, none):
    rows = op12.periodic_runs(odd, arrange=op12.repeated_from).collect()
    assert len(rows) == odd.count() and op12.periodic_runs(none).count() == 0
    by = {r.doc_id: r for r in op12.periodic_runs(odd).collect()}
    assert [tuple(x) for x in by[4].runs] == [(0, 12000, 3)] and by[4].collapsed == "word and another,"
    assert [tuple(x) for x in by[13].runs] == [(0, 12000, 3)] and by[13].collapsed == "word and another, x"
    assert by[1].runs == by[2].runs == by[3].runs == [] and by[3].collapsed == "" and by[8].collapsed == "ÉCOLE été İstanbul ẞ Σ 中文 <|endoftext|> \\n"


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    marked = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    rejected = any(rule(op13.Reading(text)) for rule in op13.RULES.values())
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed, not failed and not rejected)


def test_op13_equals_brute_force(spark, sf_dir, texts, docs, monkeypatch):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = {r.doc_id: tuple(r[c] for c in cols) for r in op13.op13_quality(spark, sf_dir).collect()}
    assert rows == {d: brute_quality(t) for d, t in texts.items()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [rows[r.doc_id] for r in labels if r.quality == 1]
    poor = [rows[r.doc_id] for r in labels if r.quality == 0]
    assert all(r[6] or r[5] for r in good) and not any(r[6] for r in poor)


def test_op13_words_beyond_21_bits(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    want = [op13.Reading(t).n_repeat_words for t in texts]
    assert want == [brute_quality(t)[4] for t in texts]
    monkeypatch.setattr(op13, "NUMBER_BITS", 0)
    assert [op13.Reading(t).n_repeat_words for t in texts] == want


def test_op13_cascade():
    """Rules go by rejections per cost among what is left, and stop at the first that rejects."""
    rejected = np.array([[1, 1, 0, 0]] * 6 + [[0, 1, 0, 1]] * 2 + [[0, 0, 0, 0]] * 92, bool)
    assert op13.cascade(rejected, np.array([1.0, 4.0, 0.5, 2.0])) == [0, 3, 2, 1]
    assert op13.cascade(np.zeros((3, 2), bool), np.array([2.0, 1.0])) == [1, 0]
    asked = []
    rules = {"slow": lambda r: asked.append("slow") or bool(sum(range(3000))) and "bad" in r.text, "quick": lambda r: asked.append("quick") or "bad" in r.text}
    judge = op13.Cascade(rules)
    verdicts = [judge.rejects(op13.Reading("bad" if k % 2 else "good")) for k in range(400)]
    assert [v for v, _ in verdicts] == [bool(k % 2) for k in range(400)]
    assert [n for k, (v, n) in enumerate(verdicts) if v and k > 130 and (k + 1) % op13.EVERY] == [1] * sum(1 for k in range(131, 400, 2) if (k + 1) % op13.EVERY)


def test_op13_odd(spark, odd, none):
    rows = op13.quality_rules(odd, reasons=True).collect()
    assert len(rows) == odd.count() and all(r.kept == (not r.failed) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == 0 and "few_words" in by[1].failed and "repeated_words" in by[4].failed and "no_letters" in by[10].failed
    assert op13.quality_rules(none).count() == 0 and op13.keep_quality(none).count() == 0
    kept = op13.keep_quality(odd, rules={"empty": lambda r: r.n_words == 0})
    assert kept.columns == odd.columns and kept.count() == sum(r.n_words > 0 for r in rows)
