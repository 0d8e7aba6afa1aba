"""Each operator against SQL or a brute-force version, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholion.llm import op1_packing as op1
from scholion.llm import op2_counts as op2
from scholion.llm import op3_scoring as op3
from scholion.llm import op4_exact_dedup as op4
from scholion.llm import op5_language as op5
from scholion.llm import op6_mixing as op6
from scholion.llm import op7_minhash as op7
from scholion.llm import op8_media as op8
from scholion.llm import op9_chat as op9
from scholion.llm import op10_licenses as op10
from scholion.llm.tokens import WordCoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shown(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def coded():
    return WordCoder(PATH), Tokenizer.from_file(PATH)


def ids_of(coded, text):
    return np.array(coded[1].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_coder_equals_tokenizer(coded, texts, odd):
    for text in [*list(texts.values())[:60], *[r.text or "" for r in odd.select("text").collect()], "don't we'LL <|STARTOFTEXT|>a<|startoftext|> \x1c\x85 日本 ﬁ ½ x² ÷ ŉ", "T\u0308he J\u030c H\u0331 W\u030a Y\u030a \u00c8 A\u0300bc"]:
        assert coded[0].encode(text) == ids_of(coded, text)


def check_packed(rows, coded, given):
    seqs = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= op1.CAPACITY
    for doc_id, text in given.items():
        ids = ids_of(coded, text or "") + bytes(4)
        got = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in got] == [(a // 4, len(ids[a : a + 8192]) // 4, zlib.crc32(ids[a : a + 8192])) for a in range(0, len(ids), 8192)]
    return len(seqs)


def test_op1_packs_everything_once(spark, sf_dir, coded, texts, odd, none):
    rows = op1.op1_packing(spark, sf_dir).collect()
    assert check_packed(rows, coded, texts) <= op1.lower_bound(np.array([r.length for r in rows]), op1.CAPACITY) + 1
    unique = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packed(op1.pack_documents(unique).collect(), coded, {r.doc_id: r.text for r in unique.collect()})
    parts = {(r.bins, r.bound) for r in rows}
    assert len(parts) == 1 and all(bound <= bins <= bound + 1 for bins, bound in parts) and parts.pop()[0] == len({r.sequence_id for r in rows})
    whole = op1.pack_documents(odd).where("piece = 0").count()
    assert whole == odd.count() and op1.pack_documents(none).count() == 0


def test_op1_rounds_and_bounds(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2049, 3000)
    bins, offsets, free = op1.best_fit_decreasing(lengths, 2048)
    assert (np.bincount(bins, lengths) + free == 2048).all() and len(free) >= op1.lower_bound(lengths, 2048)
    assert op1.lower_bound(np.full(9, 1100), 2048) == 9 and op1.lower_bound(np.full(9, 700), 2048) == 5
    df = spark.createDataFrame([(int(k), 0, 0, int(n), 0) for k, n in enumerate(lengths)], op1.PIECE_SCHEMA)
    out = op1.pack(df, per_partition=200).toPandas()
    assert len(out) == 3000 and out.groupby("sequence_id")["length"].sum().max() <= 2048
    assert out["sequence_id"].nunique() <= 1.04 * op1.lower_bound(lengths, 2048)


def test_op1_partitions_keep_their_size(spark, monkeypatch):
    """Pieces that leave gaps in most bins are released again and again, never into one task."""
    lengths = np.random.default_rng(4).integers(600, 1101, 3000)
    df = spark.createDataFrame([(int(k), 0, 0, int(n), 0) for k, n in enumerate(lengths)], op1.PIECE_SCHEMA)
    most, write = [], op1.materialise

    def watched(frame, label):
        out = write(frame, label)
        most.append(out.groupBy("key").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(op1, "materialise", watched)
    out = op1.pack(df, per_partition=200).toPandas()
    assert len(most) > 1 and max(most) <= 300
    assert sorted(out["doc_id"]) == list(range(3000)) and out.groupby("sequence_id")["length"].sum().max() <= 2048
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert list(seq["offset"]) == [0, *np.cumsum(seq["length"])[:-1]]


def test_op2_counts_after_edits(spark, coded, odd, texts):
    count = lambda t: len(ids_of(coded, t)) // 4
    rng = np.random.default_rng(5)
    for text in [*list(texts.values())[:12], "", "a b", "x" * 50]:
        tree = op2.Tree(text, count, leaf=8)
        for _ in range(12):
            a, n = int(rng.integers(0, len(text) + 2)), int(rng.integers(0, 90))
            new = ["", "zz", " new words here ", "don't\n"][int(rng.integers(0, 4))]
            tree.replace(a, a + n, new)
            start = min(a, len(text))
            text = text[:start] + new + text[min(a + n, len(text)) :]
            assert tree.text == text and tree.total == count(text)
    edits = spark.createDataFrame([(5, 0, 4, 7, "dog"), (5, 1, 0, 0, None), (99, 0, 0, 1, "x"), (2, 0, 0, 9, "new")], "doc_id long, seq int, start int, stop int, new string")
    given = odd.where("doc_id IS NOT NULL")
    got = {r.doc_id: r for r in op2.count_with_edits(given, op2.build_trees(given), edits).collect()}
    assert got[5].tokens_after == count("The dog sat on the mat by the door today.") and got[2].tokens_after == 1 and got[1].tokens_before == 0
    assert got[5].edits == 2 and got[7].leaves_encoded == 0
    assert op2.count_with_edits(odd, op2.build_trees(odd), edits).count() == odd.count()
    none = odd.where("false")
    assert op2.count_with_edits(none, op2.build_trees(none), edits).count() == 0
    unedited = op2.count_with_edits(odd, op2.build_trees(odd), edits.where("false")).collect()
    assert len(unedited) == odd.count() and all(r.tokens_before == r.tokens_after and r.leaves_encoded == r.edits == 0 for r in unedited)
    assert sorted(r.tokens_after for r in unedited) == sorted(count(r.text or "") for r in odd.collect())


@pytest.mark.parametrize("bits", [1, 7, 1 << 27])
def test_op2_shuffles_edited_texts_only(spark, coded, odd, monkeypatch, bits):
    """Counts do not depend on the filter: one bit takes every id for an edited one."""
    count = lambda t: len(ids_of(coded, t)) // 4
    monkeypatch.setattr(op2, "FILTER_BITS", bits)
    edits = spark.createDataFrame([(5, 0, 4, 7, "dog"), (10, 0, 0, 5, ""), (None, 0, 0, 1, "x"), (999, 0, 0, 1, "x")], "doc_id long, seq int, start int, stop int, new string")
    got = op2.count_with_edits(odd, op2.build_trees(odd), edits).collect()
    want = []
    for r in odd.collect():
        before, after = r.text or "", r.text or ""
        if r.doc_id == 5:
            after = after[:4] + "dog" + after[7:]
        if r.doc_id == 10:
            after = after[5:]
        want.append((str(r.doc_id), count(before), count(after), int(r.doc_id in (5, 10))))
    assert sorted((str(r.doc_id), r.tokens_before, r.tokens_after, r.edits) for r in got) == sorted(want)
    if bits > 7:
        flags = {r.doc_id for r in op2._flagged(odd.select("doc_id"), op2.edit_filter(edits)).where("maybe").collect()}
        assert flags == {5, 10}


def test_op2_query(spark, sf_dir, coded, docs):
    """Counts of the edited texts, made anew from the whole texts."""
    count = lambda t: len(ids_of(coded, t)) // 4
    given, edits = {r.doc_id: r for r in docs.collect()}, defaultdict(list)
    for e in op2.edits_of(docs).orderBy("doc_id", "seq").collect():
        edits[e.doc_id].append(e)
    rows = op2.op2_counts(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(given)
    for r in rows:
        text = given[r.doc_id].text or ""
        assert r.tokens_before == count(text) and r.edits == 3
        for e in edits[r.doc_id]:
            a = min(e.start, len(text))
            text = text[:a] + e.new + text[min(e.stop, len(text)) :]
        assert r.tokens_after == count(text)
    assert sum(r.leaves_encoded for r in rows) < 5 * len(rows)


def test_op3_base(spark, sf_dir, texts, odd, none):
    rows = op3.op3_scoring(spark, sf_dir).collect()
    seen = Counter()
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            seen.update([*op3.words_of(t), b"\n"])
    n, v = sum(seen.values()), len(seen)
    assert len(rows) == len(texts)
    for r in rows:
        words = [*op3.words_of(texts[r.doc_id]), b"\n"]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(seen[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score < 0
    # neither blocks nor shards change a score
    small = {r.doc_id: r for r in op3.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), op3.training(), block_bytes=30_000).collect()}
    for r in rows:
        assert math.isclose(r.score, small[r.doc_id].score, rel_tol=1e-4) and math.isclose(r.base_score, small[r.doc_id].base_score, rel_tol=1e-9)
    long = spark.createDataFrame([(1, "so many words " * 30_000), (2, "x" * 70_000 + " y"), (None, "so many"), (None, "so many")], "doc_id long, text string")
    got = op3.score_texts(long.unionByName(odd.select("doc_id", "text")), op3.training()).collect()
    assert len(got) == 4 + odd.count() and {r.n_tokens for r in got if r.doc_id == 1} >= {90_001}
    assert op3.score_texts(none, op3.training()).count() == 0
    free = op3.score_texts(odd, F.lit(False)).collect()
    assert all(math.isclose(r.score, -8 * r.n_bytes * math.log10(2), rel_tol=1e-5) and r.n_known == 0 for r in free)


def scorer_of(texts, learn):
    code = op3.Code(np.bincount(np.frombuffer(b"".join(t for t, x in zip(texts, learn, strict=True) if x), np.uint8), minlength=256))
    answers = [op3.answered([blob], code)[0][0] for _, blob in sorted(op3.Block(texts, 3, learn).blobs())]
    return op3.Scorer(op3.Block(texts, 3), answers, code)


def test_op3_gains_on_every_predictor(spark, monkeypatch):
    """Held-out bits per byte of the mix are below those of each predictor, and of the words."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    given = [op3.written(t) for t in texts.values()]
    learn = np.array([zlib.crc32(str(d).encode()) % 7 != 2 for d in texts])
    scorer, size = scorer_of(given, learn), np.array(list(map(len, given)))
    per_byte = lambda bits: bits[~learn].sum() / size[~learn].sum()
    tokens, _, logs, bits = scorer.scores(given)
    n, v = tokens[learn].sum(), len({w for t, x in zip(given, learn, strict=True) if x for w in t.split()}) + 1
    alone = [per_byte((tokens * math.log10(n + v + 1) - logs) / math.log10(2))]
    with monkeypatch.context() as m:
        m.setattr(op3, "RATE", 0.0)
        for k in range(op3.WORD + 1):
            m.setattr(op3, "WEIGHTS", (tuple(float(j == k) for j in range(op3.WORD + 1)), (0.0,) * 4, (0.0,) * 4))
            alone.append(per_byte(scorer.scores(given)[3]))
        m.setattr(op3, "WEIGHTS", ((0.25,) * 4, (0.0,) * 4, (0.0,) * 4))
        alone.append(per_byte(scorer.scores(given)[3]))
    assert per_byte(bits) < min(alone), (per_byte(bits), alone)


def test_op3_counts_every_context(monkeypatch):
    """The log odds of each bit against counts made text by text, over two blocks of one shard."""
    given = [b"ab ab ba \n", b"a b \n", b"abab \n", b"\n"]
    learn = np.array([True, True, False, True])
    code = op3.Code(np.bincount(np.frombuffer(b"".join(t for t, x in zip(given, learn, strict=True) if x), np.uint8), minlength=256))
    blocks = [op3.Block(given[:2], 1), op3.Block(given[2:], 1)]
    answers, n_words = op3.answered([next(op3.Block(given[k : k + 2], 1, learn[k : k + 2]).blobs())[1] for k in (0, 2)], code)
    assert n_words == 5  # ab, ba, a, b and the end
    seen = Counter()

    def contexts(text):
        padded = bytes(6) + text
        for i, byte in enumerate(text):
            word = text[text.rfind(b" ", 0, i) + 1 : i]
            yield byte, [*[padded[6 + i - n : 6 + i] for n in op3.ORDERS], b"w" + word]

    for text, x in zip(given, learn, strict=True):
        for byte, which in contexts(text) if x else ():
            for c in which:
                for node, bit in zip(code.nodes[byte], code.bits[byte][: code.length[byte]], strict=False):
                    seen[len(c) if c[:1] != b"w" else "w", c, int(node), int(bit)] += 1
    for at, block in enumerate(blocks):
        part = given[2 * at : 2 * at + 2]
        scorer = op3.Scorer(block, [answers[at]], code)
        cells = []
        monkeypatch.setattr(op3, "mix", lambda c, n, w, cells=cells: (cells.append(c), (np.zeros(len(n)), w))[1])
        scorer.scores(part)
        got = cells[0].view(np.int8).reshape(-1, 4)[:-1].tolist()
        want = []
        for text in sorted(part, key=lambda t: -len(t)):
            for byte, which in contexts(text):
                for node, bit in zip(code.nodes[byte], code.bits[byte][: code.length[byte]], strict=False):
                    pairs = [[seen[len(c) if c[:1] != b"w" else "w", c, int(node), x] for x in (bit, 1 - bit)] for c in which]
                    want.append([round(math.log((y + op3.SMOOTH) / (n + op3.SMOOTH)) * op3.SCALE) for y, n in pairs])
        assert got == want


def test_op3_is_a_distribution():
    """All texts of a few bytes over two letters have probabilities that add up to at most 1."""
    texts = [b"ab ab ba \n", b"a b \n", b"abab \n"]
    every = [bytes([x]) + b" \n" for x in range(256) if bytes([x]).split()] + [t + b" \n" for t in (b"ab", b"ba", b"aa", b"bb")] + [b"\n"]
    scorer = scorer_of(texts + every, np.arange(len(texts + every)) < 3)
    cost = scorer.scores(texts + every)[3]
    assert 0.01 < (2.0 ** -cost[3:]).sum() <= 1 + 1e-6
    alone = [scorer_of(texts + [t], np.array([True] * 3 + [False])).scores(texts + [t])[3][3] for t in every[-5:]]
    assert np.allclose(alone, cost[-5:], rtol=1e-4)


def test_op4_equals_sql(spark, sf_dir, duck, odd, none):
    df = op4.op4_exact_dedup(spark, sf_dir)
    want = duck.sql(op4.ORACLE)
    cols = sorted(df.columns)
    assert shown(map(tuple, df.select(*cols).collect())) == shown(want.select(*cols).fetchall())
    got = op4.exact_duplicates(odd, block_bytes=16).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r.text_sha256].add((r.keep_id, r.group_size))
    assert all(len(v) == 1 for v in by.values())
    norm = {hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest() for t in (r.text for r in odd.collect())}
    assert set(by) == norm
    kept = op4.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(norm)
    assert op4.exact_duplicates(none).count() == 0


def test_op5_held_out_accuracy(spark, sf_dir, docs, odd, none):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = op5.op5_language(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    model = op5.fit(docs)
    en, de = (next(r.text for r in docs.collect() if r.lang == x and len(r.text) > 2000)[:2000] for x in ("en", "de"))
    shares = model.infer(en + " " + de)[2]
    assert set(shares) == {"en", "de"} and abs(shares["en"] - 0.5) < 0.15
    got = op5.predict(odd, model).collect()
    assert len(got) == odd.count() and all(r.found.lang_pred == "und" for r in got if not any(map(str.isalpha, r.row.text or "")))
    assert op5.predict(odd, op5.fit(none)).where("found.lang_pred <> 'und'").count() == 0
    assert op5.predict(none, model).count() == 0


def test_op5_learns_every_language_and_em_is_exact(spark):
    """300 languages of one word each are all told apart; shares equal those of plain EM."""
    words = [f"{a}{b}{c}" for a in "bcdfghjkl" for b in "aeiou" for c in "mnpqrstvwx"][:300]
    df = spark.createDataFrame([(k, f"{w} " * 20, f"l{k}") for k, w in enumerate(words)], "doc_id long, text string, lang string")
    model = op5.fit(df)
    assert len(model.languages) == 300
    assert all(r.found.lang_pred == r.row.lang for r in op5.predict(df, model).collect())
    text = f"{words[0]} " * 30 + f"{words[7]} " * 10
    found = model.infer(text)
    rows = [model.languages.index(lang) for lang in found[2]]
    like = model.likelihood[rows][:, op5.trigrams(text)].astype(float)
    share = np.full(len(rows), 1 / len(rows))
    for _ in range(300):
        parts = share[:, None] * like
        share = (parts / parts.sum(axis=0)).mean(axis=1)
    assert found[0] == "l0" and np.allclose(share, list(found[2].values()), atol=0.02)


def test_op6_meets_targets(spark, sf_dir, odd, none):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = op6.op6_mixing(spark, sf_dir).collect()
    got = [sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) for d in op6.DOMAINS]
    want = [op6.TARGETS[d] for d in op6.DOMAINS]
    assert np.allclose(np.array(got) / sum(got), np.array(want) / sum(want), atol=1e-3) and min(r.rate for r in rows) >= 0
    assert all(math.isclose(sum(r[f"p_{d}"] for d in op6.DOMAINS), 1, rel_tol=1e-9) and abs(r.copies - r.rate) < 1 for r in rows)
    assert op6.mixing_rates(odd, labels).count() == odd.count() and op6.mixing_rates(none, labels).count() == 0
    assert op6.mixing_rates(odd, labels.where("false")).where("rate < 0").count() == 0
    mixed = op6.mix_documents(odd, labels)
    assert mixed.columns == odd.columns and mixed.count() <= odd.count()


def test_op6_posteriors_equal_brute_force(spark, docs):
    """Naive Bayes by hand: telling words by toxicity, other features by quality."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = op6._labels(labels, "doc_id")
    texts = docs.select("doc_id", "text")
    feats = op6.features(texts, op6.telling_words(texts, known)).cache()
    domain = {r.label_id: r.domain for r in known.collect()}
    rows = feats.collect()
    seen = [(r, domain[r.doc_id]) for r in rows if r.doc_id in domain]
    for r in op6.posteriors(feats, known).collect():
        x = next(y for y in rows if y.doc_id == r.doc_id)
        scores = []
        for d in range(4):
            if not any(k == d for _, k in seen):
                scores.append(0.0)
                continue
            p = (sum(k == d for _, k in seen) + 1) / (len(seen) + 4)
            for f, ends in op6.BINS.items():
                pool = [y for y, k in seen if (k % 2 == d % 2 if f == "telling" else k // 2 == d // 2)]
                p *= (sum(y[f"bin_{f}"] == x[f"bin_{f}"] for y in pool) + 0.5) / (len(pool) + 0.5 * (len(ends) + 1))
            scores.append(p)
        assert np.allclose(r.p, np.array(scores) / sum(scores), atol=1e-9)


def test_op6_held_out_recall(spark):
    """Labelled rows that were not learned from are found.  Of those labelled poor and toxic, a
    third and more has no telling word left in its text: they look poor."""
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    known = op6._labels(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").cache()
    learn = known.where(F.crc32(F.col("label_id").cast("string")) % 3 != 0)
    feats = op6.features(texts, op6.telling_words(texts, learn))
    p = op6.posteriors(feats, learn).join(known, F.col("doc_id") == F.col("label_id")).where(F.crc32(F.col("label_id").cast("string")) % 3 == 0)
    best = F.array_position("p", F.array_max("p")) - 1
    recall = {r.domain: (r.hits / r.n, r.n) for r in p.groupBy("domain").agg(F.count_if(best == F.col("domain")).alias("hits"), F.count("*").alias("n")).collect()}
    assert len(recall) == 4 and all(recall[d][0] >= 0.9 for d in (0, 1, 2)) and recall[3][0] >= 0.4, recall


def test_op6_report(spark, docs, none):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rates = op6.mixing_rates(docs, labels)
    report = {r.domain: r for r in op6.mix_report(rates).collect()}
    total = sum(r.have for r in report.values())
    assert list(report) == list(op6.DOMAINS) and all(abs(r.residual) <= 1e-3 * total for r in report.values()) and math.isclose(sum(r.goal for r in report.values()), total)
    bounded = {r.domain: r.residual for r in op6.mix_report(op6.mixing_rates(docs, labels, max_rate=1.0)).collect()}
    assert min(bounded.values()) < 0
    assert [r.reached for r in op6.mix_report(op6.mixing_rates(none, labels)).collect()] == [0.0] * 4


def test_op6_size_is_not_set_by_a_scarce_domain(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tokens = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    assert op6.mix_documents(docs, labels.where("false")).count() == docs.count()
    good = docs.join(labels.where("quality = 1 AND toxic = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    assert tokens(op6.mix_documents(docs, labels.where("toxic = 0")).join(good.select("doc_id"), "doc_id", "left_semi")) > 0.9 * tokens(good)
    rows = [(100, [float(k == d) for k in range(4)]) for d, n in enumerate((899, 50, 50, 1)) for _ in range(n)]
    soft = spark.createDataFrame(rows, "tokens long, p array<double>")
    _, got = op6.fit_rates(soft, op6.TARGETS, 1.0)
    assert np.allclose([got[d] for d in op6.DOMAINS], [87_000, 3_000, 5_000, 100], rtol=1e-3)
    _, got = op6.fit_rates(soft, op6.TARGETS)
    assert np.allclose([got[d] for d in op6.DOMAINS], [87_000, 3_000, 9_000, 1_000], rtol=1e-3)


def brute_components(texts, size=4):
    sets = {}
    for d, t in texts.items():
        w = op7.words_of(t)
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_op7_equals_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op7.op7_minhash(spark, sf_dir).collect()}
    assert got == brute_components(texts)


def test_op7_dense_cluster(spark):
    """Many edits of one text: far, near and equal ones."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(90)]
    texts = {}
    for d in range(70):
        w = list(base)
        for at in rng.integers(0, 90, int(rng.integers(0, 9))):
            w[at] = f"x{int(rng.integers(0, 4))}"
        texts[d + 1] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op7.near_duplicates(df, size=size).collect()}
        assert got == brute_components(texts, size)


def test_op7_odd(spark, odd, none):
    rows = op7.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[5] == by[6] == 5 and by[1] == 1 and by[2] == 2 and by[11] == by[12] == 11 and by[4] == 4 and by[13] == 13
    assert op7.near_duplicates(none).count() == 0
    assert op7.drop_near_duplicates(odd).columns == odd.columns


def test_near_dedup_stage_takes_five_words(spark, sf_dir):
    """Two texts alike by 131 of 163 shingles of four words, and by 126 of 166 of five."""
    import corpus_pipeline as pipeline

    words = [f"w{k}" for k in range(150)]
    other = [f"x{k}" if k in (20, 50, 80, 110) else w for k, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words) + " z")], "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_dedup(spark, df, sf_dir).collect()} == {1, 2}
    assert {r.doc_id for r in op7.drop_near_duplicates(df, size=4).collect()} == {1}


def test_op8_round_trip(spark, sf_dir, texts, odd, none):
    for r in op8.op8_media(spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    rows = op8.media_columns(odd).collect()
    assert len(rows) == odd.count() and min(r.payload_bytes for r in rows) == 64
    same = [r[1:8] for r in rows if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1] and any(r.shared_chunks for r in rows)
    assert op8.media_columns(none).count() == 0


def test_op8_cuts_are_content_defined():
    data = np.random.default_rng(2).integers(0, 256, 200_000).astype(np.uint8).tobytes()
    ends = op8.cuts(data)
    assert ends[-1] == len(data) and max(np.diff([0, *ends])) <= op8.MOST
    one, two = {d for d, _ in op8.chunks(data)}, {d for d, _ in op8.chunks(b"shift" + data)}
    assert len(one & two) > 0.9 * len(one)


def test_op9_equals_sql(spark, sf_dir, duck):
    df = op9.op9_chat(spark, sf_dir)
    cols = sorted(df.columns)
    assert shown(map(tuple, df.select(*cols).collect())) == shown(duck.sql(op9.ORACLE).select(*cols).fetchall())


def test_op9_odd_turns(spark):
    odd = [(1, 0, "user", "a</turn>\n### b: \\"), (1, 1, "assistant", "\\h \\\\t ###"), (2, 0, None, None), (2, None, "assistant", ""), (3, 0, "x: y", "z"), (None, 1, "assistant", "q"), (4, 0, "assistant", "r"), (4, 0, "assistant", "r")]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    back = op9.format_conversations(df).withColumn("turns", op9.parse(F.col("formatted")))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back.collect()}
    assert got == {1: [("user", odd[0][3]), ("assistant", odd[1][3])], 2: [("assistant", ""), ("", "")], 3: [("x: y", "z")], None: [("assistant", "q")], 4: [("assistant", "r")] * 2}
    assert op9.read_back(op9.format_conversations(df.where("false"))).count() == 0


WORD = re.compile(op10.WORD)


def test_op10_base(spark, sf_dir, texts, odd, none):
    def brute(text):
        w = WORD.findall((text or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in op10.PHRASES:
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))

    for r in op10.op10_licenses(spark, sf_dir).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    rows = {r.doc_id: r for r in op10.scan_licenses(odd).collect()}
    assert (rows[9].n_words, rows[9].n_base, rows[9].first_word, rows[9].last_word, rows[9].base_labels) == brute(next(r.text for r in odd.collect() if r.doc_id == 9))
    assert op10.scan_licenses(odd).count() == odd.count() and op10.scan_licenses(none).count() == 0


def test_op10_rules(spark):
    given = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT", "Licensed under CC BY-NC 4.0.", "see https://creativecommons.org/licenses/by-sa/3.0/", "no such thing", "GNU Lesser General Public License version 2.1 applies", "Apache License, 2019", "Permission is hereby granted, free\nof charge, to any person obtaining a copy of this software"]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, len(r.detections or [])) for r in op10.scan_licenses(df).collect()}
    assert len(op10.RULES) > 300 and got[0] == ("apache,apache-2.0", 1) and got[1][0] == "mit" and got[2] == ("cc-by,cc-by-nc-4.0", 1)
    assert got[3][0] == "cc-by-sa-3.0" and got[4] == ("", 0) and "lgpl-2.1" in got[5][0]
    assert got[6] == ("apache", 0) and got[7] == ("mit", 1)


NOTICES = {
    "Mozilla Public License, v. 2.0": "mpl-2.0", "Eclipse Public License - v 2.0": "epl-2.0", "GNU Lesser General Public License, v. 3": "lgpl-3.0", "Artistic License v 2.0": "artistic-2.0", "Apache-2.0": "apache-2.0",
    "Licensed under Apache 2.0": "apache-2.0", "MPL-2.0": "mpl-2.0", "GPL version 3": "gpl-3.0", "AGPLv3": "agpl-3.0", "EUPL v1.2": "eupl-1.2", "released under the MIT/X11 license": "mit", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "https://opensource.org/licenses/MIT": "mit", "LGPL-2.1": "lgpl-2.1", "GNU General Public License as published by the Free Software Foundation; either version 3 of the License": "gpl,gpl-3.0", "https://www.gnu.org/licenses/old-licenses/gpl-2.0.html": "gpl-2.0",
    "https://creativecommons.org/publicdomain/zero/1.0/": "cc0-1.0", "EPL-2.0 OR GPL-2.0": "epl-2.0,gpl-2.0", "https://www.boost.org/LICENSE_1_0.txt": "bsl-1.0", "simplified examples of gplus and mplayer": "", "apache helicopters 2.0": "", "mit 11 x": "",
}


def test_op10_notices(spark):
    df = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in op10.scan_licenses(df).collect()}
    assert [got[k] for k in range(len(NOTICES))] == list(NOTICES.values())


def written_out(parsed, gap):
    """Texts that a rule's regex matches: each branch and option, with ``gap`` between words."""
    out = [""]
    for op, arg in parsed:
        if str(op) == "BRANCH":
            new = [t for part in arg[1] for t in written_out(part, gap)]
        elif str(op) == "SUBPATTERN":
            new = written_out(arg[3], gap)
        elif str(op) == "MAX_REPEAT":
            inner = written_out(arg[2], gap)
            new = inner if inner == [gap] or arg[0] else ["", *inner]
        elif str(op) == "LITERAL":
            new = [chr(arg)]
        elif str(op) == "AT":
            new = [""]
        else:  # a class: of what is no word or is space, or of letters
            new = [chr(v) for k, v in arg if str(k) == "LITERAL" and chr(v).isalpha()] or [gap]
        out = [a + b for a in out for b in new]
    return out


def test_op10_gates_lose_no_match(spark):
    """On wrapped texts of every rule, the scan finds what all rules find without a gate."""
    given = []
    for _, keys, rx, _ in op10.RULES:
        made = written_out(re._parser.parse(rx), "\n")
        assert all(re.search(rx, t) and all(k in t for k in keys.split(" ")) for t in made)
        given += {made[0], made[-1]}
    given += ["All rights\nreserved", "SIL Open\nFont License", "GNU Library General Public License version 2", "MIT No Attribution", "Open Data Commons Attribution", "Creative\nCommons Attribution 4.0", "CCBY 4.0"]
    rules = [(label, re.compile(rx, re.ASCII), p) for label, _, rx, p in op10.RULES]

    def ungated(text):
        found = {(m.start(), m.end(), label, p) for label, rx, p in rules for m in rx.finditer(text.translate(LOWER)) if m.end() > m.start()}
        beats = lambda y, x: (
            y[0] < x[1] and x[0] < y[1] and y[3] > x[3] or y[3] == x[3] and y[0] <= x[0] and y[1] >= x[1] and (y[:2] != x[:2] or y[2] < x[2])
        )
        return {x for x in found if not any(beats(y, x) for y in found)}

    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(4)
    for r in op10.scan_licenses(df).select("doc_id", "detections").collect():
        want = ungated(given[r.doc_id])
        assert want and {tuple(x) for x in r.detections or []} == want, given[r.doc_id]


def test_stages_on_odd_tables(spark, sf_dir, odd, none):
    """Every stage keeps its columns on tables of nulls, repeats and clashing names."""
    import corpus_pipeline as pipeline

    for clash in (odd, none):
        taken = {c: F.lit("x") for c in ("row", "found", "own_id", "own_tkey", "keep_id", "keep_tkey", "gone_id", "mix_id", "mix_copies", "inferred_language", "col")}
        given = clash.withColumns(taken)
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, given, sf_dir)
            assert out.columns == given.columns
            rows = out.collect()
            assert len(rows) <= given.count() and all(r.own_tkey == "x" for r in rows) and (clash is none or rows)
        assert pipeline.packing(spark, given, sf_dir).where("piece = 0").count() == given.count()


def test_pipeline(spark, sf_dir, docs, texts):
    import corpus_pipeline as pipeline

    frame, at = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.columns == docs.columns
        frame = out.cache()
        at[name] = {r.doc_id for r in frame.collect()}
    kept = {d for d, t in texts.items() if any(map(str.isalpha, t))}
    assert at["language_id"] == kept
    last = {}
    for d in sorted(kept):
        last[texts[d].translate(LOWER)] = d
    assert at["exact_dedup"] == set(last.values())
    want = brute_components({d: texts[d] for d in at["exact_dedup"]}, 5)
    assert at["near_dedup"] == {d for d, v in want.items() if v[2]}
    assert at["mixing"] <= at["near_dedup"]
    packed = {r.doc_id for r in pipeline.run(spark, sf_dir).collect()}
    assert packed == at["mixing"]
