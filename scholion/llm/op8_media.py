"""Media columns with content-defined payload chunking.

A payload is wrapped in a lossless 8-bit container (mono PCM in a RIFF header) and cut where
a rolling gear hash of the last 32 bytes hits a pattern, so equal stretches of bytes give
equal chunks wherever they stand.  Chunk digests are counted by Spark; a chunk whose digest
occurs once is stored inline with its document, a chunk that occurs more often goes once to
a chunk table.  Reading back puts each document's ordered chunk list together again (chunks
of the table are joined by digest) and verifies it against the stored digest.

Which digests are shared is told to the writers by a Bloom filter of at most FILTER_BITS
bits.  A false positive only sends an unshared chunk to the chunk table; reading back is
exact for any filter.  Text is never shuffled: only chunks that documents share are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import documents, materialise, ship

#: Payloads are filled up to a multiple of this many bytes, one unit at least.
UNIT = 64
SAMPLE_RATE = 8000
#: Chunk sizes in bytes: least, about the mean beyond it, most.
LEAST, MEAN_BITS, MOST = 512, 11, 8192
#: Most bits of the filter of shared digests, and bits that each digest sets.
FILTER_BITS, FILTER_HASHES = 1 << 27, 4

_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text, filled up with bytes 0, and its length before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0)), len(raw)


def media_of(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono samples behind a 44-byte RIFF/WAVE header."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload


def payload_in(media: bytes) -> bytes:
    """The samples of a container as ``media_of`` writes it."""
    (size,) = struct.unpack_from("<I", media, 40)
    if media[:4] != b"RIFF" or media[36:40] != b"data" or size != len(media) - 44:
        raise ValueError("not a container of 8-bit samples")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``.

    The gear hash of 32 bytes doubles its window five times: a window of 2n is two windows
    of n, the older one shifted n places.
    """
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for n in (1, 2, 4, 8, 16):
        older = h[:-n] << np.uint64(n)
        h = h.copy()
        h[n:] += older
    hits = (np.flatnonzero((h >> np.uint64(20)) & np.uint64((1 << MEAN_BITS) - 1) == 0) + 1).tolist()
    ends, at = [], 0
    for hit in [*hits, len(data)]:
        while hit - at > MOST:
            at += MOST
            ends.append(at)
        if hit - at >= LEAST:
            ends.append(hit)
            at = hit
    if at < len(data):
        ends.append(len(data))
    return ends


def chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk in order."""
    out, at = [], 0
    for end in cuts(media):
        part = media[at:end]
        out.append((hashlib.blake2b(part, digest_size=16).digest(), part))
        at = end
    return out


def _positions(digest: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", digest)
    return [(a + k * (b | 1)) % bits for k in range(FILTER_HASHES)]


def features(media: bytes) -> str:
    """Mean, root mean square around it and zero crossings of the samples."""
    x = np.frombuffer(payload_in(media), np.uint8).astype(np.int64)
    total, square = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"{total / len(x):.6f};{(square / len(x) - (total / len(x)) ** 2) ** 0.5:.6f};{crossings}"


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, chunks long, shared_chunks long"
STORED = "row string, doc_id long, n_bytes long, media_sha256 string, digests array<binary>, inline array<boolean>, blob binary"


def _result(doc_id, n_bytes: int, stored_sha: str, media: bytes, n_chunks: int, n_shared: int) -> tuple:
    sha = hashlib.sha256(media).hexdigest()
    if sha != stored_sha:
        raise ValueError(f"media of document {doc_id} reads back different")
    payload = payload_in(media)
    return (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha, features(media), n_chunks, n_shared)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})


def _digest_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"digest": [d for text in batch["text"] for d, _ in chunks(media_of(payload_of(text)[0]))]})


def _filter_positions(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"position": [p for d in batch["digest"] for p in _positions(d, bits)]})

    return run


def _shared_filter(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of a Bloom filter of the digests that occur more than once (at most FILTER_BITS)."""
    digests = texts.mapInPandas(_digest_rows, "digest binary")
    shared = materialise(digests.groupBy("digest").count().where("count > 1").select("digest"), "op8-shared")
    bits = min(FILTER_BITS, 1 << max(10, (16 * shared.count()).bit_length()))
    words = (
        shared.mapInPandas(_filter_positions(bits), "position long")
        .groupBy(F.shiftright("position", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(position & 63 AS INT))")).alias("mask"))
        .toPandas()
    )
    table = np.zeros(bits // 64, np.uint64)
    if len(words):
        table[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return bits, table


def store_media(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the document table (ordered digests, inline chunks) and the chunk table
    (digest, data) of (doc_id, text) rows; returns both as read back."""
    spark = texts.sparkSession
    bits, table = _shared_filter(texts)
    sent = spark.sparkContext.broadcast(table)

    def is_shared(digest: bytes) -> bool:
        words = sent.value
        return all(int(words[p >> 6]) >> (p & 63) & 1 for p in _positions(digest, bits))

    def write_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                payload, n_bytes = payload_of(text)
                media = media_of(payload)
                parts = chunks(media)
                inline = [not is_shared(d) for d, _ in parts]
                blob = packer.compress(b"".join(struct.pack("<I", len(p)) + p for (_, p), own in zip(parts, inline, strict=True) if own))
                sha = hashlib.sha256(media).hexdigest()
                out.append((f"{doc_id}/{sha}", doc_id, n_bytes, sha, [d for d, _ in parts], inline, blob))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in STORED.split(", ")]).astype({"doc_id": "Int64"})

    def write_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            here = {d: p for text in batch["text"] for d, p in chunks(media_of(payload_of(text)[0])) if is_shared(d)}
            yield pd.DataFrame({"digest": list(here), "data": list(here.values())})

    docs = materialise(texts.mapInPandas(write_docs, STORED), "op8-docs")
    table_rows = texts.mapInPandas(write_chunks, "digest binary, data binary").groupBy("digest").agg(F.max("data").alias("data"))
    return docs, materialise(table_rows, "op8-chunks")


def _inline_parts(blob: bytes) -> Iterator[bytes]:
    raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        yield raw[at + 4 : at + 4 + n]
        at += 4 + n


def _media(inline, blob: bytes, shared: dict[int, bytes]) -> bytes:
    own = _inline_parts(blob)
    return b"".join(next(own) if x else shared[k] for k, x in enumerate(inline))


def _read_inline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield _frame([_result(d, n, s, _media(i, z, {}), len(i), 0) for d, n, s, i, z in zip(b["doc_id"], b["n_bytes"], b["media_sha256"], b["inline"], b["blob"], strict=True)])


def _read_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for d, n, s, i, z, parts in zip(b["doc_id"], b["n_bytes"], b["media_sha256"], b["inline"], b["blob"], b["parts"], strict=True):
            shared = {int(p["at"]): bytes(p["data"]) for p in parts}
            out.append(_result(d, n, s, _media(i, z, shared), len(i), len(shared)))
        yield _frame(out)


def read_media(docs: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """Reconstruct, verify and measure every stored document."""
    alone = docs.where(F.forall("inline", lambda x: x)).mapInPandas(_read_inline, RESULT)
    mixed = docs.where(F.exists("inline", lambda x: ~x))
    # rows that repeat an id and a text are stored alike, and fetch their chunks once
    wanted = mixed.dropDuplicates(["row"]).select(
        "row", F.explode(F.filter(F.zip_with(F.zip_with("digests", "inline", lambda d, i: F.struct(d.alias("digest"), i.alias("inline"))), F.sequence(F.lit(0), F.size("digests") - 1), lambda x, k: F.struct(x["digest"].alias("digest"), x["inline"].alias("inline"), k.alias("at"))), lambda x: ~x["inline"])).alias("c")
    ).select("row", "c.at", "c.digest")
    fetched = wanted.join(chunk_table, "digest").groupBy("row").agg(F.collect_list(F.struct("at", "data")).alias("parts"))
    return alone.unionByName(mixed.join(fetched, "row").mapInPandas(_read_joined, RESULT))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, chunks, shared_chunks, all read back from storage.

    A null or empty text is a payload of 64 bytes 0.  Null and repeated ids are kept as they
    are; equal texts have equal values.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read_media(*store_media(texts))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
