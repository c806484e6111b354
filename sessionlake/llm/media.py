"""Media columns: content-defined chunks, stored once, and rebuilt into verified media.

A payload becomes a WAV file of 8-bit samples. A rolling gear hash cuts the
file where its content says so, so equal passages give equal chunks. A first
pass over the texts shuffles only short chunk hashes and marks the repeated
ones in a bitmap of fixed size. In the second pass a chunk that the bitmap
rules out as repeated stays with its document, in one compressed blob; any
other goes to the chunk store, where a join on digests keeps one copy. Every
document has an ordered chunk list, from which its media file is rebuilt and
checked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, new_path
from .batches import of_texts
from .bitmap import bitmap_of, is_set

LEAST, AVERAGE_BITS, MOST = 1024, 12, 16384
#: Bits of the bitmap of repeated chunk hashes. More repeats than bits only send more chunks to the store.
BITMAP_BITS = 1 << 24
SAMPLE_RATE = 8000
_WINDOW_STEPS = (1, 2, 4, 8, 16)  # doubling to a window of 32 bytes
_ROWS_OUT = 500


def gear_table() -> np.ndarray:
    """One 32-bit number per byte value, from a multiplicative hash."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = gear_table()


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 32 bytes has its top bits zero, between LEAST and MOST bytes."""
    if len(data) <= LEAST:
        return [len(data)]
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in _WINDOW_STEPS:  # h[i] = gear[i] + 2 * gear[i - 1] + 4 * gear[i - 2] + ...
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    ends = np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + 1
    out, start = [], 0
    while len(data) - start > LEAST:
        at = int(np.searchsorted(ends, start + LEAST))
        end = min(int(ends[at]) if at < len(ends) else len(data), start + MOST, len(data))
        out.append(end)
        start = end
    if start < len(data):
        out.append(len(data))
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and their number without the zeros."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def to_wav(payload: bytes, n_bytes: int) -> bytes:
    """WAV file: mono, one byte a sample; a chunk ``olen`` keeps the unpadded length."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sIQ", b"olen", 8, n_bytes) + struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length of a file made by :func:`to_wav`."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, parts = 12, {}
    while at < len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        parts[name] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return parts[b"data"], struct.unpack("<Q", parts[b"olen"])[0]


def describe(payload: bytes) -> str:
    """Features of the samples, in whole numbers: count, sum, energy, crossings of the middle, largest step."""
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    steps = np.abs(np.diff(samples))
    crossings = int(np.count_nonzero((samples[1:] >= 0) != (samples[:-1] >= 0)))
    return f"samples={len(samples)};sum={int(samples.sum())};energy={int((samples * samples).sum())};crossings={crossings};step={int(steps.max(initial=0))}"


def _chunks(text: str | None) -> tuple[bytes, list[bytes]]:
    media = to_wav(*payload_of(text))
    ends = cut_points(media)
    return media, [media[s:e] for s, e in zip([0, *ends[:-1]], ends)]


def repeated_bitmap(docs: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of the hashes of chunks that stand more than once in ``docs``: bit ``hash mod bits``.

    Its size is fixed. Wrongly set bits cost a detour through the store, no
    repeated chunk is ever missed.
    """

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([[xxhash.xxh64_intdigest(c) >> 1 for c in _chunks(t)[1]] for t in texts])

    repeated = docs.select(F.explode(hashes("text")).alias("h")).groupBy("h").count().filter("count > 1")
    return bitmap_of(repeated, "h", bits)


def _store(batches: Iterator[pd.DataFrame], marks: np.ndarray) -> Iterator[pd.DataFrame]:
    """Chunk lists with their own chunks, and the chunks for the store."""
    pack = zstandard.ZstdCompressor(level=3).compress
    columns = ["kind", "doc_id", "media_sha256", "list", "data", "digest"]
    for batch in batches:
        rows, sent = [], set()
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            media, chunks = _chunks(text)
            own, items = [], []
            hashes = np.array([xxhash.xxh64_intdigest(c) >> 1 for c in chunks], dtype=np.int64)
            for chunk, shared in zip(chunks, is_set(marks, hashes).tolist()):
                digest = hashlib.sha256(chunk).digest()
                items.append({"digest": digest, "length": len(chunk), "shared": shared})
                if not shared:
                    own.append(chunk)
                elif digest not in sent:
                    sent.add(digest)
                    rows.append(("chunk", None, None, None, pack(chunk), digest))
            kind = "shared" if any(x["shared"] for x in items) else "alone"
            rows.append((kind, None if pd.isna(doc_id) else int(doc_id), hashlib.sha256(media).digest(), items, pack(b"".join(own)), None))
            if len(rows) >= _ROWS_OUT:
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})


_LIST = "array<struct<digest: binary, length: int, shared: boolean>>"
_STORED = f"kind string, doc_id long, media_sha256 binary, list {_LIST}, data binary, digest binary"


def new_chunks(candidates: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row (digest, data) for each digest of ``candidates`` that ``stored`` lacks."""
    one = candidates.select("digest", "data").dropDuplicates(["digest"])
    return one if stored is None else one.join(stored.select("digest"), "digest", "left_anti")


def store(docs: DataFrame, *, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """Store the media of all texts: (lists, chunks), both as written tables in the shared folder.

    lists: kind (``alone``: all chunks are in ``data``; ``shared``: some are in
    the store), doc_id, media_sha256, list (digest, length, shared), data.
    chunks: digest, data; each digest once.
    """
    marks = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(docs, bits))  # bits / 8 bytes
    rows = of_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lambda b: _store(b, marks.value), _STORED)
    path = new_path(docs.sparkSession, "media")
    rows.write.partitionBy("kind").parquet(path)
    spark = docs.sparkSession
    tables = {kind: _part(spark, path, kind) for kind in ("alone", "shared", "chunk")}
    lists = tables["alone"].select(F.lit("alone").alias("kind"), "doc_id", "media_sha256", "list", "data").unionByName(
        tables["shared"].select(F.lit("shared").alias("kind"), "doc_id", "media_sha256", "list", "data")
    )
    return lists, materialize(new_chunks(tables["chunk"]), "media-chunks")


def _part(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path).filter(F.col("kind") == kind)


def rebuild(items: list, own: bytes, fetched: dict[int, bytes], expected: bytes) -> bytes:
    """Media file from its chunk list; every chunk and the whole are checked."""
    unpack = zstandard.ZstdDecompressor().decompress
    mine, at, out = unpack(own), 0, []
    for n, item in enumerate(items):
        if item["shared"]:
            chunk = unpack(fetched[n])
        else:
            chunk = mine[at : at + item["length"]]
            at += item["length"]
        if len(chunk) != item["length"] or hashlib.sha256(chunk).digest() != bytes(item["digest"]):
            raise ValueError(f"chunk {n} does not match its digest")
        out.append(chunk)
    media = b"".join(out)
    if hashlib.sha256(media).digest() != expected:
        raise ValueError("rebuilt media does not match its digest")
    return media


_FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _measure(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rebuild each row's media and measure what it holds."""
    columns = [key, *(c.split()[0] for c in _FEATURES.split(", "))]
    for batch in batches:
        rows = []
        fetched = batch["fetched"] if "fetched" in batch else [None] * len(batch)
        for name, items, own, sha, parts in zip(batch[key], batch["list"], batch["data"], batch["media_sha256"], fetched):
            media = rebuild(items, own, {p["at"]: p["data"] for p in parts} if parts is not None else {}, bytes(sha))
            payload, n = from_wav(media)
            rows.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)))
        out = pd.DataFrame(rows, columns=columns)
        yield out.astype({"doc_id": "Int64"}) if key == "doc_id" else out


def read_back(lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id and the features of every stored document, from the stored bytes alone.

    Documents whose chunks are all their own are rebuilt where they are read.
    Of the others each distinct media file is rebuilt once: its shared chunks
    are fetched by a join on digest and meet in one row, and the features go
    back to all documents that have that media.
    """
    alone = lists.filter("kind = 'alone'").select("doc_id", "media_sha256", "list", "data").mapInPandas(lambda b: _measure(b, "doc_id"), f"doc_id long, {_FEATURES}")
    shared = lists.filter("kind = 'shared'")
    distinct = shared.select("media_sha256", "list", "data").dropDuplicates(["media_sha256"])
    wanted = distinct.select("media_sha256", F.posexplode("list").alias("at", "item")).filter("item.shared").select("media_sha256", "at", F.col("item.digest").alias("digest"))
    fetched = wanted.join(chunks, "digest").groupBy("media_sha256").agg(F.collect_list(F.struct("at", "data")).alias("fetched"))
    measured = distinct.join(fetched, "media_sha256").select("media_sha256", "list", "data", "fetched", F.hex("media_sha256").alias("name")).mapInPandas(lambda b: _measure(b, "name"), f"name string, {_FEATURES}")
    owners = shared.select("doc_id", F.hex("media_sha256").alias("name"))
    return alone.unionByName(owners.join(measured, "name").drop("name"))


def media_features(docs: DataFrame, *, bits: int = BITMAP_BITS) -> DataFrame:
    """Store every whole text of ``docs`` (``doc_id``, ``text``) and measure what reads back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature; one row per row of ``docs``. Null texts count as
    empty; equal texts share chunks and values; repeated rows stay; extra
    columns are ignored; an empty table gives an empty table.
    """
    return read_back(*store(docs, bits=bits))
