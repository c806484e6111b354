"""Conflict-constrained best-fit packing of documents into bins.

Documents are cut into pieces that fit a bin. Pieces are dealt to shards of
bounded size, and each shard is packed on its own, longest piece first; its
bins leave as texts, with the boundaries of their pieces. Open
bins stand in order of their residual room. The search starts at the
tightest bin that has room and goes on to its successors until one is
compatible: two bitmaps per bin say which sources have used up their share of
it and which clusters of duplicates it already holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import of_texts
from .mixing import BLANKS, word_count

#: Words in a bin, pieces of one source in a bin at most, and pieces and bytes that a shard should hold.
CAPACITY, PER_SOURCE, SHARD_PIECES, SHARD_BYTES = 2048, 3, 2048, 8 << 20
#: Stands between the pieces of a bin.
SEPARATOR = "\n\n"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, taken in the given order.

    ``sources`` and ``clusters`` are small integers; a negative cluster
    conflicts with nothing. Bins are kept as (residual, number), so the first
    at or after (size, 0) is the tightest; it is passed over while one of its
    bitmaps has the piece's bit.
    """
    bins = np.zeros(len(sizes), dtype=np.int64)
    offsets = np.zeros(len(sizes), dtype=np.int64)
    room: list[tuple[int, int]] = []
    source_bits: list[list[int]] = []  # per bin: plane p has the sources with more than p pieces
    cluster_bits: list[int] = []
    for n, (size, source, cluster) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist())):
        s_bit, c_bit = 1 << source, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(room, (size, 0))
        while at < len(room) and (source_bits[room[at][1]][-1] & s_bit or cluster_bits[room[at][1]] & c_bit):
            at += 1
        if at < len(room):
            residual, number = room.pop(at)
        else:
            residual, number = capacity, len(cluster_bits)
            source_bits.append([0] * per_source)
            cluster_bits.append(0)
        bins[n], offsets[n] = number, capacity - residual
        carry, planes = s_bit, source_bits[number]
        for p in range(per_source):
            planes[p], carry = planes[p] | carry, planes[p] & carry
        cluster_bits[number] |= c_bit
        if residual > size:
            insort(room, (residual - size, number))
    return bins, offsets


def cut(text: str | None, capacity: int) -> list[tuple[int, str]]:
    """Pieces of at most ``capacity`` words: (number of words, text without blanks around it)."""
    if not text:
        return []
    words = len(text.encode("utf-8", "replace").split())
    if words <= capacity:
        return [(words, text.strip(BLANKS))] if words else []
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(len(part), text[part[0][0] : part[-1][1]]) for part in (spans[i : i + capacity] for i in range(0, words, capacity))]


_PIECE = "doc_id {doc_id}, source {source}, cluster string, piece int, first_word long, piece_words long"


def _pieces(batches: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        each = [cut(text, capacity) for text in batch["text"]]
        again = np.repeat(np.arange(len(batch)), [len(x) for x in each])
        out = batch[["doc_id", "known", "source", "cluster", "row"]].iloc[again].reset_index(drop=True)
        out["piece"] = np.array([n for x in each for n in range(len(x))], dtype=np.int32)
        out["first_word"] = out["piece"].astype("int64") * capacity
        out["piece_words"] = np.array([words for x in each for words, _ in x], dtype=np.int64)
        out["text"] = [text for x in each for _, text in x]
        yield out


def _pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """The bins of one shard."""
    rows = rows.sort_values(["piece_words", "doc_id", "cluster", "piece", "row"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    sources = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    codes, _ = pd.factorize(rows["cluster"])
    shared = np.bincount(codes[codes >= 0], minlength=1)[codes] > 1 if (codes >= 0).any() else np.zeros(len(codes), dtype=bool)
    shared &= codes >= 0
    clusters = np.full(len(rows), -1)
    clusters[shared] = pd.factorize(codes[shared])[0]
    bins, offsets = best_fit(rows["piece_words"].to_numpy(), sources, clusters, capacity, per_source)
    order = np.lexsort((offsets, bins))
    out: list[list] = []
    fields = ["doc_id", "source", "cluster", "piece", "first_word", "piece_words", "text"]
    columns = [[None if x is None or x != x else x for x in rows[f].iloc[order].tolist()] for f in fields]
    columns[0] = [x if known else None for x, known in zip(columns[0], rows["known"].iloc[order])]
    for number, offset, (*piece, text) in zip(bins[order].tolist(), offsets[order].tolist(), zip(*columns)):
        if len(out) == number:
            out.append([0, "", [], []])
        held = out[number]
        if held[3]:
            held[0] += len(SEPARATOR)
        held[2].append(dict(zip(fields, piece)) | {"offset": offset, "start": held[0] + 1, "length": len(text)})
        held[3].append(text)
        held[0] += len(text)
    return pd.DataFrame({
        "shard": rows["shard"].iloc[0], "bin": range(len(out)), "words": np.bincount(bins, weights=rows["piece_words"]).astype(np.int64),
        "text": [SEPARATOR.join(held[3]) for held in out], "pieces": [held[2] for held in out],
    })


def pack(docs: DataFrame, *, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_pieces: int = SHARD_PIECES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The bins: one packed text each, and where its pieces stand in it.

    In: ``doc_id``, ``text``, ``source`` and, if there, ``cluster`` (the
    document's duplicate cluster; else documents that differ in blanks and
    case only form one). Out, one row per bin: shard, bin (from 0 within the
    shard), words, text, and pieces in their order: doc_id, source, cluster,
    piece (from 0), first_word, piece_words, offset (words before it in the
    bin), start and length (characters in ``text``, from 1).

    No bin holds more than ``capacity`` words, two pieces of one cluster, or
    more than ``per_source`` pieces of one source. Longer documents are cut
    into pieces of ``capacity`` words and a rest. Null, empty and blank texts
    have no words and no pieces. Null sources count as one source, a null
    cluster conflicts with nothing. Repeated rows are packed each, in
    different bins, and are dealt to shards like any other rows. Extra columns
    are ignored. An empty table gives an empty table.
    """
    if "cluster" in docs.columns:
        cluster = F.col("cluster").cast("string")
    else:
        cluster = F.md5(F.lower(F.translate("text", BLANKS, "")))
    n, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    # a word takes two bytes at least, but for the last
    shards = max(1, -(-(n + n_bytes // (2 * capacity)) // shard_pieces), -(-n_bytes // shard_bytes))
    kind = dict(docs.dtypes)
    piece = _PIECE.format(**kind)
    no_id = F.lit("0").cast(kind["doc_id"])  # pandas has no null for whole numbers
    rows = of_texts(docs).select(F.coalesce("doc_id", no_id).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "source", cluster.alias("cluster"), F.monotonically_increasing_id().alias("row"), "text")
    pieces = rows.mapInPandas(lambda batches: _pieces(batches, capacity), f"{piece.replace(', source', ', known boolean, source')}, row long, text string")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "row"), F.lit(shards)).cast("int"))
    placed = ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ") for x in piece.split(", ")))
    schema = f"shard int, bin long, words long, text string, pieces array<struct<{placed}, offset: long, start: long, length: long>>"
    return dealt.groupBy("shard").applyInPandas(lambda rows: _pack_shard(rows, capacity, per_source), schema)


def placements(bins: DataFrame) -> DataFrame:
    """One row per piece of packed bins, its words and digest read back from the packed text.

    doc_id, source, cluster, piece, first_word, piece_words, shard, bin,
    offset and text_md5.
    """
    each = bins.select("shard", "bin", "text", F.explode("pieces").alias("p"))
    own = F.substring(F.col("text"), F.col("p.start").cast("int"), F.col("p.length").cast("int"))
    read = each.select("p.doc_id", "p.source", "p.cluster", "p.piece", "p.first_word", "shard", "bin", "p.offset", own.alias("own"))
    return read.select(
        "doc_id", "source", "cluster", "piece", "first_word", word_count(F.col("own")).alias("piece_words"), "shard", "bin", "offset", F.md5("own").alias("text_md5")
    )
