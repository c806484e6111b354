"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in one global order. A keyed Feistel network permutes the
numbers below the next power of four, and cycle walking (permuting again
whatever falls outside) makes it a permutation of the row numbers themselves.
Shard and slot are the remainder and the quotient of the permuted number, so
the whole shuffle can be computed, and undone, for any row from its number,
the row count and the seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows

ROUNDS = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier: 2^64 over the golden ratio


def _round(half: np.ndarray, key: int) -> np.ndarray:
    x = (half + np.uint64(key)) * _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**62, ROUNDS).tolist()


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Images of row numbers in [0, n) under the permutation."""
    bits = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    out = numbers.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> bits, out[walk] & mask
        for key in _keys(seed):
            left, right = right, left ^ (_round(right, key) & mask)
        out[walk] = (left << bits) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def invert(images: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Row numbers of images: the network run backwards."""
    bits = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    out = images.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> bits, out[walk] & mask
        for key in reversed(_keys(seed)):
            left, right = right ^ (_round(left, key) & mask), left
        out[walk] = (left << bits) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted(row_number: Column, n: int, seed: int = 0) -> Column:
    @F.pandas_udf("long")
    def images(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return images(row_number)


def assign(docs: DataFrame, shards: int = 40, *, seed: int = 0) -> DataFrame:
    """Shard and slot of every row of ``docs`` (``doc_id``, ``text``) under the law ``rows``.

    Shard counts differ by one at most, and slots run from 0 without gaps.
    Rows are numbered by doc_id (null first), then by checksum and size;
    repeated rows get numbers of their own. size is the text's UTF-8 bytes
    (null: none) plus 16, text_crc32 that of the text, a null one as empty.
    grown_shard is null: under this law one more shard deals all rows anew.
    Extra columns are ignored. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = number_rows(rows, "doc_id", "text_crc32", "size")
    n = docs.count()
    return numbered.withColumn("image", permuted(F.col("row_number"), n, seed)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("image") % shards).cast("int").alias("shard"), F.expr(f"image div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def locate(row_number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number, without the table."""
    image = int(permute(np.array([row_number]), n, seed)[0])
    return image % shards, image // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Row number that stands at a shard's slot."""
    return int(invert(np.array([slot * shards + shard]), n, seed)[0])
