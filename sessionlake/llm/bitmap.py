"""Bitmaps of fixed size that tell where a key cannot be.

A wrongly set bit only sends a row the long way round; no key is missed. The
size does not grow with the data, so a bitmap may be collected and broadcast;
where the data outgrow it, it saves less and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def words_of(bits: np.ndarray) -> pd.DataFrame:
    """(word, mask) of bit numbers, a row for each word."""
    bits = np.unique(bits)
    words, start = np.unique(bits >> 5, return_index=True)
    masks = np.bitwise_or.reduceat(np.int64(1) << (bits & 31), start) if len(bits) else bits
    return pd.DataFrame({"word": words, "mask": masks})


def collect_words(words: DataFrame, bits: int) -> np.ndarray:
    """One bitmap from rows (word, mask): at most bits / 32 rows reach the driver."""
    found = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[found["word"].to_numpy()] = found["mask"].to_numpy().astype(np.uint32)
    return out


def bitmap_of(keys: DataFrame, key: str, bits: int = BITS) -> np.ndarray:
    """Bitmap of a column of longs: bit ``key mod bits``."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield words_of(batch[key].to_numpy(dtype=np.int64) % bits)

    return collect_words(keys.select(key).mapInPandas(mark, "word long, mask long"), bits)


def is_set(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the bitmap."""
    bits = keys % (len(bitmap) * 32)
    return (bitmap[bits >> 5] >> (bits & 31).astype(np.uint32)) & 1 == 1


def may_hold(bitmap, key: Column) -> Column:
    """Whether each key may be among those of a broadcast bitmap."""

    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        return pd.Series(is_set(bitmap.value, keys.to_numpy(dtype=np.int64)))

    return held(key)


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """Left semi join of wide ``rows``: those that cannot match are dropped where they are read, before the shuffle."""
    key = F.xxhash64(*on)
    marks = rows.sparkSession.sparkContext.broadcast(bitmap_of(keys.select(key.alias("key")), "key", bits))  # bits / 8 bytes
    return rows.filter(may_hold(marks, key)).join(keys.select(*on).distinct(), on, "left_semi")
