"""Toxicity scores by non-negative positive-unlabelled learning.

Trusted toxic examples are the positives, all other text is unlabelled. A
text's features are its words and their beginnings of three to seven letters,
which carry stems in inflected languages; standing twice counts apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from itertools import chain, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pu

_WORD = re.compile(r"\w+")
_STEMS = range(3, 8)
_TWICE = 8  # bit of a feature that says its words stand twice or more; the lowest bits say how much of the word it is
#: Words whose features a task remembers between texts.
_MEMORY = 50_000


def word_features(word: str) -> tuple[int, ...]:
    """Numbers of a word's beginnings, the shortest with the smallest remainder, and of the whole word."""
    parts = [word[:n] for n in _STEMS if len(word) >= n]
    hashes = [xxhash.xxh64_intdigest("<" + part) for part in parts] + [xxhash.xxh64_intdigest("=" + word)]
    return tuple((h >> 5 << 4) + n for n, h in enumerate(hashes))


class Features:
    """What a text holds, and (with the bit ``_TWICE``) what it holds twice or more."""

    def __init__(self):
        self._memory: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"_memory": {}}

    def ids(self, text: str) -> np.ndarray:
        memory = self._memory
        if len(memory) > _MEMORY:
            memory.clear()
        words = Counter(_WORD.findall(text.lower()))
        each = []
        for word in words:
            known = memory.get(word)
            if known is None:
                known = memory[word] = word_features(word)
            each.append(known)
        n = sum(map(len, each))
        flat = np.fromiter(chain.from_iterable(each), dtype=np.int64, count=n)
        times = np.fromiter(chain.from_iterable(map(repeat, words.values(), map(len, each))), dtype=np.int64, count=n)
        found, place = np.unique(flat, return_inverse=True)
        return np.concatenate((found, found[np.bincount(place, weights=times, minlength=len(found)) > 1] + _TWICE))

    def names(self, texts: Iterable[str], ids: set[int]) -> dict[int, str]:
        out = {}
        for text in texts:
            for word in set(_WORD.findall(text.lower())):
                parts = [word[:n] for n in _STEMS if len(word) >= n] + ["=" + word]
                for part, f in zip(parts, word_features(word)):
                    if f in ids:
                        out[f] = part
                    if f + _TWICE in ids:
                        out[f + _TWICE] = part + "*"
        return out

    def adder(self, weights: dict[str, float]) -> Callable[[str], float]:
        twice = {name[:-1]: w for name, w in weights.items() if name.endswith("*")}
        values = {part: (weights.get(part, 0.0), twice.get(part, 0.0)) for part in twice.keys() | {name for name in weights if not name.endswith("*")}}
        known: dict[str, tuple[str, ...]] = {}
        nothing: set[str] = set()  # words without any weight, by far the most

        def total(text: str) -> float:
            words = Counter(_WORD.findall(text.lower()))
            times: dict[str, int] = {}
            for word in words.keys() - nothing:
                hits = known.get(word)
                if hits is None:
                    if len(known) + len(nothing) >= _MEMORY:
                        known.clear()
                        nothing.clear()
                    hits = tuple(word[:n] for n in _STEMS if len(word) >= n and word[:n] in values)
                    if "=" + word in values:
                        hits += ("=" + word,)
                    if not hits:
                        nothing.add(word)
                        continue
                    known[word] = hits
                for part in hits:
                    times[part] = times.get(part, 0) + words[word]
            return sum(values[part][0] + (values[part][1] if n > 1 else 0.0) for part, n in sorted(times.items()))

        return total


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 4, held_out: int = 2) -> pu.Model | None:
    """Train on the labels of rows outside the held-out fold; None if no positive is there.

    Labels that are null, and rows whose id is null, are left out. Of repeated
    labels of one id, one positive is enough.
    """
    training = pu.remainder(F.col("doc_id"), folds) != held_out
    known = labels.filter(F.col("doc_id").isNotNull())
    positives = known.filter(training & (F.col(label) == 1)).select("doc_id").distinct()
    return pu.train(docs, positives, training, Features(), 1)


def flag(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Empty, blank and null texts get the score of a text without features.
    Repeated rows are scored alike, one row each. Extra columns, also columns
    named like results, are ignored. An empty table gives an empty table.
    """
    model = fit(docs, labels)
    return docs.select(
        "doc_id", (pu.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), pu.score(F.col("text"), model, Features(), 0.0).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
