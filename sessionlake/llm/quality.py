"""Quality scores by non-negative positive-unlabelled learning.

Texts labelled good are the trusted positives, other web text is unlabelled.
Features describe the shape of a text, not its topic: shares of character
classes and of single signs, repetition of words and lines, lengths. Each
measure is cut into steps, and each step is a feature of a linear classifier.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pu

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DIGITS, _UPPER, _LOWER = slice(48, 58), slice(65, 91), slice(97, 123)


def _step(share: float) -> int:
    """0 for nothing, then one step for each factor of two from 1/1024 up."""
    return 0 if share <= 0 else max(1, 11 + math.floor(math.log2(min(1.0, share)))) if share > 2**-11 else 1


def measures(text: str) -> dict[str, int]:
    """Stepped measures of one whole text."""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(1, len(raw))
    words = text.split()
    total = max(1, len(words))
    seen = Counter(words)
    lines = text.split("\n")
    out = {f"sign {c}": _step(int(counts[ord(c)]) / n) for c in _SIGNS}
    out["digits"] = _step(int(counts[_DIGITS].sum()) / n)
    out["upper"] = _step(int(counts[_UPPER].sum()) / n)
    out["lower"] = _step(int(counts[_LOWER].sum()) / n)
    out["wide"] = _step(int(counts[128:].sum()) / n)
    out["blank"] = _step(int(counts[32] + counts[9] + counts[10]) / n)
    out["lines"] = _step(len(lines) / total)
    out["line copies"] = _step(1 - len(set(lines)) / len(lines))
    out["same as before"] = _step(sum(map(operator.eq, words, words[1:])) / total)
    out["commonest word"] = _step(seen.most_common(1)[0][1] / total if seen else 0)
    out["word length"] = min(15, len(text) // total)
    out["words"] = min(16, len(words).bit_length())
    out["new words"] = round(30 * math.log(len(seen) + 1) / math.log(len(words) + 1)) if words else 0  # hardly falls with length
    return out


#: Measures that are odd at either end: their steps are counted downward too.
_BOTH_WAYS = ("lower", "blank", "word length", "words", "new words")
_STEPS = 64


class Features:
    """Every step up to the one that a measure reaches; for some measures also every step down to it."""

    def ids(self, text: str) -> np.ndarray:
        out = []
        for n, (name, value) in enumerate(measures(text).items()):
            out.append(np.arange(1, value + 1, dtype=np.int64) + 2 * n * _STEPS)
            if name in _BOTH_WAYS:
                out.append(np.arange(value, 32, dtype=np.int64) + (2 * n + 1) * _STEPS)
        return np.concatenate(out) << 4

    def names(self, texts: Iterable[str], ids: set[int]) -> dict[int, str]:
        every, out = list(measures("")), {}
        for f in ids:
            n, step = divmod(f >> 4, _STEPS)
            out[f] = f"{every[n // 2]} {'<=' if n % 2 else '>='} {step}"
        return out

    def adder(self, weights: dict[str, float]) -> Callable[[str], float]:
        every = list(measures(""))
        steps: dict[tuple[int, str], np.ndarray] = {}  # measure and direction to the weight of each step
        for name, weight in weights.items():
            measure, way, step = name.rsplit(" ", 2)
            steps.setdefault((every.index(measure), way), np.zeros(_STEPS))[int(step)] = weight
        sums = [(n, np.cumsum(w) if way == ">=" else np.cumsum(w[::-1])[::-1]) for (n, way), w in sorted(steps.items())]

        def total(text: str) -> float:
            values = list(measures(text).values())
            return sum(float(of[values[n]]) for n, of in sums)

        return total


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, held_out: int = 0) -> pu.Model | None:
    """Train on the labels of rows outside the held-out fold; None if no positive is there.

    Labels that are null, and rows whose id is null, are left out.
    """
    training = pu.remainder(F.col("doc_id"), folds) != held_out
    known = labels.filter(F.col("doc_id").isNotNull())
    positives = known.filter(training & (F.col(label) == 1)).select("doc_id").distinct()
    return pu.train(docs, positives, training, Features(), -1)


def rate(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Empty, blank and null texts get the score of a text without words.
    Repeated rows are scored alike, one row each. Extra columns, also columns
    named like results, are ignored. An empty table gives an empty table.
    """
    model = fit(docs, labels)
    return docs.select(
        "doc_id", (pu.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), pu.score(F.col("text"), model, Features(), 1.0).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
