"""Non-negative positive-unlabelled learning of text classifiers.

Only positives are trusted; everything else is unlabelled text. With the class
prior pi the negative risk is what the unlabelled risk holds beyond the
positives' share, and it is kept from going below zero:

    risk = pi * E_P[l(+)] + max(0, E_U[l(-)] - pi * E_P[l(-)])

(Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator",
2017). The prior is estimated from the same two samples, without negative
labels: the positives' share of the unlabelled text is at most U(A) / P(A) for
every set A of texts, and sets of the best scores come closest to it (Garg et
al., "Mixture Proportion Estimation and PU Learning", 2021).

Several linear classifiers are trained in parallel tasks, each on its own bag
of a bounded sample, and averaged. Only training is bounded: every whole text
is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from . import batches

#: Bounds of one bag (trusted positives, unlabelled texts, bytes of each kind) and the number of bags.
BAG_POSITIVES, BAG_UNLABELLED, BAG_BYTES, BAGS = 500, 1500, 12 << 20, 16
#: Features that a classifier keeps at most, and at least where there are so many; share of chance findings allowed among them.
KEPT_FEATURES, LEAST_FEATURES, CHANCE_SHARE = 2048, 12, 0.1
STEPS, RATE, L2 = 300, 0.05, 1e-4
#: Share of the rarer class that is taken for granted, and the number of positives that its estimate must have to weigh as much.
GUESS, GUESS_WEIGHS = 0.1, 50


@dataclass
class Model:
    """Averaged linear classifier: ``score = sigmoid(bias + sum of weights of the features present)``."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)


class Features(Protocol):
    """Features as 64-bit numbers. Of features in the same texts that with the smallest ``number % 16`` is kept."""

    def ids(self, text: str) -> np.ndarray:
        """Distinct features of a whole text."""

    def names(self, texts: Iterable[str], ids: set[int]) -> dict[int, str]:
        """Names of given features that stand in ``texts``."""

    def adder(self, weights: dict[str, float]) -> Callable[[str], float]:
        """Sum of the weights of a whole text's features, by name."""


def risk_and_slopes(z: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Estimated risk, its negative part before the cut at zero, and the slope that a step goes down, by row.

    ``z``: score of each row before the sigmoid; ``is_p``: trusted positives,
    the others are unlabelled. The loss is the sigmoid loss, which is bounded
    and keeps the noise of the estimate small. While the negative part is
    below zero, the step goes against it, which undoes overfitting to the
    unlabelled texts.
    """
    n_p, n_u = max(1, int(is_p.sum())), max(1, int((~is_p).sum()))
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    positive = prior * (1 - p[is_p]).sum() / n_p
    negative = p[~is_p].sum() / n_u - prior * p[is_p].sum() / n_p
    each = p * (1 - p)
    slope = np.where(is_p, -prior * each / n_p, each / n_u)  # of the negative part
    slope = slope + np.where(is_p, -prior * each / n_p, 0.0) if negative >= 0 else -slope
    return positive + max(0.0, negative), negative, slope


def fit_nnpu(flat: np.ndarray, owner: np.ndarray, n_features: int, is_p: np.ndarray, prior: float, sign: int) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk by full-batch Adam on sparse 0/1 features.

    Text ``owner[i]`` has feature ``flat[i]``. Weights keep the given
    ``sign``: features are evidence for the rarer class, and a text without
    any is of the other.
    """
    weights, bias = np.zeros(n_features), -2.0 * sign
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, weights=weights[flat], minlength=len(is_p)) + bias
        _, _, slope = risk_and_slopes(z, is_p, prior)
        grad = np.append(np.bincount(flat, weights=slope[owner], minlength=n_features) + L2 * weights, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        delta = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - delta[:-1], bias - delta[-1]
        weights = np.maximum(weights, 0.0) if sign > 0 else np.minimum(weights, 0.0)
    return weights, float(bias)


def surprise(near: np.ndarray, far: np.ndarray, n_near: float, n_far: float) -> np.ndarray:
    """-log of a bound on the chance that a feature of near + far texts has so many of them near by luck (Chernoff's); 0 where it is not more common there."""
    total = near + far
    share = n_near / (n_near + n_far)
    found = np.divide(near, total, out=np.zeros(len(total)), where=total > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = total * (np.where(found > 0, found * np.log(found / share), 0.0) + np.where(found < 1, (1 - found) * np.log((1 - found) / (1 - share)), 0.0))
    return np.where(found > share, bound, 0.0)


def choose_features(flat: np.ndarray, owner: np.ndarray, is_p: np.ndarray, prior: float, sign: int) -> np.ndarray:
    """Features more common in the rarer class, that of ``sign``, the surest first.

    The negatives' counts are the unlabelled ones less the positives among
    them (prior times the positives' rate, a standard error to the safe side).
    Of features that stand in the same texts one is kept. The others are
    ranked by how unlikely chance makes them, and kept while the expected
    share of chance findings stays below CHANCE_SHARE (Benjamini and
    Hochberg), the first LEAST_FEATURES in any case. No count of texts is
    asked for, so that a small table has its features too.
    """
    if not len(flat):
        return flat
    n_p, n_u = int(is_p.sum()), int((~is_p).sum())
    names, place = np.unique(flat, return_inverse=True)
    of_p = np.bincount(place, weights=is_p[owner])
    of_u = np.bincount(place) - of_p
    some = np.flatnonzero((of_p if sign > 0 else of_u) > 1)
    p, u = of_p[some], of_u[some]
    if sign > 0:
        strength = surprise(p, np.maximum(0.0, u - prior * n_u * (p - np.sqrt(p)) / n_p), n_p, (1 - prior) * n_u)
    else:
        strength = surprise(np.maximum(0.0, u - prior * n_u * (p + np.sqrt(p + 1)) / n_p), p, (1 - prior) * n_u, n_p)
    texts = np.bincount(place, weights=np.random.default_rng(1).random(len(is_p))[owner])[some]  # equal for equal sets of texts
    some, strength, texts = (x[strength > 0] for x in (names[some], strength, texts))
    shortest = np.lexsort((some, some % 16))
    some, strength, texts = some[shortest], strength[shortest], texts[shortest]
    _, first = np.unique(np.round(texts, 9), return_index=True)
    some, strength = some[first], strength[first]
    best = np.lexsort((some, -strength))
    some, strength = some[best], strength[best]
    sure = np.flatnonzero(np.exp(-strength) * len(some) <= CHANCE_SHARE * np.arange(1, len(some) + 1))
    return some[: min(KEPT_FEATURES, max(LEAST_FEATURES, int(sure[-1]) + 1 if len(sure) else 0))]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled text from held-out scores of both: the least U(score >= c) / P(score >= c), with a margin for the noise of either."""
    cuts = np.unique(positive)
    of_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    of_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    noise = np.sqrt(np.log(40) / 2 / len(positive)) + np.sqrt(np.log(40) / 2 / len(unlabelled))
    best = np.argmin((of_u + noise) / of_p)
    return float(of_u[best] / of_p[best])


def _among(ids: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether each id is one of the sorted ``names``."""
    return names[np.minimum(np.searchsorted(names, ids), len(names) - 1)] == ids if len(names) else np.zeros(len(ids), dtype=bool)


def _select(flat: np.ndarray, owner: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``names`` of the features that are among them, and their texts."""
    order = np.argsort(names)
    at = np.minimum(np.searchsorted(names[order], flat), max(0, len(names) - 1))
    hit = names[order][at] == flat if len(names) else np.zeros(len(flat), dtype=bool)
    return order[at[hit]] if len(names) else at[hit], owner[hit]


def fit_bag(texts: list[str], is_p: np.ndarray, features: Features, sign: int) -> tuple[Model, float]:
    """Classifier of one bag, and the prior it is fitted for.

    The prior comes from two halves that score each other, drawn towards GUESS
    where positives are few. The rarer class is the one that ``sign`` names,
    so the prior is at most 1/2 for sign 1 and at least 1/2 for sign -1.
    """
    # a feature of the rarer class stands in two of its texts at least, which leaves out most of them at once
    seen = np.sort(np.concatenate([features.ids(t) for t, y in zip(texts, is_p) if y == (sign > 0)] or [np.zeros(0, dtype=np.int64)]))
    often = np.unique(seen[1:][seen[1:] == seen[:-1]])
    del seen
    each = [ids[_among(ids, often)] for ids in map(features.ids, texts)]
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    flat = np.concatenate(each) if each else np.zeros(0, dtype=np.int64)
    guess, n_p = GUESS if sign > 0 else 1 - GUESS, int(is_p.sum())
    half = np.where(is_p, np.cumsum(is_p), np.cumsum(~is_p)) % 2  # both kinds in both halves

    def train(rows: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
        number = np.cumsum(rows) - 1
        inside = rows[owner]
        names = choose_features(flat[inside], number[owner[inside]], is_p[rows], prior, sign)
        at, of = _select(flat[inside], number[owner[inside]], names)
        return names, *fit_nnpu(at, of, len(names), is_p[rows], prior, sign)

    priors = []
    for side in (0, 1):
        rows, others = half == side, half != side
        if is_p[rows].any() and is_p[others].any() and (~is_p[rows]).any() and (~is_p[others]).any():
            names, weights, bias = train(rows, guess)
            at, of = _select(flat, owner, names)
            z = np.bincount(of, weights=weights[at], minlength=len(is_p))
            priors.append(estimate_prior(z[others & is_p], z[others & ~is_p]))
    found = min(0.5, max(0.01, np.mean(priors or [guess]))) if sign > 0 else min(0.99, max(0.5, np.mean(priors or [guess])))
    prior = float(n_p * found + GUESS_WEIGHS * guess) / (n_p + GUESS_WEIGHS)
    names, weights, bias = train(np.ones(len(is_p), dtype=bool), prior)
    called = features.names((t for t, y in zip(texts, is_p) if y == (sign > 0)), set(names.tolist()))
    return Model(bias, {called[n]: w for n, w in zip(names.tolist(), weights.tolist()) if w}), prior


def _bag_sample(docs: DataFrame, positives: DataFrame, trainable: Column, bag_positives: int, bag_unlabelled: int, bag_bytes: int, bags: int) -> tuple[DataFrame, int] | None:
    """(bag, text, positive) of the sample, and the number of bags; see ``train``."""
    row = F.xxhash64("doc_id", "text")
    keys = docs.select("doc_id", row.alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    keys = materialize(keys.distinct(), "pu-keys")  # a row that repeats counts once, here and in the chances below
    trusted = materialize(keys.join(positives.select("doc_id").distinct(), "doc_id", "left_semi").select("k", "n_bytes").distinct(), "pu-positives")
    unlabelled = keys.filter(trainable)
    n_positive, n_unlabelled = trusted.count(), unlabelled.count()
    if not n_positive:
        return None
    bags = min(bags, -(-n_positive // bag_positives))

    def chance(purpose: str) -> Column:
        return F.pmod(F.xxhash64(F.col("k"), F.lit(purpose)), F.lit(1 << 40)) / (1 << 40)

    sides = [
        trusted.filter(chance("positive") < bags * bag_positives / n_positive).select("k", "n_bytes", F.lit(1).alias("positive")),
        unlabelled.filter(chance("unlabelled") < bags * bag_unlabelled / max(1, n_unlabelled)).select("k", "n_bytes", F.lit(0).alias("positive")),
    ]
    chosen = sides[0].unionByName(sides[1]).withColumn("bag", F.pmod(F.xxhash64("k", F.lit("bag")), F.lit(bags)).cast("int"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]  # keys alone, in numbers that the chances above bound but for luck
        for (_, positive), rows in pd.concat(held).groupby(["bag", "positive"]) if held else ():
            rows = rows.sort_values("k")
            fits = (np.arange(len(rows)) < (bag_positives if positive else bag_unlabelled)) & (rows["n_bytes"].cumsum() <= bag_bytes)
            yield rows[fits | (np.arange(len(rows)) == 0)]

    chosen = materialize(chosen.repartitionById(bags, "bag").mapInPandas(bound, chosen.schema), "pu-chosen")
    texts = docs.select(row.alias("k"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("k", "positive", "bag")), "k")  # at most bags * (bag_positives + bag_unlabelled) keys
    return texts.dropDuplicates(["k", "positive"]).select("bag", "text", "positive"), bags


def train(docs: DataFrame, positives: DataFrame, trainable: Column, features: Features, sign: int, *, bag_positives: int = BAG_POSITIVES, bag_unlabelled: int = BAG_UNLABELLED, bag_bytes: int = BAG_BYTES, bags: int = BAGS) -> Model | None:
    """Train one classifier per bag in its own task and average them.

    ``positives`` holds the doc_ids of trusted positives; ``trainable`` (of
    ``doc_id``) says which documents may serve as unlabelled text. The sample
    is taken from distinct (doc_id, text) by a hash of both, so it is the same
    on every run, and repeated rows count once. A bag has at most
    ``bag_positives`` positives and ``bag_unlabelled`` unlabelled texts, and
    of either no more than ``bag_bytes`` bytes (one text in any case): the
    classifier is fitted on this bounded sample of rows, whatever the size of
    the corpus. None if no positive is among the documents.
    """
    found = _bag_sample(batches.of_texts(docs), positives, trainable, bag_positives, bag_unlabelled, bag_bytes, bags)
    if found is None:
        return None
    sample, bags = found

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_bag: dict[int, list[tuple[int, str]]] = {}
        for part in parts:
            for bag, text, positive in part.itertuples(index=False, name=None):
                of_bag.setdefault(bag, []).append((positive, text))
        for bag, rows in of_bag.items():
            rows.sort()  # the same sums in the same order on every run
            is_p = np.array([positive == 1 for positive, _ in rows])
            if is_p.any():
                model, _ = fit_bag([text for _, text in rows], is_p, features, sign)
                yield pd.DataFrame({"bag": bag, "name": ["", *model.weights], "weight": [model.bias, *model.weights.values()]})

    # each bag is a partition of its own
    parts = sample.repartitionById(bags, "bag").mapInPandas(fit, "bag int, name string, weight double").collect()  # at most bags * (KEPT_FEATURES + 1) rows
    used = len({r["bag"] for r in parts})
    if not used:
        return None
    total: dict[str, float] = {}
    for r in sorted(parts, key=lambda r: (r["name"], r["bag"])):
        total[r["name"]] = total.get(r["name"], 0.0) + r["weight"] / used
    return Model(total.pop(""), total)


def score(text: Column, model: Model | None, features: Features, otherwise: float) -> Column:
    """Probability of the positive class, 0 to 1; a null text counts as empty; ``otherwise`` without a model."""
    if model is None:
        return F.lit(otherwise)
    bias, weights = model.bias, model.weights

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        total = features.adder(weights)
        for texts in batches:
            z = np.array([bias + total(text or "") for text in texts], dtype=np.float64)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))

    return scores(text)


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
