import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import pu, quality, toxicity

from .conftest import prose


@pytest.fixture(scope="module")
def corpus(spark):
    """600 documents: a fifth toxic, a fifth junk; labels for most."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("zork", "blagh", "vunkost", "vunkira")))
        text = " ".join(w + "$%#"[rng.randrange(3)] * 3 for w in words) if junk else " ".join(words)
        docs.append((i, text))
        if i % 6:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(got, truth, held_out):
    rows = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out == held_out and r.doc_id in truth]
    return sum(a == b for a, b in rows) / len(rows)


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    got = toxicity.flag(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got) and len(got) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert accuracy(got, {i: t for i, _, t in truth}, True) > 0.95


def test_quality_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    got = quality.rate(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert accuracy(got, {i: q for i, q, _ in truth}, True) > 0.95


def test_held_out_labels_change_nothing(corpus):
    docs, labels, _ = corpus
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert one.weights == two.weights and one.bias == two.bias


def plain_risk(z, is_p, prior):
    """Risk and its negative part in plain loops."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p = [sigmoid(x) for x, y in zip(z, is_p) if y]
    u = [sigmoid(x) for x, y in zip(z, is_p) if not y]
    negative = sum(u) / len(u) - prior * sum(p) / len(p)
    return prior * sum(1 - x for x in p) / len(p) + max(0.0, negative), negative


@pytest.mark.parametrize("prior", [0.05, 0.3, 0.9])
def test_risk_and_slopes_match_plain_loops(prior):
    rng = random.Random(prior)
    z = np.array([rng.gauss(0, 2) for _ in range(60)])
    is_p = np.array([rng.random() < 0.4 for _ in z])
    risk, negative, slope = pu.risk_and_slopes(z, is_p, prior)
    want, want_negative = plain_risk(z, is_p, prior)
    assert math.isclose(risk, want) and math.isclose(negative, want_negative)
    for i in range(len(z)):  # by finite differences; below zero the step goes against the negative part
        up, down = z.copy(), z.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        column = 0 if want_negative >= 0 else 1
        change = (plain_risk(up, is_p, prior)[column] - plain_risk(down, is_p, prior)[column]) / 2e-5
        assert math.isclose(slope[i], change if want_negative >= 0 else -change, abs_tol=1e-8)


def test_fit_lowers_the_risk():
    flat, owner = np.zeros(75, dtype=np.int64), np.arange(75)
    is_p = np.array([True] * 50 + [False] * 100)
    weights, bias = pu.fit_nnpu(flat, owner, 1, is_p, 0.25, 1)
    z = np.where(np.arange(150) < 75, weights[0], 0.0) + bias
    assert weights[0] + bias > 0 > bias and plain_risk(z, is_p, 0.25)[0] < plain_risk(np.full(150, -2.0), is_p, 0.25)[0] / 4


def test_prior_comes_from_positives_and_unlabelled_text_alone():
    rng = np.random.default_rng(5)
    for share in (0.1, 0.5, 0.85):
        p = rng.normal(2, 1, 2000)
        u = np.where(rng.random(6000) < share, rng.normal(2, 1, 6000), rng.normal(-2, 1, 6000))
        assert abs(pu.estimate_prior(p, u) - share) < 0.06


@pytest.mark.parametrize("kind,sign", [(toxicity.Features, 1), (quality.Features, -1)])
def test_scores_add_up_the_features_of_the_whole_text(rows, kind, sign):
    features = kind()
    texts = [r[1] or "" for r in rows] + ["a$ b$ c$ c$", "WORD " * 50]
    every = sorted({i for t in texts for i in features.ids(t).tolist()})
    by_id = {name: sign * (n % 7) / 8 for n, name in enumerate(every)}
    called = features.names(texts, set(every))
    weights = {called[i]: w for i, w in by_id.items()}
    assert len(weights) == len(every)
    total = features.adder(weights)
    for text in texts:
        ids = features.ids(text).tolist()
        assert len(ids) == len(set(ids)) and math.isclose(total(text), sum(by_id[i] for i in ids), abs_tol=1e-9)
    tail = kind()
    long = "plain words " * 40_000
    assert set(tail.ids(long + "zork").tolist()) - set(tail.ids(long).tolist())  # the last word of a long text counts


def test_chosen_features_match_plain_counts():
    rng = random.Random(8)
    sets = [{f for f in range(40) if rng.random() < (0.5 if i < 30 and f < 4 else 0.1)} for i in range(130)]
    flat = np.array([16 * f for s in sets for f in sorted(s)])
    owner = np.array([i for i, s in enumerate(sets) for _ in s])
    names = pu.choose_features(flat, owner, np.arange(130) < 30, 0.1, 1)
    assert {0, 16, 32, 48} <= set(names[:6].tolist()) and len(names) <= pu.LEAST_FEATURES
    for f in names.tolist():  # each is more common among positives than in unlabelled text
        has = [16 * g == f for g in range(40)].index(True)
        assert sum(has in s for s in sets[:30]) / 30 > sum(has in s for s in sets[30:]) / 100


def test_bag_sample_is_bounded_in_rows_and_bytes(spark):
    """One id on most rows, rows repeated, one id null, and long texts."""
    rows = [(1, f"text {i} of one id") for i in range(3000)] + [(2, "the same row")] * 2000 + [(None, f"null {i}") for i in range(300)]
    rows += [(i, "long " * 4000) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    positives = spark.createDataFrame([(1,), (2,), (5,)], "doc_id long")
    sample, bags = pu._bag_sample(docs, positives, F.lit(True), 100, 300, 50_000, 4)
    got = sample.collect()
    for bag in range(bags):
        for positive, most in ((1, 100), (0, 300)):
            texts = [r.text for r in got if r.bag == bag and r.positive == positive]
            assert 0 < len(texts) <= most and sum(map(len, texts)) <= 50_000
    assert sum(r.text == "the same row" and r.positive == 1 for r in got) <= 1
    assert sorted(map(str, got)) == sorted(map(str, pu._bag_sample(docs.repartition(5), positives, F.lit(True), 100, 300, 50_000, 4)[0].collect()))


def test_a_repeated_unlabelled_row_leaves_the_sample_as_it_is(spark):
    """The chance of the sample counts distinct rows, so one row without end takes no other's place."""
    rows = [(i, f"text number {i}") for i in range(2000)]
    positives = spark.createDataFrame([(i,) for i in range(0, 2000, 50)], "doc_id long")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = docs.unionByName(spark.range(200_000).selectExpr("cast(7 as long) AS doc_id", "'text number 7' AS text"))
    pick = lambda d: sorted((r.bag, r.positive, r.text) for r in pu._bag_sample(d, positives, F.col("doc_id") % 4 != 2, 20, 300, 1 << 20, 2)[0].collect())
    assert pick(hot) == pick(docs) and 400 < sum(p == 0 for _, p, _ in pick(docs)) <= 600


@pytest.mark.parametrize("sf,recall,clean", [("sf0.001", 0.5, 0.9), ("sf0.01", 0.6, 0.99)])
def test_small_tables_are_learned(spark, sf, recall, clean):
    """Ten labelled positives are enough for a score that tells texts apart."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.collect()}
    toxic = toxicity.flag(docs, labels).collect()
    good = quality.rate(docs, labels).collect()
    assert len({r.score for r in toxic}) > 1 and len({r.score for r in good}) > 1
    held = [(r.predicted, truth[r.doc_id].toxic) for r in toxic if r.held_out and r.doc_id in truth]
    assert np.mean([p for p, t in held if t]) >= recall and np.mean([not p for p, t in held if not t]) >= clean
    held = [(r.predicted, truth[r.doc_id].quality) for r in good if r.held_out and r.doc_id in truth]
    assert np.mean([p for p, q in held if q]) >= 0.98 and np.mean([not p for p, q in held if not q]) >= 0.6


@pytest.mark.parametrize("operator", [toxicity.flag, quality.rate])
def test_nulls_empty_tables_and_extra_columns(spark, docs, wide, no_docs, corpus, operator):
    labels = corpus[1]
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 1, 1)], labels.schema)).withColumn("text", F.lit("clash"))
    assert operator(docs, odd).count() == docs.count() == operator(wide, odd).count()
    scores = {r.doc_id: r.score for r in operator(docs, odd).collect()}
    assert scores[400] == scores[401]  # null counts as empty
    assert operator(no_docs, labels).collect() == []
    none = operator(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == ({0.0} if operator is toxicity.flag else {1.0})
