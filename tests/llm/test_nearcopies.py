import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from sessionlake.llm import nearcopies, simhash

from .conftest import DOCS, prose


def plain_set(text):
    words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_groups(texts):
    sets = [plain_set(t) for t in texts]
    groups = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if groups[a] != groups[b] and (not union or len(sets[a] & sets[b]) >= 0.8 * union):
                old, new = max(groups[a], groups[b]), min(groups[a], groups[b])
                groups = [new if g == old else g for g in groups]
    return groups


def edited(rng, text, places):
    words = text.split()
    for at in rng.sample(range(len(words)), places):
        words[at] = prose(rng, 1) + "x"
    return " ".join(words)


def test_stage_keeps_one_of_each_group_at_any_similarity(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    for base in texts[:40]:  # copies on both sides of 0.8, chains among them
        for _ in range(rng.randint(1, 4)):
            base = edited(rng, base, rng.randint(1, 4))
            texts.append(base)
    texts += [prose(rng, 90) + " end" for _ in range(2)] + ["one two", "One  two", "one", "", None]
    crowd = prose(rng, 120)
    texts += [edited(rng, crowd, 3) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    groups = plain_groups(texts)
    got = sorted(r.doc_id for r in nearcopies.keep_one(docs).collect())
    assert got == sorted(set(groups))
    assert len(got) < len(set(simhash.fingerprint(t) for t in texts)) - 40
    assert got != sorted(r.doc_id for r in simhash.keep_one(docs).collect())


def test_wide_fingerprints_meet_as_often_as_stated():
    """Of pairs at every similarity from 0.8 up at least as many meet at an anchor as ``meeting_chance`` says for it."""
    rng = random.Random(2)
    for places in (1, 3, 5):
        met, chance = [], []
        for _ in range(60):
            a = prose(rng, 120)
            b = edited(rng, a, places)
            prints = [nearcopies.wide_print(t)[None, :] for t in (a, b)]
            x, y = ([set(keys.tolist()) for _, keys, _, _ in simhash._places(p)] for p in prints)
            homes = [[{k for k, h in zip(keys.tolist(), home.tolist()) if h} for _, keys, home, _ in simhash._places(p)] for p in prints]
            met.append(any(homes[0][n] & y[n] or homes[1][n] & x[n] for n in range(2 * nearcopies.PRINT_WORDS)))
            sets = [set(nearcopies.shingle_set(t, nearcopies.PRINT_SHINGLE).tolist()) for t in (a, b)]
            chance.append(nearcopies.meeting_chance(len(sets[0] & sets[1]) / len(sets[0] | sets[1])))
        assert sum(met) >= sum(chance) - 6
    assert nearcopies.meeting_chance(1.0) == 1.0 and 0.88 < nearcopies.meeting_chance(0.8) < 0.9 and nearcopies.meeting_chance(0.9) > 0.98


@pytest.mark.parametrize("sf,least", [("sf0.001", 1.0), ("sf0.01", 0.99)])
def test_given_tables_against_all_pairs(spark, sf, least):
    """Groups by exact similarity of every pair that shares a shingle."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = docs.collect()
    sets, holders, shared = [plain_set(r.text) for r in rows], defaultdict(list), Counter()
    for i, own in enumerate(sets):
        for shingle in own:
            shared.update((j, i) for j in holders[shingle])
            holders[shingle].append(i)
    groups = list(range(len(rows)))
    empty = [i for i, own in enumerate(sets) if not own]
    pairs = [(a, b) for (a, b), n in shared.items() if 9 * n >= 4 * (len(sets[a]) + len(sets[b]))] + [(empty[0], i) for i in empty[1:]]
    for a, b in pairs:
        if groups[a] != groups[b]:
            old, new = max(groups[a], groups[b]), min(groups[a], groups[b])
            groups = [new if g == old else g for g in groups]
    want = {min(rows[i].doc_id for i in range(len(rows)) if groups[i] == g) for g in set(groups)}
    got = {r.doc_id for r in nearcopies.keep_one(docs).select("doc_id").collect()}
    assert want <= got and len(got - want) <= (1 - least) * (len(rows) - len(want)) and len(want) < len(rows)


def test_stage_finds_what_the_fingerprints_miss(spark):
    import corpus_pipeline

    rng = random.Random(11)
    rows = []
    for i in range(30):
        text = prose(rng, 100)
        rows += [(2 * i, text, "en", "s", None), (2 * i + 1, edited(rng, text, 2), "en", "s", None)]
    groups = plain_groups([r[1] for r in rows])
    assert len(set(groups)) < 45
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(groups))


def test_empty_and_clashing(docs, no_docs, wide):
    assert nearcopies.keep_one(no_docs).collect() == []
    assert nearcopies.keep_one(wide).columns == wide.columns
    assert nearcopies.keep_one(wide).count() == nearcopies.keep_one(docs).count()


def _edited(rng, kind, n):
    """Two texts of which one is the other with a block added, a block cut off or words changed here and there; similarity from 0.80 to 0.85."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    a = [word() for _ in range(n)]
    while True:
        if kind == "append":
            b = a + [word() for _ in range(int(n * rng.uniform(0.15, 0.27)))]
        elif kind == "cut":
            b = a[int(n * rng.uniform(0.13, 0.22)) :]
        else:
            b = [word() if rng.random() < rng.uniform(0.015, 0.025) else w for w in a]
        x, y = (set(nearcopies.shingle_set(" ".join(t)).tolist()) for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            return " ".join(a), " ".join(b)


@pytest.mark.parametrize("kind", ["append", "cut", "spread"])
def test_most_near_copies_of_every_kind_of_edit_are_found(spark, kind):
    """Pairs at 0.80 to 0.85, the hardest: at least nine of ten are joined, whole operator."""
    rng = random.Random(len(kind))
    pairs = [_edited(rng, kind, rng.randint(80, 400)) for _ in range(250)]
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = {r.doc_id for r in nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(250)) and sum(2 * i + 1 not in kept for i in range(250)) >= 225


def test_cells_join_what_is_alike_and_nothing_else():
    """Bitmap bound and union against all pairs, over sets of many sizes and cells of one or two blocks."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 300)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(255, 299)), replace=False), rng.integers(0, 1 << 62, int(rng.integers(0, 30)))])) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 99, 4)) for _ in range(10)] + [sets[0][:-1], sets[1][3:]]
    rows = pd.DataFrame({"root": 0, "i": 0, "j": 0, "node": np.arange(len(sets)), "top": np.arange(len(sets)), "block": np.arange(len(sets)) % 2, "shingles": sets})
    alike = lambda x, y: 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))

    def components(edges):
        label = list(range(len(sets)))
        for a, b in edges:
            label = [label[a] if v == label[b] else v for v in label]
        return [label.index(v) for v in label]

    every = [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])]
    found = nearcopies._decide_cell(rows)
    assert components(zip(found["a"], found["b"])) == components(every) and len(found) < len(sets) <= len(every)
    across = nearcopies._decide_cell(rows.assign(j=1))
    assert components(zip(across["a"], across["b"])) == components([(a, b) for a, b in every if a % 2 != b % 2])


def test_a_large_group_carries_few_rows_and_pairs(spark, monkeypatch):
    """Most anchors of a crowd of near copies have only that crowd: they go before the joins, and a text is decided against few others."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = list(dict.fromkeys(edited(rng, base, rng.randint(1, 4)) for _ in range(250)))
    texts += [prose(rng, 100) for _ in range(50)]
    written, write = defaultdict(int), nearcopies.materialize

    def counted(df, label, *partition_by):
        out = write(df, label, *partition_by)
        written[label] += out.count()
        return out

    monkeypatch.setattr(nearcopies, "materialize", counted)
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == sorted(set(plain_groups(texts)))
    assert written["near-met"] <= 40 * len(texts) and written["near-dealt"] <= 12 * len(texts)
