"""Divergence rules: counts against plain loops, distances against the formula, verdicts on planted junk."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sessionlake.llm import divergence

from .conftest import DOCS

COMMON = ("the", "of", "and", "to", "in", "is", "it", "was", "for", "on")


def english(rng, n):
    """Words of which common ones are a third, a sentence mark here and there."""
    words = [rng.choice(COMMON) if rng.random() < 0.35 else "".join(rng.choice(("ter", "ing", "an", "lo", "pre", "sti", "gra", "mon", "vel", "dor", "ka", "ple", "ush", "ow", "ness")) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 12 == 0 else w + "." * (i % 12 == 11) for i, w in enumerate(words))


def _plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \t\n", "a", "a b c", "a b c a b c", "x x x x x", "é語 🦆|<b> \n\n \nz\nz\nz ", "a b c d a b c\nq\na b c d a b c\nq", "\x1c\x85 w \x1f"])
def test_counts_equal_plain_loops(text):
    r = divergence.read(text)
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _plain_counts(text)
    assert r.classes.sum() == len(text or "")


def test_distance_is_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.25, 0.25, 0.5])
    want = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        want += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    assert divergence.distance(p, q) == pytest.approx(math.sqrt(want))
    assert divergence.distance(p, p) == 0 and divergence.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    good = [(i, english(rng, rng.randint(60, 400)), "en" if i % 7 else None, "s", None) for i in range(300)]
    junk = []
    for i in range(30):
        words = english(rng, 200).split()
        junk.append((1000 + i, ("!! ".join(words).upper(), " ".join(w + rng.choice(("***", "$$$", "%%%")) for w in words), " | ".join(w for w in words if w not in COMMON))[i % 3], "en", "s", None))
    failing = [(2000, "too short", "en", "s", None), (2001, "again and again " * 40, "en", "s", None), (2002, None, None, None, None), (2003, "", "xx", "s", 0), (None, good[0][1], "en", "s", None)]
    return good, junk, failing, [good[1]] * 3


def test_junk_goes_and_clean_stays(spark, corpus):
    good, junk, failing, repeats = corpus
    docs = spark.createDataFrame(good + junk + failing + repeats, DOCS).selectExpr("*", "'x' AS n_words", "1 AS kept")
    out = divergence.judge(docs).collect()
    assert len(out) == len(good) + len(junk) + len(failing) + len(repeats)
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[g[0]]["kept"] for g in good) and by_id[None]["kept"]
    assert not any(by_id[j[0]]["kept"] or by_id[j[0]]["base_failed"] for j in junk)
    assert all(by_id[i]["base_failed"] and not by_id[i]["kept"] for i in (2000, 2001, 2002, 2003))
    assert len({tuple(r)[1:] for r in out if r["doc_id"] == good[1][0]}) == 1


def test_references_are_sums_over_all_documents(spark, corpus):
    good, junk, _, _ = corpus
    found = divergence.references(spark.createDataFrame(good + junk, DOCS).repartition(5))
    assert set(found) == {"en", None}
    total, names, n = np.zeros(7), Counter(), 0
    for _, text, lang, _, _ in good + junk:
        r = divergence.read(text)
        if lang == "en" and not r.base_failed:
            n += 1
            total += [divergence.PARTS * int(c) // int(r.classes.sum()) for c in r.classes]
            names.update({w: divergence.PARTS * k // r.n_words for w, k in r.words.items()})
    top = sorted(names.items(), key=lambda kv: (-kv[1], kv[0]))[: divergence.COMMON]
    assert np.allclose(found["en"].classes, total / total.sum())
    assert found["en"].words == {w: k / (divergence.PARTS * n) for w, k in top}


def test_few_documents_have_base_rules_alone(spark, no_docs):
    rng = random.Random(2)
    few = [(i, english(rng, 80), None, None, None) for i in range(5)] + [(9, "X!! " + "Y!! Z!! " * 3, None, None, None), (10, " ".join(f"A{i}!!" for i in range(90)), "q", None, None)]
    out = {r["doc_id"]: r for r in divergence.judge(spark.createDataFrame(few, DOCS)).collect()}
    assert out[10]["kept"] and not out[9]["kept"] and out[10]["class_distance"] is None
    assert divergence.judge(no_docs).count() == 0


def test_languages_without_tags_share_the_pooled_reference(spark, corpus):
    good, junk, _, _ = corpus
    out = {r["doc_id"]: r for r in divergence.judge(spark.createDataFrame([(i, t, None, s, c) for i, t, _, s, c in good + junk], DOCS)).collect()}
    assert all(out[g[0]]["kept"] for g in good) and not any(out[j[0]]["kept"] for j in junk)


def test_a_language_without_a_reference_is_not_held_against_others(spark, corpus):
    """A few clean texts in other letters stay, tagged; the junk of the known language goes."""
    good, junk, _, _ = corpus
    rng = random.Random(6)
    other = [(5000 + i, " ".join("".join(rng.choice("абвгдеклмн") for _ in range(rng.randint(2, 7))) for _ in range(150)), "bg", "s", None) for i in range(12)]
    out = {r["doc_id"]: r for r in divergence.judge(spark.createDataFrame(good + junk + other, DOCS)).collect()}
    assert all(out[o[0]]["kept"] and out[o[0]]["class_distance"] is None for o in other) and all(out[g[0]]["kept"] for g in good) and not any(out[j[0]]["kept"] for j in junk)
