"""Fill in the middle: plain-Python slices, exact restoring, and the tree against a running sum."""

import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F
from sessionlake.llm import fim

from .conftest import prose


def _draws(doc_id):
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def _plain_loop(doc_id, text):
    """The contract on Python strings, which count code points."""
    text, (h1, h2, h3, h4) = text or "", _draws(doc_id)
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 100])
def test_descent_equals_a_running_sum(size):
    rng = np.random.default_rng(size)
    units, points = rng.integers(0, 4, size), rng.integers(1, 9, size)
    tree = fim.BlockTree(units, points)
    for k in range(int(units.sum())):
        block, before, points_before = tree.descend(k)
        assert before == units[:block].sum() <= k < units[: block + 1].sum() and points_before == points[:block].sum()


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_cuts_fall_on_code_points(block):
    text = "aé語🦆́ b" * 30
    cutter = fim.Cutter(text, block_bytes=block)
    for k in range(-1, len(text) + 2):
        at, points = cutter.at(k)
        assert cutter.raw[:at].decode() == text[: max(0, k)] and points == min(max(0, k), len(text))


def test_units_of_a_pattern():
    text = "eins zwei  drei\nvier"
    cutter = fim.Cutter(text, re.compile(r"\S+\s*"), block_bytes=4)
    assert cutter.n_units == 4
    assert [cutter.raw[: cutter.at(k)[0]].decode() for k in range(5)] == ["", "eins ", "eins zwei  ", "eins zwei  drei\n", text]
    assert fim.Cutter("  ", re.compile(r"\S+")).n_units == 0


def test_documents_equal_the_plain_loop(spark, wide, rows):
    rng = random.Random(3)
    odd = [(900 + i, t, None, None, None) for i, t in enumerate(("<P> in it", "a<S>", "<M>", "<", "🦆", "語" * 9000, "\x00nul", prose(rng, 40_000)))]
    docs = wide.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    made = fim.transform(docs).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted([(r[0], r[1]) for r in rows + odd], key=str)
    got = sorted(made, key=lambda r: str((r["doc_id"], r["restored"] if r["restored"] else None)))
    assert len(got) == len(want)
    found = sorted([(r["doc_id"], r["restored"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) for r in made], key=str)
    assert found == sorted([(i, t or "", *_plain_loop(i, t)) for i, t in want], key=str)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_words_as_units_restore_too(docs):
    made = fim.transform(docs, unit=r"\S+\s*", percent=100, spm_percent=50, seed=9).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    both = made.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "doc_id")
    assert both.filter("restored <> text").count() == 0 and both.filter("form <> 'plain'").count() > 100


def test_no_documents(no_docs):
    assert fim.transform(no_docs).count() == 0
