"""Vector codes: against k-means in plain Python integers, with bounds that must never lose a nearest entry."""

import math
import random

import numpy as np
import pytest

from sessionlake.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(code, error) by row and the codebooks, all distances in Python integers."""
    width = -(-len(rows[0][1]) // parts)
    ints = [[int(math.floor(v * scale)) for v in e] + [0] * (width * parts - len(e)) for _, e, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for p in range(parts):
        cut = [v[p * width : (p + 1) * width] for v in ints]
        book = [cut[i] for i in order]
        for n in range(rounds + 1):
            found = [min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book)) for v in cut]
            if n == rounds:
                break
            for e in range(len(book)):
                own = [v for v, (_, i) in zip(cut, found) if i == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own)]
        books.append(book)
        codes = [c + f"{i:02x}" for c, (_, i) in zip(codes, found)]
        errors = [a + d for a, (d, _) in zip(errors, found)]
    return codes, errors, books


def vectors(n, seed=1, length=32, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (9, length))
    return [(i, [float(np.float32(v)) for v in centres[rng.integers(9)] + rng.normal(0, 0.3, length)], int(i % 4) if i % 5 else None) for i in range(n)]


def check(spark, rows, schema=SCHEMA, **options):
    made = codebooks.compress(spark.createDataFrame(rows, schema).repartition(3), **options)
    codes, errors, books = brute(rows, **options)
    assert made.books == books
    got = sorted([(r["vec_id"], r["label"], r["code"], r["error"]) for r in made.rows.collect()], key=str)
    assert got == sorted([(r[0], r[2], c, e if e < 2**63 else None) for r, c, e in zip(rows, codes, errors)], key=str)
    return made


def test_equals_brute_force(spark):
    made = check(spark, vectors(400))
    assert len(made.kept) == 7


def test_ties_repeats_and_nulls(spark):
    rng = random.Random(4)
    rows = [(i % 60, [float(rng.choice((-1, 0, 0.5, 1))) for _ in range(16)], 1) for i in range(200)]  # many equal distances
    rows += [rows[3]] * 50 + [(None, [0.25] * 16, None)] * 2
    check(spark, rows)


def test_few_vectors_and_odd_lengths(spark):
    check(spark, vectors(5, length=11))
    check(spark, vectors(1, length=8))
    check(spark, vectors(40, length=8), entries=4, parts=4, rounds=3)


def test_large_components_stay_exact(spark):
    rows = [(i, [v * 10.0**12 for v in e], lab) for i, e, lab in vectors(60, length=16)]
    check(spark, rows, "vec_id long, embedding array<double>, label int")
    made = codebooks.compress(spark.createDataFrame([(0, [1e300, 0.0], 1), (1, [-1e300, 3.0], 1)], "vec_id long, embedding array<double>, label int"), parts=2)
    assert [r["error"] for r in made.rows.collect()] == [0, 0] and made.books[0][0] == [int(1e300) * 4096]


def test_unusable_vectors_take_no_part(spark):
    rows = vectors(50, length=16)
    bad = [(-3, None, 1), (-2, [None] * 16, 1), (-1, [float("nan")] * 16, 1), (60, [float("inf")] + [0.0] * 15, 1), (61, [-float("inf")] * 16, 1), (62, [0.0] * 5, 1)]
    made = codebooks.compress(spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "'x' AS entry", "1 AS error", "2 AS near"))
    codes, errors, books = brute(rows)
    assert made.books == books and {r["vec_id"]: r["code"] for r in made.rows.collect()} == dict(zip(range(50), codes))
    assert codebooks.compress(spark.createDataFrame(bad[:5], SCHEMA)) is None and codebooks.compress(spark.createDataFrame([], SCHEMA)) is None


def test_label_errors_by_either_join(spark, monkeypatch):
    made = codebooks.compress(spark.createDataFrame(vectors(90, length=8), SCHEMA))
    rows = made.rows.collect()
    want = {}
    for r in rows:
        want[r["label"]] = want.get(r["label"], 0) + r["error"]
    expect = sorted([(r["vec_id"], want[r["label"]]) for r in rows])
    assert sorted((r["vec_id"], r["label_error"]) for r in codebooks.with_label_errors(made.rows).collect()) == expect
    monkeypatch.setattr(codebooks, "BROADCAST_LABELS", 1)
    assert sorted((r["vec_id"], r["label_error"]) for r in codebooks.with_label_errors(made.rows).collect()) == expect


@pytest.mark.parametrize("b,grow", [(1, 3), (4, 4), (6, 2), (15, 15)])
def test_bounds_hold_while_entries_move(b, grow):
    """After any moves every bound is below the distance it stands for, and the own entry is the nearest."""
    rng = np.random.default_rng(b)
    x = rng.integers(-3000, 3000, (500, 4))
    book = rng.integers(-3000, 3000, (16, 4))
    held, worked_out = codebooks.from_scratch(x, book, b), 0
    for n in range(8):
        after = book + rng.integers(-200 >> n, (200 >> n) + 1, book.shape)
        moves = codebooks.above(codebooks.squared(after, book))
        held = codebooks.moved_on(x, after, moves, codebooks.with_places(held, grow if n % 2 else b))
        book = after
        d2 = codebooks.squared(x[:, None, :], book[None])
        assert (held.own == d2.argmin(axis=1)).all() and (held.d2 == d2.min(axis=1)).all()
        d = np.sqrt(d2)
        for place in range(held.near.shape[1]):
            there = held.near[:, place] >= 0
            assert (held.low[there, place] <= d[there, held.near[there, place]]).all()
        named = np.zeros(d.shape, dtype=bool)
        named[np.arange(len(x)), held.own] = True
        for column in held.near.T:
            named[np.flatnonzero(column >= 0), column[column >= 0]] = True
        assert (held.outer <= np.where(named, np.inf, d).min(axis=1)).all()
        worked_out += (held.need > 0).sum()
    assert worked_out < 8 * len(x)  # bounds spare some rows any comparison


def test_number_of_bounds_follows_need():
    assert codebooks._next_keep([100, 0, 0, 0, 0, 0], 4, 16) == 2
    assert codebooks._next_keep([50, 20, 10, 15, 5, 0], 4, 16) == 3
    assert codebooks._next_keep([10, 10, 10, 10, 10, 50], 4, 16) == 8
    assert codebooks._next_keep([0] * 9 + [50], 8, 16) == 15
