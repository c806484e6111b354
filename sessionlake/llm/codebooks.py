"""Vector code compression: one small codebook for each part of the vectors.

The codebooks come from k-means (product quantization: Jegou, Douze and
Schmid, 2011) in exact integers. Drake and Hamerly's adaptive distance bounds
("Accelerated k-means with Adaptive Distance Bounds", 2012) skip most
distances: every part keeps, from round to round, its b closest entries
besides its own with ordered lower bounds of their distances, and one outer
bound for all the others. When entries move, the bounds give way by as much;
only where the distance to the own entry reaches a bound, the entries up to
that bound are compared, in integers. b adapts to how many bounds the rounds
need.

The vectors and their bounds are one table, written anew in each round without
a shuffle. What goes to the driver is the sums of the entries, one row for
each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, owned

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bounds kept at first, and the share of rows that may need more than are kept.
FIRST_BOUNDS, MAY_MISS = ENTRIES // 4, 1 / 16
#: Label sums up to which they are broadcast; beyond, they are joined by a salted shuffle.
BROADCAST_LABELS, SALTS = 50_000, 16

_LONG_MAX = 2**63 - 1
#: Float bounds give way by this share, more than rounding can amount to.
_SLACK = 1e-9


def usable(embedding: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~bad


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in exact integers: of 64 bits where squared distances fit into them, else Python's own."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2**30 / scale / max(1, x.shape[-1]):
        return np.floor(x * scale).astype(np.int64)
    # a float from 2**53 on is a whole number
    whole_numbers = [int(np.floor(v * scale)) if abs(v) < 2**53 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(whole_numbers, dtype=object).reshape(x.shape)


def entries_of(book: Sequence[Sequence[int]]) -> np.ndarray:
    """A codebook as a matrix, by the rule of ``whole``."""
    fits = all(abs(v) < 2**30 // max(1, len(entry)) for entry in book for v in entry)
    return np.array(book, dtype=np.int64 if fits else object).reshape(len(book), -1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = x - y
    return (d * d).sum(axis=-1)


def above(d2: np.ndarray) -> np.ndarray:
    """Floats not below the roots of exact squares."""
    return np.sqrt(_floats(d2, np.inf)) * (1 + _SLACK)


def below(d2: np.ndarray) -> np.ndarray:
    """Floats not above the roots of exact squares."""
    return np.sqrt(_floats(d2, 1e300)) * (1 - _SLACK)


def _floats(d2: np.ndarray, beyond: float) -> np.ndarray:
    if d2.dtype != object:
        return d2.astype(np.float64)
    return np.array([float(v) if v < 10**300 else beyond for v in d2.ravel().tolist()]).reshape(d2.shape)


@dataclass
class Bounds:
    """Of every row: its own entry, the closest others with lower bounds in order, and the bound of all the rest. -1 where a place is free."""

    own: np.ndarray
    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray
    need: np.ndarray
    d2: np.ndarray


def from_scratch(x: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
    """Bounds from all distances; equal distances go to the lower index."""
    d2 = squared(x[:, None, :], entries[None, :, :])
    order = np.argsort(d2, axis=1, kind="stable")
    rows = np.arange(len(x))
    near = np.full((len(x), b), -1)
    low = np.full((len(x), b), np.inf)
    there = min(b, len(entries) - 1)
    near[:, :there] = order[:, 1 : there + 1]
    low[:, :there] = below(np.take_along_axis(d2, near[:, :there], axis=1))
    outer = below(d2[rows, order[:, b + 1]]) if len(entries) > b + 1 else np.full(len(x), np.inf)
    return Bounds(order[:, 0], near, low, outer, np.full(len(x), b + 1), d2[rows, order[:, 0]])


def with_places(old: Bounds, b: int) -> Bounds:
    """The same bounds with ``b`` places: what falls out is left to the outer bound, new places are free."""
    kept = old.near.shape[1]
    if b < kept:
        return Bounds(old.own, old.near[:, :b], old.low[:, :b], np.minimum(old.outer, old.low[:, b:].min(axis=1)), old.need, old.d2)
    free = ((0, 0), (0, b - kept))
    return Bounds(old.own, np.pad(old.near, free, constant_values=-1), np.pad(old.low, free, constant_values=np.inf), old.outer, old.need, old.d2)


def moved_on(x: np.ndarray, entries: np.ndarray, moves: np.ndarray, old: Bounds) -> Bounds:
    """Bounds after the entries moved; ``moves``: how far at most. Only uncertain rows have other distances worked out than that to their own entry."""
    own, near, b = old.own.copy(), old.near.copy(), old.near.shape[1]
    low = old.low - np.where(near >= 0, moves[near], 0.0)
    low -= np.abs(low, where=np.isfinite(low), out=np.zeros_like(low)) * _SLACK
    outer = old.outer - moves.max()
    outer = outer - np.abs(outer, where=np.isfinite(outer), out=np.zeros_like(outer)) * _SLACK
    d2 = squared(x, entries[own])
    every = np.column_stack([low, outer])
    least = np.minimum.accumulate(every[:, ::-1], axis=1)[:, ::-1]  # bound of a place and of all behind it
    need = (least <= above(d2)[:, None]).sum(axis=1)
    for place in range(b):
        rows = np.flatnonzero((need > place) & (need <= b))
        rows = rows[near[rows, place] >= 0]
        if not len(rows):
            continue
        other = near[rows, place]
        other_d2 = squared(x[rows], entries[other])
        wins = ((other_d2 < d2[rows]) | ((other_d2 == d2[rows]) & (other < own[rows]))).astype(bool)
        near[rows, place] = np.where(wins, own[rows], other)
        low[rows, place] = below(np.where(wins, d2[rows], other_d2))
        own[rows], d2[rows] = np.where(wins, other, own[rows]), np.where(wins, other_d2, d2[rows])
    order = np.argsort(low, axis=1, kind="stable")
    out = Bounds(own, np.take_along_axis(near, order, axis=1), np.take_along_axis(low, order, axis=1), outer, need, d2)
    lost = np.flatnonzero(need > b)
    if len(lost):
        fresh = from_scratch(x[lost], entries, b)
        for name in ("own", "near", "low", "outer", "d2"):
            getattr(out, name)[lost] = getattr(fresh, name)
    return out


@dataclass
class Plan:
    """What a round needs: codebooks by part, how far their entries moved, and the bounds kept by part before and now."""

    books: list[list[list[int]]]
    moves: list[np.ndarray] | None
    kept: list[int]
    keep: list[int]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32) if matrix.shape[1] else np.zeros(len(matrix) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel(), type=kind))


def _part(x: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Consecutive components of one part; vectors that do not divide evenly end in zeros."""
    width = -(-x.shape[1] // parts)
    cut = x[:, part * width : (part + 1) * width]
    return np.pad(cut, ((0, 0), (0, width - cut.shape[1])))


def _assign(plan: Plan, parts: int, scale: int, first: bool):
    """Task of one round: every row's entries and bounds for the plan's codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [entries_of(book) for book in plan.books]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch["vector"], n)
            found = []
            for p in range(parts):
                own = whole(_part(x, p, parts), scale)
                if first:
                    found.append(from_scratch(own, books[p], plan.keep[p]))
                    continue
                at, wide = sum(plan.kept[:p]), plan.kept[p]
                old = Bounds(
                    _matrix(batch["entry"], n)[:, p].astype(np.int64), _matrix(batch["near"], n)[:, at : at + wide].astype(np.int64),
                    _matrix(batch["low"], n)[:, at + p : at + p + wide], _matrix(batch["low"], n)[:, at + p + wide], np.zeros(n), np.zeros(n),
                )
                found.append(moved_on(own, books[p], plan.moves[p], with_places(old, plan.keep[p])))
            error = [sum(int(f.d2[i]) for f in found) for i in range(n)]
            columns = {
                "vec_id": batch["vec_id"], "label": batch["label"], "vector": batch["vector"],
                "entry": _lists(np.column_stack([f.own for f in found]).astype(np.int16), pa.int16()),
                "near": _lists(np.column_stack([f.near for f in found]).astype(np.int16), pa.int16()),
                "low": _lists(np.column_stack([c for f in found for c in (f.low, f.outer)]), pa.float64()),
                "need": _lists(np.column_stack([f.need for f in found]).astype(np.int16), pa.int16()),
                "error": pa.array([e if e <= _LONG_MAX else None for e in error], type=pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _sum(parts: int, scale: int, sizes: list[int], kept: list[int]):
    """Task that sums rows by part and entry, and counts under entry -1 how many bounds the rows needed. One row for each at most, sums as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], list] = {}

        def add(key: tuple[int, int], count: int, sums: np.ndarray) -> None:
            held = total.setdefault(key, [0, [0] * len(sums)])
            held[0] += count
            held[1] = [a + int(s) for a, s in zip(held[1], sums.tolist())]

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, entry, need = _matrix(batch["vector"], n), _matrix(batch["entry"], n), _matrix(batch["need"], n)
            for p in range(parts):
                own = whole(_part(x, p, parts), scale)
                for e in np.unique(entry[:, p]).tolist():
                    rows = own[entry[:, p] == e]
                    add((p, e), len(rows), rows.sum(axis=0))
                add((p, -1), n, np.bincount(need[:, p], minlength=max(sizes[p], kept[p]) + 2))
        yield pa.RecordBatch.from_pylist([{"part": p, "entry": e, "n": n, "sums": [str(s) for s in sums]} for (p, e), (n, sums) in total.items()], schema=_SUMS)

    return run


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _together(rows: pd.DataFrame) -> pd.DataFrame:
    """The sums of one part and entry over all tasks."""
    sums = [sum(map(int, column)) for column in zip(*rows["sums"])]
    return pd.DataFrame({"part": rows["part"][:1], "entry": rows["entry"][:1], "n": [rows["n"].sum()], "sums": [[str(s) for s in sums]]})


def _next_keep(needed: Sequence[int], kept: int, entries: int) -> int:
    """Bounds to keep next: the fewest that all but MAY_MISS of the rows make do with, twice as many where more rows than that lack one; an eighth of the entries at least."""
    n = max(1, sum(needed))
    enough = next((b for b in range(kept + 1) if sum(needed[b + 1 :]) <= MAY_MISS * n), 2 * kept)
    return max(1, entries // 8, min(enough, entries - 1))


@dataclass
class Codes:
    """Table (vec_id, label, code, error) and the final codebooks, by part, entry and position."""

    rows: DataFrame
    books: list[list[list[int]]]
    kept: list[list[int]]

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for entry in book for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codes of all vectors by codebooks that are fitted to all of them.

    In: ``vec_id``, ``embedding``, ``label``; other columns are ignored. A
    component x counts as the integer floor(scale * x). Every codebook starts
    as that part of the first ``entries`` vectors in order of vec_id (null
    ids last, repeated ids by their vectors); each round assigns every part
    to the nearest entry, ties to the lower index, and replaces entries by
    the componentwise floor of their parts' mean; an entry without parts
    stays. Out: codes of two hex digits for each part, and error, the squared
    distances summed over the parts (null where it is beyond a long).

    Vectors that are null or hold null or non-finite components take no part,
    nor do those of another length than the first one; a length that the
    parts do not divide is filled up with zeros. With fewer vectors than
    entries there are as many entries as vectors. Repeated rows count and
    come out each; null ids and labels stay null. None if no vector is left.
    """
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    vector = F.col("embedding") if kind == "float" else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", "label", vector.alias("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()  # as many rows as a codebook has entries
    if not first:
        return None
    length = len(first[0]["vector"])
    seeds = np.array([r["vector"] for r in first if len(r["vector"]) == length], dtype=np.float64).reshape(-1, length)
    rows = rows.filter(F.size("vector") == length)
    if len(seeds) < len(first):  # vectors of other lengths stood among the first
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
        seeds = np.array([r["vector"] for r in first], dtype=np.float64).reshape(-1, length)
    books = [[[int(v) for v in entry] for entry in whole(_part(seeds, p, parts), scale)] for p in range(parts)]
    keep = [min(FIRST_BOUNDS, max(1, len(books[0]) - 1))] * parts
    plan, kept_by_round = Plan(books, None, keep, keep), []
    schema = "vec_id {0}, label {1}, vector array<{2}>, entry array<short>, near array<short>, low array<double>, need array<short>, error long".format(
        rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString(), "float" if kind == "float" else "double"
    )
    state, before = None, None
    for n in range(rounds + 1):
        source = rows if state is None else state
        with owned() as now:
            state = materialize(source.mapInArrow(_assign(plan, parts, scale, first=state is None), schema), f"codes-{n}")
        if before is not None:
            before.free(rows.sparkSession)
        before = now
        kept_by_round.append(plan.keep)
        if n == rounds:
            break
        sums = state.select("vector", "entry", "need").mapInArrow(_sum(parts, scale, [len(b) for b in books], plan.keep), "part int, entry int, n long, sums array<string>")
        sums = sums.groupBy("part", "entry").applyInPandas(_together, "part int, entry int, n long, sums array<string>").collect()  # parts * (entries + 1) rows
        after, needed = [[list(entry) for entry in book] for book in books], {}
        for r in sums:
            if r["entry"] < 0:
                needed[r["part"]] = [int(s) for s in r["sums"]]
            else:
                after[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        if after == books:  # all later rounds would find the same
            break
        moves = [above(squared(entries_of(new).astype(object), entries_of(old).astype(object))) for new, old in zip(after, books)]
        # the first round had no bounds to do without
        next_keep = plan.keep if n == 0 else [_next_keep(needed[p], plan.keep[p], len(books[p])) for p in range(parts)]
        books, plan = after, Plan(after, moves, plan.keep, next_keep)
    code = F.array_join(F.transform("entry", lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 2, "0"))), "")
    return Codes(state.select("vec_id", "label", code.alias("code"), "error"), books, kept_by_round)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` and label_error, the errors summed over rows of equal labels, nulls together; null where the sum is beyond a long.

    A label may stand on a third of all rows: it is summed before the shuffle,
    and its sum goes to the rows, not they to it.
    """
    sums = codes.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sums = materialize(sums, "codes-labels")
    if sums.count() <= BROADCAST_LABELS:
        return codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
    sums = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt"))).drop("of_label", "of_salt", "salt")
