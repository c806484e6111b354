"""Fill-in-the-middle: cut texts at drawn units and put the middle last.

A text's units (code points, or what a pattern matches) are found in its UTF-8
bytes. Fixed blocks of these bytes are the leaves of a Fenwick tree (Fenwick,
"A New Data Structure for Cumulative Frequency Tables", 1994) that sums units
and code points. To cut after k units, a binary-lifting descent finds the
block where the next unit starts and what stands before that block; only
inside the block the boundary itself is looked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4096
#: Percent of documents that are transformed, and percent of these that put the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_KINDS = "n long, form string, output string, prefix_chars long, middle_chars long"


class BlockTree:
    """Fenwick tree over blocks with two sums, of units and of code points."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        self.size = len(units)
        self._units, self._points = [0, *units.tolist()], [0, *points.tolist()]
        for i in range(1, self.size + 1):  # each node hands its sum on to the next that covers it
            above = i + (i & -i)
            if above <= self.size:
                self._units[above] += self._units[i]
                self._points[above] += self._points[i]

    def descend(self, k: int) -> tuple[int, int, int]:
        """Block that holds unit number ``k`` (from 0), and the units and code points before that block."""
        block, units, points = 0, 0, 0
        step = 1 << self.size.bit_length()
        while step := step >> 1:
            to = block + step
            if to <= self.size and units + self._units[to] <= k:
                block, units, points = to, units + self._units[to], points + self._points[to]
        return block, units, points


class Cutter:
    """Cuts one text after any number of its units."""

    def __init__(self, text: str, unit: re.Pattern | None = None, block_bytes: int = BLOCK_BYTES):
        self.raw = text.encode("utf-8", "replace")
        self._lead = (np.frombuffer(self.raw, dtype=np.uint8) & 0xC0) != 0x80
        self._starts = self._lead
        if unit is not None:
            self._starts = np.zeros(len(self.raw), dtype=bool)
            self._starts[np.flatnonzero(self._lead)[[m.start() for m in unit.finditer(text) if m.end() > m.start()]]] = True
        self._block = block_bytes
        firsts = np.arange(0, len(self.raw), block_bytes)
        units, points = (np.add.reduceat(x, firsts, dtype=np.int64) if len(firsts) else np.zeros(0, dtype=np.int64) for x in (self._starts, self._lead))
        self.n_units, self.n_points = int(units.sum()), int(points.sum())
        self._tree = BlockTree(units, points)

    def at(self, k: int) -> tuple[int, int]:
        """Byte and code point where the first ``k`` units end: where unit ``k`` starts; the ends of the text belong to the first and last cut."""
        if k <= 0:
            return 0, 0
        if k >= self.n_units:
            return len(self.raw), self.n_points
        block, units, points = self._tree.descend(k)
        start = block * self._block
        inside = int(np.flatnonzero(self._starts[start : start + self._block])[k - units])
        return start + inside, points + int(self._lead[start : start + inside].sum())


def arrange(text: str, draws: tuple[int, int, int, int], unit: re.Pattern | None, percent: int, spm_percent: int, marks: tuple[str, str, str]) -> tuple[int, str, str, int | None, int | None]:
    """Units, form, output and the code points of prefix and middle; see ``transform``."""
    cutter = Cutter(text, unit)
    n = cutter.n_units
    if not text or draws[2] % 100 >= percent or any(m in text for m in marks):
        return n, "plain", text, None, None
    cuts = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (a, a_points), (b, b_points) = map(cutter.at, cuts)
    prefix, middle, suffix = (part.decode("utf-8") for part in (cutter.raw[:a], cutter.raw[a:b], cutter.raw[b:]))
    p, s, m = marks
    form = "spm" if draws[3] % 100 < spm_percent else "psm"
    output = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return n, form, output, a_points, b_points - a_points


def draws_of(doc_id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers of a document, from the hex sha256 of seed, colon and id (a null id: the word null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, seed: int = 1, unit: str | None = None, percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Every document's text with its middle last, or as it is.

    In: ``doc_id``, ``text``; other columns are ignored. ``unit``: pattern of
    the units between which texts are cut; by default single code points.
    Out, one row per row of ``docs``: doc_id, n (units), form (psm: prefix,
    suffix, middle; spm: suffix, prefix, middle; plain), output, prefix_chars
    and middle_chars (code points; null if plain). Both cuts and the form
    follow from ``seed`` and doc_id alone, so reruns agree and repeated rows
    come out alike.

    Null texts count as empty; empty texts and texts that hold a mark stay
    plain, so that ``restore`` is exact; a null id draws as the word null; a
    text without units is cut at its ends only; an empty table gives no rows.
    A text of any length costs its bytes once and one path down the tree for
    each cut.
    """
    pattern = re.compile(unit) if unit is not None else None

    @F.pandas_udf(_KINDS)
    def arranged(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, *draws in batches:
            rows = [arrange(t or "", d, pattern, percent, spm_percent, marks) for t, *d in zip(text, *draws)]
            out = pd.DataFrame(rows, columns=["n", "form", "output", "prefix_chars", "middle_chars"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.select("doc_id", arranged(F.col("text"), *draws_of(F.col("doc_id"), seed)).alias("f")).select("doc_id", "f.*")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text again, from output and form alone. No mark stands in a transformed text, so each is found where it was put."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    prefix, suffix = F.when(form == "spm", parts[2]).otherwise(parts[1]), F.when(form == "spm", parts[1]).otherwise(parts[2])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
