"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are held
against references of languages, learned from the corpus itself: over all
documents that pass the base rules, every document with the same weight. The
divergence is the Jensen-Shannon distance (Lin, "Divergence Measures Based on
the Shannon Entropy", 1991), from 0 for equal histograms to 1 for disjoint
ones. A short text fills its histogram by luck, so a histogram counts only from
a minimum length on. A document is held against every reference and judged by
the nearest one: a wrong or missing tag of a known language costs it nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: Base rules: words at least, and percent of words in repeated three-word windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Common words of a language, and documents that a reference needs.
COMMON, LEAST_DOCS = 64, 30
#: Languages with references of their own, those with most documents.
LANGUAGES = 200
#: Distances up to which a document is kept, and the lengths from which each histogram counts. From SHORT_WORDS to WORD_WORDS words luck is allowed for.
CLASS_DISTANCE, CLASS_CHARS = 0.25, 200
WORD_DISTANCE, WORD_WORDS = 0.40, 100
SHORT_DISTANCE, SHORT_WORDS = 0.46, 50
#: A histogram's share is a whole number of these, so that sums over documents are exact in any order.
PARTS = 1_000_000
#: Entries of a task's table of sums before it is handed on.
TABLE_ENTRIES = 200_000
#: Texts whose histograms are compared at once.
READ_AT_ONCE = 200
_ENDINGS = b".,;:?!"

CLASSES = ("upper", "lower", "digit", "blank", "sentence mark", "other ASCII", "beyond ASCII")


def _class_table() -> np.ndarray:
    """Class of every byte of UTF-8; 7 for the bytes that continue a character."""
    table = np.full(256, 5)
    for chars, number in ((range(65, 91), 0), (range(97, 123), 1), (range(48, 58), 2), ((32, *range(9, 14)), 3), (b".,;:?'\"()-", 4), (range(128, 192), 7), (range(192, 256), 6)):
        table[list(chars)] = number
    return table


_CLASS_OF = _class_table()
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


@dataclass
class Reading:
    """Counts of one whole text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    classes: np.ndarray
    words: dict[bytes, int]

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in three-word windows found twice or more, the first find included; each word counts once."""
    if len(words) < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # a pair by its place instead, so that windows fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(windows), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def read(text: str | None) -> Reading:
    """Words are runs between the six ASCII blanks; a null text has none. Common words are compared in lower case (A-Z) without the marks after them."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    classes = np.bincount(_CLASS_OF, weights=by_byte, minlength=8)[:7].astype(np.int64)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    named: dict[bytes, int] = {}
    for word, n in Counter(raw.lower().split()).items():
        word = word.rstrip(_ENDINGS)
        named[word] = named.get(word, 0) + n
    return Reading(len(words), int(classes.sum() - classes[3]), int(by_byte[_IS_SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(words), classes, named)


@dataclass
class Reference:
    """Histograms of one language: shares of the classes, and of its common words by name."""

    classes: np.ndarray
    words: dict[bytes, float]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms along the last axis, each of which sums up to 1."""
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(p > 0, p * np.log2(p / middle), 0.0) + np.where(q > 0, q * np.log2(q / middle), 0.0)
    return np.sqrt(np.maximum(0.0, each.sum(axis=-1) / 2))


class Nearest:
    """Distances of readings to the nearest of some references."""

    def __init__(self, references: list[Reference]):
        self._classes = np.array([r.classes for r in references])
        self._names = [list(r.words) for r in references]
        self._words = [np.array([*r.words.values(), 1 - sum(r.words.values())]) for r in references]

    def classes(self, readings: list[Reading]) -> np.ndarray:
        """Null (NaN) for texts under CLASS_CHARS characters."""
        counts = np.array([r.classes for r in readings], dtype=np.float64).reshape(len(readings), -1)
        size = counts.sum(axis=1)
        if not len(readings) or not len(self._classes):
            return np.full(len(readings), np.nan)
        found = distance((counts / np.maximum(size, 1)[:, None])[:, None, :], self._classes[None]).min(axis=1)
        return np.where(size >= CLASS_CHARS, found, np.nan)

    def words(self, readings: list[Reading]) -> np.ndarray:
        """Null (NaN) for texts under SHORT_WORDS words. All words that are not common in a language share one bin."""
        least, size = np.full(len(readings), np.nan), np.array([r.n_words for r in readings])
        for names, q in zip(self._names, self._words):
            p = np.array([[r.words.get(w, 0) for w in names] for r in readings], dtype=np.float64).reshape(len(readings), -1) / np.maximum(size, 1)[:, None]
            least = np.fmin(least, distance(np.column_stack([p, 1 - p.sum(axis=1)]), q[None]))
        return np.where(size >= SHORT_WORDS, least, np.nan)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (lang, kind, name, amount) of a task's documents, summed as far as its tables reach."""
    total: dict[tuple[str | None, str], dict] = {}

    def rows() -> pd.DataFrame:
        out = [pd.DataFrame({"lang": lang, "kind": kind, "name": [n.decode("utf-8") for n in names], "amount": list(names.values())}) for (lang, kind), names in total.items()]
        total.clear()
        return pd.concat(out)

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            found = read(text)
            if found.base_failed:
                continue
            words = total.setdefault((lang, "word"), {})
            for word, n in found.words.items():
                words[word] = words.get(word, 0) + PARTS * n // found.n_words
            classes, n_chars = total.setdefault((lang, "class"), {}), int(found.classes.sum())
            for number, n in enumerate(found.classes.tolist()):
                name = b"%d" % number
                classes[name] = classes.get(name, 0) + PARTS * n // n_chars
            docs = total.setdefault((lang, "docs"), {b"": 0})
            docs[b""] += 1
            if sum(map(len, total.values())) >= TABLE_ENTRIES:
                yield rows()
    if total:
        yield rows()


def references(docs: DataFrame) -> dict[str | None, Reference]:
    """Reference of every language with at least LEAST_DOCS documents that pass the base rules; under None the pooled one, of all documents.

    Collected are at most LANGUAGES + 1 times the classes and COMMON words.
    """
    sums = docs.select("lang", "text").mapInPandas(_sums, "lang string, kind string, name string, amount long")
    sums = materialize(sums.groupBy("lang", "kind", "name").agg(F.sum("amount").alias("amount")), "divergence-sums")
    pooled = sums.groupBy("kind", "name").agg(F.sum("amount").alias("amount")).withColumn("lang", F.lit(None).cast("string"))
    every = sums.filter("lang is not null").unionByName(pooled)
    by_size = Window.partitionBy("lang", "kind").orderBy(F.desc("amount"), "name")
    top = every.withColumn("place", F.row_number().over(by_size)).filter(F.col("place") <= COMMON)
    languages = every.filter(F.col("kind") == "docs").filter(F.col("amount") >= LEAST_DOCS).orderBy(F.desc("amount"), F.col("lang").asc_nulls_first()).limit(LANGUAGES + 1)
    named = languages.select(F.col("lang").alias("l"), F.col("amount").alias("n_docs"))
    found = top.join(F.broadcast(named), F.col("lang").eqNullSafe(F.col("l"))).select("lang", "kind", "name", "amount", "n_docs", "place").collect()
    out: dict[str | None, Reference] = {}
    for r in sorted(found, key=lambda r: r["place"]):
        own = out.setdefault(r["lang"], Reference(np.zeros(len(CLASSES)), {}))
        if r["kind"] == "class":
            own.classes[int(r["name"])] = r["amount"]
        elif r["kind"] == "word":
            own.words[r["name"].encode("utf-8")] = r["amount"] / (PARTS * r["n_docs"])
    for own in out.values():
        own.classes /= own.classes.sum()
    return out


def _facts(readings: list[Reading], nearest: Nearest) -> pd.DataFrame:
    counts = {name: np.array([getattr(r, name) for r in readings], dtype=np.int64) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return pd.DataFrame({**counts, "class_distance": nearest.classes(readings), "word_distance": nearest.words(readings)})


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, divergences and verdict of every document.

    In: ``doc_id``, ``text``, ``lang``; other columns are ignored. Out, one
    row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, class_distance and
    word_distance (to the nearest reference; null where a text is too short
    for that histogram or there is no reference) and kept. A document is kept
    unless it fails the base rules or one of its distances is above its
    limit.

    Null and empty texts have no words and fail. Documents of a language with
    fewer than LEAST_DOCS of them are judged by the base rules alone, those
    without a language by the nearest reference; both count in the pooled
    reference, which stands in only where no language has one of its own.
    Equal texts of one language have equal verdicts; repeated rows stay and
    count each in the references; a table with fewer than LEAST_DOCS documents that pass the
    base rules has no references, so that the base rules alone decide; an
    empty table gives no rows.
    """
    found = references(docs)
    languages = [lang for lang in found if lang is not None]
    nearest = Nearest([found[lang] for lang in languages] or list(found.values()))
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double"

    @F.pandas_udf(kinds)
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [_facts([read(t) for t in texts[at : at + READ_AT_ONCE]], nearest) for at in range(0, len(texts), READ_AT_ONCE)]
            yield pd.concat(parts or [_facts([], nearest)], ignore_index=True)

    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    # other languages' references say nothing about a language that has none
    own = F.lit(True) if not languages else F.col("lang").isNull() | F.col("lang").isin(languages)
    near = F.coalesce(F.col("class_distance"), F.lit(0.0)) <= CLASS_DISTANCE
    like = F.coalesce(F.col("word_distance"), F.lit(0.0)) <= F.when(F.col("n_words") < WORD_WORDS, SHORT_DISTANCE).otherwise(WORD_DISTANCE)
    return (
        docs.select("doc_id", "lang", facts("text").alias("f"))
        .select("doc_id", own.alias("own"), "f.*")
        .withColumns({c: F.when(F.col("own") & ~F.isnan(c), F.col(c)) for c in ("class_distance", "word_distance")})
        .drop("own")
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & near & like)
    )
