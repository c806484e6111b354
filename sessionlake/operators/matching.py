"""Tokens of a list matched to rows by code, by name, and by similar name."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

CUTOFF = 0.6


def _first_row(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def _characters(text: Column) -> Column:
    """Each character with its occurrence number, as one string per pair."""
    letters = F.split(text, "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda o: o == c)).cast("string")))


def fuzzy_names(tokens: DataFrame, names: DataFrame, keys: Sequence[str] = ("date",), cutoff: float = CUTOFF) -> DataFrame:
    """Per distinct token the most similar distinct name of the same keys, if its ratio reaches ``cutoff``.

    The ratio is Ratcliff-Obershelp with the name first; ties go to the larger
    name. Twice the number of shared characters over both lengths bounds the
    ratio from above, so of n characters at least n * cutoff / (2 - cutoff)
    are shared with any name that counts. Two texts with that many in common
    share one among the rarest of each; only those meet in the join, and
    nothing is lost. The ratio alone runs in Python.
    """
    def lettered(df: DataFrame, column: str) -> DataFrame:
        return df.select(*keys, F.col(column).alias("text")).filter(F.length("text") > 0).distinct().withColumn("letters", _characters(F.col("text")))

    sides = [materialize(lettered(df, column), "fuzzy-letters") for df, column in ((tokens, "token"), (names, "name"))]
    letters = [side.select(*keys, "text", F.explode("letters").alias("letter")) for side in sides]
    rarity = letters[0].unionByName(letters[1]).groupBy("letter").count()

    def rarest(side: DataFrame, each: DataFrame) -> DataFrame:
        ranked = each.join(rarity, "letter").groupBy(*keys, "text").agg(F.sort_array(F.collect_list(F.struct("count", "letter"))).alias("ranked"))  # as many as the text has letters
        kept = F.size("ranked") - F.ceil(F.size("ranked") * (cutoff / (2 - cutoff)) - 1e-9).cast("int") + 1
        return ranked.select(*keys, "text", F.explode(F.slice("ranked", F.lit(1), kept)).alias("r")).select(*keys, "text", F.col("r.letter").alias("letter")).join(side, [*keys, "text"])

    one, other = (rarest(side, each) for side, each in zip(sides, letters))
    met = one.withColumnsRenamed({"text": "token", "letters": "of_token"}).join(other.withColumnsRenamed({"text": "name", "letters": "of_name"}), [*keys, "letter"])
    total = F.size("of_token") + F.size("of_name")
    near_length = 2 * F.least(F.size("of_token"), F.size("of_name")) >= cutoff * total - 1e-9
    pairs = met.filter(near_length & (2 * F.size(F.array_intersect("of_token", "of_name")) >= cutoff * total - 1e-9)).select(*keys, "token", "name").distinct()

    @F.pandas_udf("double")
    def ratio(name: pd.Series, token: pd.Series) -> pd.Series:
        matcher = SequenceMatcher()
        out = []
        for a, b in zip(name, token):
            matcher.set_seqs(a, b)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    scored = pairs.withColumn("ratio", ratio("name", "token")).filter(F.col("ratio") >= cutoff)
    best = scored.groupBy(*keys, "token").agg(F.max(F.struct("ratio", "name")).alias("_best"))
    return best.select(*keys, "token", F.col("_best.name").alias("name"), F.col("_best.ratio").alias("ratio"))


def match_tokens(tokens: DataFrame, rows: DataFrame, keys: Sequence[str] = ("date",), order: str = "row_pos", fuzzy: bool = True) -> DataFrame:
    """Every token with match_type (code, name, fuzzy_name or null) and the first row it matches.

    ``tokens`` has the keys, ``token`` and any other columns, ``rows`` the
    keys, ``code``, ``name``, ``order`` and any others, which come back with
    the prefix ``row_``. Only tokens that neither code nor name explain go to
    the similar names.
    """
    columns = [c for c in rows.columns if c not in keys]
    by_code = _first_row(rows.filter("code is not null"), [*keys, "code"], order).select(*keys, F.col("code").alias("token"), F.struct(*columns).alias("_code"))
    named = _first_row(rows.filter("name is not null"), [*keys, "name"], order)
    by_name = named.select(*keys, F.col("name").alias("token"), F.struct(*columns).alias("_name"))
    out = tokens.join(by_code, [*keys, "token"], "left").join(by_name, [*keys, "token"], "left")
    found, kind = F.coalesce("_code", "_name"), F.when(F.col("_code").isNotNull(), "code").when(F.col("_name").isNotNull(), "name")
    if fuzzy:
        left = unmatched(tokens, rows, keys)
        similar = fuzzy_names(left, rows, keys).select(*keys, "token", "name").join(named, [*keys, "name"]).select(*keys, "token", F.struct(*columns).alias("_near"))
        out = out.join(similar, [*keys, "token"], "left")
        found, kind = F.coalesce("_code", "_name", "_near"), kind.when(F.col("_near").isNotNull(), "fuzzy_name")
    return out.withColumn("_found", found).withColumn("match_type", kind).select(*tokens.columns, "match_type", *[F.col("_found")[c].alias(f"row_{c}") for c in columns])


def unmatched(tokens: DataFrame, rows: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """The tokens that are neither a code nor a name."""
    by_code = rows.select(*keys, F.col("code").alias("token"))
    by_name = rows.select(*keys, F.col("name").alias("token"))
    return tokens.join(by_code, [*keys, "token"], "left_anti").join(by_name, [*keys, "token"], "left_anti")


def match_counts(matches: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Per key the tokens, the matched and unmatched ones, and the distinct codes matched."""
    return matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(F.col("match_type").isNotNull()).alias("matched"),
        F.count_if(F.col("match_type").isNull()).alias("unmatched"),
        F.countDistinct("row_code").alias("candidates"),
    )
