"""Surveillance lists and watchlists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAVING = "出關"
#: Lists in page order and the class a watched code takes from the first that holds it.
LIST_CLASSES = (("one_away", "alert"), ("exiting", "alert"), ("found", "candidate"), ("not_found", "candidate"))
#: A join partner of at most this many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def restricted_group(days_left: Column, raw: Column) -> Column:
    """Exiting (0 days, or the text says so), hidden (nothing known), else rest. Reads the number and the raw text."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.when((days_left == 0) | text.isin("0", "0天", LEAVING), "exiting").when(days_left.isNull() & (text == ""), "hidden").otherwise("rest")


def split_restricted(df: DataFrame, days_left: str = "trading_days_left", raw: str = "trading_days_text") -> DataFrame:
    return df.withColumn("restricted_group", restricted_group(F.col(days_left), F.col(raw)))


def alert_summary(near: DataFrame, restricted: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Per key one_away, exiting, their total, and hidden; ``restricted`` comes from :func:`split_restricted`."""
    a = near.groupBy(*by).agg(F.count(F.lit(1)).alias("one_away"))
    b = restricted.groupBy(*by).agg(F.count_if(F.col("restricted_group") == "exiting").alias("exiting"), F.count_if(F.col("restricted_group") == "hidden").alias("hidden"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return a.join(b, list(by), "full").select(*by, zero("one_away").alias("one_away"), zero("exiting").alias("exiting"), (zero("one_away") + zero("exiting")).alias("total"), zero("hidden").alias("hidden"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where a count shows that the table is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def classify_watchlist(codes: DataFrame, listed: DataFrame, key: str = "code", classes=LIST_CLASSES) -> DataFrame:
    """Every watched code with its class: that of the first list (in page order) holding it, else other.

    ``listed`` has the code and ``list_name``.
    """
    names = F.array(*[F.lit(name) for name, _ in classes])
    kinds = F.create_map(*[F.lit(x) for pair in classes for x in pair])
    known = listed.filter(F.array_contains(names, F.col("list_name")))
    best = known.groupBy(key).agg(F.min_by("list_name", F.array_position(names, F.col("list_name"))).alias("list_name"))
    return codes.join(best, key, "left").withColumn("watch_class", F.coalesce(kinds[F.col("list_name")], F.lit("other")))


def watch_only(df: DataFrame, codes: DataFrame, key: str = "code") -> DataFrame:
    """The rows of watched codes."""
    return df.join(_small(codes.select(key).distinct()), key, "left_semi")


def merge_watchlist(current: DataFrame, new: DataFrame, owner: Sequence[str] = ("owner",), key: str = "code", pos: str = "pos", override: bool = False) -> DataFrame:
    """The lists of each owner merged: unseen codes appended in their order, or the new list instead.

    Codes keep their first occurrence; ``pos`` orders a list. The result has
    list_no (0 current, 1 new) and pos to sort by.
    """
    tagged = new.select(*owner, key, pos, F.lit(1).alias("list_no"))
    if not override:
        tagged = current.select(*owner, key, pos, F.lit(0).alias("list_no")).unionByName(tagged)
    first = tagged.groupBy(*owner, key).agg(F.min(F.struct("list_no", pos)).alias("_first"))
    return first.select(*owner, key, "_first.list_no", F.col("_first")[pos].alias(pos))


def merge_arrays(current: Column, new: Column, override: bool = False) -> Column:
    """U02 on arrays: order kept, repeats dropped."""
    return F.array_distinct(new) if override else F.array_union(current, new)


def remove_code(codes: Column, code: Column) -> Column:
    """One code taken off a list."""
    return F.array_remove(codes, code)


def typed_sort_keys(value: Column, explicit: Column | None = None) -> tuple[Column, Column]:
    """(number, text) to sort a column of mixed text by.

    The number is the explicit one, else month * 100 + day of a leading
    "MM-DD", else the first number with thousands commas read whole; rows
    without one follow by text.
    """
    month_day = F.regexp_extract(value, r"^(\d{1,2})-(\d{1,2})", 1).try_cast("double") * 100 + F.regexp_extract(value, r"^(\d{1,2})-(\d{1,2})", 2).try_cast("double")
    number = F.replace(F.regexp_extract(value, r"([+-]?\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(*([explicit.cast("double")] if explicit is not None else []), month_day, number), value


def typed_order(column: str, ascending: bool = True, explicit: str | None = None, tie: str | None = None) -> list[Column | str]:
    """Sort order by :func:`typed_sort_keys`, rows without a number last in either direction, those by text."""
    number, text = typed_sort_keys(F.col(column), F.col(explicit) if explicit else None)
    plain = F.when(number.isNull(), text)
    order = [number.asc_nulls_last(), plain.asc_nulls_last()] if ascending else [number.desc_nulls_last(), plain.desc_nulls_last()]
    return [*order, *([tie] if tie else [])]


def typed_sort(df: DataFrame, column: str, ascending: bool = True, explicit: str | None = None, tie: str | None = None) -> DataFrame:
    """The rows in that order."""
    return df.orderBy(*typed_order(column, ascending, explicit, tie))
