"""Headlines in the news window, scored and ranked; company announcements after the last close."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import roc_timestamp


def in_news_window(df: DataFrame, published: str, start: Column, end: Column) -> DataFrame:
    """Published within the window, both ends included."""
    return df.filter(F.col(published).between(start, end))


def top_news(df: DataFrame, k: int = 5, by: Sequence[str] = (), pos: str = "pos", published: str = "published") -> DataFrame:
    """The ``k`` best headlines by score, newest first, ties in feed order; per ``by`` if given."""
    order = [F.desc("score"), F.desc(published), F.asc(pos)]
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def latest_article(df: DataFrame, by: Sequence[str] = (), wanted: str = "盤前", unwanted: str = "盤後", pos: str = "pos") -> DataFrame:
    """The first title (by pos) that holds one word and not the other, and has a link."""
    fit = df.filter(F.contains("title", F.lit(wanted)) & ~F.contains("title", F.lit(unwanted)) & (F.coalesce("link", F.lit("")) != ""))
    columns = [c for c in df.columns if c not in by]
    first = fit.groupBy(*by).agg(F.min_by(F.struct(*columns), pos).alias("_row")).filter("_row is not null")
    return first.select(*by, *[F.col("_row")[c].alias(c) for c in columns])


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """Announcement feeds in one table; ``feed`` names the source, columns that a feed lacks are null."""
    out = None
    for name, df in feeds.items():
        df = df.withColumn("feed", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def with_announced_at(df: DataFrame, date: str = "date", time: str = "time") -> DataFrame:
    return df.withColumn("announced_at", roc_timestamp(F.col(date), F.col(time)))


def unreflected(df: DataFrame, cutoff: Column, announced: str = "announced_at") -> DataFrame:
    """Announcements strictly after the cutoff; those without a readable time are left out."""
    return df.filter(F.col(announced) > cutoff)


def unreflected_counts(df: DataFrame, feed: str = "feed") -> DataFrame:
    """Rows per feed and in total (feed null)."""
    return df.rollup(feed).agg(F.count(F.lit(1)).alias("n"))
