"""Mixing sources to target weights.

Every document gets a hash-random key, from its id and its text. Within its source the documents stand
in key order; the leading bits of the key cut that order into ranges, so a
source with a third of all rows is spread over as many tasks as it needs.
Range sums, a prefix over the ranges and a running sum inside each range give
every document the number of words that stand before it, without one task
ever holding a source. The budget is then cut at the exact word.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .batches import of_texts

#: Rows that one range of a source's key order should hold.
RANGE_ROWS = 20_000
#: A mix takes no source more than this many times.
MAX_EPOCHS = 3
#: Sources up to which the table of cuts (one short row each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
_KEY_DIGITS = 4  # hex digits of the key that number the finest ranges

BLANKS = " \t\n\x0b\x0c\r"
#: Copies of a repeated row that are listed at once.
COPIES_AT_ONCE = 4096


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` runs; null counts 0."""

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        # bytes.split parts at the six ASCII blanks and at nothing else
        return pd.Series([len(t.encode("utf-8", "replace").split()) if t else 0 for t in texts], dtype="int64")

    return counts(text)


def has_words(text: Column) -> Column:
    """Whether ``word_count`` is above 0, without Python."""
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def mix_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Hash-random sort key: hex text, the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets per source from rows (source, source_size): one row per source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and
    share the sum of all sizes. A target stops at ``max_epochs`` times its
    source's size; what is above is shared again by weight. In the order of
    size per weight, the sources that stop come first, so the level that the
    rest reach follows from running sums over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)
    return (
        sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("own_level", level)
        .withColumn("reached", F.when(F.col("own_level") * F.col("weight") <= max_epochs * F.col("source_size"), F.col("own_level")))
        .withColumn("level", F.max("reached").over(everything))  # it falls from the first source that does not stop onward
        .withColumn("target", F.least(F.col("level") * F.col("weight"), (max_epochs * F.col("source_size")).cast("double")))
        .select("source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, *, seed: int = 0, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """How many words of each document the mix takes.

    In: ``doc_id``, ``text``, ``source``; other columns are ignored. Out, one
    row per row of ``docs``: doc_id, source, size, source_size, target,
    epochs (whole passes over the source), rest (words of the last, partial
    pass taken from this document), key (its place in the order) and taken =
    epochs * size + rest.

    Null and blank texts have size 0 and are taken 0 words; null sources form
    one source; null and repeated ids are told apart by their texts. Rows that
    repeat both stand one after the other, each with its own place in the
    order: they are counted before the shuffle and listed again at the end,
    so a row that repeats without end crowds no range. An empty table gives
    an empty table. Reruns agree: the key depends on ``seed``, ``doc_id`` and
    ``text`` only.
    """
    sized = of_texts(docs).select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    sized = materialize(sized.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")), "mix-sizes")
    rows = sized.count()
    digits = 0
    while digits < _KEY_DIGITS and 16**digits * range_rows < rows:
        digits += 1
    bucketed = sized.withColumn("range", F.substring("key", 1, digits)).withColumn("weighs", F.col("size") * F.col("copies"))

    ranges = bucketed.groupBy("source", "range").agg(F.sum("weighs").alias("range_size"))
    ranges = materialize(ranges, "mix-ranges")
    by_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(by_source), F.lit(0)))
    targets = materialize(source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), max_epochs), "mix-targets")
    facts = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("f_source"), F.col("o.range").alias("f_range"), "offset", "source_size", "target"
    )

    running = Window.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        bucketed.withColumn("inside", F.coalesce(F.sum("weighs").over(running), F.lit(0)))
        .join(facts, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("range") == F.col("f_range")))
        .withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES_AT_ONCE})")))
        .withColumn("copy", F.explode(F.expr(f"sequence(lot * {COPIES_AT_ONCE}, least(copies, (lot + 1) * {COPIES_AT_ONCE}) - 1)")))
        .withColumn("budget", F.floor("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("inside") - F.col("copy") * F.col("size"))
        .withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left"))).cast("long"))
    )
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "rest", "key",
        (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"),
    )


def take_mix(docs: DataFrame, *, seed: int = 0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``.

    A document stands once for every epoch that takes it; where the budget
    ends inside a document, its last copy is cut after the last word taken.
    Documents without words carry nothing and are left out. What a source
    takes is a prefix of its key order, so one row per source says it all:
    the whole epochs, the last document of the partial pass and how much of
    it. Texts are therefore never shuffled. Rows that repeat that last
    document, id and text, are all cut alike. Null texts and sources go as in
    ``mix``; an empty table gives an empty table.
    """
    spot = F.struct("key", "size", "doc_id")
    plan = mix(docs, seed=seed, max_epochs=max_epochs)
    cuts = materialize(
        plan.groupBy(F.col("source").alias("c_source")).agg(
            F.max("epochs").alias("c_epochs"),
            F.max(F.when(F.col("rest") > 0, F.struct(spot.alias("spot"), "rest"))).alias("c_end"),  # of copies, the one that keeps most
        ).select("c_source", "c_epochs", F.col("c_end.spot").alias("c_spot"), F.col("c_end.rest").alias("c_rest")),
        "mix-cuts",
    )
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    sized = docs.withColumn("c_here", F.struct(mix_key(F.col("doc_id"), F.col("text"), seed).alias("key"), word_count(F.col("text")).alias("size"), "doc_id"))
    last = (
        F.when(F.col("c_spot").isNull() | (F.col("c_here") > F.col("c_spot")), F.lit(0))
        .when(F.col("c_here") == F.col("c_spot"), F.col("c_rest"))
        .otherwise(F.col("c_here.size"))
        .cast("long")
    )
    sized = sized.filter(has_words(F.col("text")))  # by the number of words, Spark would count them twice, in two Python workers at once
    joined = sized.join(cuts, F.col("source").eqNullSafe(F.col("c_source"))).withColumn("c_last", last).filter("c_epochs > 0 or c_last > 0")
    passes = F.expr("concat(array_repeat(c_here.size, cast(c_epochs as int)), if(c_last > 0, array(c_last), array()))")
    copies = joined.withColumn("c_take", F.explode(passes))
    # pieces of a split at word ends are one word each, with the blanks before it
    head = F.expr(r"array_join(slice(split(text, '(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])'), 1, cast(c_take as int)), '')")
    whole = F.col("c_take") == F.col("c_here.size")
    columns = {"text": F.when(whole, F.col("text")).otherwise(head)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(head).cast(docs.schema["n_chars"].dataType))
    return copies.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])
