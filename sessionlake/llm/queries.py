"""Queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codebooks, divergence, fim, media, mixing, packing, quality, sharding, simhash, topk, toxicity, warc
from .oracles import ORACLES  # noqa: F401 - part of this module's interface


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix takes that shares all words by the sources' weights.

    Null texts have size 0, null sources are one source, repeated rows have
    places of their own; an empty table gives no rows; other columns are not
    read. See ``mixing.mix``.
    """
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out fold.

    Null and empty texts score as texts without features, a null id has no
    label and counts as empty text in the fold, repeated rows score alike; an
    empty table gives no rows; other columns are not read. See ``toxicity.flag``.
    """
    return toxicity.flag(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document was packed, with words and digest read back from the packed text.

    Null, empty and blank texts have no pieces, null ids stay null, null
    sources are one source, repeated rows are packed each; an empty table
    gives no rows; other columns are not read. See ``packing.pack``.
    """
    return packing.placements(packing.pack(_table(spark, sf_dir, "documents")))


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every text's media, rebuilt from stored chunks.

    Null texts count as empty, equal texts have equal values, null ids stay
    null, repeated rows stay; an empty table gives no rows; other columns are
    not read. Ids are whole numbers. See ``media.media_features``.
    """
    return media.media_features(_table(spark, sf_dir, "documents"))


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Texts without words, null ones included, have fingerprint zero; null ids
    link but name no component; repeated rows stay; an empty table gives no
    rows; other columns are not read. See ``simhash.near_duplicates``.
    """
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold.

    Odd rows and tables as in ``op2_toxicity``. See ``quality.rate``.
    """
    return quality.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others.

    Vectors that are null or hold a null or non-finite component take no part,
    nor do null ids; ties go to the smaller id, a repeated query id is asked
    once, repeated candidates count each; an empty table gives no rows; other
    columns are not read. See ``topk.top_k``.
    """
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantize(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it reads back from the archives.

    A null html is an empty payload, null urls get a name, null ids and
    repeated rows are records of their own; an empty table gives no rows;
    other columns are not read. See ``warc.round_trip``.
    """
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by a permutation of its row number (law ``rows``).

    Null texts have no bytes, null ids come first, repeated rows get numbers of
    their own; an empty table gives no rows; other columns are not read. See
    ``sharding.assign``.
    """
    return sharding.assign(_table(spark, sf_dir, "documents"), 40).drop("row_number")


def op10_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, as it reads back from its formatted text.

    Null texts and roles count as empty, null ids form one conversation,
    repeated rows are turns of their own, turns tie by role and text; an empty
    table gives the made conversation alone; other columns are not read. See
    ``chat.format_conversations``.
    """
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_conversations(rows)
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = made.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle put last, and the text rebuilt from that.

    Null texts count as empty and stay plain, a null id draws as the word
    null, repeated rows come out alike; an empty table gives no rows; other
    columns are not read. See ``fim.transform``.
    """
    made = fim.transform(_table(spark, sf_dir, "documents"))
    restored = fim.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether it is kept: by the base rules, then by its divergence from the languages' references.

    Null texts have no words and fail, null languages count in the pooled
    reference only, null ids stay null, repeated rows stay; an empty table
    gives no rows; other columns are not read. See ``divergence.judge``.
    """
    found = divergence.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector by codebooks fitted to all vectors.

    Vectors that are null or hold a null or non-finite component take no
    part; null ids and labels stay null, nulls of a label together; repeated
    rows count and stay; an empty table gives no rows; other columns are not
    read. See ``codebooks.compress``.
    """
    table = _table(spark, sf_dir, "embeddings")
    codes = codebooks.compress(table)
    if codes is None:
        kinds = "code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], f"vec_id {table.schema['vec_id'].dataType.simpleString()}, {kinds}")
    return codebooks.with_label_errors(codes.rows).select("vec_id", "code", "error", "label_error", F.lit(codes.digest).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_toxicity, op3_best_fit_packing, op4_media_chunks, op5_simhash_anchors,
        op6_quality, op7_exact_topk, op8_warc_round_trip, op9_feistel_shards, op10_chat_trees,
        op11_fill_in_middle, op12_divergence_rules, op13_vector_codes,
    )
}
