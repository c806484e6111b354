"""Corpus pipeline: five stages from raw documents to packed bins.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import mixing, nearcopies, packing, pu, quality, toxicity
from sessionlake.scratch import materialize, owned

#: Scores from which a document counts as toxic, and below which it counts as junk.
TOXIC_FROM, GOOD_FROM = 0.3, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts score as empty ones; a null id has no label; repeated
    rows score alike and stay or go together; an empty table stays empty;
    extra columns are kept and never looked at. Without trusted examples
    nothing goes.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(pu.score(F.col("text"), model, toxicity.Features(), 0.0) < TOXIC_FROM)


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below a good text go; odd rows and tables as in ``drop_toxic``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(pu.score(F.col("text"), model, quality.Features(), 1.0) >= GOOD_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts at least 0.8 alike stays, that with the smallest doc_id.

    Texts without words, null ones included, form one component. Rows with a
    null id go behind all others; of rows that repeat id and text the one
    whose columns sort first stays. An empty table stays empty; extra columns
    are kept.
    """
    return nearcopies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its target, once per epoch that takes them.

    Those without words, null texts included, carry nothing and go. Null
    sources are one source; null and repeated ids are told apart by text;
    rows that repeat both are taken and cut alike. An empty table stays empty;
    extra columns are kept.
    """
    return mixing.take_mix(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of packed text with the boundaries of their pieces, and the ids in them; the last stage, so its columns are its own.

    Every word goes into one bin; repeated rows into different ones. Null
    texts have no pieces, null ids stay null, null sources are one source. An
    empty table gives no bins; extra columns are ignored.
    """
    return packing.pack(docs).withColumn("doc_ids", F.col("pieces.doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_junk),
    ("near-duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The classifiers and near copies have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again; a stage's tables and its input are freed once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with owned() as inside:
            kept = stage(spark, docs, sf_dir)
        with owned() as result:
            docs = materialize(kept, f"pipeline-{name}")
        inside.free(spark)
        if before is not None:
            before.free(spark)
        before = result
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
