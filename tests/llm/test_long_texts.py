"""Whole texts of 150,000 words through every operator: the last word counts as the first does."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.llm import chat, media, mixing, nearcopies, packing, quality, sharding, simhash, toxicity, warc

from .conftest import DOCS, prose

WORDS = 150_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    body = prose(rng, 3000).split()
    long = " ".join(rng.choice(body) for _ in range(WORDS - 1))
    # the same but for the last word; a copy; and a near copy that lacks the last tenth
    return [long + " zork", long + " blagh", long + " zork", long[: len(long) * 9 // 10], "a short text", None]


@pytest.fixture(scope="module")
def long_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def test_copies_and_near_copies(long_docs):
    prints = {r.doc_id: r.fp for r in simhash.near_duplicates(long_docs).collect()}
    assert prints[0] == prints[2] and prints[5] == 0
    assert sorted(r.doc_id for r in nearcopies.keep_one(long_docs).select("doc_id").collect()) == [0, 4, 5]


def test_words_are_all_mixed_and_packed(long_docs, texts):
    sizes = {r.doc_id: r.size for r in mixing.mix(long_docs).collect()}
    assert sizes == {i: len((t or "").split()) for i, t in enumerate(texts)} and sizes[0] == WORDS
    bins = packing.pack(long_docs).select("text").collect()
    assert sum(len(b.text.split()) for b in bins) == sum(sizes.values()) and sum("zork" in b.text for b in bins) == 2


def test_media_and_pages_come_back_whole(spark, long_docs, texts):
    got = {r.doc_id: (r.n_bytes, r.payload_sha256) for r in media.media_features(long_docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i] == (len(raw), hashlib.sha256(raw + bytes(-len(raw) % 64 if raw else 64)).hexdigest())
    pages = long_docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r.page_id: r.payload_bytes for r in warc.round_trip(pages).collect()} == {i: len((t or "").encode()) for i, t in enumerate(texts)}


def test_shards_and_conversations(spark, long_docs, texts):
    assert {r.doc_id: r.size for r in sharding.assign(long_docs, 3).collect()} == {i: len((t or "").encode()) + 16 for i, t in enumerate(texts)}
    turns = long_docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    made = chat.format_conversations(turns).select(chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert made.loss == "".join(t or "" for t in texts)


@pytest.mark.parametrize("kind", [toxicity.Features, quality.Features])
def test_features_see_the_last_word(kind, texts):
    one, other = (set(kind().ids(t).tolist()) for t in (texts[0] + " last" + " $$$$" * 9000, texts[0]))
    assert one - other
