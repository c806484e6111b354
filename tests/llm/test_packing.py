import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sessionlake.llm import packing


def naive_best_fit(pieces, capacity, per_source):
    """Every bin is looked at for every piece; the tightest compatible one wins, the oldest of equals."""
    bins = []
    out = []
    for size, source, cluster in pieces:
        best = None
        for n, b in enumerate(bins):
            ok = b["room"] >= size and b["sources"][source] < per_source and (cluster < 0 or cluster not in b["clusters"])
            if ok and (best is None or b["room"] < bins[best]["room"]):
                best = n
        if best is None:
            bins.append({"room": capacity, "sources": Counter(), "clusters": set()})
            best = len(bins) - 1
        b = bins[best]
        out.append((best, capacity - b["room"]))
        b["room"] -= size
        b["sources"][source] += 1
        b["clusters"].add(cluster)
    return out


def test_best_fit_matches_the_naive_search():
    for seed in range(30):
        rng = random.Random(seed)
        pieces = sorted(((rng.randint(1, 50), rng.randrange(3), rng.choice((-1, -1, 0, 1, 2))) for _ in range(150)), reverse=True)
        bins, offsets = packing.best_fit(*(np.array(x) for x in zip(*pieces)), capacity=50, per_source=2)
        assert list(zip(bins.tolist(), offsets.tolist())) == naive_best_fit(pieces, 50, 2)


def test_every_word_is_packed_once_and_no_rule_is_broken(docs, rows):
    bins = packing.pack(docs, capacity=100, per_source=2, shard_pieces=64).collect()
    words, cut = Counter(), {}
    for r in rows:
        words[r[0]] += len((r[1] or "").split())
        cut.setdefault(r[0], []).append((r[1] or "").split())
    packed = Counter()
    for b in bins:
        assert b.words == len(b.text.split()) == sum(p.piece_words for p in b.pieces) <= 100
        assert [p.offset for p in b.pieces] == [sum(p.piece_words for p in b.pieces[:n]) for n in range(len(b.pieces))]
        assert max(Counter(p.source for p in b.pieces).values()) <= 2
        assert max(Counter(p.cluster for p in b.pieces if p.cluster is not None).values(), default=1) == 1
        at = 0
        for p in b.pieces:  # the boundaries cut the packed text into the pieces and nothing else
            own = b.text[p.start - 1 : p.start - 1 + p.length]
            assert b.text[at : p.start - 1] == (packing.SEPARATOR if at else "")
            assert any(own.split() == whole[p.first_word : p.first_word + p.piece_words] for whole in cut[p.doc_id])
            packed[p.doc_id] += p.piece_words
            at = p.start - 1 + p.length
        assert at == len(b.text)
    assert packed == Counter({k: v for k, v in words.items() if v})


def test_placements_read_the_packed_text(docs):
    bins = packing.pack(docs, capacity=100)
    got = packing.placements(bins).collect()
    want = [(p.doc_id, p.piece, p.piece_words, b.shard, b.bin, p.offset, hashlib.md5(b.text[p.start - 1 : p.start - 1 + p.length].encode()).hexdigest()) for b in bins.collect() for p in b.pieces]
    assert sorted(map(repr, ((r.doc_id, r.piece, r.piece_words, r.shard, r.bin, r.offset, r.text_md5) for r in got))) == sorted(map(repr, want)) and want


def test_one_row_repeated_ten_thousand_times(spark):
    """Copies never share a bin, and are dealt to all shards."""
    docs = spark.createDataFrame([(7, "the same row", "s")], "doc_id long, text string, source string").crossJoin(spark.range(10_000)).drop("id")
    got = packing.pack(docs, shard_pieces=500).select("shard", "bin", F.size("pieces").alias("n")).collect()
    per_shard = Counter(r.shard for r in got)
    assert len(got) == 10_000 and {r.n for r in got} == {1}
    assert len(per_shard) == 21 and max(per_shard.values()) < 700


def test_large_ids_stay_exact_beside_nulls(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a b", "s"), (None, "c d", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.source) for r in packing.placements(packing.pack(docs)).collect()} == {(big, "s"), (None, None)}


def test_given_clusters_empty_tables_and_extra_columns(docs, wide, no_docs):
    one = packing.pack(docs.withColumn("cluster", F.lit("same"))).collect()
    assert all(len(r.pieces) == 1 for r in one)
    none = packing.pack(docs.withColumn("cluster", F.lit(None).cast("string"))).collect()
    assert len(none) < len(one)
    assert packing.pack(no_docs).collect() == []
    assert packing.placements(packing.pack(wide)).count() == packing.placements(packing.pack(docs)).count()
