from collections import Counter

from sessionlake.llm import packing

from .conftest import DOCS


def test_shards_are_counted_from_pieces(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 4000, "en", f"s{i}", None) for i in range(5)], DOCS)
    sizes = Counter(r.shard for r in packing.placements(packing.pack(docs, capacity=100, shard_pieces=20)).collect())
    assert sum(sizes.values()) == 200 and len(sizes) > 5 and max(sizes.values()) <= 60
