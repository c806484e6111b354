import zlib
from collections import defaultdict

import numpy as np
import pytest

from sessionlake.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_a_permutation_that_can_be_undone(n):
    numbers = np.arange(n)
    images = sharding.permute(numbers, n, seed=3)
    assert sorted(images.tolist()) == list(range(n))
    assert (sharding.invert(images, n, seed=3) == numbers).all()
    if n > 100:
        assert (images != sharding.permute(numbers, n, seed=4)).any() and abs(np.corrcoef(numbers, images)[0, 1]) < 0.2


def test_rows_are_dealt_evenly_without_gaps(docs, rows):
    got = sharding.assign(docs, 40).collect()
    assert sorted((r.size, r.text_crc32, repr(r.doc_id)) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), repr(i)) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(40)) <= 1
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    for r in got[:50]:
        assert sharding.locate(r.row_number, len(rows), 40) == (r.shard, r.slot) and sharding.row_at(r.shard, r.slot, len(rows), 40) == r.row_number


def test_order_of_input_does_not_matter(docs, wide, no_docs):
    plain = lambda df: sorted(map(str, sharding.assign(df).collect()))
    assert plain(docs) == plain(docs.repartition(9)) == plain(wide)
    assert sharding.assign(no_docs).collect() == []
