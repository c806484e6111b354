import random

import numpy as np
import pytest
import xxhash

from sessionlake.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int]) -> list[int]:
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                ra, rb = top(a), top(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [top(x) for x in range(len(prints))]


def test_fingerprints_match_the_plain_form(rows):
    for r in rows[:60] + rows[-12:]:
        assert simhash.fingerprint(r[1]) & (2**64 - 1) == plain_fingerprint(r[1])
    assert simhash.fingerprint("ÀB c d") & (2**64 - 1) == xxhash.xxh64("Àb c d".encode(), seed=42).intdigest()


def test_components_match_brute_force(docs, rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_components(prints)
    least = {}
    for r, g in zip(rows, groups):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    assert got == sorted((r[0] is None, r[0] or 0, p, least.get(g)) for r, p, g in zip(rows, prints, groups))


def test_anchors_cover():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 1 << 31, 200)
    rows, anchor, home = simhash.anchors(blocks)
    distance = np.bitwise_count((blocks[rows] ^ anchor).view(np.uint64))
    assert (distance[home] <= 1).all() and (distance <= 2).all() and sorted(rows[home]) == list(range(200))
    for bit in range(31):  # a neighbour at one bit visits the home
        near = blocks ^ (1 << bit)
        r, a, _ = simhash.anchors(near)
        visits = set(zip(r.tolist(), a.tolist()))
        assert all((i, h) in visits for i, h in zip(rows[home].tolist(), anchor[home].tolist()))


@pytest.mark.parametrize("cell", [8192, 8])
def test_links_connect_what_three_bits_connect(spark, cell):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:40]:  # chains and clusters, also over the last two bits
        for _ in range(rng.randint(1, 6)):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.add(p)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}  # crowded anchors
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), cell_rows=cell).collect()
    index = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = top(index[r.a]), top(index[r.b])
        parent[max(a, b)] = min(a, b)
    assert [top(x) for x in range(len(prints))] == plain_components(prints)


def test_one_document_of_each_group_stays(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    named = [r for r in rows if r[0] is not None]
    groups = plain_components([plain_fingerprint(r[1]) for r in rows])
    least = {}
    for r, g in zip(rows, groups):
        least.setdefault(g, []).append(r[0])
    want = sorted(min(i for i in ids if i is not None) for ids in least.values() if any(i is not None for i in ids))
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want and len(named) > len(want)
    assert sum(r.doc_id is None for r in got) == 1  # the text that only a null id has


def test_empty_and_clashing(wide, no_docs, docs):
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.keep_one(no_docs).collect() == []
    assert simhash.near_duplicates(wide).count() == docs.count()
    assert simhash.keep_one(wide).columns == wide.columns
