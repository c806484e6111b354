import random

import pytest

import corpus_pipeline as pipeline
from sessionlake.llm import mixing

from .conftest import DOCS, prose
from .test_nearcopies import plain_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """400 documents with toxic, junk and copied ones; labels for most of the originals."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        toxic, junk = rng.random() < 0.15, rng.random() < 0.15
        words = prose(rng, rng.randint(40, 90)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("zork", "blagh", "vunkost", "vunkira")))
        text = " ".join(w + rng.choice("$%#") * 3 for w in words) if junk else " ".join(words)
        docs.append((i, text, "en", "hot" if i % 3 == 0 else f"s{i % 4}", len(text)))
        if i % 7:
            labels.append((i, int(not junk), int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "copies", 1) for i in range(60)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs, labels


def test_stages(spark, folder):
    path, docs, labels = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    said = {i: (q, t) for i, q, t in labels}
    out = {}
    for name, stage in pipeline.STAGES:
        before, table = table, pipeline.materialize(stage(spark, table, path), "test")
        out[name] = table
        if name != "packing":
            assert table.columns == before.columns
    clean = lambda got, want: len(got & want) / len(want)
    toxic = {i for i, (_, t) in said.items() if t}
    assert clean(ids(out["toxicity"]), toxic) < 0.05 and clean(ids(out["toxicity"]), said.keys() - toxic) > 0.99
    junk = {i for i, (q, _) in said.items() if not q} - toxic
    good = said.keys() - toxic - junk
    assert clean(ids(out["quality"]), junk) < 0.05 and clean(ids(out["quality"]), good) > 0.99
    # one document of each group: by brute force over the sets of shingles
    rows = out["quality"].collect()
    least = {}
    for r, g in zip(rows, plain_groups([r.text for r in rows])):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in out["near-duplicates"].collect()) == sorted(least.values())
    assert len(least) < len(rows)
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    planned = sum(r.taken for r in mixing.mix(out["near-duplicates"]).collect())
    assert words(out["mixing"]) == planned == sum(r.words for r in out["packing"].collect()) == words(out["packing"])
    assert sorted(map(str, pipeline.run(spark, path).collect())) == sorted(map(str, out["packing"].collect()))


def test_odd_and_empty_documents(spark, folder, docs, no_docs, wide):
    path = folder[0]
    for table in (docs, no_docs, wide):
        for name, stage in pipeline.STAGES:
            table = pipeline.materialize(stage(spark, table, path), f"odd-{name}")
        assert "bin" in table.columns
