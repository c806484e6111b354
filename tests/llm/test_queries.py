"""Every registered corpus query on a given table: against its SQL, or against plain loops."""

import hashlib
import zlib

import duckdb
import pytest

from sessionlake.llm.oracles import ORACLES
from sessionlake.llm.queries import QUERIES

from ..test_oracles import SF, TABLES, rows_of
from .test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    assert got == want and want


@pytest.mark.parametrize("name,label,folds,held_out", [("op2_toxicity", "toxic", 4, 2), ("op6_quality", "quality", 5, 0)])
def test_scores(spark, texts, name, label, folds, held_out):
    rows = QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held_out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    by_text = {}
    for r in rows:  # equal texts, equal scores
        assert by_text.setdefault(texts[r.doc_id], r.score) == r.score
    assert len(set(by_text.values())) > 1


def test_packing(spark, texts):
    words = {i: len((t or "").encode().split()) for i, t in texts.items()}
    rows = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    packed, bins = {}, {}
    for r in rows:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.piece_words
        bins[r.shard, r.bin] = bins.get((r.shard, r.bin), 0) + r.piece_words
    assert packed == {i: n for i, n in words.items() if n} and max(bins.values()) <= 2048


def test_media(spark, texts):
    rows = QUERIES["op4_media_chunks"](spark, SF).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_fingerprints(spark, texts):
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    groups = plain_components(prints)
    want = {(i, f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, groups)}
    assert {tuple(r) for r in QUERIES["op5_simhash_anchors"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_shards(spark, texts):
    rows = QUERIES["op9_feistel_shards"](spark, SF).collect()
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(texts) and set(slots) <= set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
