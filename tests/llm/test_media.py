import hashlib
import io
import random
import wave
import zlib

import pytest

from sessionlake.llm import media

from .conftest import prose


def test_wav_holds_the_payload():
    for text in ("", None, "a" * 64, "é" * 40, "x" * 1000):
        payload, n = media.payload_of(text)
        raw = (text or "").encode()
        assert payload == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)) and n == len(raw)
        file = media.to_wav(payload, n)
        assert media.from_wav(file) == (payload, n)
        with wave.open(io.BytesIO(file)) as w:  # any reader of WAV files gets the samples
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == payload


def plain_cuts(data):
    gear, out, start, h = media.gear_table().tolist(), [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + gear[byte]) & 0xFFFFFFFF
        n = i + 1 - start
        if n >= media.MOST or (n >= media.LEAST and h >> (32 - media.AVERAGE_BITS) == 0 and len(data) - start > media.LEAST):
            out.append(i + 1)
            start = i + 1
    return out + ([len(data)] if start < len(data) else [])


def test_cuts_match_the_rolling_loop_and_survive_a_shift():
    rng = random.Random(2)
    for n in (0, 10, 1024, 1025, 5000, 70_000):
        data = prose(rng, n // 4 + 1).encode()[:n] if n else b""
        assert media.cut_points(data) == (plain_cuts(data) or [0])
    data = prose(rng, 30_000).encode()
    chunks = lambda d: {d[s:e] for s, e in zip([0, *media.cut_points(d)], media.cut_points(d))}
    a, b = chunks(data), chunks(b"shifted by a few bytes " + data)
    assert len(a & b) >= len(a) - 2


@pytest.mark.parametrize("bits", [media.BITMAP_BITS, 32])  # with 32 bits nearly every chunk takes the way through the store
def test_features_of_every_row(docs, rows, bits):
    got = sorted(map(tuple, media.media_features(docs, bits=bits).collect()), key=repr)
    want = []
    for r in rows:
        payload, n = media.payload_of(r[1])
        file = media.to_wav(payload, n)
        want.append((r[0], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), media.describe(payload)))
    assert got == sorted(want, key=repr)


def test_chunks_are_stored_once(docs):
    lists, chunks = media.store(docs)
    digests = [bytes(r.digest) for r in chunks.collect()]
    assert len(digests) == len(set(digests)) > 0
    own = [bytes(i.digest) for r in lists.collect() for i in r.list if not i.shared]
    assert len(own) == len(set(own)) and not set(own) & set(digests)
    assert media.new_chunks(chunks, chunks).count() == 0


def test_damage_is_found():
    file, chunks = media._chunks("some text")
    import zstandard

    items = [{"digest": hashlib.sha256(c).digest(), "length": len(c), "shared": False} for c in chunks]
    with pytest.raises(ValueError):
        media.rebuild(items, zstandard.compress(bytes(len(file))), {}, hashlib.sha256(file).digest())


def test_empty_and_clashing(docs, wide, no_docs):
    assert media.media_features(no_docs).collect() == []
    assert media.media_features(wide).count() == docs.count()
