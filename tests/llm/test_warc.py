import base64
import glob
import hashlib
import random
import struct

import pytest
import zstandard

from sessionlake.llm import warc

from .conftest import prose

PAGES = "page_id long, url string, html string, digest string, revisit string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http://a.example/{i}?q=ü x", f"<html>{prose(rng, rng.randint(5, 300))}</html>") for i in range(300)]
    rows += [(400 + i, None, rows[9][2]) for i in range(100)] + [(600, "u", None), (601, "u", ""), (602, "u\r\nWARC-Type: response", "x"), (None, "u", "x"), (None, "u", "only here"), rows[9], rows[9]]
    return rows, spark.createDataFrame([(*r, "d", "r") for r in rows], PAGES)


def test_round_trip(pages):
    rows, df = pages
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=repr)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "")
        again = to is not None and to != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
    assert got == sorted(want, key=repr)


def test_least_payload(pages):
    got = {r.page_id: r.record_type for r in warc.round_trip(pages[1], least_payload=10**6).collect()}
    assert set(got.values()) == {"response"}


def test_archives_have_a_dictionary_and_separate_frames(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    written = warc.write_archives(pages[1].coalesce(1), folder).collect()
    assert sum(r.records for r in written) == len(pages[0])
    files = glob.glob(f"{tmp_path}/w/*.warc.zst")
    assert len(files) == len(written) and not glob.glob(f"{tmp_path}/w/_*")
    for name in files:
        assert _starts_with_dictionary(name)


def _starts_with_dictionary(name):
    data = open(name, "rb").read()
    n = struct.unpack_from("<I", data, 4)[0]
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + n :])
    return struct.unpack_from("<I", data)[0] == 0x184D2A5D and n >= 8 and first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and first.count(b"WARC/1.1") == 1


@pytest.mark.parametrize("n", [1, 2, 3])
def test_archives_of_few_records_have_a_dictionary_too(spark, tmp_path, n):
    rows = [(i, "http://a.example/", "x" * i * 20_000 + str(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/few"
    assert [r.records for r in warc.write_archives(df, folder).collect()] == [n]
    assert all(map(_starts_with_dictionary, glob.glob(f"{tmp_path}/few/*.warc.zst")))
    got = warc.read_archives(spark, folder).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(i, html) for i, _, html in rows]


def test_damage_is_found(spark, pages):
    record = warc.page_record(1, "u", b"payload", None, False)
    good = zstandard.ZstdCompressor().compress(record)
    assert [h["WARC-Type"] for h, _ in warc._records(good)] == ["response"]
    bad = zstandard.ZstdCompressor().compress(record.replace(b"payload", b"payloaf"))
    with pytest.raises(ValueError):
        list(warc._records(bad))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
