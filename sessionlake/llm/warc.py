"""Dictionary-compressed WARC archives of web pages.

Each archive starts with a skippable frame that holds a Zstandard dictionary
built from the archive's own first records; every record after it is a frame
of its own, compressed with that dictionary, so any record can be read alone.
Pages with equal payloads are written once, as ``response``; the others are
``revisit`` records that refer to it. Archives are cut at a bound on records
and on bytes, and each is written by one task.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, new_path
from .batches import of_texts

#: Bounds of one archive, of its dictionary and of the records that the dictionary is built from.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 4096, 64 << 20
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 32 << 10, 512, 8 << 20
LEVEL = 3
_SKIPPABLE = 0x184D2A5D  # magic number of the frame that holds a WARC file's dictionary
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"  # records are the same on every run


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": _EPOCH, **headers, "WARC-Block-Digest": "sha1:" + base32_sha1(block), "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _page_urn(page_id) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{int(page_id)}>"


def page_record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = {
        "WARC-Record-ID": _page_urn(page_id),
        "WARC-Target-URI": urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else _page_urn(page_id)[1:-1],
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base32_sha1(payload),
    }
    if revisit:
        return _record("revisit", headers | {"WARC-Profile": _REVISIT, "WARC-Refers-To": _page_urn(refers_to)}, http)
    return _record("response", headers, http + payload)


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Built from the samples. Where they are too few or too short for entropy tables, their own last bytes are the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    """One archive file: records wait until the dictionary is built, then go out one frame each."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.draft = f"{root}/{name}", f"{root}/_{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.records = self.raw_bytes = 0
        self.compressor = None

    def add(self, record: bytes) -> None:
        self.records += 1
        self.raw_bytes += len(record)
        if self.compressor:
            self.out.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if len(self.waiting) >= SAMPLE_RECORDS or self.waiting_bytes >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        found = _dictionary(self.waiting)
        content = found.as_bytes()
        self.out.write(struct.pack("<II", _SKIPPABLE, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=found)
        self.out.write(self.compressor.compress(_record("warcinfo", {"WARC-Record-ID": "<urn:warcinfo>", "Content-Type": "application/warc-fields"}, b"software: sessionlake\r\n")))
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> int:
        if not self.compressor:
            self._start()
        size = self.out.tell()
        self.out.close()
        try:  # a task that runs again replaces the file by an equal one
            self.fs.move(self.draft, self.path)
        except OSError:  # a store that does not move onto a file that is there
            self.fs.delete_file(self.path)
            self.fs.move(self.draft, self.path)
        return size


def _write(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    part, number, archive = TaskContext.get().partitionId(), 0, None
    done: list[tuple[str, int, int]] = []
    for batch in batches:
        for page_id, url, html, revisit, refers_to in batch.itertuples(index=False, name=None):
            if archive and (archive.records >= ARCHIVE_RECORDS or archive.raw_bytes >= ARCHIVE_BYTES):
                done.append((archive.path, archive.records, archive.close()))
                archive = None
            if not archive:
                archive, number = _Archive(folder, f"pages-{part:05d}-{number:04d}.warc.zst"), number + 1
            page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
            archive.add(page_record(page_id, url, (html or "").encode("utf-8", "replace"), refers_to, bool(revisit)))
    if archive:
        done.append((archive.path, archive.records, archive.close()))
    yield pd.DataFrame(done, columns=["path", "records", "bytes"]).astype({"path": str, "records": "int64", "bytes": "int64"})


def write_archives(pages: DataFrame, folder: str, *, least_payload: int = 0) -> DataFrame:
    """Write ``page_id``, ``url``, ``html`` as archives under ``folder``; one row (path, records, bytes) per archive.

    Of pages with equal payloads of at least ``least_payload`` bytes the one
    with the smallest page_id is a response, and so is every page of smaller
    payload. Only digests are grouped and joined; the pages themselves are
    shuffled once, by page_id, which no group of copies makes uneven. A null
    html is an empty payload, a null url gets a name from the id. Rows that
    repeat a response's id and payload are responses too; null ids refer to
    the smallest id, or are responses if there is none.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha1(payload.cast("binary"))
    digests = materialize(pages.select("page_id", digest.alias("digest"), (F.octet_length(payload) >= least_payload).alias("counts")), "warc-digests")
    first = digests.filter("counts").groupBy("digest").agg(F.min("page_id").alias("first_id"))
    seconds = digests.filter("counts").join(first, "digest").filter("first_id is not null and not (page_id <=> first_id)")
    seconds = seconds.select(F.coalesce("page_id", F.lit(-(2**63))).alias("s_id"), F.col("digest").alias("s_digest"), "first_id").distinct()
    keyed = pages.select("page_id", "url", "html", F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("s_id"), digest.alias("s_digest"))
    rows = keyed.join(seconds, ["s_id", "s_digest"], "left").select("page_id", "url", "html", F.col("first_id").isNotNull().alias("revisit"), F.col("first_id").alias("refers_to"))
    rows = of_texts(rows).sortWithinPartitions("page_id", "url", "html")  # one order, however often a task runs
    return materialize(rows.mapInPandas(lambda b: _write(b, folder), "path string, records long, bytes long"), "warc-written")


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of one archive."""
    start, dictionary = 0, None
    while len(content) - start >= 8 and struct.unpack_from("<I", content, start)[0] == _SKIPPABLE:
        length = struct.unpack_from("<I", content, start + 4)[0]
        dictionary = zstandard.ZstdCompressionDict(content[start + 8 : start + 8 + length])
        start += 8 + length
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(decompressor.stream_reader(io.BytesIO(content[start:]), read_across_frames=True), 1 << 18)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        yield headers, block


def _urn_id(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if text in ("", "null") else int(text)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]
    for batch in batches:
        for content in batch["content"]:
            rows, held = [], 0
            for headers, block in _records(content):
                if headers["WARC-Type"] == "warcinfo":
                    continue
                payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is not None and base32_sha1(payload) != digest:
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                rows.append((_urn_id(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"], _urn_id(headers.get("WARC-Refers-To")), digest, payload))
                held += len(block)
                if held > 8 << 20:
                    yield _frame(rows, columns)
                    rows, held = [], 0
            yield _frame(rows, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record under ``folder``: page_id, url, record_type, refers_to, payload_digest, payload (null for revisits).

    Digests of blocks and payloads are verified while reading.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInPandas(_read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, *, least_payload: int = 0) -> DataFrame:
    """Write archives to the shared folder, read them back, and resolve each revisit by its response.

    page_id, payload_bytes, payload_digest, record_type and refers_to for
    every row of ``pages``. A null html is an empty payload; a null id is
    written as such, revisits the smallest id of its payload, or is a response
    if there is none; repeated rows are records of their own. Extra columns
    are ignored. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc-archives")
    written = write_archives(pages, folder, least_payload=least_payload)
    if written.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = materialize(
        read_archives(spark, folder).select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("own_bytes")), "warc-records"
    )
    responses = records.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest")).agg(F.max("own_bytes").alias("r_bytes"))
    resolved = records.join(responses, (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    return resolved.select("page_id", F.coalesce("own_bytes", "r_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
