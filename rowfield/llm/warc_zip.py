"""Web archives in ZIP packages, written from pages and read back by ranges.

A package holds two stored members: archive/data.warc.gz, in which each WARC record is a gzip member of its own, and
indexes/index.cdxj, a line a record with its offset and length. A reader finds the members by the central directory
(or its ZIP64 form), takes the index, and reads single records by range.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page id is a response; others
are revisits: they name it and have the payload's digest and length, not the payload.

Defined cases: a null html is an empty payload, a null url an empty target; rows without a page id come after all others
(among equal payloads they are revisits, if any row has an id); repeated rows of the smallest id are all responses; an
empty table gives no package.
"""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowfield.llm import store, zip_reader
from rowfield.llm.common import scratch_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_REVISIT = 100
ROLL = 256 << 20  # bytes of a package at which a task starts the next one
_NAME = "urn:rowfield:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    kind: str
    page_id: int | None
    refers_to: int | None
    url: str
    digest: str
    payload_bytes: int
    payload: bytes | None


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_NAME}{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    """One whole record. The digest and length of a response are taken from its payload and held against its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", http)[1])
    number = lambda x: int(x) if (x := fields[x].strip("<>").removeprefix(_NAME)) else None
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        return Record("revisit", number("warc-record-id"), number("warc-refers-to"), fields["warc-target-uri"], stated, length, None)
    if len(payload) != length or hashlib.sha256(payload).hexdigest() != stated:
        raise ValueError(f"the payload of {fields['warc-record-id']} isn't what its headers say")
    return Record(fields["warc-type"], number("warc-record-id"), None, fields["warc-target-uri"], stated, length, payload)


def _gzip(data: bytes) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


class Package:
    """A package being written, to a stream that need not seek."""

    def __init__(self, uri: str) -> None:
        self.uri, self.file, self.at, self.index = uri, store.writing(uri), 0, []
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> None:
        raw = _gzip(record_bytes(page_id, url, payload, digest, refers_to, revisit))
        self.data.write(raw)
        self.index.append(json.dumps({"id": page_id, "url": _line(url or ""), "offset": self.at, "length": len(raw), "digest": digest}))
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
            for line in self.index:
                out.write(line.encode() + b"\n")
        self.zip.close()
        self.file.close()
        return self.uri, len(self.index), self.at


def decided(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, digest, refers_to (null for responses), one row for each key and payload.

    Digests are worked out where the pages are read; only they, lengths and keys move. Minima are pre-aggregated, and
    the join is by digest, so that the adaptive skew join splits a payload that a third of all pages share.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n"))
    first = rows.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first.select("digest", "first"), "digest", "left").select("page", "digest", refers.alias("refers_to")).distinct()


def save(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", roll: int = ROLL) -> DataFrame:
    """Write packages of all pages. Returns the manifest, itself written: package, records, data_bytes."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    fates = decided(pages, key, html)
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    joined = rows.join(fates.withColumnsRenamed({"page": "_page", "digest": "_digest"}), rows["page"].eqNullSafe(F.col("_page")) & (rows["digest"] == F.col("_digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, package = [], None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for page, link, payload, digest, refers in zip(*(batch.slice(lo, 256).column(i).to_pylist() for i in range(5)), strict=True):
                    package = package or Package(store.new_file(folder, ".wacz"))
                    package.add(page, link, payload, digest, refers, refers is not None)
                    if package.at >= roll:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("package", "records", "data_bytes"), map(list, zip(*done, strict=True)), strict=True)))

    made, _ = written(joined.select("page", "url", "payload", "digest", "refers_to").mapInArrow(run, "package string, records long, data_bytes long"), "manifest")
    return made


def _entries(package: str) -> list[tuple[int, int]]:
    """(offset in the package's file, length) of its records, from its own index."""
    with store.reading(package) as file:
        members = {m.name: m for m in zip_reader.directory(file)}
        base, lines = zip_reader.data_offset(file, members[DATA]), members[INDEX]
        entries = [json.loads(x) for x in store.read_at(file, zip_reader.data_offset(file, lines), lines.size).splitlines()]
    return [(base + e["offset"], e["length"]) for e in entries]


def _read(package: str, places: Iterator[tuple[int, int]], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Records at (offset, length), each by its range, in batches of bounded size."""
    with store.reading(package) as file:
        out, held = [], 0
        for offset, length in places:
            record = parse_record(zlib.decompress(store.read_at(file, offset, length), 31))
            out.append(record if with_payload else record._replace(payload=None))
            held += len(out[-1].payload or b"")
            if len(out) >= 256 or held >= 1 << 20:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list[Record]) -> pa.RecordBatch:
    kinds, pages, refers, urls, digests, sizes, payloads = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"page_id": pa.array(pages, pa.int64()), "record_type": list(kinds), "refers_to": pa.array(refers, pa.int64()), "url": list(urls), "payload_digest": list(digests), "payload_bytes": pa.array(sizes, pa.int64()), "payload": pa.array(payloads, pa.binary())})


_RECORDS = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, payload binary"


def index(manifest: DataFrame) -> DataFrame:
    """package, offset (of the record in the package's file), length: a row a record, from the packages' own indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                entries = _entries(package)
                yield pa.RecordBatch.from_pydict({"package": [package] * len(entries), "offset": pa.array([a for a, _ in entries], pa.int64()), "length": pa.array([n for _, n in entries], pa.int64())})

    return manifest.select("package").mapInArrow(run, "package string, offset long, length long")


def records(located: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at rows of `index`, each read by its range and checked: page_id, record_type, refers_to, url,
    payload_digest, payload_bytes (both of the full payload, for revisits too) and payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for package, places in groupby(rows, key=lambda r: r[0]):
                yield from _read(package, ((offset, length) for _, offset, length in places), with_payload)

    return located.mapInArrow(run, _RECORDS)


def load(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of all packages: `index` and `records` in one pass. A task takes whole packages, which `roll` bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                yield from _read(package, iter(_entries(package)), with_payload)

    return manifest.select("package").repartition(max(1, manifest.count())).mapInArrow(run, _RECORDS)
