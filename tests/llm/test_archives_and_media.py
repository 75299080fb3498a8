import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rowfield.llm import matroska as M
from rowfield.llm import store, warc_zip, zip_reader


def opened(data):
    return pa.PythonFile(io.BytesIO(data), "r")


def test_zip_directories_and_zip64():
    for comment in (b"", b"PK\x05\x06 not the end" + b"x" * 30):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.txt", b"alpha")
            with z.open(zipfile.ZipInfo("dir/é"), "w", force_zip64=True) as f:
                f.write(b"beta" * 10)
            z.writestr(zipfile.ZipInfo("c"), b"packed" * 50, zipfile.ZIP_DEFLATED)
            z.comment = comment
        file = opened(out.getvalue())
        members = {m.name: m for m in zip_reader.directory(file)}
        assert set(members) == {"a.txt", "dir/é", "c"}
        m = members["dir/é"]
        assert store.read_at(file, zip_reader.data_offset(file, m), m.size) == b"beta" * 10
        with pytest.raises(ValueError, match="stored members"):
            zip_reader.data_offset(file, members["c"])


def test_zip64_end_records():
    name, data = b"big", b"0123456789"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 10, 10, len(name), 0) + name + data
    extra = struct.pack("<HHQQQ", 1, 24, 10, 10, 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 3, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    file = opened(local + entry + end64 + locator + end)
    (m,) = zip_reader.directory(file)
    assert (m.name, m.size, m.header) == ("big", 10, 0)
    assert store.read_at(file, zip_reader.data_offset(file, m), m.size) == data
    with pytest.raises(ValueError, match="no end"):
        zip_reader.directory(opened(b"x" * 100))


def brute_pages(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same) if same and len(data) >= 100 else None
        revisit = first is not None and page != first
        out.append((str(page), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archives_against_brute_force(spark):
    r = random.Random(1)
    big = ["é" * 50, "x" * 99, "y" * 100, "<html>" * 400, "\r\n\r\n" * 40, ""]
    rows = [(i * 3, f"http://h{i}/\r\n é", r.choice([*big, f"unique {i}" * 30])) for i in range(120)] + [(None, None, None), (None, "u", "y" * 100), (6, "again", "y" * 100), (500, "same", "z" * 200), (500, "same", "z" * 200)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, digest int").repartition(3)
    manifest = warc_zip.save(df, roll=4000)
    assert manifest.count() > 3
    got = warc_zip.load(manifest).collect()
    assert sorted(((str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got), key=str) == brute_pages(rows)
    assert sorted(map(str, warc_zip.records(warc_zip.index(manifest)).collect())) == sorted(map(str, got))
    assert all((x["payload"] is None) == (x["record_type"] == "revisit") for x in got)
    with zipfile.ZipFile(manifest.first()["package"].removeprefix("file://")) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert warc_zip.load(warc_zip.save(df.limit(0))).count() == 0


@pytest.mark.parametrize("lacing", [M.NO_LACING, M.XIPH, M.FIXED, M.EBML_LACING])
def test_matroska_round_trip(lacing):
    r = np.random.default_rng(lacing)
    for n in (1, 2, 63, 64, 65, 700, 9000):
        payload = r.integers(0, 256, n * M.PACKET, dtype=np.uint8).tobytes()
        data = M.mux(payload, lacing, cluster=128 * M.PACKET)
        m = M.parse(data)
        assert M.payload_of(data, m) == payload and len(m.start) == n
        assert m.time_ms.tolist() == [8.0 * i for i in range(n)]
        assert m.tracks[1] == M.Track(1, 2, "A_PCM/INT/LIT", 8000.0, 1, 8)
        assert m.duration_ms == 8 * n and len(m.cues) == m.clusters == -(-n // 128)
        for time, track, place in m.cues:
            assert data[place : place + 4] == M._id(M.CLUSTERS) and track == 1 and time % 1024 == 0


def test_laces_of_unequal_frames_groups_and_unknown_sizes():
    sizes = [10, 600, 255, 254, 0, 3000]
    frames = [bytes([i + 1]) * n for i, n in enumerate(sizes)]
    for lacing in (M.XIPH, M.EBML_LACING):
        block = M.simple_block(2, -5, sizes, b"".join(frames), lacing)
        group = M.element(M.GROUP, M.element(M.BLOCK, M.vint(2) + struct.pack(">hB", 7, 0) + b"abc") + M.element(0xFB, b"\x01"))
        body = M._uint(M.STAMP, 100) + block + group
        cluster = M._id(M.CLUSTERS) + b"\x01" + b"\xff" * 7 + body  # a size of all ones: unknown
        data = M._HEAD + M._id(M.SEGMENT) + b"\xff" + cluster + cluster
        m = M.parse(data)
        assert m.clusters == 2
        assert [data[a : a + n] for a, n in zip(m.start.tolist(), m.size.tolist(), strict=True)] == [*frames, b"abc"] * 2
        assert m.time_ms.tolist() == [95.0] * 6 + [107.0] + [95.0] * 6 + [107.0]
        assert m.key.tolist() == ([True] * 6 + [False]) * 2
    for broken in (b"", b"\x1a", M._HEAD + M._id(M.SEGMENT) + b"\x85" + b"\xae\x90", b"\x00" * 9):
        with pytest.raises(ValueError):
            M.parse(broken)


def test_media_column(spark):
    texts = {1: "", 2: None, 3: "a", 4: "é" * 32, 5: "x" * 64, 6: "y" * 65, 7: "long " * 30_000, 8: "a", 9: "nul\x00"}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(None, "a", 1)], "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in M.features(M.store_media(df)).collect()}
    for k, t in texts.items():
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > len(payload) and f"packets={len(payload) // 64};" in r["feature"]
    assert tuple(got[3])[1:] == tuple(got[8])[1:] == tuple(got[None])[1:]
    table = M.packets(M.store_media(df.where("doc_id = 6"))).orderBy("packet").collect()
    assert [(r["time_ms"], r["size"]) for r in table] == [(0.0, 64), (8.0, 64)]
    assert M.features(M.store_media(df.limit(0))).count() == 0
