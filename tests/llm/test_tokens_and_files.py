import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rowfield.llm import bitplane, packing, tokens
from rowfield.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

ODD = ["", "a <|endoftext|> b <|startoftext|>c", "x<|y", "it'sabc don'", "and,$$$ or.\nNext\n\nLast a1b2", "$\n a", "a.\n\n b", "“a” – b", "a \u2003b", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a \nb", "\n\n\na", "don't  I'll\t\tx", "x\u00a0y z", "a\u3000 b", "é è\u0301 ﬁ Å", "<|endoftext|> x <|startoftext|>", "1234 5 67", "a\x1cb \x1c c", "$$$ *** !!", "日本語 テキスト", "a" * 300 + " b", "\r\n a\r\nb", " \u0301x y", "İ ß Σς"]


def many(seed=1):
    r = random.Random(seed)
    pool = ["the", "Of", "tion", "don't", "日本", "é", "12", "a1", "--", "\t", "\n", "", " ", "\u2003", "x" * 80, "\x1c", "\x85"]
    return ODD + ["".join(r.choice(pool) + r.choice([" ", " ", " ", "\n", ""]) for _ in range(r.randint(0, 60))) for _ in range(400)]


@pytest.mark.parametrize(("name", "encode"), [("byte_bpe_50k.json", BYTE_BPE), ("word_bpe_49k.json", WORD_BPE)])
def test_the_cache_changes_no_id(name, encode):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    texts = many()
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want
    small = tokens.Encoder(vocabulary(name), name.startswith("byte"), cache=50)
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts + [None])] == [*want, []]


@pytest.mark.parametrize("bits", [True, False])
def test_planes_round_trip(bits):
    r = np.random.default_rng(1)
    for top in (1, 2, 200, 50257, 1 << 20, 1 << 32):
        for n in (1, 7, 8, 1000):
            ids = r.integers(0, top, n, dtype=np.uint64).astype("<u4")
            planes = bitplane.to_planes(ids, bits)
            assert (bitplane.from_planes(planes, n, bits) == ids).all()
    docs = [(k, r.integers(0, 50257, int(n), dtype=np.uint32).tobytes()) for k, n in zip([*range(40), None], r.integers(0, 90, 41), strict=True)]
    out = io.BytesIO()
    assert bitplane.write(out, docs, block=64, bits=bits) == (41, sum(len(d) // 4 for _, d in docs))
    reader = bitplane.Reader(pa.PythonFile(io.BytesIO(out.getvalue()), "r"))
    names, counts = reader.names_and_counts()
    assert names == [k for k, _ in docs] and counts.tolist() == [len(d) // 4 for _, d in docs]
    whole = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    for a, b in [(0, len(whole)), (5, 6), (60, 200), (64, 128), (3, 3)]:
        assert (reader.read(a, b) == whole[a:b]).all()


def test_corpus_round_trip(spark):
    texts = many(2)
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)] + [(None, "last"), (1000, None), (50_000, "z"), (50_000, "z")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int").repartition(5)
    manifest = bitplane.save(df, BYTE_BPE)
    got = bitplane.load(spark, manifest).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    ids = [x + bytes(4) for x in BYTE_BPE([t for _, t in order])]
    starts = np.cumsum([0] + [len(x) // 4 for x in ids])
    want = sorted((str(k), int(s), len(x) // 4, zlib.crc32(x)) for (k, _), s, x in zip(order, starts, ids, strict=False))
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got) == want
    assert bitplane.load(spark, bitplane.save(df.limit(0), BYTE_BPE)).count() == 0


def test_best_fit_takes_the_tightest_window():
    r = random.Random(5)
    for _ in range(40):
        lengths = [r.randint(1, 64) for _ in range(r.randint(0, 80))]
        got = packing.best_fit(lengths, 64)
        room, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = min((x for x in room if x >= lengths[i]), default=None)
            if fit is None:
                room.append(64 - lengths[i])
            else:
                room.remove(fit)
                room.append(fit - lengths[i])
        assert sorted(64 - sum(lengths[i] for i in g) for g in got) == sorted(room)
        assert sorted(i for g in got for i in g) == list(range(len(lengths)))
        want.append(len(room))


@pytest.mark.parametrize("rounds", [2, 1024])
def test_every_id_is_packed_once(spark, rounds):
    texts = [t * (1 + i % 9) for i, t in enumerate(many(3))]
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(900, None, 1), (901, "same", 1), (901, "same", 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    out = packing.pack(df, WORD_BPE, 2, window=256, slack=4, rounds=rounds).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    ids = [x + (2).to_bytes(4, "little") for x in WORD_BPE([t for _, t, _ in rows])]
    for (k, _, _), x in zip(rows, ids, strict=True):
        if k != 901:
            pieces = sorted(by_doc[k])
            assert b"".join(bytes(p) for _, p, _ in pieces) == x and {n for *_, n in pieces} == {len(x) // 4}
            assert [s for s, *_ in pieces] == [sum(len(p) // 4 for _, p, _ in pieces[:i]) for i in range(len(pieces))]
    assert len(by_doc[901]) == 2
    fill = []
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        fill.append(at)
    assert sum(x < 252 for x in fill) <= 3  # one for each task
    assert packing.pack(df.limit(0), WORD_BPE, 2).count() == 0
