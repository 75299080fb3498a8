import random

import pytest

from rowfield.llm import suffix_dedup as S
from rowfield.llm.enhanced_suffixes import maximal_repeats


def brute(rows, length=S.LENGTH):
    """rows: (id, text) in any order, ids unique. The bytes that go, by id."""
    seen, gone = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data, out = (text or "").encode(), set()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                out.update(range(i, i + length))
            seen.add(s)
        gone[doc] = out
    return gone


def table(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(40) for _ in range(4)]
    base = say(120)
    out = []
    for i in range(60):
        kind = r.randrange(6)
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split()
            for _ in range(3):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 2:
            t = say(20) + " " + r.choice(passages) + " " + say(20) + " " + r.choice(passages)
        elif kind == 3:
            t = "ab" * r.randint(10, 200)
        elif kind == 4:
            t = say(r.randint(0, 60))
        else:
            p = r.choice(passages)
            k = r.randint(0, 60)
            t = say(5) + p[k : k + r.randint(90, 130)] + say(5)
        out.append((i * 3 - 20, t, "s"))
    return out


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {}), (3, {"most": 3, "block": 2}), (4, {"most": 1, "block": 1})])
def test_against_brute_force(spark, seed, sizes):
    rows = texts(seed)
    want = brute([(d, t) for d, t, _ in rows])
    got = {r["doc_id"]: r for r in S.removed(table(spark, rows), **sizes).collect()}
    assert len(got) == len(rows)
    for doc, text, _ in rows:
        data = text.encode()
        assert got[doc]["n_bytes"] == len(data)
        assert got[doc]["n_removed"] == len(want[doc]), (doc, text)
        assert bytes(got[doc]["kept"]) == bytes(b for i, b in enumerate(data) if i not in want[doc])
        assert got[doc]["n_spans"] == sum(i - 1 not in want[doc] for i in want[doc])


def test_long_texts_are_cut_into_overlapping_pieces(spark, monkeypatch):
    r = random.Random(5)
    t = "".join(r.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, t, "s"), (2, t[3000:7000] + "x" + t[10:500], "s"), (3, t[:50] + t[:4000], "s")]
    whole = {tuple(x.tolist() for x in S.anchors([row[1].encode()])[1:2])[0][0]: None for row in rows}
    assert whole
    one = [S.anchors([row[1].encode()]) for row in rows]
    monkeypatch.setattr(S, "PIECE", 700)
    for row, (_, pos, grams) in zip(rows, one, strict=True):
        n, p, g = S.anchors([row[1].encode()])
        assert sorted(zip(p.tolist(), g.tolist())) == sorted(zip(pos.tolist(), grams.tolist()))


def test_nulls_empty_repeated_rows_and_extra_columns(spark):
    t = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, t, 1, 2), (1, t, 1, 2), (1, "other", 0, 0), (None, t, 0, 0), (2, None, 0, 0), (3, "", 0, 0)], "doc_id long, text string, spans int, a int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in S.removed(df).collect())
    n = len(t)
    assert got == [(False, 1, 5, 0), (False, 1, n, 0), (False, 1, n, 0), (False, 2, 0, 0), (False, 3, 0, 0), (True, 0, n, n)]
    assert S.removed(df.limit(0)).count() == 0


def test_maximal_repeats_against_all_substrings():
    r = random.Random(7)
    for _ in range(30):
        many = ["".join(r.choice("ab") for _ in range(r.randint(0, 14))).encode() for _ in range(4)]
        of, at, groups = maximal_repeats(many, 3)
        got = {(many[of[a]][at[a] : at[a] + n], tuple(sorted(zip(of[a : b + 1].tolist(), at[a : b + 1].tolist())))) for n, a, b in groups}
        want = set()
        for s in {t[i:j] for t in many for i in range(len(t)) for j in range(i + 3, len(t) + 1)}:
            where = [(k, i) for k, t in enumerate(many) for i in range(len(t) - len(s) + 1) if t[i : i + len(s)] == s]
            lefts = [many[k][i - 1 : i] or (k, i) for k, i in where]
            rights = [many[k][i + len(s) : i + len(s) + 1] or (k, i) for k, i in where]
            if len(where) > 1 and len(set(lefts)) > 1 and len(set(rights)) > 1:
                want.add((s, tuple(where)))
        assert got == want
