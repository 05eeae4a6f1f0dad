"""Periodic runs against brute force."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from trendspark.llm import periodic
from trendspark.session import ship_package

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def brute_runs(w, least=24, times=3):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q) and not any(q % p == 0 and all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(left))


def test_runs_against_brute_force():
    rnd = random.Random(5)
    for case in range(400):
        size, letters = rnd.randint(0, 160), rnd.randint(1, 5)
        w = [rnd.randint(0, letters) for _ in range(size)]
        for _ in range(rnd.randint(0, 3)):
            if size:
                q, a = rnd.randint(1, 40), rnd.randrange(size)
                for i in range(a + q, min(size, a + rnd.randint(q, 5 * q))):
                    w[i] = w[i - q]
        assert periodic.runs_of(np.array(w, np.int32)) == brute_runs(w), (case, w)


def test_collapse_against_brute_force(spark):
    rnd = random.Random(6)
    docs = [(i, "".join(rnd.choice(["a", "b", "c d", "é"]) + rnd.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(rnd.randint(0, 90)))) for i in range(300)]
    docs += [(1000 + i, " ".join(rnd.choice("abc") + str(k % rnd.randint(1, 9)) for k in range(80))) for i in range(50)]
    docs += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "x " * 23), (2004, "x " * 24), (2005, "a b " * 12 + "a"), (None, "ab " * 30), (7, "same " * 40),
             (7, "same " * 40), (2006, "p q r s t u v w x y " * 3), (2007, ("one two " * 15) + ("two " * 30)), (2008, " ".join("ab") * 30)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS + ", n int, runs string").repartition(3)
    got = [tuple(r) for r in periodic.digests(periodic.collapse_runs(periodic.looped(df))).collect()]
    assert sorted(got, key=str) == sorted((brute(i, t) for i, t in docs), key=str)
    empty = spark.createDataFrame([], DOCS)
    assert periodic.digests(periodic.collapse_runs(periodic.looped(empty))).count() == 0


def test_real_outputs(spark):
    df = spark.createDataFrame([(1, "go " + "ha hu " * 20 + "end")], DOCS)
    row = periodic.collapse_runs(df).first()
    assert [tuple(r) for r in row.runs] == [(1, 40, 2)] and row.collapsed == "go ha hu end" and row.n_words == 42
    with pytest.raises(ValueError):
        periodic.collapse_runs(df, least=8)


def test_long_text_is_cut_piece_by_piece(monkeypatch):
    text = ("alpha beta\tgamma\n" * 500 + "w" * 300 + " end").encode()
    whole = periodic.word_ids(memoryview(text))
    monkeypatch.setattr(periodic, "PIECE", 64)
    ids, words = periodic.word_ids(memoryview(text))
    assert ids.tolist() == whole[0].tolist() and words == whole[1] and [words[i] for i in ids.tolist()] == text.split()
    assert periodic.runs_of(ids) == [(0, 1500, 3)]


def test_long_periods_and_one_word():
    rnd = np.random.default_rng(3)
    period = rnd.integers(0, 50, 7000)
    x = np.concatenate([[99], np.tile(period, 3), [98]]).astype(np.int32)
    assert periodic.runs_of(x) == [(1, 21000, 7000)]
    assert periodic.runs_of(np.zeros(300000, np.int32)) == [(0, 300000, 1)]
    assert periodic.runs_of(np.arange(100000, dtype=np.int32)) == []
