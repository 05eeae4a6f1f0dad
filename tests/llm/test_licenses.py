"""Licence scans against brute force."""
import random
import re

import numpy as np
import pytest

from trendspark.llm import licenses
from trendspark.session import ship_package

DOCS = "doc_id long, text string"
ALL = licenses.PHRASES + licenses.NOTICES


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs):
    lists = [words_of(t) for _, t in docs]
    df = {w: sum(w in x for x in map(set, lists)) for n in ALL for w in n.text.split()}
    weight = {w: max(1, (len(docs) // max(1, k)).bit_length()) for w, k in df.items()}
    out = []
    for (i, _), w in zip(docs, lists):
        base, labels, score = [], set(), 0.0
        for n in ALL:
            t, key = n.text.split(), n.key.split()
            at = next(k for k in range(len(t)) if t[k:k + len(key)] == key)
            total = sum(weight[x] for x in t)
            for o in range(-len(t) + 1, len(w)):
                met = [0 <= o + j < len(w) and w[o + j] == x for j, x in enumerate(t)]
                got = sum(weight[x] for x, m in zip(t, met) if m)
                if all(met[at:at + len(key)]) and (all(met) if n.base else 100 * got >= 80 * total):
                    labels.add(n.label)
                    score = max(score, got / total)
                    if n.base:
                        base.append((o, n.label))
        out.append((i, len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
                    ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), score))
    return out


def test_places_against_brute_force(spark):
    rnd = random.Random(8)
    bits = [n.text for n in ALL] + ["GNU", "General", "public", "LICENSE", "the", "of", "cc", "by", "mit", "é", "x-y", "Apache", "license", "licensed", "2.0", "\n", "naïve"]
    docs = []
    for i in range(150):
        t = []
        for _ in range(rnd.randint(0, 6)):
            w = rnd.choice(bits).split(" ")
            if len(w) > 6 and rnd.random() < .6:   # a word changed, or the beginning lost
                w[rnd.randrange(len(w))] = "other"
                w = w[rnd.choice([0, 0, 1, 3]):]
            t.append(rnd.choice([" ", ", ", "\n", "; "]).join(w))
        docs.append((i, rnd.choice([" ", ". "]).join(t)))
    docs += [(500, None), (501, ""), (502, "...  "), (None, "MIT License"), (3, "mit license"), (3, "mit license"), (503, "mit-license cc/by CC BY-NC 4.0, Licensed under CC BY-SA"),
             (504, "mit licenses, smit license, mit  license"), (505, "apache license " * 3000), (506, "é" * 40 + "mit license"), (507, "gnu general public gnu general public license")]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], DOCS + ", n_words int, places string").repartition(3)
    got = [tuple(r) for r in licenses.digests(licenses.license_places(df)).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)
    empty = spark.createDataFrame([], DOCS)
    assert licenses.digests(licenses.license_places(empty)).count() == 0


def test_own_labels_and_spans(spark):
    text = "Copyright. Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files. Licensed under CC BY-NC 4.0."
    row = licenses.license_places(spark.createDataFrame([(1, text)], DOCS)).first()
    assert [(p.label, p.base, p.start) for p in row.places] == [("mit", False, 1), ("cc-by-nc", False, 21), ("cc-by", True, 23)]
    assert row.places[0].share < 1 and row.places[2].share == 1


def test_pieces_do_not_show(monkeypatch):
    texts = ["The MIT License and the cc by " * 20, "", "w" * 500 + " mit license", "é" * 300, "apache", "license"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    v = licenses.Vocabulary(ALL)
    wid, first = licenses.licence_words(raw, offsets, v)
    want = [[v.number.get(w, -1) for w in words_of(t)] for t in texts]
    assert wid.tolist() == sum(want, []) and first.tolist() == np.cumsum([0] + [len(w) for w in want]).tolist()
    monkeypatch.setattr(licenses, "CHUNK", 37)
    again = licenses.licence_words(raw, offsets, v)
    assert again[0].tolist() == wid.tolist() and again[1].tolist() == first.tolist()
