"""The whole pipeline against a brute-force version of its stages."""
import random
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import test_pii_layouts as layouts
from tokenizers import Tokenizer

import corpus_pipeline
from trendspark.llm.queries import PII_KEY
from trendspark.session import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def near_duplicates(docs):
    """Of each group the smallest id, by all pairs of five-word shingles."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, t) for i, t in docs if find(i) == i]


def without_repeats(docs, length=100):
    """Characters go if all their bytes stand in strings that start earlier."""
    seen, out = set(), []
    for i, t in sorted(docs):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(b[s:s + length])
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not gone[at:at + n].all():
                kept.append(c)
            at += n
        out.append((i, "".join(kept)))
    return out


def test_run_is_the_brute_force_pipeline(spark, monkeypatch):
    monkeypatch.setattr(layouts, "KEY", PII_KEY)
    rnd = random.Random(21)
    words = {"en": "the house of many people and their things with some more".split(), "de": "das haus und die straße der leute ist nicht weit über".split()}
    rows, cards = [], {}
    passage = " ".join(rnd.choice(words["en"]) for _ in range(60))
    for i in range(80):
        lang = rnd.choice(["en", "de"])
        w = [rnd.choice(words[lang]) + rnd.choice(["", "", "n", "s"]) for _ in range(rnd.randint(30, 120))]
        t = " ".join(w)
        if i % 10 == 3:
            t = f"{t} {passage} {' '.join(w[:5])}"
        if i % 9 == 4:
            c = layouts.with_check(rnd, 16)
            cards[c] = layouts.card(c)
            t = f"{t} card {c} end"
        if i % 8 == 5 and rows:   # a copy with one word changed
            t = rows[-1][1].replace(" ", " x ", 1)
        rows.append((i, t, lang))
    rows += [(200, None, "en"), (201, "12 34 !", None), (202, rows[7][1], rows[7][2])]
    at = tempfile.mkdtemp(prefix="trendspark-pipeline-", dir="/tmp")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    docs = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    docs = without_repeats(near_duplicates(docs))
    for old, new in cards.items():
        docs = [(i, t.replace(old, new)) for i, t in docs]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in docs:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), 1024):
            want[i, a] = (len(ids[a:a + 1024]), zlib.crc32(ids[a:a + 1024].tobytes()), len(ids))
    got = corpus_pipeline.run(spark, at).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024


def test_workers_are_handed_little_text_at_a_time(spark):
    """Workers hold several times a batch; 40 texts of 0.1 MB are no one batch."""
    corpus_pipeline._bounded(spark)

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, b.column("text").to_pylist()))], pa.int64())], ["size"])
    docs = spark.range(40, numPartitions=1).selectExpr("repeat(cast(id % 10 as string), 100000) as text")
    got = [r["size"] for r in docs.mapInArrow(sizes, "size long").collect()]
    assert sum(got) == 40 * 100000 and max(got) <= (1 << 20) + 100000
