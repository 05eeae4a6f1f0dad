"""The trie of conversation prefixes against brute force."""
import hashlib
import random
import zlib

import pytest

from trendspark.llm import prefix_trie
from trendspark.session import ship_package

CONV = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def small_partitions(spark):
    """Conversations and stretches of the sorted order lie in many partitions."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            key = hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, key, r, t))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + v[h:])
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV + ", depth string, part int").repartition(parts)
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.prefix_trie(df).collect()]
    assert sorted(got, key=lambda r: r[:2] + r[3:]) == sorted(brute(rows), key=lambda r: r[:2] + r[3:])


def random_rows(seed, n, texts=3, most=9):
    rnd = random.Random(seed)
    rows = []
    for c in range(-n // 8, n):
        for t in range(rnd.randint(1, most)):
            rows.append((c, t, rnd.choice(["user", "user", None, "bot"]), rnd.choice(["", "é" * 3, "hello", None, "😀x"][:texts + 2])))
    return rows


def test_trie_against_brute_force(spark, small_partitions):
    rows = random_rows(1, 260)
    rows += [(None, 0, "user", "no id"), (500, None, "user", "null turn"), (500, None, "user", "null turn"), (500, 3, "bot", "tie b"), (500, 3, "bot", "tie a"),
             (1 << 40, 0, "u", "x"), ((1 << 40) + 5, 0, "u", "x"), (-100, 1, "u", "y"), (-105, 1, "u", "z")]
    rows += [(600 + i, t, "user", "same") for i in range(150) for t in range(4)]   # copies, and prefixes of each other
    check(spark, rows)


def test_hot_and_long_conversations_lie_across_partitions(spark, small_partitions):
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(3000)] + [(101 + i, t, "user", f"turn {t % 7}") for i in range(40) for t in range(0, 5 + 11 * i)]
    rows += [(300, 0, "user", "equal")] * 900   # equal rows are turns
    check(spark, rows, 8)
    df = spark.createDataFrame(rows, CONV)
    assert prefix_trie._sorted_rows(prefix_trie.turn_rows(df)).where("conv_id = 100").select("part").distinct().count() > 2


def test_empty_and_single(spark):
    df = spark.createDataFrame([], CONV)
    assert prefix_trie.prefix_trie(df).count() == 0
    check(spark, [(7, 0, "user", "one")])
    check(spark, [(-7, None, None, None)])


def test_stretches_meet(monkeypatch):
    """Any cut of the sorted order into stretches gives the same sums."""
    rnd = random.Random(2)
    seqs = sorted({tuple(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) for _ in range(60)})
    nodes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    name = {p: (len(p), hash(p) % 1000003) for p in nodes}
    branch = {p for p in nodes if p in seqs or sum(x[:-1] == p for x in nodes if x) > 1} | {()}
    rows = []
    for i, s in enumerate(seqs):
        key = [{"depth": d, "p1": name[s[:d]][0], "p2": name[s[:d]][1], "q1": name[s[:d - 1]][0], "q2": name[s[:d - 1]][1], "before": 10 * (d - 1)}
               for d in range(1, len(s) + 1) if s[:d - 1] in branch]
        rows.append({"rep": rnd.randrange(1000), "depth": len(s), "total": 10 * len(s), "p1": name[s][0], "p2": name[s][1], "copies": 1 + i % 3, "key": key})
    rows.sort(key=lambda r: [(e["depth"], e["p1"], e["p2"]) for e in r["key"]])

    def merged(cuts):
        out = {}
        edges = [0, *cuts, len(rows)]
        for lo, hi in zip(edges, edges[1:]):
            for r in prefix_trie._forest(rows[lo:hi], rows[lo - 1] if lo else None, rows[hi] if hi < len(rows) else None):
                old = out.get(r[:3])
                most = lambda a, b: b if a is None else a if b is None else max(a, b)
                out[r[:3]] = r[3:11] if old is None else (old[0] + r[3], min(old[1], r[4]), old[2] + r[5], old[3] + r[6], old[4] + r[7], *(most(a, b) for a, b in zip(old[5:], r[8:11])))
        return out
    whole = merged([])
    for _ in range(30):
        assert merged(sorted(rnd.sample(range(1, len(rows)), rnd.randint(1, 20)))) == whole
