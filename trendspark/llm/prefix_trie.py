"""The trie of shared conversation prefixes.

Method: union-find over LCP edges of sorted neighbours, in descending depth.
Conversations are sorted so that those with a common beginning are neighbours;
an edge joins two neighbours at the depth of their longest common prefix.
Taking the edges from deep to shallow, every merge of components makes a
branching node of the trie, with the sums of its members. Each partition of
the sorted order does this alone; where components touch an edge of the
partition, the nodes that lie across it are emitted with the sums of this side
(a contracted forest), and the sides are added up by node.

What makes it bounded:

* Turns are numbered and hashed by a segmented scan: rows are range
  partitioned by (conversation, turn), and a row a partition carries the
  running state over partition edges. A long conversation is many partitions.
* A prefix is known by its depth and 128 bits: the sum of the turns' digests,
  each mixed with its depth.
* A conversation is sorted by its branch points alone (the prefixes whose
  parent branches or is somebody's end). A conversation with k of them needs k
  others at least as long, each longer than the one before, so a key holds at
  most about sqrt(2 * turns) entries.
* Equal conversations are one row of the sort; subtree sums are sums over
  members (see ``_forest``), so no node's members are gathered. Only the
  digest of member ids is a stream by definition.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ensure_checkpoint_dir, materialize
from .common import mix, string_bytes

HEADS = 5        # a rebuilt conversation takes at most so many turns from the head of its hundred
STEP = 1024      # depths of a chain that are joined with its rows at a time
_D = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text) and chars (code points of the
    text). Null roles and texts are empty; rows of a null conv_id are in no
    conversation and left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                digest.alias("digest"), F.length(text).cast("long").alias("chars")).filter("conv_id is not null")


def heads_taken(conv_id):
    """Turns that a rebuilt conversation takes from the head of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEADS + 1)


def _sorted_rows(turns: DataFrame) -> DataFrame:
    """A row per conversation (its head's first turns) and its own turns after
    it, range partitioned and sorted; equal turns may stand in any order, and
    a salt lets them lie in several partitions."""
    order = [F.col("turn").asc_nulls_first(), "digest"]
    base = F.expr("conv_id - conv_id % 100")
    first = turns.filter(F.col("conv_id") == base).withColumn("i", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)))
    first = first.filter(F.col("i") <= HEADS)   # a limit per partition comes before the shuffle
    head = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "digest", "chars"))).alias("head"))
    convs = turns.select("conv_id").distinct().withColumn("base", base).join(head.withColumnRenamed("conv_id", "base"), "base", "left")
    none = F.array().cast(head.schema["head"].dataType)
    convs = convs.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"),
                         F.lit(0).cast("long").alias("chars"), F.slice(F.coalesce("head", none), F.lit(1), heads_taken(F.col("conv_id")).cast("int")).alias("head"))
    own = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "chars", none.alias("head"))
    rows = materialize(convs.union(own).withColumn("salt", F.monotonically_increasing_id()), "trie-turns")
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "digest", "salt"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint().withColumn("part", F.spark_partition_id())


class _Conv:
    """Running state of the conversation that a scan is in."""
    __slots__ = ("id", "h", "seen", "depth", "chars", "hash")

    def __init__(self, conv_id: int):
        self.id, self.h = conv_id, zlib.crc32(str(conv_id).encode()) % (HEADS + 1)
        self.seen, self.depth, self.chars, self.hash = 0, 0, 0, (0, 0)

    def copy(self) -> "_Conv":
        c = _Conv(self.id)
        c.seen, c.depth, c.chars, c.hash = self.seen, self.depth, self.chars, self.hash
        return c


def _bound(digest: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Two 64-bit words of every turn's digest, mixed with its depth."""
    d = depth.astype(np.uint64)
    return np.stack([mix(digest[:, k] ^ mix((d + np.uint64(1)) * _D[k])) for k in (0, 1)], axis=1)


def _digests(column: pa.Array) -> np.ndarray:
    """The first 128 bits of each digest (zeros for null)."""
    raw, offsets = string_bytes(column)
    out = np.zeros((len(column), 2), np.uint64)
    full = np.flatnonzero(np.diff(offsets) == 32)
    if len(full):
        out[full] = raw[offsets[full][:, None] + np.arange(16)].view(np.uint64)
    return out


def _scan(batches: Iterator[pa.RecordBatch], state: _Conv | None) -> Iterator[tuple]:
    """Rebuilt rows of sorted batches as arrays (conv_id, depth, chars, sum of
    chars, hash, the parent's hash); the last yield is the final state."""
    for b in batches:
        conv, kind = b.column("conv_id").to_numpy(), b.column("kind").to_numpy()
        chars, digest = b.column("chars").to_numpy(), _digests(b.column("digest"))
        heads = b.column("head")
        edge = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])) if len(conv) else np.zeros(0, np.int64)
        out = []
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(conv)]):
            c, d, n, at = int(conv[lo]), [], [], lo
            if kind[lo] == 0:                    # a conversation begins: its root, and the turns of its head
                state, at = _Conv(c), lo + 1
                head = heads[lo].as_py()
                d = [np.frombuffer(x["digest"][:16], np.uint64)[None] for x in head]
                n = [x["chars"] for x in head]
                out.append((np.array([c]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, 2), np.uint64), np.zeros((1, 2), np.uint64)))
            skip = min(max(state.h - state.seen, 0), hi - at)
            state.seen += hi - at
            dig = np.concatenate([*d, digest[at + skip:hi]]) if d else digest[at + skip:hi]
            num = np.concatenate([np.array(n, np.int64), chars[at + skip:hi]])
            if not len(num):
                continue
            depth = state.depth + 1 + np.arange(len(num))
            step = _bound(dig, depth)
            full = np.cumsum(np.vstack([np.array([state.hash], np.uint64), step]), axis=0, dtype=np.uint64)
            total = state.chars + np.cumsum(num)
            out.append((np.full(len(num), c), depth, num, total, full[1:], full[:-1]))
            state.depth, state.chars, state.hash = int(depth[-1]), int(total[-1]), tuple(int(x) for x in full[-1])
        if out:
            yield tuple(np.concatenate(x) for x in zip(*out))
    yield (state,)


def _states(rows: DataFrame) -> dict[int, _Conv]:
    """The state in which each partition begins: a few rows a partition come
    to the driver. First the turns of conversations that lie across partition
    edges are counted (their depths follow), then their hashes are summed."""
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None                      # (conv, own turns, head's turns or -1)
        part = None
        for b in batches:
            conv, kind = b.column("conv_id").to_numpy(), b.column("kind").to_numpy()
            if not len(conv):
                continue
            part = b.column("part")[0].as_py()
            for c in dict.fromkeys((int(conv[0]), int(conv[-1]))):
                here = conv == c
                head = np.flatnonzero(here & (kind == 0))
                n, h = int((here & (kind == 1)).sum()), len(b.column("head")[int(head[0])]) if len(head) else -1
                if last is not None and last[0] == c:
                    last = (c, last[1] + n, max(last[2], h))
                else:
                    last = (c, n, h)
                if first is None or first[0] == c:
                    first = last
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part, part]), pa.array([0, 1]), *[pa.array([first[k], last[k]], pa.int64()) for k in range(3)]],
                                             ["part", "side", "conv", "turns", "heads"])
    got = rows.select("part", "conv_id", "kind", "head").mapInArrow(summary, "part long, side long, conv long, turns long, heads long").collect()
    ends = {(r["part"], r["side"]): r for r in got}
    begin: dict[int, _Conv] = {}
    now: _Conv | None = None
    for part in sorted({p for p, _ in ends}):
        first, last = ends[part, 0], ends[part, 1]
        if first["heads"] < 0:                   # goes on from before
            begin[part] = now.copy()
        for r in (first, last) if first["conv"] != last["conv"] else (first,):
            if r["heads"] >= 0:
                now = _Conv(r["conv"])
                now.depth = r["heads"]
            skip = min(max(now.h - now.seen, 0), r["turns"])
            now.seen += r["turns"]
            now.depth += r["turns"] - skip
    if not begin:
        return begin
    # sums of the turns of these conversations, by partition
    across = rows.sparkSession.sparkContext.broadcast({p: s for p, s in begin.items()})
    wanted = {s.id for s in begin.values()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keep() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(np.isin(b.column("conv_id").to_numpy(), list(wanted))))
        it = keep()
        at = next((b for b in it if b.num_rows), None)
        if at is None:
            return
        part = at.column("part")[0].as_py()
        found: dict[int, list[int]] = {}

        def again() -> Iterator[pa.RecordBatch]:
            yield at
            yield from it
        start = across.value.get(part)
        start = start.copy() if start is not None and start.id in wanted else None
        for x in _scan(again(), start):
            if len(x) > 1:
                edge = np.flatnonzero(np.append(True, x[0][1:] != x[0][:-1]))
                step = x[4] - x[5]
                for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(x[0])]):
                    s = found.setdefault(int(x[0][lo]), [0, 0, 0])
                    s[0] += int(x[2][lo:hi].sum())
                    for k in (0, 1):
                        s[1 + k] = (s[1 + k] + int(step[lo:hi, k].sum(dtype=np.uint64))) % (1 << 64)
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(found)), pa.array(list(found), pa.int64()), pa.array([v[0] for v in found.values()], pa.int64()),
                                          *[pa.array([signed(v[k]) for v in found.values()], pa.int64()) for k in (1, 2)]], ["part", "conv", "chars", "a", "b"])
    got = rows.mapInArrow(sums, "part long, conv long, chars long, a long, b long").collect()   # at most a few rows a partition
    across.unpersist()
    before: dict[int, list[int]] = {}
    by_part: dict[int, list] = {}
    for r in got:
        by_part.setdefault(r["part"], []).append(r)
    for part in sorted({*by_part, *begin}):
        if part in begin:
            s = before.get(begin[part].id, [0, 0, 0])
            begin[part].chars, begin[part].hash = s[0], (s[1], s[2])
        for r in by_part.get(part, []):
            s = before.setdefault(r["conv"], [0, 0, 0])
            s[0] += r["chars"]
            s[1], s[2] = (s[1] + r["a"]) % (1 << 64), (s[2] + r["b"]) % (1 << 64)
    return begin


def prefix_rows(conversations: DataFrame) -> DataFrame:
    """A row per rebuilt conversation and depth, from 0 (no turn): conv_id,
    depth, chars (of the last turn), total (of all turns), p1, p2 (128 bits
    that name the prefix) and q1, q2 (those of its parent)."""
    spark = conversations.sparkSession
    ensure_checkpoint_dir(spark)
    rows = _sorted_rows(turn_rows(conversations))
    begin = spark.sparkContext.broadcast(_states(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def again(first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        state = begin.value.get(first.column("part")[0].as_py())
        for x in _scan(again(first), state.copy() if state else None):
            if len(x) > 1:
                p, q = x[4].view(np.int64), x[5].view(np.int64)
                yield pa.RecordBatch.from_arrays([*[pa.array(v.astype(np.int64)) for v in x[:4]], *[pa.array(np.ascontiguousarray(v)) for v in (p[:, 0], p[:, 1], q[:, 0], q[:, 1])]],
                                                 ["conv_id", "depth", "chars", "total", "p1", "p2", "q1", "q2"])
    out = materialize(rows.mapInArrow(run, "conv_id long, depth long, chars long, total long, p1 long, p2 long, q1 long, q2 long"), "trie-prefixes")
    begin.unpersist()
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """Equal conversations as one: rep (smallest id), depth, total, p1, p2,
    copies, and the digest of the ids, which is streamed in their order."""
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "total", "p1", "p2")).alias("e")).select("conv_id", "e.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, row, names = None, None, None, ["rep", "depth", "total", "p1", "p2", "copies", "ends_sha256"]
        kinds = [pa.int64()] * 6 + [pa.string()]

        def closed(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        for b in batches:
            out = []
            for c, d, t, p1, p2 in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "total", "p1", "p2"))):
                if (d, p1, p2) != now:
                    if now is not None:
                        out.append((*row, sha.hexdigest()))
                    now, sha, row = (d, p1, p2), hashlib.sha256(str(c).encode()), [c, d, t, p1, p2, 1]
                else:
                    sha.update(f",{c}".encode())
                    row[5] += 1
            yield closed(out)
        if now is not None:
            yield closed([(*row, sha.hexdigest())])
    of = ends.repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "conv_id")
    return materialize(of.mapInArrow(run, "rep long, depth long, total long, p1 long, p2 long, copies long, ends_sha256 string"), "trie-classes")


def _keys(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` with the branch points of each: an array of (depth, p1, p2,
    q1, q2, before: characters of the parent's turns), by depth."""
    nodes = rows.filter("depth > 1").groupBy("depth", "p1", "p2", "q1", "q2").agg(F.count("*").alias("n"))
    several = nodes.groupBy("depth", "q1", "q2").agg(F.count("*").alias("k")).filter("k > 1").select("depth", "q1", "q2")
    ended = classes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    points = several.union(ended).distinct()
    row = F.struct("depth", "p1", "p2", "q1", "q2", (F.col("total") - F.col("chars")).alias("before"))
    mine = rows.filter("depth > 0").join(classes.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    # every conversation branches off at the root, so that hot key needs no join
    found = mine.filter("depth = 1").union(mine.filter("depth > 1").join(points, ["depth", "q1", "q2"], "left_semi").select(*mine.columns))
    key = found.groupBy(F.col("conv_id").alias("rep")).agg(F.sort_array(F.collect_list(row)).alias("key"))
    none = F.array().cast(key.schema["key"].dataType)
    return classes.join(key, "rep", "left").withColumn("key", F.coalesce("key", none))


def _split(a: list, b: list) -> tuple | None:
    """The entry of ``b`` at which the later of two sorted keys leaves the
    earlier one: (depth of the common prefix, its q1, q2, its characters)."""
    for i, e in enumerate(b):
        if i >= len(a) or (a[i]["depth"], a[i]["p1"], a[i]["p2"]) != (e["depth"], e["p1"], e["p2"]):
            return e["depth"] - 1, e["q1"], e["q2"], e["before"]
    return None


class Forest:
    """Union-find over neighbours; a component is a stretch of the order and
    its root holds the sums of its members."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.lo, self.hi = list(range(n)), list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.hi[a] - self.lo[a] < self.hi[b] - self.lo[b]:
                a, b = b, a
            self.up[b] = a
            self.lo[a], self.hi[a] = min(self.lo[a], self.lo[b]), max(self.hi[a], self.hi[b])


NODE = ("depth", "p1", "p2", "copies", "rep", "held", "fresh", "leaves", "before", "up_l", "up_r", "l1", "l2", "r1", "r2")


def _forest(rows: list[dict], prev: dict | None, after: dict | None) -> list[tuple]:
    """Nodes of a stretch of the sorted order (see NODE), with the sums over
    its members there; nodes that reach over its ends come with this side's
    sums, and their outer limits are left to the other sides.

    With T the characters of a whole conversation and t those of the common
    prefix with its predecessor, a node over members l..r at depth d sums:
    copies, ``held`` = copies * T, ``fresh`` = T - t (characters that no member
    before has), and ``leaves`` (members that no successor continues); t at l
    is kept as ``before``. ``up_l`` and ``up_r`` are the depths at which the
    neighbours outside part: the greater is the parent's, and l or r its name.
    """
    n = len(rows)
    cuts = [None if prev is None else _split(prev["key"], rows[0]["key"])]
    cuts += [_split(a["key"], b["key"]) for a, b in zip(rows, rows[1:])]
    cuts.append(None if after is None else _split(rows[-1]["key"], after["key"]))
    sums = np.zeros((n + 1, 4), object)
    rep = [r["rep"] for r in rows]
    for i, r in enumerate(rows):
        before = cuts[i][3] if cuts[i] else 0
        leaf = 1 if cuts[i + 1] is None or cuts[i + 1][0] < r["depth"] else 0
        sums[i + 1] = sums[i] + np.array([r["copies"], r["copies"] * r["total"], r["total"] - before, leaf], object)
    # events by depth: edges between neighbours, ends of members, and nodes that lie over the stretch's ends
    events: dict[int, list[tuple]] = {}
    for i, r in enumerate(rows):
        events.setdefault(r["depth"], []).append((i, i, r["p1"], r["p2"]))
        if i and cuts[i]:
            events.setdefault(cuts[i][0], []).append((i - 1, i, cuts[i][1], cuts[i][2]))
    for cut, member, key in ((cuts[0], 0, rows[0]["key"]), (cuts[n], n - 1, after["key"] if after else [])):
        for e in key if cut else []:
            if e["depth"] - 1 <= cut[0]:
                events.setdefault(e["depth"] - 1, []).append((member, member, e["q1"], e["q2"]))
    forest, out = Forest(n), []
    least = _Least(rep)
    for depth in sorted(events, reverse=True):
        for a, b, _, _ in events[depth]:
            if a != b:
                forest.unite(a, b)
        seen = set()
        for a, _, p1, p2 in events[depth]:
            root = forest.find(a)
            if root in seen:
                continue
            seen.add(root)
            lo, hi = forest.lo[root], forest.hi[root]
            left, right = cuts[lo], cuts[hi + 1]
            # an outer cut at this depth or deeper lies inside the node: the limit is on another side
            own_l, own_r = left is None or left[0] < depth, right is None or right[0] < depth
            copies, held, fresh, leaves = sums[hi + 1] - sums[lo]
            out.append((depth, p1, p2, copies, least.of(lo, hi), held, fresh, leaves, (left[3] if left else 0) if own_l else None,
                        (left[0] if left else -1) if own_l else None, (right[0] if right else -1) if own_r else None,
                        *(left[1:3] if own_l and left else (None, None)), *(right[1:3] if own_r and right else (None, None))))
    return out


class _Least:
    """Least value of any stretch, from a table of powers of two."""

    def __init__(self, values: list[int]):
        self.rows = [np.array(values, np.int64)]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            k = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-k], self.rows[-1][k:]))
            if len(self.rows[-1]) <= 1:
                break

    def of(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        return int(min(self.rows[k][lo], self.rows[k][hi - (1 << k) + 1]))


def _nodes(keys: DataFrame) -> DataFrame:
    """Branching and end nodes of the whole trie (see NODE)."""
    order = keys.repartitionByRange("key").sortWithinPartitions("key")
    order = order.checkpoint().withColumn("part", F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if b.num_rows:
                first = b.slice(0, 1) if first is None else first
                last = b.slice(b.num_rows - 1, 1)
        if first is not None:
            yield first
            yield last
    # the first and last key of each partition come to the driver
    got = order.select("part", "key").mapInArrow(ends, order.select("part", "key").schema).collect()
    by_part: dict[int, list] = {}
    for r in got:
        by_part.setdefault(r["part"], []).append([e.asDict() for e in r["key"]])
    parts = sorted(by_part)
    edges = {p: (by_part[parts[i - 1]][1] if i else None, by_part[parts[i + 1]][0] if i + 1 < len(parts) else None) for i, p in enumerate(parts)}
    edges = keys.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], list(NODE))
        # a stretch of some thousand rows at a time: its neighbours are the rows around it
        prev, hold, end = None, [], None
        for b in batches:
            if b.num_rows and end is None:
                before, end = edges.value[b.column("part")[0].as_py()]
                prev = None if before is None else {"key": before}
            hold += b.to_pylist()
            while len(hold) > 4096:
                yield batch(_forest(hold[:4096], prev, hold[4096]))
                prev, hold = hold[4095], hold[4096:]
        if hold:
            yield batch(_forest(hold, prev, None if end is None else {"key": end}))
    parts = order.mapInArrow(run, ", ".join(f"{c} long" for c in NODE))
    up = lambda side: F.max(F.when(F.col(f"up_{side}").isNotNull(), F.struct(F.col(f"up_{side}").alias("d"), F.col(f"{side}1").alias("p1"), F.col(f"{side}2").alias("p2"))))
    whole = parts.groupBy("depth", "p1", "p2").agg(
        *[F.sum(c).alias(c) for c in ("copies", "held", "fresh", "leaves")], F.min("rep").alias("rep"), F.max("before").alias("before"), F.greatest(up("l"), up("r")).alias("up"))
    out = materialize(whole.select("depth", "p1", "p2", "copies", "held", "fresh", "leaves", "rep", "before", F.col("up.d").alias("up"), F.col("up.p1").alias("u1"), F.col("up.p2").alias("u2")),
                      "trie-nodes")
    edges.unpersist()
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless
    nodes of its subtree), saved_tokens (over its subtree, members less one
    times code points of the last text) and ends_sha256 (of the ids that end
    there, ascending, joined by commas).

    A conversation's turns go by turn (nulls first), equal turns by the digest
    of role and text; repeated rows are turns of their own. Null roles and
    texts are empty; rows of a null conv_id are in no conversation and left
    out. A table without conversations has no root and gives no rows; other
    columns are not read.
    """
    rows = prefix_rows(conversations)
    classes = _classes(rows)
    nodes = _nodes(_keys(rows, classes))
    children = nodes.filter("up >= 0").groupBy(F.col("up").alias("depth"), F.col("u1").alias("p1"), F.col("u2").alias("p2")).agg(F.count("*").alias("children"))
    parents = nodes.select(F.col("depth").alias("up"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("rep").alias("parent"))
    nodes = nodes.join(children, ["depth", "p1", "p2"], "left").join(classes.select("depth", "p1", "p2", "ends_sha256"), ["depth", "p1", "p2"], "left")
    nodes = nodes.join(parents, ["up", "u1", "u2"], "left")
    # a node stands for the chain of prefixes with its members, from below its parent to its depth
    chain = nodes.withColumn("from", F.col("up") + 1).withColumn("block", F.explode(F.expr(f"sequence((up + 1) div {STEP}, depth div {STEP})")))
    chain = chain.select(F.col("rep").alias("conv_id"), "block", "from", F.col("depth").alias("to"), "copies", "held", "fresh", "leaves", "before", "children", "parent", "ends_sha256")
    of = rows.select("conv_id", "depth", (F.col("total") - F.col("chars")).alias("start"), F.expr(f"depth div {STEP}").alias("block"))
    d = chain.join(of, ["conv_id", "block"]).filter("depth between `from` and `to`")
    last = F.col("depth") == F.col("to")
    none = hashlib.sha256(b"").hexdigest()
    return d.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("from"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("copies").alias("n_convs"), F.when(last, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("held") - F.col("copies") * F.col("start") - (F.col("fresh") + F.col("before") - F.col("start"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(none))).otherwise(F.lit(none)).alias("ends_sha256"))
