"""Removal of repeated passages by longest-previous-factor arrays.

Every byte string of ``length`` bytes that also starts earlier (in a document
of smaller id, or earlier in the same one) is removed; its first occurrence
stays. In suffix order the earlier occurrence with the longest match of a
suffix is its previous or its next entry of smaller text position, so the
longest previous factor (LPF) of each start comes from one suffix array with
its common-prefix lengths, and a start is a repeat if its LPF reaches
``length``.

One suffix array over all texts would not fit anywhere. Starts are therefore
dealt by content: each string of ``length`` bytes is assigned to the smallest
hash of its GRAM-byte grams, its anchor, so equal strings always meet at equal
anchors. The stretch of text that one anchor serves is its context.

1. Anchors are shuffled as hashes (no text). A context equal to an earlier one
   is a repeat as a whole; an anchor with a single context is done.
2. Only contexts that share an anchor but differ are cut from the texts, dealt
   by anchor, and their starts are sorted into suffix arrays, many anchors a
   batch. Anchors with more than HOT contexts are dealt by single strings
   instead, so that no anchor fills a task; batches send one copy of each.
3. The repeats of a document are united and its bytes removed.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize
from .common import STEP, filter_slots, id_and_text, id_filter, may_hold, mix, prefix_hash, row_chunks, span_hash, spread, string_bytes, tidied

GRAM = 32
HOT = 4096
SEGMENT = 1 << 20       # starts of a long document worked on at a time
BATCH = 1 << 20         # bytes of contexts in one suffix array
_PLACE = np.uint64((1 << 24) - 1)
LAST_ID = (1 << 63) - 1  # stands for a null id


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, document number, first start and number of
    starts of every context in a few documents (at most 2**24 bytes)."""
    lens = np.diff(offsets)
    use = np.flatnonzero(lens >= length)
    if not len(use):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix = prefix_hash(raw)
    n = len(raw)
    at = np.arange(n - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    low = (gram & ~_PLACE) | at.astype(np.uint64)  # ties of the hash go to the left
    wide, reach = length - GRAM + 1, 1
    while 2 * reach <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[:len(low) - (wide - reach)], low[wide - reach:])
    start = spread(offsets[use], lens[use] - length + 1)
    anchor = (low[start] & _PLACE).astype(np.int64)
    doc = np.repeat(use, lens[use] - length + 1)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    s = start[first]
    return gram[anchor[first]], span_hash(prefix, s, s + count + length - 1), doc[first], s - offsets[doc[first]], count


def document_anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """As ``anchors``, for documents of any length."""
    parts = []
    for lo, hi in row_chunks(offsets, STEP):
        if hi - lo > 1 or offsets[hi] - offsets[lo] <= SEGMENT:
            a, c, d, s, n = anchors(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], length)
            parts.append((a, c, d + lo, s, n))
            continue
        for at in range(0, int(offsets[hi] - offsets[lo]) - length + 1, SEGMENT):
            piece = raw[offsets[lo] + at:min(offsets[lo] + at + SEGMENT + length - 1, offsets[hi])]
            a, c, d, s, n = anchors(piece, np.array([0, len(piece)]), length)
            parts.append((a, c, d + lo, s + at, n))
    if not parts:
        parts = [anchors(raw[:0], np.zeros(1, np.int64), length)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def runs(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, sorted, with touching ones merged."""
    order = np.lexsort((s, doc))
    doc, s, n = doc[order], s[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return doc[first], s[first], np.add.reduceat(n, first) if len(first) else n


CONTEXTS = "anchor long, context long, doc long, sub int, s long, n int"
FOUND = "anchor long, doc long, sub int, s long, n int, live boolean"


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """Contexts of each batch of documents, one of each kind; the others as
    known repeats (n negative: ranges of starts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            ids, subs = b.column("doc").to_numpy(), b.column("sub").to_numpy()
            a, c, d, s, n = document_anchors(raw, offsets, length)
            if not len(a):
                continue
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((subs, ids))] = np.arange(len(ids))
            key = mix(a ^ mix(c))
            order = np.lexsort((s, rank[d], key))
            again = np.zeros(len(a), bool)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            rd, rs, rn = runs(d[again], s[again], n[again])
            first = ~again
            spread_key = mix(ids[rd].astype(np.uint64) + rs.astype(np.uint64))
            d = np.concatenate([d[first], rd])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a[first], spread_key]).view(np.int64)), pa.array(np.concatenate([c[first], np.zeros(len(rd), np.uint64)]).view(np.int64)),
                 pa.array(ids[d]), pa.array(subs[d].astype(np.int32)), pa.array(np.concatenate([s[first], rs])),
                 pa.array(np.concatenate([n[first], -rn]).astype(np.int32))], ["anchor", "context", "doc", "sub", "s", "n"])
    return rows.mapInArrow(tidied(run), CONTEXTS)


def _compare_hashes(contexts: DataFrame) -> DataFrame:
    """Repeats (not live), and contexts that share an anchor but differ (live)."""
    names = ["anchor", "doc", "sub", "s", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)          # anchor and context of the last row
        held = None                  # the first context of the open anchor while it has no other
        for b in batches:
            known = b.column("n").to_numpy() < 0
            if known.any():
                at = pa.array(np.flatnonzero(known))
                n = -b.column("n").to_numpy()[known]
                cols = [b.column(x).take(at) for x in names[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n.astype(np.int32)), pa.array(np.zeros(len(n), bool))], [*names, "live"])
            at = np.flatnonzero(~known)
            if not len(at):
                continue
            rows = b.take(pa.array(at))
            a, c = rows.column("anchor").to_numpy(), rows.column("context").to_numpy()
            new_a = np.ones(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new_a[0] = a[0] != last[0]
            new_c = new_a.copy()
            new_c[1:] |= c[1:] != c[:-1]
            new_c[0] |= c[0] != last[1]
            group = np.cumsum(new_a)          # 0: the anchor left open by the batch before
            firsts = np.bincount(group, new_c, group[-1] + 1).astype(np.int64)
            before = 0 if group[0] else 1     # it has had a context at least
            joined = firsts.copy()
            joined[0] += before
            live = new_c & (joined[group] > 1)
            if held is not None:
                if not group[0] and firsts[0]:
                    yield held
                    held = None
                elif group[-1] > 0:
                    held = None               # it ended with one context
            tail = group[-1]
            if tail > 0 and firsts[tail] == 1:
                k = int(np.flatnonzero(new_c & (group == tail))[0])
                held = _row(rows, k, names)
            elif tail > 0:
                held = None
            out = np.flatnonzero(live | ~new_c)
            if len(out):
                pick = pa.array(out)
                yield pa.RecordBatch.from_arrays([*[rows.column(x).take(pick) for x in names], pa.array(live[out])], [*names, "live"])
            last = (a[-1], c[-1])
    return contexts.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "sub", "s").mapInArrow(tidied(run), FOUND)


def _row(rows: pa.RecordBatch, k: int, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[rows.column(x).take(pa.array([k])) for x in names], pa.array([True])], [*names, "live"])


def smaller_before(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For every entry of a suffix order the common prefix with the entry
    before it of smaller text position (0: none). ``shared[i]``: the common
    prefix of entries i - 1 and i. Pointers to the nearest smaller place are
    found by jumping along the pointers of larger ones."""
    at, low = np.arange(len(place)) - 1, shared.copy()
    todo = np.arange(len(place))
    while len(todo):
        todo = todo[at[todo] >= 0]
        todo = todo[place[at[todo]] > place[todo]]
        over = at[todo]
        low[todo], at[todo] = np.minimum(low[todo], low[over]), at[over]
    low[at < 0] = 0
    return low


def previous_factors(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Longest previous factor of every entry of a suffix order."""
    back = smaller_before(place[::-1], np.concatenate([[0], shared[:0:-1]]))[::-1] if len(place) else shared
    return np.maximum(smaller_before(place, shared), back)


def repeated_starts(raw: np.ndarray, offsets: np.ndarray, n: np.ndarray, group: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Whether each start of the contexts (n of them each) is a repeat within
    its group. ``place``: text position of every start, comparable."""
    at = spread(offsets[:-1], n)
    words = -(-length // 8)
    padded = np.concatenate([raw, np.zeros(8 * words + 8, np.uint8)])
    word = np.zeros(len(raw) + 8 * words, np.uint64)
    for k in range(8):
        word |= padded[k:k + len(word)].astype(np.uint64) << np.uint64(56 - 8 * k)
    keys = [word[at + 8 * k] for k in range(words)]
    if length % 8:
        keys[-1] = keys[-1] & ~np.uint64((1 << 8 * (8 - length % 8)) - 1)
    of = np.repeat(group, n)
    order = np.lexsort((place, *keys[::-1], of))
    shared, equal = np.zeros(len(at), np.int64), np.ones(max(0, len(at) - 1), bool)
    equal &= of[order][1:] == of[order][:-1]
    for k, key in enumerate(keys):
        key = key[order]
        differ = key[1:] ^ key[:-1]
        for j in range(min(8, length - 8 * k)):  # leading bytes that agree
            same = equal & (differ >> np.uint64(56 - 8 * j) == 0)
            shared[1:] += same
        equal &= differ == 0
    out = np.zeros(len(at), bool)
    out[order] = previous_factors(place[order], shared) >= length
    return out


CUT = "key long, doc long, sub int, s long, n int, bytes binary"


def _cut_contexts(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the live contexts (column ``live``: a list a document)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            ids, subs, lists = b.column("doc").to_numpy(), b.column("sub").to_numpy(), b.column("live").to_pylist()
            out, seen = [], {}
            data = raw.tobytes()
            for i in np.lexsort((subs, ids)).tolist():
                base, doc, sub = int(offsets[i]), int(ids[i]), int(subs[i])
                for x in sorted(lists[i], key=lambda x: x["s"]):
                    s, n = x["s"], x["n"]
                    if not x["hot"]:
                        out.append((x["anchor"], doc, sub, s, n, data[base + s:base + s + n + length - 1]))
                        continue
                    for t in range(s, s + n):
                        string = data[base + t:base + t + length]
                        key = seen.get(string)
                        if key is None:
                            key = seen[string] = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                            out.append((key, doc, sub, t, 1, string))
                        else:  # a repeat, whatever else there is
                            out.append((hash((doc, t)), doc, sub, t, -1, b""))
            for lo in range(0, len(out), 20000):
                cols = list(zip(*out[lo:lo + 20000]))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in CUT.split(", ")])
    return texts.mapInArrow(tidied(run), CUT)


REPEATS = "doc long, sub int, s long, n int"


def _compare_bytes(cut: DataFrame, length: int) -> DataFrame:
    """Repeats among contexts of equal keys, by suffix arrays of whole keys."""
    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        doc, sub, s, n = (rows.column(x).to_numpy() for x in ("doc", "sub", "s", "n"))
        raw, offsets = string_bytes(rows.column("bytes"))
        _, group = np.unique(rows.column("key").to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(s)), n)
        start = np.repeat(s, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        place = np.empty(len(row), np.int64)
        place[np.lexsort((start, sub[row], doc[row]))] = np.arange(len(row))
        hit = repeated_starts(raw, offsets, n, group, place, length)
        row, start = row[hit], start[hit]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(row)))
        return pa.RecordBatch.from_arrays([pa.array(doc[row[at]]), pa.array(sub[row[at]].astype(np.int32)), pa.array(start[at]),
                                           pa.array(size.astype(np.int32))], ["doc", "sub", "s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            known = b.column("n").to_numpy() < 0
            if known.any():
                at = pa.array(np.flatnonzero(known))
                yield pa.RecordBatch.from_arrays([b.column(x).take(at) for x in ("doc", "sub", "s")] + [
                    pa.array(-b.column("n").to_numpy()[known].astype(np.int32))], ["doc", "sub", "s", "n"])
                b = b.take(pa.array(np.flatnonzero(~known)))
            while b.num_rows:
                # rows up to the first change of key beyond a full batch
                ends = np.cumsum(np.diff(string_bytes(b.column("bytes"))[1]))
                key = b.column("key").to_numpy()
                over = int(np.searchsorted(ends, BATCH - size, "left"))
                if over >= len(key):
                    held.append(b)
                    size += int(ends[-1])
                    break
                change = np.flatnonzero(key[over + 1:] != key[over:-1])
                if size > BATCH and held and held[-1].column("key")[-1].as_py() != key[0]:
                    cut = 0
                elif len(change):
                    cut = over + 1 + int(change[0])
                else:
                    held.append(b)
                    size += int(ends[-1])
                    break
                if cut:
                    held.append(b.slice(0, cut))
                yield solve(pa.Table.from_batches(held))
                held, size, b = [], 0, b.slice(cut)
        if held:
            yield solve(pa.Table.from_batches(held))
    return cut.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(run), REPEATS)


def numbered(docs: DataFrame) -> DataFrame:
    """doc (a null id as the largest), sub (0, 1, ... for rows that share an
    id, by their text) and text."""
    rows = id_and_text(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), "text")
    if rows.groupBy("doc").count().filter("count > 1").isEmpty():
        return rows.withColumn("sub", F.lit(0))
    sub = F.row_number().over(W.partitionBy("doc").orderBy(F.md5(F.col("text").cast("binary")))) - 1
    return materialize(rows.withColumn("sub", sub), "repeats-numbered")


def repeats(rows: DataFrame, length: int) -> DataFrame:
    """doc, sub, s, n: ranges of starts of repeated strings, in any order."""
    found = materialize(_compare_hashes(_contexts(rows, length)), "repeats-found")
    live = found.filter("live")
    hot = live.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    live = live.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    lists = live.groupBy("doc", "sub").agg(F.collect_list(F.struct("anchor", "s", "n", "hot")).alias("live"))
    texts = _passing(rows, live.select("doc").distinct(), True).join(lists, ["doc", "sub"])
    compared = _compare_bytes(_cut_contexts(texts.select("doc", "sub", "text", "live"), length), length)
    return found.filter("not live").select("doc", "sub", "s", "n").union(compared)


def _passing(rows: DataFrame, ids: DataFrame, holds: bool) -> DataFrame:
    """Documents that the filter over ``ids`` lets pass, or the others."""
    bits = rows.sparkSession.sparkContext.broadcast(id_filter(ids, "doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array(np.flatnonzero(may_hold(bits.value, b) == holds))
            yield pa.RecordBatch.from_arrays([b.column(x).take(at) for x in ("doc", "sub", "text")], ["doc", "sub", "text"])
    return rows.select("doc", "sub", "text", *filter_slots("doc")).mapInArrow(tidied(run), "doc long, sub int, text string")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(texts: DataFrame, length: int, keep: bool) -> DataFrame:
    """Digests of what is left of every text; ``cut`` lists its ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            ids, cuts = b.column("doc").to_numpy(), b.column("cut")
            out = []
            for i in range(b.num_rows):
                own = raw[offsets[i]:offsets[i + 1]]
                cut = cuts[i].as_py()
                gone = np.zeros(len(own) + 1, np.int64)
                if cut:
                    s = np.array([x["s"] for x in cut])
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + np.array([x["n"] for x in cut]) + length - 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                left = own[~gone]
                row = (None if ids[i] == LAST_ID else int(ids[i]), len(own), int(gone.sum()), spans, hashlib.sha256(left.tobytes()).hexdigest())
                out.append(row + ((_whole_characters(own, gone),) if keep else ()))
            kinds = [pa.int64()] * 4 + [pa.string()] * (1 + keep)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 [x.split()[0] for x in RESULT.split(", ")] + ["kept"] * keep)
    return texts.select("doc", "text", "cut").mapInArrow(tidied(run), RESULT + ", kept string" * keep)


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> str:
    """What is left as text: a character goes if all its bytes go."""
    if not gone.any():
        return raw.tobytes().decode()
    head = np.flatnonzero((raw & 0xC0) != 0x80)
    size = np.diff(np.append(head, len(raw)))
    all_gone = np.add.reduceat(gone.astype(np.int64), head) == size
    return raw[~np.repeat(all_gone, size)].tobytes().decode()


def remove_repeats(docs: DataFrame, length: int = 100, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    (of the bytes left) and, with ``keep``, kept: what is left as text, where
    a character goes only if all its bytes go.

    Null texts are empty; texts shorter than ``length`` (at least GRAM) stay.
    A null doc_id counts as the largest; rows that share an id are ordered by
    a hash of their text, so of repeated rows one stays. An empty table gives
    no rows; other columns are not read. Strings never cross documents.
    """
    rows = numbered(docs)
    cut = materialize(repeats(rows, length), "repeats")
    lists = cut.groupBy("doc", "sub").agg(F.collect_list(F.struct("s", "n")).alias("cut"))
    ids = cut.select("doc").distinct()
    near = _passing(rows, ids, True).join(lists, ["doc", "sub"], "left")
    far = _passing(rows, ids, False).withColumn("cut", F.expr("cast(null as array<struct<s: bigint, n: int>>)"))
    return _removed(near, length, keep).union(_removed(far, length, keep))
