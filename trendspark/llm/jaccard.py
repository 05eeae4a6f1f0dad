"""Similarity join of documents by the Jaccard similarity of word shingles.

Method: T-occurrence search after DivideSkip. A document's shingles are
inverted lists; two documents that reach the threshold share at least T of
them. Lists are ordered by length (from counts over all documents in a sketch
of fixed size), and the T - 1 longest of each document are set aside: any
partner occurs in one of the short lists that remain. Short lists are merged
by a shuffle on the shingle, occurrences are counted by pair, and a pair goes
on only if its count in the short lists can still reach the overlap. The long
lists are never merged: the remaining candidates are probed by binary search
in the partner's sorted shingles, which gives the exact overlap.

A short list that still holds more than MANY documents (a large group of near
copies, a passage in very many documents) is not merged with the others: it
counts as a bound for pairs met elsewhere. Only components are asked for, so
its documents are first tried with the list's leader, the one whose shingles
are the most common ones over its whole set (the text the others are copies of
has no shingle of its own; the few short lists alone leave many documents equal
in that), and those of other components with a second leader, again as long as
this links documents; then only pairs are compared that still lie in different
components and whose crowded lists could make up the overlap alone. Documents with equal shingle sets are one class from
the start, so groups of copies cost one document.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import STEP, filter_slots, id_filter, id_and_text, may_hold, mix, row_chunks, string_bytes, tidied, word_hash
from .components import components

SKETCH_BITS = 18
MANY = 64     # lists of more classes are not merged pair by pair
ROUNDS = 4    # of leaders at most


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted in each; and n + 1 offsets.

    Words are runs of other bytes than blanks and 0x09-0x0D, A-Z in lower case.
    A text of fewer words has its whole sequence as one shingle."""
    docs = len(offsets) - 1
    raw = raw[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    low = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begin[first] = inside[first]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[first[1:] - 1] = inside[first[1:] - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    h, _ = word_hash(low, s, e)
    doc = np.searchsorted(offsets, s, "right") - 1
    count = np.bincount(doc, minlength=docs)
    start = np.cumsum(count) - count
    size = np.where(count > words, count - words + 1, np.minimum(count, 1))
    width = np.minimum(count, words)
    out = np.zeros(docs + 1, np.int64)
    if not len(s):
        return np.zeros(0, np.uint64), out
    of = np.repeat(np.arange(docs), size)
    at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    key = width[of].astype(np.uint64)
    for k in range(words):
        here = k < width[of]
        key[here] = mix(key[here] * np.uint64(0x9E3779B97F4A7C15) + h[at[here] + k])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[new], of[new]
    out[1:] = np.cumsum(np.bincount(of, minlength=docs))
    return key, out


def _class_key(keys: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(keys.tobytes()).digest()[:8], "little", signed=True)


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """A row per document (doc_id, n, cls: a key of its shingle set), and rows
    of the sketch (bucket, hits): how many sets hold a shingle of the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n", "cls", "bucket", "hits"]
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            for lo, hi in row_chunks(offsets, STEP):
                keys, at = shingle_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], words)
                hits += np.bincount((keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(hits))
                cls = [_class_key(keys[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(cls, pa.int64()), none, none], names)
        some = np.flatnonzero(hits)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(some), pa.array(hits[some])], names)
    return id_and_text(docs).mapInArrow(tidied(run), "doc_id long, n long, cls long, bucket long, hits long")


LISTS = "token long, cls long, n int, place int, common int"
COLUMNS = [x.split()[0] for x in LISTS.split(", ")]


def _short_lists(docs: DataFrame, hits: np.ndarray, words: int, percent: int) -> tuple[DataFrame, Broadcast]:
    """(token, cls, n, place, common): each class in its shortest lists, all but
    the T - 1 longest, where T is the least overlap with any partner; place: the
    list's number in the class's order; common: the mean logarithm (in 1/1024) of
    the lengths of all lists of the class. And the broadcast that this reads."""
    model = docs.sparkSession.sparkContext.broadcast(hits)  # 2**SKETCH_BITS counts at any size; released by the caller

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, seen = model.value, set()  # classes met lately; what is passed on twice is one row later
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            for lo, hi in row_chunks(offsets, STEP):
                keys, at = shingle_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], words)
                n = np.diff(at)
                cls = np.array([_class_key(keys[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())], np.int64)
                new = np.zeros(hi - lo, bool)  # copies within the task add nothing
                for i, c in enumerate(cls.tolist()):
                    if n[i] and c not in seen:
                        new[i] = True
                        seen.add(c)
                if len(seen) > 1 << 18:
                    seen.clear()
                of = np.repeat(np.arange(hi - lo), n)
                length = weight[(keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                common = np.bincount(of, np.log2(length), hi - lo) * 1024 // np.maximum(n, 1)
                order = np.lexsort((keys, length, of))
                short = n + (-percent * n // 100) + 1  # n - ceil(percent * n / 100) + 1
                place = np.arange(len(of)) - np.repeat(at[:-1], n)
                keep = (place < short[of]) & new[of]
                of, token, place = of[keep], keys[order][keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(cls[of]), pa.array(n[of].astype(np.int32)),
                                                  pa.array(place.astype(np.int32)), pa.array(common[of].astype(np.int32))], COLUMNS)
    return id_and_text(docs).select("text").mapInArrow(tidied(run), LISTS), model


def _shared_lists(lists: DataFrame) -> DataFrame:
    """Rows of lists that hold at least two classes, each class once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_out = None, False  # the last row, and whether it has been passed on
        for b in batches:
            t, c, n, p, m = (b.column(x).to_numpy() for x in COLUMNS)
            if not len(t):
                continue
            if held is not None:
                t, c, n, p, m = (np.append(x, y) for x, y in zip(held, (t, c, n, p, m)))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
            t, c, n, p, m = t[new], c[new], n[new], p[new], m[new]
            same = np.zeros(len(t) + 1, bool)
            same[1:-1] = t[1:] == t[:-1]
            out = same[:-1] | same[1:]
            done = held is not None and held_out
            held, held_out = (t[-1:], c[-1:], n[-1:], p[-1:], m[-1:]), bool(out[-1]) or (done and len(t) == 1)
            out[0] &= not done
            out = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(c[out]), *[pa.array(x[out].astype(np.int32)) for x in (n, p, m)]], COLUMNS)
    return lists.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(tidied(run), LISTS)


def _ceil(x: Column, p: int, q: int) -> Column:
    return F.floor((x * p + (q - 1)) / q)


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """The least overlap at which sets of sizes a and b link."""
    return _ceil(a + b, percent, 100 + percent)


def _enough(count: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether two classes of sizes a and b with ``count`` shared short lists
    can reach the overlap: of the two ranges of short lists the one that ends
    first holds no other shared shingle."""
    need = _overlap(a, b, percent)
    least = [need - x + (x - _ceil(x, percent, 100) + 1) for x in (a, b)]
    return count >= F.least(*least)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: the shingles of one are
    probed by binary search in those of the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [string_bytes(b.column(x)) for x in ("text_a", "text_b")]
            both = np.maximum(*[np.diff(o) for _, o in sides])
            keep = []
            for lo, hi in row_chunks(np.concatenate([[0], np.cumsum(both)]), STEP):
                (x, at_x), (y, at_y) = (shingle_sets(raw[o[lo]:o[hi]], o[lo:hi + 1] - o[lo], words) for raw, o in sides)
                for i in range(hi - lo):
                    mine, other = x[at_x[i]:at_x[i + 1]], y[at_y[i]:at_y[i + 1]]
                    place = np.searchsorted(other, mine)
                    common = int((other[np.minimum(place, len(other) - 1)] == mine).sum())
                    if 100 * common >= percent * (len(mine) + len(other) - common):
                        keep.append(lo + i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])
    a = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long")


def _class_texts(docs: DataFrame, rows: DataFrame, alive: DataFrame, words: int) -> DataFrame:
    """cls and text: the whole text of one document of each class in ``alive``."""
    no_id = F.lit(-(1 << 63))  # stands for a null id
    reps = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep")).join(alive, "cls", "left_semi")
    reps = materialize(reps.select("cls", F.coalesce("rep", no_id).alias("rep")), "join-reps")
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(reps, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array(np.flatnonzero(may_hold(bits.value, b)))
            ids, texts = b.column("doc_id").take(at), b.column("text").take(at)
            raw, offsets = string_bytes(texts)
            for lo, hi in row_chunks(offsets, STEP):
                keys, own = shingle_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], words)
                cls = [_class_key(keys[x:y]) for x, y in zip(own[:-1].tolist(), own[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(cls, pa.int64()), texts.slice(lo, hi - lo)], ["doc_id", "cls", "text"])
    near = id_and_text(docs).select(F.coalesce("doc_id", no_id).alias("doc_id"), "text")
    near = near.select("doc_id", "text", *filter_slots("doc_id")).mapInArrow(tidied(run), "doc_id long, cls long, text string")
    texts = near.join(reps, "cls").filter("doc_id = rep").select("cls", "text")
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["cls"])
    texts = materialize(texts, "join-texts")
    bits.unpersist()
    return texts


def _leader_pairs(rows: DataFrame, side: tuple[str, ...], may_link: Column) -> DataFrame:
    """Pairs (a, b) of each list's members with its leader, and of those of
    other components than the leader's with a second one: at most two pairs a
    row. A pair's first is the larger one (ties: by class)."""
    def with_leader(rows: DataFrame) -> DataFrame:
        top = rows.groupBy("token").agg(F.max_by(F.struct(*side), F.struct("common", "n", "cls")).alias("t"))
        met = rows.join(top, "token").filter("g <> t.g")
        return met.select(*rows.columns, *[F.col(f"t.{c}").alias(f"{c}_b") for c in side])
    rows = materialize(rows.select("token", *side), "join-leaders")
    first = with_leader(rows)
    second = with_leader(first.select("token", *side))
    both = first.filter(may_link).union(second.filter(may_link))
    larger = F.expr("n > n_b or (n = n_b and cls > cls_b)")
    return both.select(F.when(larger, F.col("cls")).otherwise(F.col("cls_b")).alias("a"), F.when(larger, F.col("cls_b")).otherwise(F.col("cls")).alias("b")).distinct()


class _Groups:
    """Links found so far and the components they make."""

    def __init__(self, texts: DataFrame, words: int, percent: int):
        self.texts, self.words, self.percent = texts, words, percent
        self.tried: DataFrame | None = None
        self.group: DataFrame | None = None

    def add(self, pairs: DataFrame) -> bool:
        """Verify pairs (a, b); whether any of them links."""
        pairs = materialize(pairs.select("a", "b"), "join-pairs")
        if pairs.isEmpty():
            return False
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        new = materialize(_verified(pairs, self.texts, self.words, self.percent), "join-links")
        if new.isEmpty():
            return False
        if self.group is not None:  # the stars found so far stand for their links
            new = new.union(self.group.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.group = materialize(components(new), "join-components")
        return True

    def untried(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti")

    def named(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with the component of a column of classes."""
        if self.group is None:
            return rows.withColumn(name, F.col(column))
        group = self.group.select(F.col("node").alias(column), F.col("component").alias("__g"))
        return rows.join(group, column, "left").withColumn(name, F.coalesce("__g", column)).drop("__g")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs not tried yet whose components differ."""
        return self.named(self.named(self.untried(pairs), "a", "ga"), "b", "gb").filter("ga <> gb").select("a", "b")


def near_duplicate_groups(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id: the smallest
    doc_id reached by links, itself included. Two documents link when
    100 * |intersection| >= percent * |union| of their sets.

    Null, empty and blank texts have an empty set and link with nothing. A
    null doc_id is kept, links like any other and is named only if no other
    id is reached. Repeated rows are copies; repeated ids are rows of their
    own. An empty table gives no rows; other columns are not read. Sets are
    keyed by 64-bit hashes together with their size.
    """
    scan = materialize(_scan(docs, words), "join-scan")
    rows = scan.filter("cls is not null").select("doc_id", "n", "cls")
    sketch = scan.filter("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits")).toPandas()
    hits = np.zeros(1 << SKETCH_BITS, np.int64)
    hits[sketch["bucket"].to_numpy(np.int64)] = sketch["hits"].to_numpy(np.int64)
    short, model = _short_lists(docs, hits, words, percent)
    lists = materialize(_shared_lists(short), "join-lists")
    model.unpersist()

    # pairs by the lists that a few documents share; the lists of many are counted only as a bound
    many = lists.groupBy("token").count().filter(F.col("count") > MANY).select("token")
    few, crowd = lists.join(many, "token", "left_anti"), materialize(lists.join(many, "token", "left_semi"), "join-crowd")
    crowds = crowd.groupBy("cls").agg(F.count("*").alias("crowds"))
    fits = F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * percent
    other = few.select("token", F.col("cls").alias("cls_b"), F.col("n").alias("n_b"))
    pairs = few.join(other, "token").filter("n > n_b or (n = n_b and cls > cls_b)").filter(fits)
    pairs = pairs.groupBy(F.col("cls").alias("a"), F.col("cls_b").alias("b")).agg(
        F.count("*").alias("count"), F.first("n").alias("n"), F.first("n_b").alias("n_b"))
    pairs = pairs.join(crowds.toDF("a", "more_a"), "a", "left").join(crowds.toDF("b", "more_b"), "b", "left")
    more = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    counted = materialize(pairs.filter(_enough(F.col("count") + more, F.col("n"), F.col("n_b"), percent)).select("a", "b", "count"), "join-counted")

    alive = counted.select(F.col("a").alias("cls")).union(counted.select("b")).union(crowd.select("cls")).distinct()
    texts = _class_texts(docs, rows, alive, words)
    groups = _Groups(texts, words, percent)
    groups.add(counted.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")))  # the partner met most often
    groups.add(groups.apart(counted.select("a", "b")))

    # documents that share the lists of many: the leaders of their lists, then all that are still apart;
    # they share no list of few (such pairs have been tried), so the lists of many alone must reach the overlap
    if not crowd.isEmpty():
        crowd = crowd.join(crowds, "cls")
        possible = _enough(F.least("crowds", "crowds_b"), F.col("n"), F.col("n_b"), percent)
        side = ("cls", "n", "g", "crowds", "common")
        for _ in range(ROUNDS):  # larger components have other second leaders
            if not groups.add(groups.untried(_leader_pairs(groups.named(crowd, "cls", "g"), side, fits & possible))):
                break
        mine = groups.named(crowd, "cls", "g")
        mixed = mine.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("token")
        side = ("cls", "n", "g", "crowds", "place")
        mine = mine.join(mixed, "token", "left_semi").select("token", *side)
        step = float(np.log(100 / percent))
        band = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.lit(step)).cast("int")
        other = mine.select("token", *[F.col(c).alias(f"{c}_b") for c in side]).withColumn("band", band("n_b"))
        mine = mine.withColumn("band", F.explode(F.array(band("n") - 1, band("n"), band("n") + 1)))
        # after the first list that two documents share, enough lists must follow in both
        early = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) >= _overlap(F.col("n"), F.col("n_b"), percent)
        apart = F.expr("(n > n_b or (n = n_b and cls > cls_b)) and g <> g_b") & fits & possible & early
        pairs = mine.join(other, ["token", "band"]).filter(apart)
        groups.add(groups.untried(pairs.select(F.col("cls").alias("a"), F.col("cls_b").alias("b")).distinct()))
    group = None if groups.group is None else groups.group.select(F.col("node").alias("cls"), F.col("component").alias("g"))
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("own"))
    if group is not None:
        classes = classes.join(group, "cls", "left")
        smallest = classes.filter("g is not null").groupBy("g").agg(F.min("own").alias("best"))
        classes = classes.join(smallest, "g", "left").select("cls", F.coalesce("best", "own").alias("component_id"))
    else:
        classes = classes.withColumnRenamed("own", "component_id")
    out = rows.join(classes, "cls", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
