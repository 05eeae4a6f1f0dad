"""Periodic runs of words: found exactly, and collapsed to their first period.

Method: recursive frequency splitting, then a lag scan. A run of period q has
at least three periods, so each of its words stands in it three times or more.
Words that occur less than three times within their segment therefore split
it; the pieces are split again by their own counts until nothing changes, and
pieces too short for a run are gone. The surviving segments are scanned for
lags: at scale K (8, 16, 32, ...) every position is paired with the next equal
K words, and a stretch of positions with one lag q, K/2 < q <= K (q <= 8 at
scale 8), is a maximal stretch of smallest period q: K words or more that
recur at a distance below q would give the stretch a smaller period. Equal
K-grams are told by ranks of pairs of ranks, not by hashes, so runs are exact,
and a scale costs a sort of the segment, whatever the number of lags.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, row_chunks, string_bytes

PIECE = 1 << 20    # bytes of one text that are cut into words at a time
ROUNDS = 64        # of splitting; the scan is exact on any segment, so no result depends on it
BLANKS = b" \t\n\x0b\x0c\r"


def word_ids(text: memoryview) -> tuple[np.ndarray, list[bytes]]:
    """A number for every word of a text (equal words, equal numbers), and the
    distinct words by number. Cut piece by piece, so a long text is never a
    list of all its words."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        piece = bytes(text[at:end])
        while end < len(text) and piece[-1] not in BLANKS:  # a piece ends after a blank
            cut = max(piece.rfind(bytes([c])) for c in BLANKS)
            if cut >= 0:
                piece = piece[:cut + 1]
                break
            end = min(end + PIECE, len(text))
            piece = bytes(text[at:end])
        at += len(piece)
        parts.append(np.array([known.setdefault(w, len(known)) for w in piece.split()], np.int32))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), list(known)


def segments(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches [lo, hi) of at least ``least`` words that hold every run: in
    each, every word occurs ``times`` times or more (splitting stops early
    after ROUNDS rounds)."""
    at = np.arange(len(ids))                      # positions still alive
    for _ in range(ROUNDS):
        if len(at) < least:
            return []
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > 1
        seg = np.cumsum(new) - 1
        alive = (np.bincount(seg) >= least)[seg]
        if not alive.all():
            at, seg = at[alive], seg[alive]
        key = seg * (int(ids.max()) + 1) + ids[at]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(at)))
        keep = np.zeros(len(at), bool)
        keep[order] = np.repeat(size, size) >= times
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return []
    first = np.flatnonzero(np.append(True, np.diff(at) > 1))
    last = np.append(first[1:], len(at)) - 1
    return [(lo, hi) for lo, hi in zip(at[first].tolist(), (at[last] + 1).tolist()) if hi - lo >= least]


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.unique(left.astype(np.int64) * (int(right.max()) + 1) + right, return_inverse=True)[1]


def lag_scan(x: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a segment that are at least
    ``least`` words and ``times`` (3 or more) periods long."""
    out, k = [], 1
    rank = np.unique(x, return_inverse=True)[1]
    while True:
        if k >= 8:
            order = np.argsort(rank, kind="stable")
            same = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
            if not len(same):
                return out
            lag = np.zeros(len(rank) + 1, np.int64)
            lag[order[same]] = order[same + 1] - order[same]
            start = np.flatnonzero(np.append(lag[0] != 0, lag[1:] != lag[:-1]))
            q = lag[start]
            stop = np.append(start[1:], len(lag))
            length = stop - start - 1 + q + k
            ok = (q > (k // 2 if k > 8 else 0)) & (q <= k) & (length >= np.maximum(least, times * q))
            out += zip(start[ok].tolist(), length[ok].tolist(), q[ok].tolist())
        if len(x) < (times * (k + 1) if k >= 8 else 2 * k):
            return out
        rank = _ranks(rank[:-k], rank[k:])
        k *= 2


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start and period."""
    found = []
    if len(ids) >= least:
        for lo, hi in segments(ids, least, times):
            found += [(lo + s, n, q) for s, n, q in lag_scan(ids[lo:hi], least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(ids: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        edge = np.zeros(len(ids) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        ids = ids[np.cumsum(edge[:-1]) == 0]
    step = 1 << 16
    return b" ".join(b" ".join([words[i] for i in ids[a:a + step].tolist()]) for a in range(0, len(ids), step))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then
    period) and collapsed: the words of the text without those that stand in a
    run after its first period, joined by one blank.

    Words are runs of other characters than blanks and U+0009 to U+000D. A run
    is a maximal stretch of smallest period q of at least max(least, times * q)
    words; ``times`` is 3 or more and ``least`` at least 8 * times. Runs may
    overlap; all are found, and a word goes if any run has it after its first
    q words. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Rows stay rows: null and repeated ids and repeated rows are
    kept as they are, an empty table gives no rows, other columns are not
    read. A text is worked on alone, with memory in proportion to its words.
    """
    if times < 3 or least < 8 * times:
        raise ValueError("times must be 3 or more, and least 8 * times or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            view = memoryview(raw)
            for lo, hi in row_chunks(offsets):
                n, runs, left = [], [], []
                for a, z in zip(offsets[lo:hi].tolist(), offsets[lo + 1:hi + 1].tolist()):
                    ids, words = word_ids(view[a:z])
                    found = runs_of(ids, least, times)
                    n.append(len(ids))
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                    left.append(_collapsed(ids, words, found))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)),
                     pa.array(left, pa.binary()).cast(pa.string(), safe=False)], ["doc_id", "n_words", "runs", "collapsed"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic tail put into a tenth of the documents:
    h = crc32(doc_id as text), g = floor(h / 10); where h % 10 = 0, each word
    i >= a becomes word a + (i - a) % p, with a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Other texts, null texts, texts
    without words and rows of null ids stay as they are."""
    d = id_and_text(docs)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hit = d.withColumn("h", F.coalesce(h, F.lit(1))).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    hit = hit.withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("long")).withColumn("g", F.expr("h div 10"))
    hit = hit.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    hit = hit.withColumn("p", F.expr("case when n > 0 then 1 + (n - a) div (3 + g % 8) end"))
    tail = F.expr("array_join(transform(w, (x, i) -> case when i < a then x else w[cast(a + (i - a) % p as int)] end), ' ')")
    return hit.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The runs of ``collapse_runs`` in short: n_runs; start, length, period
    and exponent_milli of the run of greatest exact length / period (ties:
    smallest start, then period; null without runs); and digests."""
    best = F.expr("array_sort(runs, (x, y) -> case when x.length * y.period > y.length * x.period then -1 "
                  "when x.length * y.period < y.length * x.period then 1 when x.start < y.start then -1 when x.start > y.start then 1 "
                  "when x.period < y.period then -1 when x.period > y.period then 1 else 0 end)")
    d = found.withColumn("b", F.get(best, F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period",
                    F.expr("1000 * b.length div b.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
