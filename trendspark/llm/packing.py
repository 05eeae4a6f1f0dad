"""Packing of tokenised documents into sequences of a fixed length.

Method: best-fit decreasing. An overlong document is cut into full windows
and a rest; pieces are dealt by hash to shards of about ``shard_rows`` pieces,
and each shard places its pieces by falling length into the tightest open
sequence, found by a segment tree over remaining capacities. A shard loses at
most a few open sequences, so padding does not grow with the data, and no task
holds more than a shard of (short, numeric) rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize
from .common import STEP, id_and_text, row_chunks, string_bytes, tidied
from .words import byte_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
END_ID = 0


class CapacityTree:
    """Which remaining capacities 0..size have an open sequence, as a segment
    tree; ``tightest(need)`` is the smallest such capacity >= need."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size.bit_length())
        self.any = [False] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        i = capacity + self.leaves
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def take(self, capacity: int) -> int:
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            i = capacity + self.leaves
            self.any[i] = False
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = False
        return sequence

    def tightest(self, need: int) -> int | None:
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of every piece (given by falling length), and the
    number of sequences."""
    tree, seqs, offs, n = CapacityTree(size), [], [], 0
    for length in lengths:
        room = tree.tightest(length)
        if room is None:
            seq, room, n = n, size, n + 1
        else:
            seq = tree.take(room)
        seqs.append(seq)
        offs.append(size - room)
        if room > length:
            tree.put(room - length, seq)
    return seqs, offs, n


def token_pieces(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """One row per piece: every document's ids and the end id, cut into
    windows of ``size``; null text is empty (one piece, the end id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_encoder(tokenizer)
        for b in batches:
            texts = b.column("text")
            doc_ids = b.column("doc_id")
            _, offsets = string_bytes(texts)
            for lo, hi in row_chunks(offsets, STEP):
                ids, counts = enc.encode(texts.slice(lo, hi - lo).to_pylist())
                n = counts + 1
                full = np.full(int(n.sum()), END_ID, "<u4")
                ends = np.cumsum(n)
                body = np.ones(len(full), bool)
                body[ends - 1] = False
                full[body] = ids
                k = -(-n // size)
                doc = np.repeat(np.arange(hi - lo), k)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * size
                length = np.minimum(size, n[doc] - start)
                at = (ends - n)[doc] + start
                raw = memoryview(full).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * a:4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())), np.int64, len(at))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[doc])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return id_and_text(docs).mapInArrow(tidied(run), PIECES)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, shard_rows: int = 32768) -> DataFrame:
    """Pieces with ``sequence_id`` (0, 1, ... without gaps) and ``offset``.

    Nulls: a null text is an empty one, a null doc_id is kept. An empty
    document is one piece of one id. Repeated rows are packed once each. An
    empty table gives no rows. Other columns of ``docs`` are not read. A last
    sequence's end is padding: the sum of lengths says how much.
    """
    pieces = materialize(token_pieces(docs, tokenizer, size), "pack-pieces")
    shards = max(1, -(-pieces.count() // shard_rows))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="last")
        seqs, offs, n = best_fit(pdf["length"].tolist(), size)
        return pdf.assign(local=np.array(seqs, np.int64), offset=np.array(offs, np.int64), used=np.int64(n))

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    placed = materialize(
        dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(place, f"{PIECES}, shard long, local long, offset long, used long"), "pack-placed")
    # as many rows as shards, so the prefix sum is over a small table
    sums = placed.groupBy("shard").agg(F.max("used").alias("n"))
    sums = sums.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    return placed.join(sums, "shard").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset")
