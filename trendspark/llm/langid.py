"""Language identification by prediction by partial matching.

Per language a variable-order byte context tree (contexts of 3, 2, 1 and 0
bytes) holds frozen counts. The code length of a byte is that of its longest
known context: with N bytes seen after it, D of them distinct, a byte seen n
times costs -log2(n / (N + D)), and any other byte costs the escape
-log2(D / (N + D)) plus its code length one order lower; below order 0 a byte
costs 8 bits. The language with the shortest code for the whole text wins.

All trees share one table: an entry is a context with its next byte and has
the finished code length in every language, so scoring is one look-up a byte,
and more only where no language knows the longer context.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import STEP, HashTable, row_chunks, spread, string_bytes, tidied

ORDER = 3
SAMPLE_DOCS = 300        # documents of each language that the trees are learned from, at most
LONG = 1 << 16           # longer documents are learned from only where a language has no shorter ones
SAMPLE_BYTES = SAMPLE_DOCS * LONG  # bytes of each language that the trees are learned from, but for the last document
PIECE = 1 << 22          # bytes counted at once
UNKNOWN = "und"


def held_out() -> F.Column:
    """Remainder 2 of crc32 of the id as text modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ORDER zero bytes before each text; places of the texts' bytes."""
    lens = np.diff(offsets)
    at = spread(offsets[:-1] - offsets[0] + ORDER * np.arange(1, len(lens) + 1), lens)
    out = np.zeros(len(at) + ORDER * len(lens), np.uint8)
    out[at] = raw[offsets[0]:offsets[-1]]
    return out, at


def _grams(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    key = np.zeros(len(at), np.uint64)
    for back in range(order, -1, -1):
        key = key << np.uint64(8) | data[at - back].astype(np.uint64)
    return key


def gram_counts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, long: int = LONG) -> pd.DataFrame:
    """lang, gram (context and byte), n of the learning sample: the
    ``sample_docs`` documents of each language that come first by a hash of
    their id, until they have ``sample_bytes``. Those of more than ``long``
    bytes are taken, and whole, where a language has no shorter ones. Bounded
    by the sample's bytes, so the driver can hold it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.octet_length("text").alias("size")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.withColumn("long", F.col("size") > long)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id"))
    first = rows.groupBy("lang", "long", "doc_id").agg(F.max("size").alias("size")).withColumn("rank", rank).filter(F.col("rank") <= sample_docs)
    before = F.coalesce(F.sum("size").over(W.partitionBy("lang").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    only_long = F.min("long").over(W.partitionBy("lang"))
    chosen = first.withColumns({"before": before, "only_long": only_long}).filter((F.col("long") == F.col("only_long")) & (F.col("before") < sample_bytes))
    sample = rows.join(F.broadcast(chosen.select("lang", "doc_id", "long")), ["lang", "doc_id", "long"], "left_semi").dropDuplicates(["lang", "doc_id"])
    sample = sample.coalesce(4)  # bounded by the sample; fewer partial counts of the same grams

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                mine = np.flatnonzero(langs == lang)
                lens = np.diff(offsets)[mine]
                data, at = _padded(raw[spread(offsets[mine], lens)], np.concatenate([[0], np.cumsum(lens)]))
                for lo in range(0, len(at), PIECE):
                    keys, n = np.unique(_grams(data, at[lo:lo + PIECE], ORDER), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
    return sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()


class Trees:
    """Frozen context trees of all languages; see the module's text."""

    def __init__(self, counts: pd.DataFrame):
        self.langs: list[str] = sorted(counts["lang"].unique())
        n_lang = len(self.langs)
        column = counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(np.int64)
        grams, n = counts["gram"].to_numpy(np.int64).astype(np.uint64), counts["n"].to_numpy(np.float64)
        keys, rows, below = [], [], None
        for k in range(ORDER + 1):
            cut = grams & np.uint64((1 << 8 * (k + 1)) - 1)
            g, where = np.unique(cut, return_inverse=True)
            seen = np.zeros((len(g), n_lang))
            np.add.at(seen, (where, column), n)
            ctx, of = np.unique(g >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            known = total > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(known, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(seen / (total + kinds)[of])
            lower = 8.0 if below is None else below[1][np.searchsorted(below[0], g & np.uint64((1 << 8 * k) - 1))]
            cost = np.where(seen > 0, own, escape[of] + lower)
            keys += [g | np.uint64((k + 1) << 56), ctx | np.uint64((0x80 | k) << 56)]
            rows += [cost, escape]
            below = (g, cost)
        self.table = HashTable(18)
        self.table.add(np.concatenate(keys) if n_lang else np.zeros(0, np.uint64))
        self.cost = np.concatenate(rows + [np.zeros((1, n_lang))])  # the last row: a context no language knows

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        data, at = _padded(raw, offsets)
        if not len(at) or not self.langs:
            return out
        cost, todo = np.zeros((len(at), len(self.langs))), np.arange(len(at))
        for k in range(ORDER, -1, -1):
            gram = _grams(data, at[todo], k)
            row = self.table.find(gram | np.uint64((k + 1) << 56))
            hit = row >= 0
            cost[todo[hit]] += self.cost[row[hit]]
            todo, gram = todo[~hit], gram[~hit]
            if not len(todo):
                break
            cost[todo] += self.cost[self.table.find((gram >> np.uint64(8)) | np.uint64((0x80 | k) << 56))]
        cost[todo] += 8.0
        lens = np.diff(offsets)
        some = np.flatnonzero(lens)
        out[some] = np.add.reduceat(cost, (np.cumsum(lens) - lens)[some], axis=0)
        return out


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, long: int = LONG) -> Trees:
    """The trees of the labelled documents, see ``gram_counts``; without
    languages where there are none to learn from."""
    return Trees(gram_counts(docs, sample_docs, sample_bytes, long))


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


PREDICTION = "held_out boolean, lang_pred string, score double, bits_per_byte double"


def with_language(docs: DataFrame, learn_from: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES,
                  long: int = LONG, trees: Trees | None = None) -> DataFrame:
    """``docs`` with held_out, lang_pred, score (probability of the language
    among the learned ones, all equally likely before) and bits_per_byte; input
    columns of these names are replaced.

    Learns from ``learn_from`` (default: ``docs``), see ``gram_counts``, unless
    learned ``trees`` are given; only
    the text is used to predict. Null texts and texts without a letter get
    ``und`` and score 0, as all do when no document can be learned from. Ties
    go to the language that comes first by name. Null ids and repeated rows
    are kept; an empty table gives no rows.
    """
    trees = trees or learn(docs if learn_from is None else learn_from, sample_docs, sample_bytes, long)
    model = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample
    new = [x.split()[0] for x in PREDICTION.split(", ")]
    rows = docs.drop(*new).withColumn(new[0], held_out())
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        for b in batches:
            texts = b.column(names.index("text"))
            raw, offsets = string_bytes(texts)
            for lo, hi in row_chunks(offsets, STEP):
                bits = t.code_lengths(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                langs, scores, rates = [], [], []
                for i, text in enumerate(texts.slice(lo, hi - lo).to_pylist()):
                    if not t.langs or not text or not _has_letter(text):
                        langs.append(UNKNOWN), scores.append(0.0), rates.append(None)
                        continue
                    best = int(np.argmin(bits[i]))
                    langs.append(t.langs[best])
                    scores.append(float(1 / np.exp2(np.maximum(bits[i][best] - bits[i], -1000)).sum()))
                    rates.append(float(bits[i][best] / (offsets[lo + i + 1] - offsets[lo + i])))
                some = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                                  pa.array(rates, pa.float64())], [*names, *new[1:]])
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.StringType() if n == "lang_pred" else T.DoubleType()) for n in new[1:]]])
    return rows.mapInArrow(tidied(run), schema)


def predict(docs: DataFrame, learn_from: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES,
            long: int = LONG) -> DataFrame:
    """doc_id and the columns of ``with_language``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    return with_language(rows, rows if learn_from is None else learn_from, sample_docs, sample_bytes, long).drop("text", "lang")
