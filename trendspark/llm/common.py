"""Shared helpers of the training-data operators: text columns, chunks of
Arrow batches, ragged gathers, rolling hashes and a vectorised hash table."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20  # bytes (or code points) worked on at a time; no result depends on it
STEP = 1 << 18   # the same where many bytes are held for each byte of text

_BASE = np.uint64(0x9E3779B97F4A7C55)          # odd, so it has an inverse modulo 2**64
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (null text: empty)."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Row ranges (lo, hi) of at most ``limit`` bytes, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one after another."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def _powers(which: str, n: int) -> np.ndarray:
    have = _pow.get(which)
    if have is None or len(have) < n:
        size = max(CHUNK + 4096, n)
        p = np.full(size, _BASE if which == "up" else _BASE_INV, np.uint64)
        p[0] = 1
        _pow[which] = have = np.cumprod(p)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums P with n + 1 entries of the polynomial hash modulo 2**64."""
    v = (values.astype(np.uint64) + np.uint64(1)) * _powers("up", len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(v, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span [start, end), the same wherever it stands."""
    h = (prefix[ends] - prefix[starts]) * _powers("down", len(prefix))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every span [start, end), none empty: sums of the
    mixed pairs of value and place in the span, so a span's hash does not
    follow from the hashes of its parts (a polynomial's would)."""
    lens = ends - starts
    at = spread(starts, lens)
    first = np.cumsum(lens) - lens
    place = (np.arange(len(at)) - np.repeat(first, lens)).astype(np.uint64)
    m = mix((values[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F) + place * np.uint64(0x9E3779B97F4A7C15))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    size = lens.astype(np.uint64)
    one = mix(np.add.reduceat(m, first) + size)
    m ^= m >> np.uint64(29)
    m *= np.uint64(0xC2B2AE3D27D4EB4F)
    m ^= m >> np.uint64(31)
    return one, mix(np.add.reduceat(m, first) ^ size)


def tidied(run):
    """An Arrow function that hands its worker's free memory back at the end
    of a task (workers are used again by other steps)."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return tidy


class HashTable:
    """Open-addressing map from 64-bit keys to 0, 1, 2, ... in order of ``add``."""

    def __init__(self, bits: int = 16):
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of every key, -1 where it is not there."""
        h = np.where(h == 0, np.uint64(1), h)
        slot = self._slots(h)
        k = self.keys[slot]
        out = np.where(k == h, self.vals[slot], -1)
        todo = np.flatnonzero((k != h) & (k != 0))
        mask = (1 << self.bits) - 1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            k = self.keys[slot[todo]]
            hit = k == h[todo]
            out[todo[hit]] = self.vals[slot[todo[hit]]]
            todo = todo[~hit & (k != 0)]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Add distinct keys that are not there; their indices."""
        vals = np.arange(self.n, self.n + len(h), dtype=np.int32)
        if (self.n + len(h)) * 2 > 1 << self.bits:
            live = self.keys != 0
            keys, old, n = self.keys[live], self.vals[live], self.n
            bits = self.bits
            while (n + len(h)) * 3 > 1 << bits:
                bits += 1
            self._clear(bits)
            self._put(keys, old)
            self.n = n
        self._put(np.where(h == 0, np.uint64(1), h), vals)
        self.n += len(h)
        return vals

    def _put(self, h: np.ndarray, vals: np.ndarray) -> None:
        slot, mask, todo = self._slots(h), (1 << self.bits) - 1, np.arange(len(h))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            at = todo[free]
            self.keys[slot[at]] = h[at]
            won = self.keys[slot[at]] == h[at]
            self.vals[slot[at[won]]] = vals[at[won]]
            lost = np.ones(len(todo), bool)
            lost[np.flatnonzero(free)[won]] = False
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & mask


FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame, id_col: str) -> np.ndarray:
    """Bits of a Bloom filter over the ids, of one fixed size (1 MB) at any
    number of ids: with very many ids it lets more rows pass, never fewer."""
    slot = F.explode(F.array(*[F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(FILTER_BITS)) for seed in (1, 2)]))
    words = ids.select(slot.alias("slot")).groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def filter_slots(id_col: str) -> list:
    """Columns to look an id up in ``id_filter``'s bits."""
    return [F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(FILTER_BITS)).alias(f"slot{seed}") for seed in (1, 2)]


def may_hold(bits: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    out = np.ones(batch.num_rows, bool)
    for seed in (1, 2):
        slot = batch.column(f"slot{seed}").to_numpy().astype(np.int64)
        out &= (bits[slot >> 6] >> (slot & 63)) & 1 == 1
    return out
