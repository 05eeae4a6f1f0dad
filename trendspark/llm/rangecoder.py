"""Token-id files, compressed by an adaptive context-mixing range coder.

An id is coded against predictions of order 2 (the id that last followed the
two ids before it), order 1 (the one before it) and order 0 (counts). Whether a
prediction holds is a binary decision; its probability mixes, in the logistic
domain and with weights that adapt, what the prediction's own confidence, the
recent decisions and whether both predictions agree say. An id that no
prediction gives is coded by order 0 in two levels: its group, by counts that
are brought up to date at fixed places of a block, and its share of the group,
by a table of all ids of the blocks that are written together. All arithmetic
is in integers, so any machine decodes what another one wrote.

Blocks of BLOCK ids are reset and checksummed: each is read alone, given the
table before it, and a damaged one is found. The blocks of a task run in step,
one numpy lane each.

A file is a table of blocks, sorted by (part, block): the encoded block, and
doc_id and number of ids of the documents that begin in it. A row with an
order-0 table goes before the blocks that use it; no document begins in it.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_and_text, row_chunks, string_bytes
from .words import byte_encoder

BLOCK = 8192
LANES = 1024
END_ID = 0
MAGIC, TABLE = b"CMR2", b"CMT2"
HEADER = struct.Struct("<4sIII")    # magic, ids, crc32 of the ids, crc32 of the payload
_BITS1, _BITS2 = 11, 12             # slots of the order-1 and order-2 predictions
_BITS = 12                          # of a decision, of the groups and of a group's ids
_MOST, _MASSES = 512, 150           # ids of a group; groups, before long ones are cut
_REFRESH = (0, 256, 1024, 2560, 5120)
_U = np.uint64
_B, _WORD, _TOP, _FULL, _LAST, _LOW, _ONE = (np.array(x, _U) for x in (_BITS, 16, 48, 1 << 48, (1 << _BITS) - 1, 0xFFFF, 1))
_SIXTEEN = np.array(16, np.int32)


def _stretch_table() -> tuple[np.ndarray, np.ndarray]:
    """Logistic tables in integers: stretch of 12-bit probabilities (8 bits of
    fraction), and squash of -2047..2047 back to 12 bits."""
    squash = np.array([int(4096 / (1 + np.exp(-x / 256)) + 0.5) for x in range(-2047, 2048)])
    squash = np.clip(squash, 1, 4095)
    stretch = np.searchsorted(squash, np.arange(4096), "left").clip(0, 4094) - 2047
    return stretch.astype(np.int32), squash.astype(np.int32)


STRETCH, SQUASH = _stretch_table()
# change of a prediction by its confidence, wrong (halved) and right (one more)
SURER = np.array([c // 2 - c for c in range(16)] + [1] * 15 + [0], np.int32)


class Table:
    """Order-0 counts of the ids of some blocks. The ids that occur, ascending,
    are the symbols; groups of neighbours have about equal counts, and in a
    group each symbol has a share of 2**_BITS, one at least."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts
        place = np.arange(len(ids))
        before = np.cumsum(counts) - counts
        total = int(counts.sum())
        mass = before * _MASSES // max(total, 1)
        new = np.diff(mass, prepend=-1) != 0
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % _MOST == 0
        first = np.flatnonzero(new)
        self.group, self.groups = np.cumsum(new) - 1, len(first)
        sums = np.add.reduceat(counts, first) if len(first) else counts
        own, start = np.diff(first, append=len(ids)), first[self.group]
        self.start = place - start + (before - before[start]) * ((1 << _BITS) - own)[self.group] // sums[self.group]
        ends = np.append(self.start[1:], 0)
        ends[np.append(first[1:], len(ids))[:len(first)] - 1] = 1 << _BITS
        self.size = ends - self.start
        self.prior = 1 + sums * 4096 // max(total, 1)

    @classmethod
    def of(cls, ids: np.ndarray, vocabulary: int) -> Table:
        counts = np.bincount(ids, minlength=vocabulary)
        return cls(np.flatnonzero(counts), counts[counts > 0])

    def to_bytes(self) -> bytes:
        raw = np.concatenate([np.diff(self.ids, prepend=0), self.counts]).astype("<u4")
        payload = zlib.compress(raw.view(np.uint8).reshape(-1, 4).T.tobytes())
        return HEADER.pack(TABLE, len(self.ids), zlib.crc32(raw.tobytes()), zlib.crc32(payload)) + payload

    @classmethod
    def from_bytes(cls, data: bytes, vocabulary: int) -> Table:
        magic, n, raw_crc, crc = HEADER.unpack_from(data)
        payload = data[HEADER.size:]
        if magic != TABLE or zlib.crc32(payload) != crc:
            raise ValueError("damaged table")
        raw = np.frombuffer(zlib.decompress(payload), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        if len(raw) != 2 * n or zlib.crc32(raw.tobytes()) != raw_crc:
            raise ValueError("damaged table")
        ids = np.cumsum(raw[:n], dtype=np.int64)
        if n and ids[-1] >= vocabulary:
            raise ValueError("the table has ids that the vocabulary has not")
        return cls(ids, raw[n:].astype(np.int64))


def _side_by_side(*tables: tuple[int, type]) -> list[np.ndarray]:
    """Zeroed tables of so many numbers in one piece of memory, which the
    system may then map by large pages: they are read at random."""
    at = np.cumsum([0] + [-(-n * np.dtype(kind).itemsize // 64) * 64 for n, kind in tables])
    piece = np.zeros(int(at[-1]), np.uint8)
    return [piece[lo:lo + n * np.dtype(kind).itemsize].view(kind) for lo, (n, kind) in zip(at.tolist(), tables)]


def _switches(hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """1 in the lanes of order 2, of order 1 and of order 0. Products with them
    choose, since numpy's own choice by a mask without a pattern takes longer."""
    two, one = hit2.astype(_U), hit1.astype(_U)
    return two, one, _ONE - two - one


class Encoder:
    """Lower ends and ranges of all lanes. The last word of a lane is held back
    for a carry; words are wider than 16 bits until the payload is taken."""

    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        self.out, self.held = np.zeros(lanes * room, np.uint32), np.zeros(lanes, _U)
        self.start = np.arange(lanes) * room  # a first word that is none is written there
        self.pos = self.start.copy()

    def code(self, model: Model, f: np.ndarray, known: np.ndarray, ids: np.ndarray):
        """Code an id in each lane: whether it is the order-2 prediction, if
        not, whether the order-1 one, if not, its group and its share of it."""
        hit2, hit1 = right = known == ids
        hit1 = hit1 > hit2
        take2, take1, take0 = _switches(hit2, hit1)
        split2 = (self.range >> _B) * f[0]
        rest = self.range - split2
        split1 = (rest >> _B) * f[1]
        rest -= split1
        group = model.table.group.take(ids)
        start, size = model.group_share(group)
        rest >>= _B
        inner = (rest * size) >> _B
        up = rest * start
        up += split2
        up += split1
        start, size = model.symbol_share(ids)
        up += inner * start
        up *= take0
        up += split2 * take1
        rng = inner * size
        rng *= take0
        rng += split1 * take1
        rng += split2 * take2
        low = self.low + up
        self.held += low < up
        self.out[self.pos] = self.held  # written again where the lane does not move on
        small = rng < _FULL
        self.held += ((low >> _TOP) - self.held) * small
        self.pos += small
        shift = small * _WORD
        low <<= shift
        rng <<= shift
        more = (rng < _FULL).nonzero()[0]
        while len(more):
            self.out[self.pos[more]] = self.held[more]
            self.pos[more] += 1
            lo, r = low[more], rng[more] << _WORD
            self.held[more], low[more], rng[more] = lo >> _TOP, lo << _WORD, r
            more = more[r < _FULL]
        self.low, self.range = low, rng
        return ids, right, hit1, group

    def payload(self, lane: int) -> bytes:
        low = int(self.low[lane])
        words = np.append(self.out[self.start[lane] + 1:self.pos[lane]], [int(self.held[lane])] * int(self.pos[lane] > self.start[lane]))
        words = np.append(words, [low >> k & 0xFFFF for k in (48, 32, 16, 0)]).astype(np.uint32)
        while (carry := words >> 16).any():
            words &= 0xFFFF
            words[:-1] += carry[1:]
        return words.astype("<u2").tobytes()


class Decoder:
    """Codes above the lower ends, and ranges, of all lanes."""

    def __init__(self, payloads: list[bytes]):
        n = len(payloads)
        self.range = np.full(n, (1 << 64) - 1, _U)
        sizes = [len(p) // 2 for p in payloads]
        room = max(sizes, default=0) + 4
        data = np.zeros((n, room), np.uint16)
        for i, p in enumerate(payloads):
            data[i, :sizes[i]] = np.frombuffer(p, "<u2")
        self.above = sum((data[:, k].astype(_U) << _U(48 - 16 * k) for k in range(4)), np.zeros(n, _U))
        self.data, self.pos, self.end = data.ravel(), np.arange(n) * room + 4, np.arange(1, n + 1) * room - 1

    def code(self, model: Model, f: np.ndarray, known: np.ndarray, ids: None):
        above = self.above
        split2 = (self.range >> _B) * f[0]
        rest = self.range - split2
        split1 = (rest >> _B) * f[1]
        rest -= split1
        hit2 = above < split2
        above2 = above - split2
        hit1 = above2 < split1      # not where hit2: the difference has wrapped around
        above = above2 - split1
        rest >>= _B
        group = model.find.take(model.find_base + np.minimum(above // rest, _LAST).view(np.int64)).astype(np.int64)
        start, size = model.group_share(group)
        inner = (rest * size) >> _B
        above -= rest * start
        symbol = model.symbols.take((group << _BITS) + np.minimum(above // inner, _LAST).view(np.int64)).astype(np.int64)
        start, size = model.symbol_share(symbol)
        above -= inner * start
        rng = inner * size
        take2, take1, take0 = _switches(hit2, hit1)
        above *= take0
        above += above2 * take1
        above += self.above * take2
        rng *= take0
        rng += split1 * take1
        rng += split2 * take2
        symbol += (known[1] - symbol) * hit1
        symbol += (known[0] - symbol) * hit2
        symbol = symbol.astype(np.int32)
        small = rng < _FULL
        shift = small * _WORD
        above <<= shift
        above += self.data.take(self.pos) * small
        rng <<= shift
        self.pos += small
        more = (rng < _FULL).nonzero()[0]
        while len(more):
            pos = np.minimum(self.pos[more], self.end[more])
            r = rng[more] << _WORD
            above[more], rng[more], self.pos[more] = (above[more] << _WORD) + self.data[pos], r, pos + 1
            more = more[r < _FULL]
        np.minimum(self.pos, self.end, out=self.pos)
        self.above, self.range = above, rng
        return symbol, known == symbol, hit1, group


class Model:
    """The state of all lanes; ``run`` codes or decodes one symbol in each.
    Arrays of two rows hold order 2 and order 1."""

    def __init__(self, lanes: int, table: Table, decode: bool):
        self.table, self.lanes, groups = table, lanes, table.groups
        at = np.arange(lanes)
        name = np.uint8 if groups <= 256 else np.uint16
        symbol = np.uint16 if len(table.ids) <= 1 << 16 else np.uint32
        # known: predictions, the symbol times 16 and a confidence of 0 to 15; groups, shares: start and size in one number;
        # p: decisions by confidence and agreement, and by history; for a decoder, the group of a lane's slot and the symbol of a group's
        self.known, self.groups, self.count, self.p, self.shares, self.find, self.symbols = _side_by_side(
            ((lanes << _BITS2) + (lanes << _BITS1), np.int32), (lanes * groups, np.uint32), (lanes * groups, np.int32), (lanes * 192, np.int32),
            (len(table.ids), np.uint64), ((lanes << _BITS) * decode, name), ((groups << _BITS) * decode, symbol))
        self.group_base, self.find_base, self.decode = at * groups, at << _BITS, decode
        self.shares[:] = table.start << 16 | table.size
        if decode:
            self.names = np.tile(np.arange(groups, dtype=name), lanes)
            self.symbols[:] = np.repeat(np.arange(len(table.ids), dtype=symbol), table.size)
        self.known_base = np.stack([at << _BITS2, (lanes << _BITS2) + (at << _BITS1)])
        self.known_shift = np.array([[32 - _BITS2], [32 - _BITS1]])
        self.p[:] = 1 << 15
        self.p_base = at * 192 + np.array([[[0], [32]], [[64], [128]]])
        self.w = np.full((2, 2, lanes), 1 << 16, np.int32)
        self.last, self.before, self.history = (np.zeros(lanes, np.int64) for _ in range(3))
        self.slot, self.place = np.zeros((2, lanes), np.int64), np.zeros((2, 2, lanes), np.int64)
        self.one, self.tried = np.zeros((2, lanes), np.int32), np.ones((2, lanes), np.int32)
        self.step = 0

    def refresh(self) -> None:
        """Group frequencies by the counts so far, and the table's to begin with."""
        groups = self.table.groups
        sums = np.cumsum(self.count.reshape(self.lanes, groups) * 8 + self.table.prior, axis=1)
        ends = np.arange(1, groups + 1) + sums * ((1 << _BITS) - groups) // sums[:, -1:]
        sizes = np.diff(ends, axis=1, prepend=0)
        self.groups[:] = (ends - sizes << 16 | sizes).ravel()
        if self.decode:
            self.find[:] = np.repeat(self.names, sizes.ravel())

    def group_share(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.groups.take(self.group_base + group).astype(_U)
        return both >> _WORD, both & _LOW

    def symbol_share(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.shares.take(symbol)
        return both >> _WORD, both & _LOW

    def run(self, coder: Encoder | Decoder, ids: np.ndarray | None) -> np.ndarray:
        if self.step in _REFRESH:
            self.refresh()
        slot, place, one, tried, w = self.slot, self.place, self.one, self.tried, self.w
        np.multiply(self.last, 0x9E3779B1, out=slot[1])
        np.multiply(self.before, 0x85EBCA77, out=slot[0])
        slot[0] += slot[1]
        slot &= 0xFFFFFFFF
        slot >>= self.known_shift
        slot += self.known_base
        old = self.known.take(slot)
        conf, known = old & 15, old >> 4
        apart = known[0] != known[1]
        np.add(self.p_base[0], conf, out=place[0])
        place[0, 0] += conf[0]
        place[0, 0] += apart
        np.add(self.p_base[1], self.history, out=place[1])
        p = self.p.take(place)
        s = STRETCH.take(p >> 4)
        both = w >> 4
        both *= s
        both = both[0] + both[1]
        both >>= 12
        both += 2047
        mixed = SQUASH.take(both, mode="clip")
        f = mixed.astype(_U)
        f[1] *= apart
        got, right, hit1, group = coder.code(self, f, known, ids)
        hit2 = right[0]
        one[0], one[1], tried[1] = hit2, hit1, apart > hit2
        # weights and probabilities
        err = one << 12
        err -= mixed
        err *= tried
        s *= err
        s >>= 10
        w += s
        np.maximum(w, 0, out=w)
        np.minimum(w, 1 << 19, out=w)
        goal = one * 65535 - p
        goal >>= 5
        goal *= tried
        goal += p
        self.p[place] = goal
        # predictions: surer where right, less sure where wrong, and another one where not sure
        conf += right * _SIXTEEN
        old += SURER.take(conf)
        old += ((got << 4) - old) * (conf < 2)
        self.known[slot] = old
        hit2 = hit2 | hit1
        if self.step < _REFRESH[-1]:
            place = self.group_base + group
            self.count[place] = self.count.take(place) + ~hit2
        self.before, self.last = self.last, got.astype(np.int64)
        self.history <<= 1
        self.history |= hit2
        self.history &= 63
        self.step += 1
        return got


def encode_blocks(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """An order-0 table, and blocks of an id stream, whole or (the last) shorter."""
    if not len(ids):
        return []
    table = Table.of(ids, vocabulary)
    out = [table.to_bytes()]
    symbol = np.zeros(vocabulary, np.int32)
    symbol[table.ids] = np.arange(len(table.ids))
    total = -(-len(ids) // BLOCK)
    for lo in range(0, total, LANES):
        lanes = min(LANES, total - lo)
        part = ids[lo * BLOCK:(lo + lanes) * BLOCK]
        sizes = np.full(lanes, BLOCK)
        sizes[-1] = len(part) - (lanes - 1) * BLOCK
        full = np.zeros(lanes * BLOCK, np.int32)
        full[:len(part)] = symbol[part]
        grid = np.ascontiguousarray(full.reshape(lanes, BLOCK).T)
        coder, model, last = Encoder(lanes, BLOCK * 3 + 8), Model(lanes, table, False), b""
        for t in range(int(sizes[0])):
            model.run(coder, grid[t])
            if t + 1 == sizes[-1]:  # what its lane does from here on is not used
                last = coder.payload(lanes - 1)
        for lane in range(lanes):
            raw = part[lane * BLOCK:lane * BLOCK + sizes[lane]].astype("<u4").tobytes()
            payload = coder.payload(lane) if lane < lanes - 1 else last
            out.append(HEADER.pack(MAGIC, int(sizes[lane]), zlib.crc32(raw), zlib.crc32(payload)) + payload)
    return out


def decode_blocks(blocks: list[bytes], vocabulary: int) -> list[np.ndarray]:
    """Ids of each block after its table (a table's own are none); raises
    where a checksum fails."""
    if not blocks:
        return []
    table = Table.from_bytes(blocks[0], vocabulary)
    heads, payloads = [], []
    for b in blocks[1:]:
        magic, n, ids_crc, crc = HEADER.unpack_from(b)
        payload = b[HEADER.size:]
        if magic != MAGIC or zlib.crc32(payload) != crc:
            raise ValueError("damaged block")
        heads.append((n, ids_crc))
        payloads.append(payload)
    out: list[np.ndarray] = [np.zeros(0, "<u4")]
    names = table.ids.astype("<u4")
    for lo in range(0, len(heads), LANES):
        some = heads[lo:lo + LANES]
        coder, model = Decoder(payloads[lo:lo + LANES]), Model(len(some), table, True)
        grid = np.zeros((max(n for n, _ in some), len(some)), np.int32)
        for t in range(len(grid)):
            grid[t] = model.run(coder, None)
        grid = np.ascontiguousarray(grid.T)
        for (n, ids_crc), row in zip(some, grid):
            out.append(names.take(row[:n]))
            if zlib.crc32(out[-1].tobytes()) != ids_crc:
                raise ValueError("damaged block")
    return out


BLOCKS = "part int, block int, doc_ids array<long>, doc_sizes array<long>, data binary"


def write_token_file(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode texts and write the file of blocks, documents by ascending id
    (nulls first, ties by text). Null text is empty; each document ends with
    id 0. Other columns are not read; an empty table gives an empty file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = byte_encoder(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        held, held_n, starts = [], 0, []   # ids not yet written; documents that begin in them

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, held_n, starts, number
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            take = len(ids) if whole else len(ids) // (LANES * BLOCK) * LANES * BLOCK
            blocks = encode_blocks(ids[:take], enc_size)
            at = np.array([s for s, _, _ in starts], np.int64) // BLOCK + 1  # after the table
            for k, data in enumerate(blocks):
                mine = [starts[i] for i in range(*np.searchsorted(at, [k, k + 1]).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([[d for _, d, _ in mine]], pa.list_(pa.int64())),
                     pa.array([[n for _, _, n in mine]], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                    [x.split()[0] for x in BLOCKS.split(", ")])
                number += 1
            starts = [(s - take, d, n) for s, d, n in starts if s >= take]
            held, held_n = [ids[take:]], len(ids) - take

        enc_size = _vocabulary(tokenizer)
        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id").to_pylist()
            _, offsets = string_bytes(texts)
            for lo, hi in row_chunks(offsets):
                ids, counts = enc.encode(texts.slice(lo, hi - lo).to_pylist())
                n = counts + 1
                full = np.full(int(n.sum()), END_ID, np.uint32)
                body = np.ones(len(full), bool)
                ends = np.cumsum(n)
                body[ends - 1] = False
                full[body] = ids
                starts += zip((held_n + ends - n).tolist(), doc_ids[lo:hi], n.tolist())
                held.append(full)
                held_n += len(full)
                if held_n >= LANES * BLOCK:
                    yield from flush(False)
        yield from flush(True)
    rows = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, BLOCKS).write.mode("overwrite").parquet(path)


_sizes: dict[str, int] = {}


def _vocabulary(tokenizer: str) -> int:
    if tokenizer not in _sizes:
        from tokenizers import Tokenizer
        _sizes[tokenizer] = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    return _sizes[tokenizer]


def read_token_file(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32,
    from the decoded blocks. A part is read as a stream, LANES blocks at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _vocabulary(tokenizer)
        table, waiting = b"", []
        state = {"part": None, "pos": 0, "open": [], "crc": 0, "left": 0}

        def drain() -> Iterator[pa.RecordBatch]:
            out = []
            for row, ids in zip(waiting, decode_blocks([table, *(r["data"] for r in waiting)], size)[1:] if waiting else []):
                if row["part"] != state["part"]:
                    if state["left"] or state["open"]:
                        raise ValueError("a block is missing")
                    state.update(part=row["part"], pos=0, open=[], crc=0, left=0)
                state["open"] += zip(row["doc_ids"], row["doc_sizes"])
                raw, at = memoryview(ids).cast("B"), 0
                while at < len(ids):
                    if not state["left"]:
                        state["left"], state["crc"] = state["open"][0][1], 0
                    n = min(state["left"], len(ids) - at)
                    state["crc"] = zlib.crc32(raw[4 * at:4 * (at + n)], state["crc"])
                    state["left"] -= n
                    at += n
                    if not state["left"]:
                        doc, n_tokens = state["open"].pop(0)
                        out.append((row["part"], doc, state["pos"], n_tokens, state["crc"]))
                        state["pos"] += n_tokens
            waiting.clear()
            if out:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])
        for b in batches:
            for row in b.to_pylist():
                if row["data"][:len(TABLE)] == TABLE:
                    yield from drain()
                    table = row["data"]
                    continue
                waiting.append(row)
                if len(waiting) == LANES:
                    yield from drain()
        yield from drain()
    blocks = spark.read.schema(BLOCKS).parquet(path).repartition("part").sortWithinPartitions("part", "block")
    return blocks.mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_file(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write the file, read it back: a row per document with its global start."""
    from ..session import materialize
    write_token_file(docs, path, tokenizer)
    spark = docs.sparkSession
    rows = materialize(read_token_file(spark, path, tokenizer), "token-rows")
    # as many rows as parts of the file
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(sums, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
