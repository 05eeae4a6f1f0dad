"""BPE encoding and decoding of a lower-casing word tokenizer.

Method: a segment tree over the ranks of adjacent pairs. Its root is the
leftmost pair of lowest rank; a merge replaces two symbols by one and updates
the two pairs beside it in logarithmic time, until no pair has a rank. Each
distinct word of a worker is merged once; ids are then gathered for whole
texts, and decoding gathers the tokens' bytes again from the ids.
"""
from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import HashTable, id_and_text, row_chunks, spread, string_bytes
from .words import WordEncoder, byte_letters

NO_RANK = 1 << 60


class PairTree:
    """Minimum segment tree over pair ranks; ties go left."""

    def __init__(self, ranks: list[int]):
        n = 1
        while n < len(ranks):
            n *= 2
        self.n = n
        self.best = [NO_RANK] * n + ranks + [NO_RANK] * (n - len(ranks))
        self.at = list(range(n)) * 2
        for i in range(n - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        a, b = 2 * i, 2 * i + 1
        c = a if self.best[a] <= self.best[b] else b
        self.best[i] = self.best[c]
        self.at[i] = self.at[c]

    def set(self, k: int, rank: int) -> None:
        best, at = self.best, self.at
        i = k + self.n
        best[i] = rank
        i >>= 1
        while i:
            c = 2 * i
            if best[c + 1] < best[c]:
                c += 1
            if best[i] == best[c] and at[i] == at[c]:
                return  # nothing changes above
            best[i], at[i] = best[c], at[c]
            i >>= 1

    def lowest(self) -> tuple[int, int]:
        return (self.best[1], self.at[1]) if self.n > 1 else (self.best[1], 0)


class PairTrees:
    """The same trees for many short words at a time, one row each: ``size``
    leaves a row, roots in column 1, updates level by level."""

    def __init__(self, ranks: np.ndarray):
        rows, self.size = ranks.shape
        self.best = np.full((rows, 2 * self.size), NO_RANK, np.int64)
        self.best[:, self.size:] = ranks
        level = self.size
        while level > 1:
            self.best[:, level // 2:level] = np.minimum(self.best[:, level:2 * level:2], self.best[:, level + 1:2 * level:2])
            level //= 2

    def lowest(self, rows: np.ndarray) -> np.ndarray:
        """Leftmost place of each root's rank."""
        node = np.ones(len(rows), np.int64)
        want = self.best[rows, 1]
        while node[0] < self.size:
            node *= 2
            node += self.best[rows, node] != want
        return node - self.size

    def set(self, rows: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
        node = places + self.size
        self.best[rows, node] = ranks
        level = self.size
        while level > 1:
            node //= 2
            level //= 2
            self.best[rows, node] = np.minimum(self.best[rows, 2 * node], self.best[rows, 2 * node + 1])


class WordBpe:
    """Encoder and decoder of one tokenizer file with word-end marks."""

    def __init__(self, path: str):
        import regex
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {}
        for r, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        self.pair_rank = HashTable(18)
        self.pair_rank.add(np.array([a << 32 | b for a, b in self.ranks], np.uint64) + np.uint64(1))
        self.merged = np.array([x for _, x in self.ranks.values()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.byte_id = np.array([self.vocab[x] for x in self.letters], np.int64)
        self.last_id = np.array([self.vocab[x + self.suffix] for x in self.letters], np.int64)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # fixed value: the pattern of the file's pre-tokenizer
        self._words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        shown = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.name_len = np.array([len(x) for x in shown], np.int64)
        self.name_start = np.cumsum(self.name_len + 1) - self.name_len - 1
        self.name_bytes = np.frombuffer(b"".join(x + b" " for x in shown), np.uint8)
        self.encoder = WordEncoder(True, self.merge_words, self.encode_text, "<|")

    def merge(self, word: str) -> list[int]:
        """Ids of one word (already normalised)."""
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.suffix
        ids = [self.vocab[x] for x in letters]
        n = len(ids)
        if n == 1:
            return ids
        ranks, none = self.ranks, (NO_RANK, -1)
        tree = PairTree([ranks.get((ids[i], ids[i + 1]), none)[0] for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            rank, i = tree.lowest()
            if rank == NO_RANK:
                break
            j = after[i]
            ids[i] = ranks[ids[i], ids[j]][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                tree.set(i, ranks.get((ids[i], ids[k]), none)[0])
            else:
                tree.set(i, NO_RANK)
            if j < n - 1:
                tree.set(j, NO_RANK)
            if (h := before[i]) >= 0:
                tree.set(h, ranks.get((ids[h], ids[i]), none)[0])
        return [x for x in ids if x >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pair_rank.find((left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1))
        return np.where((left < 0) | (right < 0) | (found < 0), np.int64(NO_RANK), found)

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Words as rows of symbols, -1 where a row has ended or a symbol has gone."""
        rows, width = ids.shape
        ids = np.concatenate([ids, np.full((rows, 1), -1)], axis=1)  # column ``width``: beyond the end
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        before = np.tile(np.arange(-1, width), (rows, 1))
        tree = PairTrees(self._rank(ids[:, :width].ravel(), ids[:, 1:].ravel()).reshape(rows, width))
        live = np.arange(rows)
        while len(live := live[tree.best[live, 1] < NO_RANK]):
            i = tree.lowest(live)
            j = after[live, i]
            k = after[live, j]
            ids[live, i] = new = self.merged[tree.best[live, 1]]
            ids[live, j] = -1
            after[live, i] = k
            inner = k < width
            before[live[inner], k[inner]] = i[inner]
            tree.set(live, j, np.full(len(live), NO_RANK))
            tree.set(live, i, self._rank(new, ids[live, np.minimum(k, width)]))
            h = before[live, i]
            some = h >= 0
            tree.set(live[some], h[some], self._rank(ids[live[some], h[some]], new[some]))
        return ids[:, :width]

    def merge_words(self, cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, given and returned flat with lengths: words of up
        to 64 bytes in rows, longer ones by themselves."""
        text = cp.tobytes().decode("utf-32-le")
        ends = np.cumsum(lens)
        size = 1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000)
        n = np.add.reduceat(size, ends - lens)
        raw = np.frombuffer(text.encode(), np.uint8)
        start = np.cumsum(n) - n
        words, ids = [], []
        low = 0
        for width in (2, 4, 8, 16, 32, 64):
            pick = np.flatnonzero((n > low) & (n <= width))
            low = width
            if len(pick):
                grid = np.full((len(pick), width), -1, np.int64)
                inside = np.arange(width) < n[pick][:, None]
                grid[inside] = self.byte_id[raw[spread(start[pick], n[pick])]]
                grid[np.arange(len(pick)), n[pick] - 1] = self.last_id[raw[start[pick] + n[pick] - 1]]
                grid = self._merge_rows(grid)
                words.append(np.repeat(pick, (grid >= 0).sum(axis=1)))
                ids.append(grid[grid >= 0])
        for w in np.flatnonzero(n > low).tolist():
            ids.append(np.array(self.merge(text[ends[w] - lens[w]:ends[w]]), np.int64))
            words.append(np.full(len(ids[-1]), w))
        order = np.concatenate(words)
        return np.concatenate(ids)[np.argsort(order, kind="stable")].astype(np.uint32), np.bincount(order, minlength=len(lens))

    def encode_text(self, text: str) -> list[int]:
        """The plain path: special tokens, normalisation, words, merges."""
        out: list[int] = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                for w in self._words.findall(part):
                    out += self.merge(w)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' names joined by blanks, as UTF-8."""
        if not len(ids):
            return b""
        at = spread(self.name_start[ids], self.name_len[ids] + 1)
        return self.name_bytes[at].tobytes()[:-1]


_models: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def encode_decode(docs: DataFrame, tokenizer: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also the
    ids and the decoded text.

    Null text is empty (no ids, empty decoded text); a null doc_id is kept;
    repeated rows give repeated rows; an empty table gives no rows; other
    columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id")
            _, offsets = string_bytes(texts)
            for lo, hi in row_chunks(offsets):
                ids, counts = bpe.encoder.encode(texts.slice(lo, hi - lo).to_pylist())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4")).cast("B")
                spans = list(zip((ends - counts).tolist(), ends.tolist()))
                decoded = [bpe.decode(ids[a:z]) for a, z in spans]
                cols = [doc_ids.slice(lo, hi - lo), pa.array(counts),
                        pa.array([hashlib.sha256(raw[4 * a:4 * z]).hexdigest() for a, z in spans], pa.string()),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.array([ids[a:z].astype(np.int64).tolist() for a, z in spans], pa.list_(pa.int64())),
                             pa.array([d.decode() for d in decoded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
    more = ", ids array<long>, decoded string" if keep else ""
    return id_and_text(docs).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
