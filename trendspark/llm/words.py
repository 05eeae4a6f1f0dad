"""Texts to token ids through a table of the words met so far.

A byte-pair tokenizer encodes each pre-token by itself, so a text's ids are
its words' ids in order. Texts are cut into words with numpy, a word's ids are
computed once per Python worker, and a text with characters for which the fast
cut is not proven equal (marked below) takes a plain path of its own.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .common import HashTable, spread, word_hash

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
_SAFE_END = 0x3000
#: The characters of Unicode's White_Space below U+3000.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]


def char_classes(folded: bool) -> np.ndarray:
    """Class per code point below U+3000, UNSURE for the rest. ``folded``: for
    texts that are normalised and lower-cased first; characters that either
    step handles in context are UNSURE."""
    out = np.full(_SAFE_END + 1, UNSURE, np.uint8)
    for c in range(_SAFE_END):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if c in _WHITE:
            out[c] = SPACE
        elif ch.isspace() or kind in ("Cn", "Cs", "Co") or ch == "'":
            continue
        elif folded and (kind[0] == "M" or unicodedata.normalize("NFC", ch) != ch or len(ch.lower()) != 1 or ch in "Σσς"):
            continue
        else:
            out[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    return out


class WordEncoder:
    """``encode_words``: ids of single words, given and returned as one flat
    array with lengths; ``encode_text``: the plain path for a whole text;
    ``special``: texts holding this string take it."""

    def __init__(self, folded: bool, encode_words: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
                 encode_text: Callable[[str], list[int]], special: str, most: int = 1 << 20):
        self.folded, self.encode_words, self.encode_text, self.special, self.most = folded, encode_words, encode_text, special, most
        self.classes = char_classes(folded)
        self._reset()

    def _reset(self) -> None:
        self.table = HashTable()
        self.start, self.len, self.check = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _cut(self, cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words. ``first``: where texts begin."""
        n = len(cp)
        kind = self.classes[np.minimum(cp, _SAFE_END)]
        begin = np.zeros(n + 1, bool)
        begin[1:n] = kind[1:] != kind[:-1]
        begin[first] = True
        begin[n] = True
        if self.folded:
            begin[:n] |= kind == NUMBER
            begin[1:n] |= kind[:-1] == NUMBER
            s = np.flatnonzero(begin)
            s, e = s[:-1], s[1:]
            word = kind[s] != SPACE
            return s[word], e[word]
        # the last character of white space before a word: a blank joins the word, another one stands alone
        text_start = np.zeros(n + 1, bool)
        text_start[first] = True
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1:n])
        begin[last] = True
        begin[last[cp[last] == 0x20] + 1] = False
        s = np.flatnonzero(begin)
        return s[:-1], s[1:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (uint32) and the count of each text."""
        if self.table.n > self.most:
            self._reset()
        odd = {i for i, t in enumerate(texts) if self.special in t}
        cp, sizes = _code_points(texts)
        unsure = np.flatnonzero(self.classes[np.minimum(cp, _SAFE_END)] == UNSURE)
        odd.update(np.unique(np.searchsorted(np.cumsum(sizes), unsure, "right")).tolist())
        if self.folded or odd:
            cp, sizes = _code_points(["" if i in odd else t.lower() if self.folded else t for i, t in enumerate(texts)])
        counts = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.uint32)
        if len(cp):
            ends = np.cumsum(sizes)
            firsts = ends - sizes
            s, e = self._cut(cp, firsts[sizes > 0])
            at, other = self._lookup(cp, s, e)
            if len(other):  # words whose key another word holds: their texts are encoded whole
                plain = set(np.unique(np.searchsorted(ends, s[other], "right")).tolist())
                return self._mixed(texts, plain)
            lens = self.len[at]
            ids = self.flat[spread(self.start[at], lens)]
            before = np.zeros(len(s) + 1, np.int64)
            np.cumsum(lens, out=before[1:])
            counts = before[np.searchsorted(s, ends)] - before[np.searchsorted(s, firsts)]
        if not odd:
            return ids, counts
        parts, at = [], 0
        for i in range(len(texts)):
            if i in odd:
                parts.append(np.array(self.encode_text(texts[i]), np.uint32))
                counts[i] = len(parts[-1])
            else:
                parts.append(ids[at:at + counts[i]])
                at += int(counts[i])
        return np.concatenate(parts), counts

    def _mixed(self, texts: list[str], plain: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of the texts, those numbered in ``plain`` by the
        plain path and the others as ever."""
        rest, rest_counts = self.encode([t for i, t in enumerate(texts) if i not in plain])
        parts, counts, at, k = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64), 0, 0
        for i, t in enumerate(texts):
            if i in plain:
                parts.append(np.array(self.encode_text(t), np.uint32))
            else:
                parts.append(rest[at:at + rest_counts[k]])
                at, k = at + int(rest_counts[k]), k + 1
            counts[i] = len(parts[-1])
        return np.concatenate(parts), counts

    def _lookup(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of every word, and the numbers of words that are not
        their entry's: an entry is told by 128 bits of its word."""
        h, check = word_hash(cp, s, e)
        at = self.table.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            where = missing[where]
            lens = e[where] - s[where]
            flat, lens = self.encode_words(cp[spread(s[where], lens)], lens)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used:self.used + len(flat)] = flat
            self.start = np.concatenate([self.start, self.used + np.cumsum(lens) - lens])
            self.len = np.concatenate([self.len, lens])
            self.check = np.concatenate([self.check, check[where]])
            self.used += len(flat)
            self.table.add(new)
            at[missing] = self.table.find(h[missing])
        return at, np.flatnonzero(self.check[at] != check)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level files."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordMerger:
    """Byte-pair merges of many words at a time: in each step every word
    merges its leftmost pair of lowest rank."""

    def __init__(self, model: dict):
        vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_id = np.array([vocab[x] for x in byte_letters()], np.int64)
        self.ranks = HashTable(18)
        self.ranks.add(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64) + np.uint64(1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def __call__(self, cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.repeat(np.arange(len(lens)), lens)
        word = np.repeat(word, 1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000))
        raw = np.frombuffer(cp.tobytes().decode("utf-32-le").encode(), np.uint8)
        sym, none, done = self.byte_id[raw], np.int64(1 << 40), []
        while len(sym):
            key = (sym[:-1].astype(np.uint64) << np.uint64(32) | sym[1:].astype(np.uint64)) + np.uint64(1)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank = np.full(len(sym), none)
            found = self.ranks.find(key[inside])
            rank[inside] = np.where(found >= 0, found, none)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            more = np.repeat(low < none, sizes)
            done.append((word[~more], sym[~more]))
            low_all = np.repeat(low, sizes)
            at = np.flatnonzero(more & (rank == low_all))
            at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])] if len(at) else at
            sym[at] = self.merged[rank[at]]
            more[at + 1] = False
            sym, word = sym[more], word[more]
        words = np.concatenate([w for w, _ in done])
        ids = np.concatenate([x for _, x in done]).astype(np.uint32)
        return ids[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(lens))


_encoders: dict[str, WordEncoder] = {}


def byte_encoder(path: str) -> WordEncoder:
    """Encoder of a byte-level BPE file of the ``tokenizers`` library (kept per
    worker). The library itself encodes the texts of the plain path."""
    if path not in _encoders:
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        with open(path, encoding="utf-8") as f:
            merger = WordMerger(json.load(f)["model"])
        _encoders[path] = WordEncoder(False, merger, lambda text: tok.encode(text, add_special_tokens=False).ids, "<|")
    return _encoders[path]
