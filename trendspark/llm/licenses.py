"""Licence scans: where licence phrases and licence notices stand in texts.

Method: a positional index of rare tokens. The words of all phrases and
notices are the index: word -> (notice, position). A word's weight is its
inverse document frequency over all documents. A file is looked up by its
rarest licence words only: every notice has as many of its heaviest words as
anchors that a text without any of them cannot reach the notice's threshold,
so nothing is lost. Each anchor in a text proposes where the notice would
begin; the postings of the notice's other words are intersected at their
positions relative to it, and a place counts if the words met carry ``share``
of the notice's weight and all words of its key phrase are met. For phrases
the share is 1: every place of a phrase is found.

Index and weights are a few hundred numbers; texts are read twice, once for
the counts, and never moved.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, id_and_text, string_bytes

SHARE = 80        # percent of a notice's weight
BLOCK = 1 << 14   # proposed places that are compared at a time; no result depends on it


@dataclass(frozen=True)
class Notice:
    """Words of a phrase (``base``) or of a notice, and its key phrase."""
    label: str
    text: str
    key: str
    base: bool = False


# FIXED VALUES: phrases that name a licence, and their labels.
PHRASES = (
    Notice("gpl", "gnu general public license", "gnu general public license", True),
    Notice("apache", "apache license", "apache license", True),
    Notice("cc-by", "cc by", "cc by", True),
    Notice("mit", "mit license", "mit license", True),
)

# FIXED VALUES: first sentences of public licence notices, their labels and mandatory key phrases.
NOTICES = (
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
           "permission is hereby granted free of charge"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
           "redistribution and use in source and binary forms"),
    Notice("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
           "gnu general public license"),
    Notice("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
           "gnu lesser general public license"),
    Notice("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
           "gnu affero general public license"),
    Notice("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
           "apache license version 2 0"),
    Notice("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
           "with or without fee is hereby granted"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    Notice("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
           "waived all copyright"),
    Notice("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Notice("cc-by-sa", "licensed under cc by sa", "cc by sa"),
)

_WORD = np.zeros(256, bool)   # bytes of words: digits, letters, and all of characters beyond U+007F
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] |= 0x20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Vocabulary:
    """Numbers of the licence words (ASCII, at most 16 bytes each): words are
    compared by all their bytes."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.words = sorted({w for x in notices for w in x.text.split()})
        raw = [w.encode() for w in self.words]
        if any(len(w) > 16 or not _WORD[list(w)].all() or w != w.lower() for w in raw):
            raise ValueError("licence words are lower-case letters and digits, at most 16 of them")
        self.number = {w: i for i, w in enumerate(self.words)}
        pad = np.frombuffer(b"".join(w.ljust(16, b"\0") for w in raw), np.uint64).reshape(-1, 2)
        key = self._mix(pad[:, 0], pad[:, 1])
        order = np.argsort(key)
        self.key, self.pad, self.id = key[order], pad[order], order.astype(np.int16)
        assert len(np.unique(key)) == len(key)
        self.edge = np.zeros((17, 256, 256), bool)   # length, first and last byte
        for w in raw:
            self.edge[len(w), w[0], w[-1]] = True

    @staticmethod
    def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * _ODD[0] ^ (b + np.uint64(1)) * _ODD[1]

    def of(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Number of each word [s, e) of the bytes, -1 for other words."""
        out = np.full(len(s), -1, np.int16)
        size = e - s
        at = np.flatnonzero(self.edge[np.where(size <= 16, size, 0), low[s], low[e - 1]])
        if not len(at):
            return out
        s, size = s[at], size[at]
        half = [np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)]
        for j in range(16):
            here = np.flatnonzero(size > j)
            half[j >> 3][here] |= low[s[here] + j].astype(np.uint64) << np.uint64(8 * (j & 7))
        key = self._mix(*half)
        near = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        same = (self.pad[near, 0] == half[0]) & (self.pad[near, 1] == half[1])
        out[at[same]] = self.id[near[same]]
        return out


def licence_words(raw: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary's number of every word of all texts (-1: another word;
    two bytes a word) and where each text's words begin (n + 1 entries). The
    bytes are worked on piece by piece, also within a long text."""
    parts, at, count = [], 0, np.zeros(len(offsets) - 1, np.int64)
    while at < len(raw):
        end = at
        while True:
            end = min(end + CHUNK, len(raw))
            inside = _WORD[raw[at:end]]
            if end == len(raw):
                break
            # a piece ends after a byte outside words, or where a text ends
            cut = len(inside) - int(np.argmin(inside[::-1])) if not inside.all() else 0
            text_end = int(offsets[np.searchsorted(offsets, end, "right") - 1]) - at
            if max(cut, text_end) > 0:
                end = at + max(cut, text_end)
                inside = inside[:end - at]
                break
        low = _LOW[raw[at:end]]
        edge = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, end, "left")] - at
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
        count += np.bincount(np.searchsorted(offsets, s + at, "right") - 1, minlength=len(count))
        parts.append(vocabulary.of(low, s, e))
        at = end
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=first[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.int16)), first


class Index:
    """Notices with their words' weights, thresholds and anchors."""

    def __init__(self, notices: tuple[Notice, ...], vocabulary: Vocabulary, docs_with: np.ndarray, docs: int, share: int):
        self.notices, self.vocabulary = notices, vocabulary
        weight = np.array([max(1, (docs // max(1, int(k))).bit_length()) for k in docs_with], np.int64)
        self.words, self.weight, self.need, self.key = [], [], [], []
        self.anchors: dict[int, list[tuple[int, int]]] = {}
        for t, x in enumerate(notices):
            ids = np.array([vocabulary.number[w] for w in x.text.split()])
            w = weight[ids]
            need = int(w.sum()) if x.base else -(-share * int(w.sum()) // 100)
            key = x.key.split()
            text = x.text.split()
            at = next(i for i in range(len(text)) if text[i:i + len(key)] == key)
            self.words.append(ids)
            self.weight.append(w)
            self.need.append(need)
            self.key.append(slice(at, at + len(key)))
            left = int(w.sum())
            for j in np.argsort(-w, kind="stable").tolist():   # heaviest first, until the rest cannot reach the threshold
                if left < need:
                    break
                self.anchors.setdefault(int(ids[j]), []).append((t, j))
                left -= int(w[j])
        self.is_anchor = np.zeros(len(vocabulary.words) + 1, bool)
        self.is_anchor[list(self.anchors)] = True              # the last entry stands for other words

    def places(self, wid: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, notice, start in the text, weight met) of every place."""
        found = []
        at = np.flatnonzero(self.is_anchor[wid])
        by_word = wid[at]
        for word, posts in self.anchors.items():
            here = at[by_word == word]
            if len(here):
                doc = np.searchsorted(first, here, "right") - 1
                found += [np.stack([np.full(len(here), t), doc, here - j]) for t, j in posts]
        if not found:
            return (np.zeros(0, np.int64),) * 4
        t, doc, start = np.unique(np.concatenate(found, axis=1), axis=1)
        got, met_weight = [], []
        edges = np.searchsorted(t, np.arange(len(self.notices) + 1))
        for k in np.unique(t).tolist():
            words = self.words[k]
            for lo in range(int(edges[k]), int(edges[k + 1]), BLOCK):
                part = slice(lo, min(lo + BLOCK, int(edges[k + 1])))
                place = start[part, None] + np.arange(len(words))
                inside = (place >= first[doc[part], None]) & (place < first[doc[part] + 1, None])
                met = inside & (wid[np.clip(place, 0, len(wid) - 1)] == words)
                weight = met @ self.weight[k]
                ok = np.flatnonzero((weight >= self.need[k]) & met[:, self.key[k]].all(1))
                got.append(lo + ok)
                met_weight.append(weight[ok])
        at = np.concatenate(got)
        return doc[at], t[at], start[at] - first[doc[at]], np.concatenate(met_weight)


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of all documents each licence word stands, and the number
    of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = np.zeros(len(vocabulary.words), np.int64), 0
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            wid, first = licence_words(raw, offsets, vocabulary)
            at = np.flatnonzero(wid >= 0)
            doc = np.searchsorted(first, at, "right") - 1
            pair = np.unique(doc * len(vocabulary.words) + wid[at])
            hits += np.bincount(pair % len(vocabulary.words), minlength=len(hits))
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(hits))), pa.array(np.append(n, hits))], ["word", "hits"])
    rows = id_and_text(docs).select("text").mapInArrow(run, "word long, hits long").groupBy("word").agg(F.sum("hits").alias("hits")).collect()
    out = np.zeros(len(vocabulary.words), np.int64)
    n = 0
    for r in rows:   # one row a licence word
        if r["word"] < 0:
            n = r["hits"]
        else:
            out[r["word"]] = r["hits"]
    return out, n


PLACE = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64())])


def license_places(docs: DataFrame, notices: tuple[Notice, ...] = PHRASES + NOTICES, share: int = SHARE) -> DataFrame:
    """doc_id, n_words and places: every place of a phrase or notice (label,
    base, start: the number of its first word, negative where a notice's
    beginning lies before the text, words, share of the weight met), by start,
    label and base.

    Words are runs of digits, letters a to z (A to Z are lower-cased) and
    characters beyond U+007F. Null, empty and wordless texts have no places.
    Rows stay rows: null and repeated ids and repeated rows are kept and count
    for the word counts like any other; an empty table gives no rows; other
    columns are not read. A long text is worked on in pieces; two bytes a word
    are held.
    """
    vocabulary = Vocabulary(notices)
    index = Index(notices, vocabulary, *word_counts(docs, vocabulary), share)
    total = [int(w.sum()) for w in index.weight]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_bytes(b.column("text"))
            wid, first = licence_words(raw, offsets, vocabulary)
            of: list[list] = [[] for _ in range(b.num_rows)]
            for d, t, s, w in zip(*(x.tolist() for x in index.places(wid, first))):
                x = notices[t]
                of[d].append({"label": x.label, "base": x.base, "start": s, "words": len(index.words[t]), "share": w / total[t]})
            for x in of:
                x.sort(key=lambda p: (p["start"], p["label"], p["base"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), pa.array(of, pa.list_(PLACE))], ["doc_id", "n_words", "places"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, places array<struct<label:string,base:boolean,start:long,words:long,share:double>>")


def digests(places: DataFrame) -> DataFrame:
    """The places in short: n_base, first_word and last_word (least and
    greatest start of a base place), base_labels and labels (distinct, sorted,
    joined by commas) and score (the greatest share; 0 without a place)."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def names(c: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return places.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                         F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
                         F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
