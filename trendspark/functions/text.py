"""Text rules: tokens (SC-6) and keyword counts (AG-15).

A token is a run of non-whitespace of the lower-cased text with leading and
trailing non-letter/non-digit characters stripped; it is kept when what is
left is all letters/digits and not a stop word. A keyword counts once per
token equal to it, so a keyword with a space or punctuation can never match.

The count runs as one JVM regular expression per text (``regexp_count``), so
whole texts of any length are processed without building token arrays.
"""
from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALNUM = re.compile(r"^[^\W_]+$", re.UNICODE)


def matchable_keywords(keywords: tuple[str, ...], stop_words: tuple[str, ...]) -> Counter:
    """Keywords that can equal a kept token, with their multiplicity."""
    stops = set(stop_words)
    out: Counter = Counter()
    for kw in keywords:
        k = kw.lower()
        if _ALNUM.match(k) and k not in stops:
            out[k] += 1
    return out


def _token_pattern(words: list[str]) -> str:
    alt = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    # whole whitespace-delimited token: optional non-alnum edges around the word
    return r"(?<!\S)[^\p{L}\p{N}\s]*(?:" + alt + r")[^\p{L}\p{N}\s]*(?!\S)"


def keyword_count(text: Column | str, keywords: tuple[str, ...], stop_words: tuple[str, ...]) -> Column:
    """Number of kept tokens equal to a keyword, summed over the keyword list;
    null or empty text → 0."""
    t = F.col(text) if isinstance(text, str) else text
    kws = matchable_keywords(keywords, stop_words)
    if not kws:
        return F.lit(0).cast("bigint")
    by_mult: dict[int, list[str]] = {}
    for w, m in kws.items():
        by_mult.setdefault(m, []).append(w)
    lowered = F.lower(t)
    total = None
    for mult, words in sorted(by_mult.items()):
        part = F.regexp_count(lowered, F.lit(_token_pattern(words)))
        part = part * F.lit(mult) if mult != 1 else part
        total = part if total is None else total + part
    return F.coalesce(total.cast("bigint"), F.lit(0).cast("bigint"))


def tokens(text: Column | str, stop_words: tuple[str, ...]) -> Column:
    """SC-6 as an array column (used where the tokens themselves are wanted)."""
    t = F.col(text) if isinstance(text, str) else text
    raw = F.split(F.lower(t), r"\s+")
    stripped = F.transform(raw, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    stops = F.array(*[F.lit(s) for s in stop_words])
    return F.filter(stripped, lambda w: w.rlike(r"^[\p{L}\p{N}]+$") & ~F.array_contains(stops, w))
