"""Near-duplicate vectors: all pairs, exactly.

Method: vectors of one length are dealt to blocks by a hash, and every pair of
blocks is one group that compares all its rows, tile by tile: in single
precision, and again in double precision where that is within its rounding
error of the threshold. A group counts links and unites them, but lists none: it
gives one row for each vector that links. Equal vectors count as one class.

Pairs grow with the square of the distinct vectors (see README for times);
rows sent grow linearly while a block is under BLOCK_BYTES.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .topk import usable

BLOCKS = 16             # least blocks of a length with at least BLOCKS * LEAST_ROWS vectors
BLOCK_BYTES = 32 << 20  # more blocks where one would be larger
LEAST_ROWS = 64         # fewer blocks where one would have fewer rows
TILE = 1024


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (bytes of doubles, -0 as 0; null where it links with nothing)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    ok = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = rows.select("vec_id", F.when(ok, F.col("v")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if x is None else (np.array(x, np.float64) + 0.0).tobytes() for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "v"])
    return rows.mapInArrow(run, "vec_id long, v binary")


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows scaled to length 1 (by the largest component first, so that
    nothing overflows)."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` (the smallest known position reached by each) after the edges (x, y)."""
    while True:
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root[x], root[y]):
            return root


def tile_hits(x: np.ndarray, small: np.ndarray, i: slice, j: slice, threshold: float) -> np.ndarray:
    """Which pairs of unit rows i, j reach the threshold; ``small`` is ``x`` in
    single precision."""
    dims = x.shape[1]
    error = (dims + 8) * 2.0 ** -23  # twice the bound of a single-precision product of unit rows
    cosine = small[i] @ small[j].T
    hit = cosine >= np.float32(threshold - error)
    if hit.any():
        a, b = np.nonzero(hit & (cosine <= np.float32(threshold + error)))
        step = max(1, (1 << 21) // dims)
        for k in range(0, len(a), step):
            p, q = a[k:k + step], b[k:k + step]
            hit[p, q] = np.einsum("ij,ij->i", x[i][p], x[j][q]) >= threshold
    return hit


def block_links(x: np.ndarray, n: np.ndarray, left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of every row (counted ``n`` times each) and the first row it
    reaches: rows before ``left`` against those from it on, or all pairs where
    ``left`` is all of them."""
    size, alone = len(x), left == len(x)
    small, root, links = x.astype(np.float32), np.arange(size), np.zeros(size, np.int64)
    for at in range(0, left, TILE):
        i = slice(at, min(left, at + TILE))
        for to in range(at if alone else left, size, TILE):
            j = slice(to, min(size, to + TILE))
            hit = tile_hits(x, small, i, j, threshold)
            if alone and at == to:
                hit = np.triu(hit, 1)
            if not hit.any():
                continue
            a, b = np.nonzero(hit)
            np.add.at(links, a + at, n[b + to])
            np.add.at(links, b + to, n[a + at])
            new = root[a + at] != root[b + to]
            if new.any():
                root = unite(root, a[new] + at, b[new] + to)
    return links, root


def all_links(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b and links: for every class (columns rep, n, v) and pair of blocks
    in which it links, a class that it reaches there and how many rows it links
    with."""
    sized = reps.withColumn("bytes", F.length("v"))
    m = F.col("m").cast("double")
    blocks = F.greatest(F.least(F.lit(BLOCKS), F.ceil(m / LEAST_ROWS)), F.ceil(m * F.col("bytes") / BLOCK_BYTES)).cast("int")
    # broadcast: a row for each length; a shuffle by length alone would leave all pairs of a length in one task
    sizes = F.broadcast(sized.groupBy("bytes").agg(F.count("*").alias("m")))
    x = sized.join(sizes, "bytes").withColumn("blocks", blocks)
    x = x.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    # every block meets itself and all others: a pair of blocks is one group
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("bytes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "v")

    def pairs(t: pa.Table) -> pa.Table:
        own = t.column("own").to_numpy()
        order = np.argsort(own, kind="stable")
        rep, n = t.column("rep").to_numpy()[order], t.column("n").to_numpy()[order]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left = int((own == i).sum())
        x = unit(t.column("v").to_pylist())[order]
        if i != j and left in (0, len(x)):
            linked = np.zeros(0, np.int64)  # one of the blocks is empty
            links = root = linked
        else:
            links, root = block_links(x, n, left, threshold)
            linked = np.flatnonzero(links)
        return pa.table({"a": rep[linked], "b": rep[root[linked]], "links": links[linked]})
    return x.groupBy("bytes", "i", "j").applyInArrow(pairs, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (the smallest
    id reached, itself included) and kept (the row is that one).

    Vectors that are null or zero, or have null or non-finite components,
    link with nothing, and rows with a null id are in no component (null,
    not kept). Vectors of different lengths do not link. Rows that repeat an
    id are rows of their own. An empty table gives no rows; other columns are
    not read. All pairs are compared, at any number of rows.
    """
    rows = materialize(classes(vectors, id_col, vector_col), "vec-rows")
    live = rows.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    keyed = live.select("vec_id", "v", F.md5("v").alias("sig"))
    reps = materialize(keyed.groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "vec-reps")
    # classes of equal vectors may share their smallest id where ids repeat: key by a number of their own
    reps = reps.withColumn("rep_key", F.xxhash64("sig"))
    linked = materialize(all_links(reps.select(F.col("rep_key").alias("rep"), "n", "v"), threshold), "vec-links")
    found = materialize(components(linked.select("a", "b")), "vec-components")
    members = found.join(reps.select("rep_key", "rep"), F.col("node") == F.col("rep_key")).select(
        "component", F.col("node").alias("key"), F.col("rep").alias("smallest"))
    counted = linked.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    smallest = members.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of = members.select("component", "key").join(smallest, "component").join(counted, "key", "left")
    per_class = reps.join(of, reps["rep_key"] == of["key"], "left").select(
        "sig", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.withColumn("sig", F.when(F.col("vec_id").isNotNull(), F.md5("v"))).join(per_class, "sig", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
