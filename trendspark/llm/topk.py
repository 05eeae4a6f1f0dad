"""Exact top-k search by integer inner product.

Method: a pivot-distance index. Every vector is keyed by its nearest pivot and
its distance from it; the vectors of a pivot, sorted by distance, are cut into
annuli. For a query q at distance d from the pivot, no vector x of an annulus
[r1, r2] is nearer than lb = max(0, d - r2, r1 - d) (triangle inequality), so
its inner product (|q|^2 + |x|^2 - |q - x|^2) / 2 is at most
(|q|^2 + max|x|^2 - lb^2) / 2. A query first takes its best annuli, which
gives a k-th score; then only annuli whose bound reaches that score are read.

The table of annuli has at most PIVOTS * RINGS rows at any size; the work on
an annulus is dealt in blocks of rows by blocks of queries.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize

PIVOTS, RINGS = 32, 32     # at most; fewer while an annulus would have under BLOCK rows
BLOCK = 2048               # rows of an index block, and queries of a query block
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter(usable(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(factor))).cast("double")).alias("v"))


def matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def unpacked(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dims)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; exact whatever the size (saturated to a long)."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def build_index(rows: DataFrame, dims: int, n: int) -> tuple[DataFrame, np.ndarray, pd.DataFrame]:
    """Index rows (vec_id, v as bytes, pivot, ring), the pivots, and the annuli
    (pivot, ring, r1, r2, norm2, n). Pivots are the PIVOTS vectors that come
    first by a hash of their id; every row is indexed."""
    per = max(1, n // BLOCK)
    pivots_n = int(min(PIVOTS, max(1, np.ceil(np.sqrt(per)))))
    rings = int(min(RINGS, max(1, per // pivots_n)))
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots_n).collect()
    pivots = matrix([r["v"] for r in first], dims)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v").to_pylist(), dims)
            d = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(near.astype(np.int32)),
                 pa.array(d[np.arange(len(x)), near]), pa.array((x ** 2).sum(axis=1))], ["vec_id", "v", "pivot", "dist", "norm2"])
    keyed = materialize(rows.mapInArrow(key, "vec_id long, v binary, pivot int, dist double, norm2 double"), "topk-keyed")
    cuts = [i / rings for i in range(1, rings)] or [1.0]
    # a row a pivot, at most PIVOTS of them
    bounds = keyed.groupBy("pivot").agg(F.array_sort(F.percentile_approx("dist", F.array(*map(F.lit, cuts)), 1000)).alias("cuts"))
    index = keyed.join(F.broadcast(bounds), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("dist")))).drop("cuts")
    index = materialize(index, "topk-index")
    annuli = index.groupBy("pivot", "ring").agg(F.min("dist").alias("r1"), F.max("dist").alias("r2"), F.max("norm2").alias("norm2"),
                                                F.count("*").alias("n")).orderBy("pivot", "ring").toPandas()
    return index, pivots, annuli


def upper_bounds(q: np.ndarray, pivots: np.ndarray, annuli: pd.DataFrame) -> np.ndarray:
    """Queries by annuli: what no score in the annulus exceeds."""
    p = annuli["pivot"].to_numpy()
    d = np.stack([np.sqrt(((q - c) ** 2).sum(axis=1)) for c in pivots], axis=1)[:, p]
    low = np.maximum(0, np.maximum(d - annuli["r2"].to_numpy(), annuli["r1"].to_numpy() - d))
    norms, q2 = annuli["norm2"].to_numpy(), (q ** 2).sum(axis=1)[:, None]
    bound = np.minimum((q2 + norms - low ** 2) / 2, np.sqrt(q2 * norms))
    return bound + 1 + 1e-9 * (np.abs(bound) + q2 + norms)  # room for rounding


ROUTES = "query_id long, q binary, pivot int, ring int"
HITS = "query_id long, vec_id long, score long"


def _best(k: int, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    if len(ids) > 4 * k:  # the k-th score keeps all its ties
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= kth)
        return pick[np.lexsort((ids[pick], -scores[pick]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_routes(index: DataFrame, routes: DataFrame, annuli: pd.DataFrame, dims: int, queries_n: int, k: int) -> DataFrame:
    """Each routed query's best k of the annulus's blocks. A block of rows and
    a block of queries meet in one small group; a large annulus has many."""
    query_blocks = max(1, -(-queries_n // BLOCK))
    parts = annuli.assign(parts=np.maximum(1, -(-annuli["n"] // BLOCK)))[["pivot", "ring", "parts"]]
    parts = F.broadcast(index.sparkSession.createDataFrame(parts, "pivot int, ring int, parts int"))  # PIVOTS * RINGS rows at most
    x = index.join(parts, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    x = x.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select("pivot", "ring", "part", "qb", "vec_id", "v")
    q = routes.join(parts, ["pivot", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id", "q"), F.lit(query_blocks)).cast("int")).select("pivot", "ring", "part", "qb", "query_id", "q")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            xs, ids = unpacked(right["v"], dims), right["vec_id"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
            for lo in range(0, len(left), 256):
                some = left.iloc[lo:lo + 256]
                s = products(unpacked(some["q"], dims), xs)
                for i, own in enumerate(some["query_id"].to_numpy(np.int64)):
                    others = np.flatnonzero(ids != own)
                    best = others[_best(k, ids[others], s[i][others])]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "score": s[i][best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    keys = ["pivot", "ring", "part", "qb"]
    return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(score, HITS)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by
    ``every`` its ``k`` highest inner products with all rows of other ids
    (components times ``factor``, floored), ties to the smaller id.

    Vectors that are null or have null or non-finite components take no part,
    as candidates with a null id do not. Vectors of different lengths are
    compared as if the shorter ended in zeros; an empty vector scores 0. Rows
    that repeat an id are rows of their own, but never partners of that id,
    and such queries count once for each distinct vector (their partners are
    ranked together). Scores beyond a long are saturated. Fewer than ``k``
    other rows give fewer ranks; an empty table gives no rows; other columns
    are not read.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col, factor).filter(F.col("vec_id").isNotNull())
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    if not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, size["dims"])
    index, pivots, annuli = build_index(rows, dims, size["n"])
    queries = index.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()

    def route(first: bool):
        """Routes of the first round (the best annuli, until they have k + 1
        rows), or of the second (the others whose bound reaches the k-th score)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, r, n = (annuli[c].to_numpy() for c in ("pivot", "ring", "n"))
            for b in batches:
                q = np.frombuffer(b"".join(b.column("q").to_pylist()), np.float64).reshape(-1, dims)
                bound = upper_bounds(q, pivots, annuli)
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                seed = np.zeros(bound.shape, bool)
                np.put_along_axis(seed, order, before < k + 1, axis=1)
                if first:
                    take = seed
                else:
                    kth = b.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
                    take = ~seed & ~(bound < kth[:, None])
                i, j = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(i)), b.column("q").take(pa.array(i)),
                                                  pa.array(p[j].astype(np.int32)), pa.array(r[j].astype(np.int32))], ["query_id", "q", "pivot", "ring"])
        return run

    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    hits = materialize(search_routes(index, queries.mapInArrow(route(True), ROUTES), annuli, dims, size["q"], k), "topk-first")
    kth = hits.withColumn("rank", best).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    again = queries.join(kth, "query_id", "left").select("query_id", "q", "kth").mapInArrow(route(False), ROUTES)
    hits = hits.union(search_routes(index, again, annuli, dims, size["q"], k))
    return hits.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
