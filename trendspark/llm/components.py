"""Connected components of an undirected graph given as an edge table."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

EDGES = "a long, b long"


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches by them."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root[x], root[y]):
            return nodes, nodes[root]


SALTS = 4


def _contract(by_key: bool):
    """Batches of edges become stars. ``by_key``: rows come sorted by the node
    ``key`` that their edges share; it is carried into the next batch, so all
    edges of a key are contracted together however many there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = root_of_key = None
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            if not len(a):
                continue
            if key is not None:
                a, b = np.append(a, key), np.append(b, root_of_key)
            node, root = roots(a, b)
            if by_key:
                key = batch.column("key").to_numpy()[-1]
                root_of_key = root[np.searchsorted(node, key)]
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["a", "b"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reached) for every node of
    ``edges`` (a, b: not null). In each round every edge meets the other edges
    of both its ends and is replaced by an edge to the smallest node known,
    until all are stars; a round is written to the shared folder.
    The edges into a node (very many for the centre of a large group) are
    salted, its own edges go to every salt. An empty table gives no rows."""
    e = edges.select("a", "b").filter("a <> b").mapInArrow(_contract(False), EDGES)
    while True:
        e = e.distinct()  # an edge comes back from every salt
        up = e.select("a", "b", F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        down = e.select("a", "b", F.col("b").alias("key"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"))
        met = up.union(down).repartition("key", "salt").sortWithinPartitions("key", "salt")
        e = materialize(met.mapInArrow(_contract(True), EDGES), "cc")
        if _stars(e):
            break
    ends = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ends).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node but the smallest of its component points at it."""
    sides = e.select(F.col("a").alias("x"), "b").union(e.select(F.col("b").alias("x"), F.lit(None).cast("long").alias("b")))
    of = sides.groupBy("x").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count_if(F.col("b").isNull()).alias("into"))
    return of.filter("lo < hi or (lo is not null and `into` > 0)").isEmpty()
