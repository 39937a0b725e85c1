"""Connected components of an edge table by alternating large-star and small-star steps.

A graph of SMALL edges at most is solved in one task, as steps over so few rows are all overhead. Of larger ones each step joins edges with the minimum of each node's neighbourhood, so a node of any degree is a
pre-aggregated minimum and a join that the optimizer may split; nothing is collected per node. Rounds grow
with the logarithm of the longest path. Every round ends in a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import arrow_map, cut, named

#: Distinct edges (16 bytes each) up to which one task finds the components.
SMALL = 1 << 18


def _oriented(edges: DataFrame) -> DataFrame:
    """(hi, lo) with hi > lo, distinct."""
    return edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("hi").alias("a"), F.col("m").alias("b")))


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their components) of edges a-b: larger roots hook to smaller neighbours, then every node moves up to its root."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = places[: len(a)], places[len(a) :], np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return nodes, nodes[root]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (hi, lo) of the task."""
    parts = [(x.column("hi").to_numpy(), x.column("lo").to_numpy()) for x in batches]
    if parts:
        nodes, least = smallest_reachable(*[np.concatenate(side) for side in zip(*parts, strict=True)])
        yield named(pa.schema([("node", pa.int64()), ("component", pa.int64())]), node=nodes, component=least)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Null ends are ignored; self-loops and repeated edges do no harm; an empty table gives an empty result.
    """
    now = cut(_oriented(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    if dict(now.dtypes)["hi"] == "bigint" and now.count() <= small:
        return cut(arrow_map(now.coalesce(1), _solved, "node bigint, component bigint"))
    state = None
    for _ in range(max_rounds):
        now = cut(_oriented(_small_star(_oriented(_large_star(now)))))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
