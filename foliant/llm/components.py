"""Connected components over an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written_at


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) that join what the pairs join."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            break
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


#: Edges that a task holds before it thins them.
_HELD = 1 << 20


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what the edges of each partition connect: a spanning forest of it, in parts of bounded size."""

    def thin(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.unique(np.concatenate([u, v]))
        a, b = forest(len(nodes), np.searchsorted(nodes, u), np.searchsorted(nodes, v))
        return nodes[a], nodes[b]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            u, v = thin(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size > _HELD:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return edges.mapInArrow(work, "u long, v long")


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. The smallest neighbour comes from a partial aggregate joined back, so a hub is never held in one group."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = near.join(low, near.u == low.c)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(u long, v long) edges to (node, component): component is the smallest node reachable. Nodes without an edge are absent.

    Each round ends in a written table, so the lineage stays short and an executor may be lost. Rounds stop when the edges no
    longer change. A table is deleted once the next is written. An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    edges, path = written_at(thinned(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        edges, last = written_at(_step(_step(edges, True), False), "edges")
        removed(spark, path)
        path = last
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
