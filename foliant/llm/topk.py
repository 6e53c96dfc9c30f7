"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments; of each the mean and the deviation are kept. For two vectors, the squared distance is at least
sum_s w_s ((m_q - m_x)^2 + (d_q - d_x)^2), which for an inner product is the ceiling sum_s w_s (m_q m_x + d_q d_x). Coarse
segments are tried first, finer ones on what remains, and exact scores are computed for the survivors only. Nothing is
approximate: a vector is dropped only when its ceiling lies below k exact scores already known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Segments at each resolution.
LEVELS = (4, 16)
#: Rows of queries and of candidates that meet in one task.
QUERY_BLOCK, ROW_BLOCK = 4096, 16384


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(w) m and sqrt(w) d of each segment, side by side: the ceiling is then one matrix product."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    w = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / w
    square = np.add.reduceat((x - np.repeat(mean, w, axis=1)) ** 2, cuts[:-1], axis=1)
    return np.hstack([mean * np.sqrt(w), np.sqrt(square)])


#: Bytes of the vectors that are multiplied at once, and queries that are tried together.
_HELD, _TOGETHER = 1 << 25, 256


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of the pairs of rows, in float64 where that is exact and in integers where it may not be."""
    out = np.empty(len(qi), np.int64)
    step = max(1, _HELD // (16 * max(1, x.shape[1])))
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2.0**52:
        q, x = q.astype(np.float64), x.astype(np.float64)
    for at in range(0, len(qi), step):
        s = slice(at, at + step)
        out[s] = np.einsum("ij,ij->i", q[qi[s]], x[xi[s]])
    return out


def _survivors(q: np.ndarray, x: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs left: pair by pair, or as one matrix product where many rows are left for many queries."""
    columns = np.flatnonzero(alive.any(axis=0))
    qi, at = np.nonzero(alive[:, columns])
    whole = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2.0**52
    if not whole or 8 * len(qi) < alive.shape[0] * len(columns):
        return qi, columns[at], _exact(q, x, qi, columns[at])
    score, step = np.empty((len(q), len(columns))), max(1, _HELD // (8 * max(1, x.shape[1])))
    for lo in range(0, len(columns), step):
        score[:, lo : lo + step] = q.astype(np.float64) @ x[columns[lo : lo + step]].astype(np.float64).T
    return qi, columns[at], score[qi, at].astype(np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, vector id, score) of each query's k best of these vectors, its own id left out; ties to smaller ids."""
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    slack = 1e-9 * (1 + np.abs(qf).max(initial=0) * np.abs(xf).max(initial=0)) * qf.shape[1]
    stats = [(_statistics(qf, s), _statistics(xf, s)) for s in LEVELS]
    # Exact scores of the most promising vectors by the coarse ceiling give each query its bar.
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), _TOGETHER):
        rows = slice(at, min(len(q), at + _TOGETHER))
        n = rows.stop - rows.start
        ceiling = stats[0][0][rows] @ stats[0][1].T
        ceiling[q_ids[rows][:, None] == x_ids[None, :]] = -np.inf
        tried = min(len(x), max(64, 4 * k))
        first = np.argpartition(-ceiling, tried - 1, axis=1)[:, :tried]
        qi = np.repeat(np.arange(n), tried) + at
        known = np.where(np.isfinite(np.take_along_axis(ceiling, first, 1)), _exact(q, x, qi, first.ravel()).reshape(n, tried), np.iinfo(np.int64).min)
        bar = np.sort(known, axis=1)[:, -k] if tried >= k else np.full(n, np.iinfo(np.int64).min)
        alive = (ceiling >= bar[:, None].astype(np.float64) - slack) & np.isfinite(ceiling)
        for fine in stats[1:]:
            columns = np.flatnonzero(alive.any(axis=0))
            alive[:, columns] &= fine[0][rows] @ fine[1][columns].T >= bar[:, None].astype(np.float64) - slack
        qi, xi, score = _survivors(q[rows], x, alive)
        keep = score >= bar[qi]
        qi, xi, score = qi[keep], xi[keep], score[keep]
        rank = np.lexsort((x_ids[xi], -score, qi))
        qi, xi, score = qi[rank], xi[rank], score[rank]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = place < k
        found.append((q_ids[qi[best] + at], x_ids[xi[best]], score[best]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component as double. Rows whose id or vector is null, or whose vector holds
    a null or non-finite component, are left out; empty vectors too."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(whole & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, k: int = 5, is_query: str = "pmod(vec_id, 50) = 0", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query row with every row of another id.

    Queries and rows meet in a grid of blocks: each row block goes once to each block of QUERY_BLOCK queries and each query to each
    block of ROW_BLOCK rows, so a task holds bounded blocks at any input size and nothing is gathered on the driver but two
    counts. Each meeting gives k rows a query; those are ranked. Vectors meet only those of their own length. Fewer than k others:
    all. Repeated rows are all candidates, also when they tie; a repeated query id is one query, with its first vector by value.
    """
    v = quantised(vectors, scale)
    queries = v.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, nq = v.count(), queries.count()
    # At least as many row blocks as the session has shuffle partitions, so that small inputs are spread too.
    rows = max(1, -(-n // ROW_BLOCK), min(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1024))
    groups = max(1, -(-nq // QUERY_BLOCK))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m: F.pmod(F.xxhash64("vec_id", "v"), F.lit(m)).cast("int")
    left = queries.select("vec_id", "v", F.size("v").alias("d"), dealt(groups).alias("g"), each(rows).alias("r"))
    right = v.select("vec_id", "v", F.size("v").alias("d"), each(groups).alias("g"), dealt(rows).alias("r"))

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            c = t.column("v").combine_chunks()
            return t.column("vec_id").to_numpy(), c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)

        got = search_block(*matrix(a), *matrix(b), k) if a.num_rows and b.num_rows else (np.empty(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.int64())})

    keys = ("d", "g", "r")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
