"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r = 2h bits exactly if some value lies within h bits of both. So every fingerprint stands for
all its variants within h bits, and fingerprints that meet on a variant are linked. The variants are dealt out by their leading
bits: a fingerprint is sent once to each cell (value of those bits) that any of its variants falls into, and the task of a cell
forms the variants that belong there. The shuffle then carries a few dozen rows a fingerprint, not 2,081.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_of, shingle_parts, table, written
from .components import connected_components, forest

#: Byte j of entry v is bit j of v: adding entries adds eight bit counters at once, up to 255 of them.
_SPREAD = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)
#: Variants formed at once in one cell.
_MOST_VARIANTS = 4_000_000


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the (n, k) 64-bit hashes have each of their 64k bits set."""
    n, k = hashes.shape
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(n, 8 * k)
    out = np.zeros(64 * k, np.int64)
    for at in range(0, n, 255):
        out += _SPREAD[octets[at : at + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return out


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """k hash words from one: the hash itself, then splitmix64 steps."""
    out = [h]
    for j in range(1, k):
        z = h + np.uint64((0x9E3779B97F4A7C15 * j) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(text: str | None, words: int = 4, width: int = 1) -> np.ndarray:
    """`width` 64-bit words; a bit is 1 if set in over half the shingle hashes (repeats count). No words: all zero."""
    total, n = np.zeros(64 * width, np.int64), 0
    for h in shingle_parts(text, words):
        if len(h):
            total += bit_counts(_mixed(h, width))
            n += len(h)
    return np.packbits(total * 2 > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row of docs(doc_id, text). A null text counts as empty, with fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [int(fingerprint(t.as_py(), words).view(np.int64)[0]) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << p for p in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def _variants(fps: np.ndarray, budget: np.ndarray, low_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, owners): for each budget, all flips of up to so many of the low bits."""
    for b in np.unique(budget):
        own = np.flatnonzero(budget == b)
        flips = np.array(_masks(low_bits, int(b)), np.uint64)
        yield (fps[own][:, None] ^ flips[None, :]).ravel(), np.repeat(own, len(flips))


def _joined(fps: np.ndarray, cell: int, cell_bits: int, bits: int, half: int, reach: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints that meet on a variant whose leading cell_bits are `cell`: in each meeting, those up to `reach`
    places apart, which connects all of them."""
    low = bits - cell_bits
    lead = fps >> np.uint64(low) if low < 64 else np.zeros(len(fps), np.uint64)
    away = np.bitwise_count(lead ^ np.uint64(cell)).astype(np.int64)
    keep = np.flatnonzero(away <= half)
    if len(keep) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    budget = half - away[keep]
    if low > 1 and sum(int((budget == b).sum()) * sum(math.comb(low, j) for j in range(b + 1)) for b in range(half + 1)) > _MOST_VARIANTS and len(keep) > 1000:
        found = [_joined(fps[keep], (cell << 1) | side, cell_bits + 1, bits, half, reach) for side in (0, 1)]
        return keep[np.concatenate([f[0] for f in found])], keep[np.concatenate([f[1] for f in found])]
    rest = fps[keep] & np.uint64((1 << low) - 1)
    parts = list(_variants(rest, budget, low))
    values, owners = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(values, kind="stable" if reach > 1 else None)
    values, owners = values[order], owners[order]
    same = [(i, np.flatnonzero(values[i:] == values[:-i])) for i in range(1, min(reach, len(values) - 1) + 1)]
    return keep[owners[np.concatenate([s for _, s in same])]], keep[owners[np.concatenate([s + i for i, s in same])]]


def ball_links(fps: DataFrame, radius: int = 4, bits: int = 64) -> DataFrame:
    """Edges (u, v) between the nodes of fps(node, fp), enough to connect all that differ in at most `radius` bits.

    fps holds one row for each distinct fingerprint. Each cell gives a spanning forest of what meets there (every meeting pair is
    a true link, which an exact bit count verifies), so a dense group of thousands gives a few edges a member and not all pairs.
    """
    half = radius // 2
    n = fps.count()
    each = sum(math.comb(bits, j) for j in range(half + 1))
    cell_bits = min(24, max(6, math.ceil(math.log2(max(1, n * each / _MOST_VARIANTS)))))
    masks = F.array(*[F.lit(m) for m in _masks(cell_bits, half)])
    lead = F.shiftrightunsigned("fp", bits - cell_bits)
    sent = fps.select("node", "fp", F.explode(F.transform(masks, lambda m: lead.bitwiseXOR(m.cast("long")))).alias("cell"))

    def work(key: tuple, t: pa.Table) -> pa.Table:
        nodes, values = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(nodes)
        nodes, values = nodes[order], values[order]
        a, b = _joined(values, key[0].as_py(), cell_bits, bits, half)
        if len(a):
            pairs = np.unique(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
            a, b = pairs // len(nodes), pairs % len(nodes)
            right = np.bitwise_count(values[a] ^ values[b]) <= radius
            a, b = forest(len(nodes), a[right], b[right])
        return pa.table({"u": pa.array(nodes[a], pa.int64()), "v": pa.array(nodes[b], pa.int64())})

    return sent.repartition(parts_of(fps.sparkSession), "cell").groupBy("cell").applyInArrow(work, "u long, v long")


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text); other columns are ignored.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest doc_id reachable through links, the
    document's own included. Null or empty texts have fingerprint zero and link like any other. Repeated rows each give a row.
    Rows with a null doc_id give a row and join a component, but never name one (component_id is null if nothing else is in it).
    An empty table gives an empty result. Copies meet in one node by a partial aggregate before anything else is shuffled.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    # A node is named by its smallest doc_id; where that is null, by nothing: such nodes can't link others under a name, so they
    # take a negative stand-in outside the range of the others.
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    nodes = nodes.select("fp", "first", F.coalesce("first", F.lit(2**62) + F.pmod(F.xxhash64("fp"), F.lit(2**61))).alias("node"))
    labels = connected_components(ball_links(nodes.select("node", "fp"), radius))
    named = nodes.join(labels, "node", "left").select(F.col("fp").alias("f"), F.coalesce("component", "node").alias("c"))
    named = named.select("f", F.when(F.col("c") < 2**62, F.col("c")).alias("component_id"))
    return fps.join(named, fps.fp == named.f).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
