"""Near-duplicate groups at a shingle similarity, exactly: fingerprints link the plain cases, a prefix filter finds all others.

A first round links the texts whose long SimHash fingerprints leave no doubt: texts that meet by ball hashing (see simhash) in one of
TABLES tables, each over BITS of the fingerprint's bits in a fixed random choice. It only makes dense groups small; nothing rests on
what it misses.

The rest is found by a prefix filter. All shingles stand in one order, the commonest last. Of two sets at Jaccard similarity s or more,
each has at least s of its own shingles in common with the other, so the first n - ceil(s n) + 1 of each have one in common. All texts of
different parts that share such a shingle are compared: by size, then by the parity of their shingles in 1,024 hash classes, which can
differ in no more classes than the sets do in shingles. Long texts fill 1,024 classes, so the pairs left are compared once more by
parities in twice as many classes as a text has shingles. None of this drops a pair that reaches s. What is left is verified on the
whole shingle sets, which are brought together in blocks of bounded size.

Pairs are taken in two steps: first those of a least spanning forest of each task, so that true groups become one part, then all that are
still in different parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, parts_of, removed, shingle_parts, trimmed, written, written_at
from .components import connected_components, forest
from .simhash import _MOST_VARIANTS, _joined, _masks, _mixed, bit_counts

#: 64-bit words of the long fingerprint, tables of the first round, bits of a table and the radius in it.
WIDTH, TABLES, BITS, RADIUS = 16, 6, 32, 2
#: Texts are linked without their sets if the estimate from the angle lies this far above the limit, four standard errors, and both sets
#: have as many shingles as SMALL.
SLACK, SMALL = 0.1, 48
#: Shingles of the texts whose sets meet in one task, of each of two blocks, on average.
BLOCK = 1_500_000
#: Texts that the common shingles are counted in, least count, and most shingles that are ranked by it. The order decides the cost only.
SAMPLE, COMMON, RANKED = 20_000, 3, 200_000
#: Hash classes of the parity, those of the longest wide one, prefix rows of a task's cell, and pairs it holds before it thins them.
CLASSES, WIDEST, CELL, HELD = 1024, 1 << 17, 100_000, 1 << 20


def _choices() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(64 * WIDTH)[:BITS] for _ in range(TABLES)])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    parts = [np.unique(p) for p in shingle_parts(text, words)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.uint64)


def _common_last(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in rising order that are common in a sample of docs(doc_id, text), and how often each is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words).view(np.int64), pa.int64())], names=["token"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, docs.count() // SAMPLE))) == 0).select("text")
    counts = some.mapInArrow(lean(work), "token long").groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(RANKED).toArrow()
    tokens, often = counts.column("token").to_numpy().view(np.uint64), counts.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], often[order]


def _prefix(hashes: np.ndarray, similarity: float, tokens: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles, by frequency in the sample and then by hash, of which two sets at that similarity share one."""
    if not len(hashes):
        return hashes
    size = len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1
    if not len(tokens):
        return hashes[:size]
    at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
    rank = np.where(tokens[at] == hashes, often[at], 0)
    return hashes[np.argsort(rank, kind="stable")[:size]]


def _parity(hashes: np.ndarray) -> bytes:
    """Parity of the shingles in each class, of at least twice as many classes as shingles, a power of two."""
    classes = min(WIDEST, max(CLASSES, 1 << (2 * len(hashes) - 1).bit_length())) if len(hashes) else CLASSES
    return np.packbits((np.bincount((hashes % np.uint64(classes)).astype(np.int64), minlength=classes) & 1).astype(bool)).tobytes()


def _folded(parity: bytes, size: int) -> np.ndarray:
    """The parity in the classes of `size` bytes."""
    out = np.frombuffer(parity, np.uint8)
    return np.bitwise_xor.reduce(out.reshape(-1, size), axis=0) if len(out) > size else out


def signatures(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, n, long binary, fps array<int>, parity binary, wide binary, prefix binary) of docs(doc_id, text): text digest, number of
    distinct shingles, long fingerprint, the tables' fingerprints, parity of the shingles in each hash class, the same in more classes
    for long texts, and the shingles of the prefix. A null text counts as empty."""
    choices = _choices()
    tokens, often = _common_last(docs, words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "n", "long", "fps", "parity", "wide", "prefix"]
        for b in batches:
            n, long, fps, parity, wide, prefix = [], [], [], [], [], []
            for t in b.column(2):
                hashes = shingle_set(t.as_py(), words)
                total = np.zeros(64 * WIDTH, np.int64)
                for at in range(0, len(hashes), 4096):
                    total += bit_counts(_mixed(hashes[at : at + 4096], WIDTH))
                bits = total * 2 > len(hashes)
                n.append(len(hashes))
                long.append(np.packbits(bits).tobytes())
                fps.append(np.packbits(bits[choices], axis=1).view(">u4").ravel().astype(np.uint32).view(np.int32))
                wide.append(_parity(hashes))
                parity.append(_folded(wide[-1], CLASSES // 8).tobytes())
                prefix.append(_prefix(hashes, similarity, tokens, often).tobytes())
            flat = np.concatenate(fps) if fps else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TABLES), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(long, pa.binary()), lists, pa.array(parity, pa.binary()), pa.array(wide, pa.binary()), pa.array(prefix, pa.binary())], names=names)

    text = F.coalesce("text", F.lit(""))
    schema = "doc_id long, h string, n int, long binary, fps array<int>, parity binary, wide binary, prefix binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("h"), text).mapInArrow(lean(work), schema)


def _estimates(a: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (n_a, long_a, n_b, long_b), the Jaccard similarity by the angle between the fingerprints, and the smaller set's size."""
    na, nb = (a.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
    la, lb = (np.frombuffer(b"".join(a.column(c).to_pylist()), np.uint64).reshape(-1, WIDTH) for c in ("long_a", "long_b"))
    apart = np.bitwise_count(la ^ lb).sum(axis=1)
    both = np.minimum(np.cos(np.pi * apart / (64 * WIDTH)) * np.sqrt(na * nb), np.minimum(na, nb))
    return np.where(np.minimum(na, nb) < np.maximum(na, nb) / 2, 0.0, both / (na + nb - both)), np.minimum(na, nb)


def _verified(pairs: pa.Table, sets: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) whose shingle sets reach the Jaccard similarity, thinned to a forest."""
    nodes, order = np.unique(sets.column("node").to_numpy(), return_index=True)  # repeated rows bring a set again
    held: dict[int, np.ndarray] = {}
    column = sets.column("s")

    def set_of(i: int) -> np.ndarray:
        if i not in held:
            held[i] = np.frombuffer(column[int(order[i])].as_buffer(), np.uint64)
        return held[i]

    a, b = (np.searchsorted(nodes, pairs.column(c).to_numpy()) for c in ("a", "b"))
    right = np.zeros(len(a), bool)
    label = np.arange(len(nodes))
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while label[x] != x:
            label[x] = x = label[label[x]]
        while label[y] != y:
            label[y] = y = label[label[y]]
        if x == y:  # joined already through others
            continue
        p, q = set_of(int(a[i])), set_of(int(b[i]))
        common = len(np.intersect1d(p, q, assume_unique=True))
        if common >= least * (len(p) + len(q) - common) - 1e-9:
            right[i] = True
            label[max(x, y)] = min(x, y)
    return nodes[a[right]], nodes[b[right]]


def _plain_pairs(nodes: DataFrame, n: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes(node, fps), each with the next one in every meeting of a table."""
    half = RADIUS // 2
    each = sum(math.comb(BITS, j) for j in range(half + 1))
    cell_bits = min(20, max(4, math.ceil(math.log2(max(1, n * each / _MOST_VARIANTS)))))
    masks = F.array(*[F.lit(m) for m in _masks(cell_bits, half)])
    met = nodes.select("node", F.posexplode("fps").alias("t", "fp"))
    met = met.select("node", "fp", F.explode(F.transform(masks, lambda m: F.col("t") * (1 << cell_bits) + F.shiftrightunsigned("fp", BITS - cell_bits).bitwiseXOR(m))).alias("cell"))

    def work(key: tuple, t: pa.Table) -> pa.Table:
        node, fps = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint32).astype(np.uint64)
        order = np.argsort(node)
        node, fps = node[order], fps[order]
        a, b = _joined(fps, key[0].as_py() & ((1 << cell_bits) - 1), cell_bits, BITS, half)
        right = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
        a, b = node[a[right]], node[b[right]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return met.repartition(parts_of(nodes.sparkSession), "cell").groupBy("cell").applyInArrow(work, "a long, b long").distinct()


def _prefix_rows(nodes: DataFrame, cells: int) -> DataFrame:
    """(cell, token, node, part): one row for each shingle in the prefix of each of nodes(node, part, prefix)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                held = [np.frombuffer(p, np.uint64) for p in b.column(2).to_pylist()]
                token, sizes = np.concatenate(held), np.array([len(h) for h in held])
                cell = ((token >> np.uint64(20)) % np.uint64(cells)).astype(np.int32)
                columns = [pa.array(cell), pa.array(token.view(np.int64)), *(pa.array(np.repeat(b.column(i).to_numpy(), sizes)) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "token", "node", "part"])

    return nodes.select("node", "part", "prefix").mapInArrow(work, "cell int, token long, node long, part long")


def _shared(rows: DataFrame) -> DataFrame:
    """(cell, token, node) of the rows (cell, token, node, part) whose token stands in more than one part."""

    def work(t: pa.Table) -> pa.Table:
        token, part = t.column("token").to_numpy(), t.column("part").to_numpy()
        order = np.argsort(token)
        heads = np.flatnonzero(np.concatenate(([True], token[order][1:] != token[order][:-1])))
        several = np.minimum.reduceat(part[order], heads) != np.maximum.reduceat(part[order], heads)
        return t.select(["cell", "token", "node"]).take(pa.array(order[np.repeat(several, np.diff(np.append(heads, len(order))))]))

    return rows.repartition(parts_of(rows.sparkSession), "cell").groupBy("cell").applyInArrow(work, "cell int, token long, node long")


def _least_forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the edges make a spanning forest of least weight."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    key = np.empty(len(u), np.int64)
    key[np.argsort(weight, kind="stable")] = np.arange(len(u))
    at = np.argsort(key)
    label, kept = np.arange(len(names)), []
    live = np.arange(len(u))
    while len(live := live[label[a[live]] != label[b[live]]]):
        best = np.full(len(names), len(u))
        np.minimum.at(best, label[a[live]], key[live])
        np.minimum.at(best, label[b[live]], key[live])
        chosen = at[np.unique(best[best < len(u)])]
        kept.append(chosen)
        own, to = forest(len(names), label[a[chosen]], label[b[chosen]])
        joined = np.arange(len(names))
        joined[own] = to
        label = joined[label]
    return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)


def _meeting(token: np.ndarray, node: np.ndarray, part: np.ndarray, n: np.ndarray, parity: np.ndarray, similarity: float, thin: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of different parts that share a token and whose sizes and parities allow the similarity: all of them, or if `thin`
    a forest over the parts that prefers pairs whose parities differ least."""
    order = np.lexsort((n, token))
    token, node, part, n, parity = token[order], node[order], part[order], n[order], parity[order]
    found = [np.empty((4, 0), np.int64)]
    size = least = 0

    def fewer() -> np.ndarray:
        both = np.concatenate(found, axis=1)
        if thin:
            lo, hi = np.minimum(part[both[0]], part[both[1]]), np.maximum(part[both[0]], part[both[1]])
            return both[:, _least_forest(lo, hi, both[2])]
        return both[:, np.unique(both[3], return_index=True)[1]]

    names = np.unique(node)
    number = np.searchsorted(names, node)
    live = np.arange(len(token))
    for shift in range(1, len(token)):
        live = live[: np.searchsorted(live, len(token) - shift)]
        far = live + shift
        live = live[(token[live] == token[far]) & (n[live] >= similarity * n[far] - 1e-6)]
        if not len(live):
            break
        a = live[part[live] != part[live + shift]]
        for lo in range(0, len(a), 1 << 16):
            x = a[lo : lo + (1 << 16)]
            y = x + shift
            apart = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
            total = n[x] + n[y]
            right = apart <= total - 2 * np.ceil(similarity / (1 + similarity) * total - 1e-6)
            x, y, apart = x[right], y[right], apart[right]
            i, j = np.minimum(number[x], number[y]), np.maximum(number[x], number[y])
            found.append(np.stack([x, y, apart, i * len(names) + j]))
            size += len(x)
        if size > max(HELD, 2 * least):
            found = [fewer()]
            size = least = found[0].shape[1]
    kept = fewer()
    a, b = node[kept[0]], node[kept[1]]
    return np.minimum(a, b), np.maximum(a, b)


def _possible_pairs(shared: DataFrame, nodes: DataFrame, similarity: float, thin: bool) -> DataFrame:
    """Distinct pairs (a, b) of nodes(node, part, n, parity) as _meeting gives them, over the cells of shared(cell, token, node)."""

    def work(t: pa.Table) -> pa.Table:
        token, node, part, n = (t.column(c).to_numpy() for c in ("token", "node", "part", "n"))
        parity = np.frombuffer(b"".join(t.column("parity").to_pylist()), np.uint64).reshape(-1, CLASSES // 64)
        a, b = _meeting(token, node, part, n.astype(np.int64), parity, similarity, thin)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = shared.join(nodes.select("node", "part", "n", "parity"), "node")
    return met.repartition(parts_of(shared.sparkSession), "cell").groupBy("cell").applyInArrow(work, "a long, b long").distinct()


def _sifted(nodes: DataFrame, pairs: DataFrame, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The pairs that are wanted by estimated similarity and size of the smaller set."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("long").alias(f"long_{x}"))
    paired = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "long_a", "n_b", "long_b")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(wanted(*_estimates(b))))

    return paired.mapInArrow(sift, "a long, b long")


def _alike(nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose wide parities allow the similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"w_{x}"))
    paired = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "w_a", "w_b")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            most = total - 2 * np.ceil(similarity / (1 + similarity) * total - 1e-6)
            apart = np.empty(b.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(b.column(4), b.column(5))):
                x, y = x.as_buffer(), y.as_buffer()
                size = min(x.size, y.size)
                apart[i] = np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(apart <= most))

    return paired.mapInArrow(lean(sift), "a long, b long")


def _exact_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) among the candidate pairs (a, b), by their texts' shingle sets.

    Texts connected by candidates make a family, a family is cut into blocks of about BLOCK shingles, and each set goes to those pairs of
    blocks in which it has a partner: once, unless the family is very large. The links are written, so that no stage holds two Python
    functions at once.
    """
    family = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    family = family.join(nodes.select(F.col("node").alias("_n"), "n"), F.col("node") == F.col("_n")).select("node", "component", "n")
    sizes = family.groupBy(F.col("component").alias("f")).agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK)).cast("int").alias("blocks"))
    placed, path = written_at(family.join(sizes, family.component == sizes.f).select("node", "f", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "families")
    end = lambda c: placed.select(F.col("node").alias(c), F.col("f").alias(f"f_{c}"), F.col("block").alias(f"k_{c}"))
    met = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", F.col("f_a").alias("f"), F.least("k_a", "k_b").alias("x"), F.greatest("k_a", "k_b").alias("y"))
    met, meetings = written_at(met, "meetings")
    ends = met.select(F.explode(F.array("a", "b")).alias("node"), "f", F.struct("x", "y").alias("p"))
    own = nodes.join(ends.groupBy("node", "f").agg(F.collect_set("p").alias("places")), "node").select("h", "first", "node", "f", "places")
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("first"))
    texts = text.join(own, ["h", "first"]).select("node", "f", "places", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingle_set(t.as_py(), words).tobytes() for t in b.column(3)], pa.binary())], names=["node", "f", "places", "s"])

    sets = texts.mapInArrow(lean(work), "node long, f long, places array<struct<x:int,y:int>>, s binary")
    sets = sets.withColumn("p", F.explode("places")).select("node", "s", "f", "p.x", "p.y")

    def verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        u, v = _verified(pairs, sets, similarity) if pairs.num_rows else (np.empty(0, np.int64),) * 2
        if sets.nbytes > 1 << 22:
            trimmed()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    links = written(met.groupBy("f", "x", "y").cogroup(sets.groupBy("f", "x", "y")).applyInArrow(verify, "u long, v long"), "links")
    removed(docs.sparkSession, path)
    removed(docs.sparkSession, meetings)
    return links


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(h, doc_id, stays boolean, component long): one row for each distinct pair of text digest and doc_id of docs(doc_id, text).

    Documents belong together if their texts are equal or linked, directly or through others, at Jaccard similarity `similarity` or
    more over distinct `words`-word shingles. Of each group the one with the smallest doc_id stays (ties: the smallest digest; a null
    id comes last). Texts without a word are alike only to equal texts, so white-space variants each stay. Copies are one node, and
    every pair of texts that may reach the limit is compared unless others join them. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = written(signatures(docs, words, similarity), "signatures")
    first = F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("first")
    nodes = rows.groupBy("h").agg(first, *(F.any_value(c).alias(c) for c in ("n", "long", "fps", "parity", "wide", "prefix")))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")
    n, tokens = nodes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("prefix")) / 8, F.lit(0.0))).first()
    some = nodes.where("n > 0")
    edges = lambda pairs: pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    passing: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Written until the groups are known."""
        df, path = written_at(df, name)
        passing.append(path)
        return df

    def parted(links: DataFrame) -> DataFrame:
        parts = connected_components(links).select(F.col("node").alias("_n"), "component")
        return some.join(parts, F.col("node") == F.col("_n"), "left").withColumn("part", F.coalesce("component", "node"))

    doubtless = lambda est, size: (est >= similarity + SLACK) & (size >= SMALL)
    links = edges(kept(_sifted(nodes, _plain_pairs(some, n), doubtless), "sure"))
    own = parted(links)
    shared = kept(_shared(_prefix_rows(own, max(parts_of(spark), math.ceil(tokens / CELL)))), "prefixes")
    near = kept(_alike(nodes, _possible_pairs(shared, own, similarity, True), similarity), "candidates")
    links = kept(links.unionByName(_exact_links(docs, nodes, near, words, similarity)), "links")
    own = kept(parted(links).select("node", "part", "n", "parity"), "parts")
    rest = _shared(shared.join(own.select("node", "part"), "node").select("cell", "token", "node", "part"))
    rest = kept(_alike(nodes, _possible_pairs(rest, own, similarity, False).join(near, ["a", "b"], "left_anti"), similarity), "candidates")
    links = links.unionByName(_exact_links(docs, nodes, rest, words, similarity))
    labels = connected_components(links)
    for path in passing:
        removed(spark, path)
    known = nodes.select("h", "first", "node").join(labels, "node", "left").select("h", "first", "node", F.coalesce("component", "node").alias("component"))
    keepers = known.groupBy("component").agg(F.min(F.struct("first", "h")).alias("k")).select("component", "k.*").select(F.col("component").alias("c"), F.col("first").alias("kept"), F.col("h").alias("kept_h"))
    held = known.join(keepers, known.component == keepers.c).select(F.col("h").alias("g"), "component", "kept", "kept_h")
    ids = rows.select("h", "doc_id").distinct()
    out = ids.join(held, ids.h == held.g)
    return out.select("h", "doc_id", ((F.col("h") == F.col("kept_h")) & (F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("kept"))).alias("stays"), "component")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, whose document stays by groups(); of repeated rows of one document, one."""
    columns = docs.columns
    digest, key = fresh(columns, "_digest"), fresh(columns, "_key")
    none = F.lit(2**63 - 1)
    held = groups(docs.select("doc_id", "text"), words, similarity).where("stays").select(F.col("h").alias(digest), F.coalesce("doc_id", none).alias(key))
    own = docs.withColumns({digest: F.md5(F.coalesce("text", F.lit("")).cast("binary")), key: F.coalesce(F.col("doc_id").cast("long"), none)})
    return own.join(held, [digest, key], "left_semi").dropDuplicates([digest, key]).select(*(F.col(f"`{c}`") for c in columns))
