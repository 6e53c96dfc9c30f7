"""Ranked lexical search with block-max pruning over a forward index.

The index is one table: a row for each block of documents that follow one another in storage, with the block's dictionary, the highest
impact of each term in it, and the forward lists (term, occurrences) of its documents. A block's bound for a query is the sum of
the query's weights times these highest impacts: no document of the block can score more. Queries take a block's documents up only
while bounds reach the k-th best score found so far: first the few blocks of highest bound give every query a bar that holds for
the whole collection, then each task goes through its blocks in falling order of their bounds and stops where they drop below the bar.

All scores are 64-bit integers: weight(term) * (10^9 tf div (1000 tf + 8 m)), m being the document's length norm.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, slices, table, written

#: Documents of a block; documents and dictionary entries that a task orders at once; blocks that set a query's first bar.
BLOCK, CHUNK, ENTRIES, FIRST = 16, 4096, 1 << 18, 4
#: Words of the queries that are searched in one pass; more queries take several passes over the index.
SHARD_WORDS = 200_000
#: Bytes of a row group of the index. Spark decodes up to 4,096 rows of a group at once, and a block with its lists may take a megabyte.
GROUP_BYTES = 4 << 20
#: Length norm and saturation: m = 25 + 75 * length / mean length, impact = 10^9 tf / (1000 tf + 8 m).
SCALE, TF, NORM = 10**9, 1000, 8

#: ASCII letters and digits and all bytes of other characters make terms, A-Z in lower case; all else separates them.
_TERMS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()

INDEX = "block long, ids array<long>, sizes array<long>, terms array<binary>, most array<long>, holders array<int>, starts array<int>, places array<int>, tf array<int>"
_NAMES = ["block", "ids", "sizes", "terms", "most", "holders", "starts", "places", "tf"]


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term of a text in UTF-8; huge texts are taken in parts."""
    out: Counter = Counter()
    for part in slices(text or b""):
        out.update(part.translate(_TERMS).split())
    return out


def norm(size: int, n_docs: int, n_terms: int) -> int:
    return 25 + (75 * size * n_docs) // n_terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (TF * tf + NORM * m)


@dataclass
class Index:
    """The table of blocks, the number of documents that hold a term, and the number of their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms in all) of docs(text binary)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [sum(len(part.translate(_TERMS).split()) for part in slices(t.as_py() or b"")) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["n", "size"])

    row = docs.select("text").mapInArrow(lean(work), "n long, size long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return row[0], row[1]


class _Chunk:
    """Documents that a task puts in order: those that share their commonest term stand together, by length, so that the bounds of a block are close."""

    def __init__(self) -> None:
        self.names: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.docs: list[tuple[bytes, int, int | None, np.ndarray, np.ndarray]] = []
        self.entries = 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        ids = np.fromiter(map(self.names.__getitem__, counts), np.int64, len(counts))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        most = tf.max()
        self.docs.append((min(w for w, n in counts.items() if n == most), int(tf.sum()), doc_id, ids, tf))
        self.entries += len(counts)

    def batch(self, number: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
        """The chunk's blocks, numbered from `number` on."""
        self.docs.sort(key=lambda d: d[:2])
        n, v = len(self.docs), max(1, len(self.names))
        held = np.array([len(d[3]) for d in self.docs], np.int64)
        heads = np.append(np.arange(0, n, BLOCK), n)
        ends = np.concatenate(([0], np.cumsum(held)))
        block = np.repeat(np.arange(n) // BLOCK, held)
        term, tf = (np.concatenate([d[k] for d in self.docs] or [np.empty(0, np.int64)]) for k in (3, 4))
        entry, place, holders = np.unique(block * v + term, return_inverse=True, return_counts=True)
        first = np.searchsorted(entry // v, np.arange(len(heads)))
        most = np.zeros(len(entry), np.int64)
        np.maximum.at(most, place, impacts(tf, np.repeat(np.array([norm(d[1], n_docs, n_terms) for d in self.docs], np.int64), held)))
        starts = np.concatenate([ends[a : b + 1] - ends[a] for a, b in zip(heads[:-1], heads[1:])] or [ends[:0]])
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
        ints = lambda values: pa.array(values, pa.int32())
        columns = [
            pa.array(range(number, number + len(heads) - 1), pa.int64()), lists(heads, pa.array([d[2] for d in self.docs], pa.int64())), lists(heads, pa.array([d[1] for d in self.docs], pa.int64())),
            lists(first, pa.array(list(self.names), pa.binary()).take(pa.array(entry % v))), lists(first, pa.array(most)), lists(first, ints(holders)),
            lists(heads + np.arange(len(heads)), ints(starts)), lists(ends[heads], ints(place - first[block])), lists(ends[heads], ints(tf)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def index(docs: DataFrame) -> Index:
    """The written index of docs(doc_id, text, ..); other columns are not read.

    Every row is a document of its own: repeated rows and ids are indexed beside each other, a null doc_id stays null. Null and empty texts and
    texts without a term are not indexed and count nowhere. Nothing is shuffled: blocks are made where their documents lie.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    n_docs, n_terms = _sizes(own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk()

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal number, chunk
            whole = chunk.batch(number, n_docs, n_terms)
            chunk = _Chunk()
            number += whole.num_rows
            yield from (whole.slice(lo, 64) for lo in range(0, whole.num_rows, 64))

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                if counts := term_counts(text.as_py()):
                    chunk.add(doc_id.as_py(), counts)
                    if len(chunk.docs) >= CHUNK or chunk.entries >= ENTRIES:
                        yield from flushed()
        yield from flushed()

    return Index(written(own.mapInArrow(lean(work), INDEX), "lexical", GROUP_BYTES), n_docs, n_terms)


@dataclass
class _Queries:
    """Queries of one pass: numbers of the terms, and for each query its terms and their weights (repeats included)."""

    terms: pa.Array
    own: list[tuple[np.ndarray, np.ndarray]]
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(counts: list[Counter], terms: dict[bytes, int], weights: np.ndarray) -> _Queries:
        own = []
        for c in counts:
            t = np.fromiter((terms[w] for w in c), np.int64, len(c))
            own.append((t, np.fromiter(c.values(), np.int64, len(c)) * weights[t]))
        term = np.concatenate([t for t, _ in own]) if own else np.empty(0, np.int64)
        query, weight = np.repeat(np.arange(len(own)), [len(t) for t, _ in own]), np.concatenate([w for _, w in own]) if own else np.empty(0, np.int64)
        order = np.argsort(term, kind="stable")
        return _Queries(pa.array(list(terms), pa.binary()), own, np.searchsorted(term[order], np.arange(len(terms) + 1)), query[order], weight[order])

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The most that any document of a block can score for each query."""
        out = np.zeros(len(self.own), np.int64)
        lo, hi = self.first[terms], self.first[terms + 1]
        size = hi - lo
        at = np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size)
        np.add.at(out, self.query[at], self.weight[at] * np.repeat(most, size))
        return out


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column, whatever slice of it this is."""
    return column.offsets.to_numpy(), column.values


class _Block:
    """Impacts of the queries' terms in a block's documents, as a table of documents and terms with an empty last column."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, numbers: np.ndarray) -> None:
        starts, places, tf = row["starts"], row["places"], row["tf"]
        self.ids = row["ids"]
        known = numbers[places] >= 0
        columns = np.cumsum(numbers >= 0) - 1
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[known]
        m = np.array([norm(n, n_docs, n_terms) for n in row["sizes"].tolist()], np.int64)
        self.table = np.zeros((len(starts) - 1, int((numbers >= 0).sum()) + 1), np.int64)
        self.table[doc, columns[places[known]]] = impacts(tf[known].astype(np.int64), m[doc])
        self.terms = numbers[numbers >= 0]

    def scores(self, column_of: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.table[:, column_of[terms]] @ weights


class _Best:
    """The k best of a query, highest score first, then the smallest doc_id, then null; nothing below the bar is let in."""

    def __init__(self, k: int, bar: int) -> None:
        self.k, self.bar, self.heap = k, bar, []

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        for i in np.flatnonzero(scores >= self.bar).tolist():
            one = (int(scores[i]), ids[i] is not None, -(ids[i] or 0))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, one)
            else:
                heapq.heappushpop(self.heap, one)
            if len(self.heap) == self.k:
                self.bar = max(self.bar, self.heap[0][0])


def _numbers(words: pa.Array, terms: pa.Array) -> np.ndarray:
    """The queries' number of each term, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy()


def _blocks(b: pa.RecordBatch, terms: pa.Array) -> Iterator[tuple[int, np.ndarray, dict]]:
    """(row, number of the queries' term or -1 for each entry of the dictionary, the row's lists) of a batch of blocks."""
    lists = {n: _lists(b.column(n)) for n in ("ids", "sizes", "terms", "most", "starts", "places", "tf")}
    at, words = lists.pop("terms")
    number = _numbers(words, terms)
    flat = {n: (o, v.to_pylist() if n == "ids" else v.to_numpy()) for n, (o, v) in lists.items()}
    for i in range(b.num_rows):
        yield i, number[at[i] : at[i + 1]], {n: v[o[i] : o[i + 1]] for n, (o, v) in flat.items()}


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents of highest score above 0 for each query of queries(query_id long, text).

    Equal scores go by ascending doc_id, null last, and repeated ids rank beside each other. Rows with the same query_id (null is an id
    like another) are one query that has the terms of their distinct texts; queries without a term, or an empty index, give no row.
    Queries are sent to the tasks in passes of about SHARD_WORDS words (a longer single query is a pass of its own), each pass written.
    """
    spark = queries.sparkSession
    own = written(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct(), "queries")
    total = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 6
    shards = max(1, -(-total // SHARD_WORDS))
    out = None
    for s in range(shards):
        rows = own.where(F.pmod(F.xxhash64("query_id"), F.lit(shards)) == s).collect()
        found = _searched(spark, index, rows, k)
        found = written(found, "ranked") if shards > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def _searched(spark: SparkSession, index: Index, rows: list, k: int) -> DataFrame:
    by_id: dict[int | None, Counter] = {}
    for r in rows:
        by_id.setdefault(r.query_id, Counter()).update(term_counts(bytes(r.text)))
    by_id = {i: c for i, c in by_id.items() if c}
    terms = {w: i for i, w in enumerate(dict.fromkeys(w for c in by_id.values() for w in c))}
    names = spark.sparkContext.broadcast(pa.array(list(terms), pa.binary()))
    n_docs, n_terms = index.n_docs, index.n_terms

    def relevant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = names.value
        for b in batches:
            at, words = _lists(b.column("terms"))
            number = _numbers(words, terms).astype(np.int64)
            keep = number >= 0
            ends = np.concatenate(([0], np.cumsum(keep)))[at].astype(np.int32)
            cut = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v[keep]))
            yield pa.RecordBatch.from_arrays([b.column("block"), cut(number), cut(_lists(b.column("most"))[1].to_numpy()), cut(_lists(b.column("holders"))[1].to_numpy())], names=["block", "terms", "most", "holders"])

    seen = index.blocks.select("block", "terms", "most", "holders").mapInArrow(lean(relevant), "block long, terms array<long>, most array<long>, holders array<int>")
    seen = written(seen, "relevant", GROUP_BYTES)
    one = F.explode(F.arrays_zip("terms", "holders"))
    df = {r.term: r.df for r in seen.select(one.alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.holders").alias("df")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
    sent = spark.sparkContext.broadcast(tuple(vars(_Queries.of(list(by_id.values()), terms, weights)).values()))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The FIRST blocks of highest bound in this task for each query."""
        q = _Queries(*sent.value)
        best: list[list[tuple[int, int]]] = [[] for _ in q.own]
        for b in batches:
            (at, number), (_, most) = (_lists(b.column(n)) for n in ("terms", "most"))
            number, most, blocks = number.to_numpy(), most.to_numpy(), b.column("block").to_pylist()
            for i, block in enumerate(blocks):
                bound = q.bounds(number[at[i] : at[i + 1]], most[at[i] : at[i + 1]])
                for j in np.flatnonzero(bound).tolist():
                    heap = best[j]
                    if len(heap) < FIRST:
                        heapq.heappush(heap, (int(bound[j]), block))
                    elif bound[j] > heap[0][0]:
                        heapq.heapreplace(heap, (int(bound[j]), block))
        rows = [(j, *x) for j, heap in enumerate(best) for x in heap]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "bound", "block"])

    top = seen.select("block", "terms", "most").mapInArrow(lean(highest), "query long, bound long, block long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    top = top.withColumn("place", place).where(F.col("place") <= FIRST).groupBy("block").agg(F.collect_list("query").alias("queries"))

    def ranked(bars: dict[int, int] | None):
        """Documents of the blocks, scored; of the queries named in the row, or of all whose bound reaches the bar."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = _Queries(*sent.value)
            bar = held.value if bars is not None else {}
            best = [_Best(k, bar.get(j, 1)) for j in range(len(q.own))]
            for b in batches:
                bounds, kept = np.zeros((b.num_rows, len(q.own)), np.int64), []
                named = b.column("queries").to_pylist() if "queries" in b.schema.names else None
                for i, numbers, row in _blocks(b, q.terms):
                    hit = numbers >= 0
                    bounds[i] = q.bounds(numbers[hit], row["most"][hit])
                    if named is not None:
                        bounds[i, np.setdiff1d(np.arange(len(q.own)), named[i])] = 0
                    kept.append((numbers, row))
                reach = np.array([x.bar for x in best])
                queries_of = np.flatnonzero((bounds >= reach).any(0))
                opened: dict[int, tuple[_Block, np.ndarray]] = {}
                for j in queries_of.tolist():
                    terms_, weights_ = q.own[j]
                    for i in np.argsort(-bounds[:, j], kind="stable").tolist():
                        if bounds[i, j] < best[j].bar:
                            break
                        if i not in opened:
                            block = _Block(kept[i][1], n_docs, n_terms, kept[i][0])
                            column_of = np.full(len(q.terms), len(block.terms), np.int32)
                            column_of[block.terms] = np.arange(len(block.terms))
                            opened[i] = block, column_of
                        block, column_of = opened[i]
                        best[j].add(block.scores(column_of, terms_, weights_), block.ids)
            rows = [(j, s, -i if there else None) for j, x in enumerate(best) for s, there, i in x.heap]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "score", "doc_id"])

        return lean(work)

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    columns = ["ids", "sizes", "terms", "most", "starts", "places", "tf"]
    # At most FIRST blocks a query, so the broadcast is bounded by the pass.
    some = index.blocks.select("block", *columns).join(F.broadcast(top), "block").select(*columns, "queries")
    bars = some.mapInArrow(ranked(None), "query long, score long, doc_id long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    held = spark.sparkContext.broadcast({r["query"]: r.score for r in bars.collect()})
    found = index.blocks.select(*columns).mapInArrow(ranked({}), "query long, score long, doc_id long")
    ids = spark.createDataFrame(list(enumerate(by_id)), "query long, query_id long")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(F.broadcast(ids), "query").select("query_id", "rank", "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search(index(table(spark, sf_dir, "documents")), items).withColumnRenamed("query_id", "item_id")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
docs AS (SELECT doc_id, row_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
items AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
tf AS (
  SELECT row_id, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row_id, doc_id, n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, whole GROUP BY term),
impact AS (SELECT row_id, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))) AS part FROM tf JOIN weight USING (term), whole),
scored AS (SELECT item_id, row_id, any_value(doc_id) AS doc_id, CAST(sum(q * part) AS BIGINT) AS score FROM impact JOIN items USING (term) GROUP BY item_id, row_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
