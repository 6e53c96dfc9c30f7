"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND, then question and answer overlap.

The test items are the indexed collection and every passage of every document is a query. A passage's score for an item is its
BM25 score as a share of the item's best (the item queried with itself). As in WAND, a passage is scored only while upper bounds
allow the threshold. The most common terms, which together can't reach it, count by their most for any item. The other terms of a
passage add their best shares over all items, then their best shares in each block of their postings; what may still reach the
threshold is scored exactly from the postings of the surviving blocks. A batch of documents goes through each step at once in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, row_slices, table, written

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$")
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach; words of an overlap; shares of question and answer that must be found.
THRESHOLD, GRAM, QUESTION, ANSWER, TOTAL = 0.5, 5, 0.6, 0.5, 0.8
#: Items in a block, words of the items in one index, and posting blocks opened at once. A larger collection is searched index by index.
BLOCK, SHARD_WORDS, HELD = 16, 1_000_000, 1 << 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_parts(text: str | None, span: int, size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(number of the first word, words) of parts of about `size` characters that share two spans with the part before; each part
    starts at a multiple of span, so that all windows of the whole text are windows of some part."""
    text = text or ""
    if len(text) <= size:
        yield 0, words_of(text)
        return
    at, offset, carry = 0, 0, []
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        words = carry + words_of(text[at:end])
        yield offset, words
        drop = max(0, (len(words) - 2 * span) // span * span)
        offset, carry, at = offset + drop, words[drop:], end


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; of one sentence alone, it is the question and there is no answer."""
    parts = [w for w in (words_of(s) for s in _SENTENCE.findall(text or "")) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


@dataclass
class Index:
    """Postings of the terms that items hold, in the order of (term, item): item and impact, the term's part of the item's own score.

    Postings of a term are cut into blocks of BLOCK neighbouring items; block_of and block_max name a posting block's place among the
    items' blocks and its highest impact. first and block_first are where a term's postings and blocks begin. essential holds the terms
    without the commonest ones; rest[item] is what those add up to.
    """

    terms: dict[str, int]
    essential: dict[str, int]
    rest: np.ndarray
    items: list[int]
    item: np.ndarray
    impact: np.ndarray
    first: np.ndarray
    block_of: np.ndarray
    block_max: np.ndarray
    block_start: np.ndarray
    block_first: np.ndarray
    list_max: np.ndarray
    words: list[tuple[list[str], list[str]]]
    span: int


def collection(rows: list[tuple[int, list[str], list[str]]]) -> tuple[int, float, int, dict[str, int]]:
    """Number of items, their mean and greatest length, and in how many each word stands, of (item_id, question, answer)."""
    df: dict[str, int] = {}
    for _, q, a in rows:
        for w in set(q + a):
            df[w] = df.get(w, 0) + 1
    sizes = [len(q) + len(a) for _, q, a in rows]
    return len(rows), sum(sizes) / max(1, len(rows)), max(sizes, default=0), df


def build_index(rows: list[tuple[int, list[str], list[str]]], whole: tuple[int, float, int, dict[str, int]] | None = None) -> Index:
    """Of (item_id, question words, answer words), each with a word at least. whole: the collection that the rows are a part of."""
    n, mean, span, frequency = whole or collection(rows)
    terms: dict[str, int] = {}
    bags: list[dict[int, int]] = []
    for _, q, a in rows:
        bag: dict[int, int] = {}
        for w in q + a:
            t = terms.setdefault(w, len(terms))
            bag[t] = bag.get(t, 0) + 1
        bags.append(bag)
    df = np.array([frequency[w] for w in terms], float)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    size = np.array([len(b) for b in bags], np.int64)
    item = np.repeat(np.arange(len(rows)), size)
    term = np.fromiter((t for b in bags for t in b), np.int64, int(size.sum()))
    tf = np.fromiter((c for b in bags for c in b.values()), float, int(size.sum()))
    length = np.array([len(q) + len(a) for _, q, a in rows], float)[item]
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))
    impact /= np.bincount(item, impact, len(rows))[item]
    order = np.lexsort((item, term))
    item, term, impact = item[order], term[order], impact[order]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    most, common = np.zeros(len(rows)), set()
    for t in np.argsort(-df, kind="stable").tolist():
        own = slice(first[t], first[t + 1])
        if (most[item[own]] + impact[own]).max(initial=0) > THRESHOLD / 2:
            break
        most[item[own]] += impact[own]
        common.add(t)
    start = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)))) if len(term) else np.empty(0, np.int64)
    block_max = np.maximum.reduceat(impact, start) if len(start) else np.empty(0)
    return Index(
        terms, {w: t for w, t in terms.items() if t not in common}, most, [r[0] for r in rows], item, impact, first, item[start] // BLOCK, block_max, np.append(start, len(term)),
        np.searchsorted(term[start], np.arange(len(terms) + 1)), np.maximum.reduceat(impact, first[:-1]) if len(terms) else np.empty(0), [(q, a) for _, q, a in rows], span,
    )


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places of the ranges, one range after another."""
    size = stop - start
    who = np.repeat(np.arange(len(size)), size)
    return who, np.arange(len(who)) + np.repeat(start - np.cumsum(size) + size, size)


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's values."""
    names, place = np.unique(key, return_inverse=True)
    return names, np.bincount(place, value, len(names))


def retrieve(index: Index, docs: list[list[str]]) -> list[tuple[int, int, int, float]]:
    """(document, passage start, item, share) of every passage and item at THRESHOLD or more.

    Passages are windows of twice the longest item's words, one starting at each multiple of it: any run of words as long as an
    item lies whole in one of them. A repeated word counts once.
    """
    if not index.items:
        return []
    span, get = index.span, index.essential.get
    flat, doc, part = [], [], []
    for d, words in enumerate(docs):
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        flat.append(ids[at])
        part.append(at // span)
        doc.append(np.full(len(at), d))
    if not flat or not sum(map(len, flat)):
        return []
    term, doc, part = np.concatenate(flat), np.concatenate(doc), np.concatenate(part)
    # Half-windows numbered over all documents; a window is a half and the next one, so each word is in at most two.
    halves = np.array([max(1, -(-len(d) // span)) for d in docs])
    start = np.cumsum(halves) - halves
    here, n = start[doc] + part, len(index.terms)
    keys = np.unique(np.concatenate([here * n + term, (here[part > 0] - 1) * n + term[part > 0]]))
    window, term = keys // n, keys % n
    heads = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
    counts = np.diff(np.append(heads, len(keys)))
    least = THRESHOLD - 1e-4
    bar = least - index.rest.max()
    blocks = -(-len(index.items) // BLOCK)
    alive = np.flatnonzero(np.add.reduceat(index.list_max[term], heads) >= bar)
    # Posting blocks that each window would open: windows are taken up so many at a time that these stay bounded.
    work = np.cumsum(np.add.reduceat(index.block_first[term + 1] - index.block_first[term], heads)[alive])
    found: list[tuple[int, int, int, float]] = []
    for some in np.split(alive, np.flatnonzero(np.diff(work // HELD)) + 1) if len(alive) else []:
        who, place = _ranges(heads[some], heads[some] + counts[some])
        terms = term[place]
        pair, block = _ranges(index.block_first[terms], index.block_first[terms + 1])
        key = who[pair] * blocks + index.block_of[block]
        names, reach = _sums(key, index.block_max[block])
        open_ = names[reach >= bar]
        if not len(open_):
            continue
        at = np.minimum(np.searchsorted(open_, key), len(open_) - 1)
        chosen = open_[at] == key
        entry, posting = _ranges(index.block_start[block[chosen]], index.block_start[block[chosen] + 1])
        names, reach = _sums(who[pair[chosen]][entry] * len(index.items) + index.item[posting], index.impact[posting])
        for name in names[reach + index.rest[names % len(index.items)] >= least].tolist():
            number, item = int(window[heads[some[name // len(index.items)]]]), name % len(index.items)
            d = int(np.searchsorted(start, number, side="right")) - 1
            begin = int(number - start[d]) * span
            passage = set(docs[d][begin : begin + 2 * span])
            share = 0.0
            for w in sorted(passage.intersection(index.words[item][0] + index.words[item][1])):
                t = index.terms[w]
                share += float(index.impact[index.first[t] + np.searchsorted(index.item[index.first[t] : index.first[t + 1]], item)])
            if share >= THRESHOLD - 1e-9:
                found.append((d, begin, item, share))
    return found


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's GRAM-word runs (fewer words: the whole part) that the passage holds; 1 for an empty part."""
    if not part:
        return 1.0
    n = min(GRAM, len(part))
    have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    runs = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(r in have for r in runs) / len(runs)


def verified(question: float, answer: float, q: int, a: int) -> bool:
    """Question and answer are both there, or nearly all runs of the two together."""
    return (question >= QUESTION and answer >= ANSWER) or (question * q + answer * a) / max(1, q + a) >= TOTAL


def _split_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, question array<string>, answer array<string>) of benchmark(item_id, text); items without an id or a word are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i.as_py(), *question_and_answer(t.as_py())) for i, t in zip(b.column(0), b.column(1))]
            rows = [r for r in rows if r[1] or r[2]]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())))], names=["item_id", "question", "answer"])

    own = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return own.mapInArrow(work, "item_id long, question array<string>, answer array<string>")


def _indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[Broadcast]:
    """The fields of each part's index, sent to the tasks. Frequencies, mean and span are those of all items, so that the parts give what one
    index of all would; a part's words add up to about SHARD_WORDS."""
    items = written(_split_items(benchmark), "items")
    size = F.size("question") + F.size("answer")
    n, mean, span, total = items.agg(F.count("*"), F.coalesce(F.avg(size), F.lit(0.0)), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    shards = max(1, -(-total // SHARD_WORDS))
    words = lambda rows: rows.select(F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word"))
    df = words(items).groupBy("word").agg(F.count("*").alias("df"))
    df = written(df, "frequencies") if shards > 1 else df
    for s in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s)
        own = df.join(words(part).distinct(), "word", "left_semi") if shards > 1 else df
        rows = sorted((r.item_id, list(r.question), list(r.answer)) for r in part.collect())
        index = build_index(rows, (n, mean, span, {r.word: r.df for r in own.collect()}))
        yield spark.sparkContext.broadcast(tuple(vars(index).values()))


def _hits(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(number of the text, item_id, score, question overlap, answer overlap, passage start) of every verified passage."""
    parts = ((i, offset, words) for i, t in enumerate(texts) for offset, words in word_parts(t.as_py(), max(1, index.span)))
    while group := list(islice(parts, 400)):
        docs = [p[2] for p in group]
        for d, start, j, share in retrieve(index, docs):
            q, a = index.words[j]
            passage = docs[d][start : start + 2 * index.span]
            qo, ao = overlap(q, passage), overlap(a, passage)
            if verified(qo, ao, len(q), len(a)):
                yield group[d][0], index.items[j], share, qo, ao, group[d][1] + start


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_start) of every verified document and item, with the best
    passage of each: highest score, then question and answer overlap, then the earliest.

    docs(doc_id, text) may have other columns. Null or empty texts and items without words match nothing; a repeated document row
    gives its rows once for each distinct doc_id; a null doc_id is a key like another. The index is built on the driver and sent to the tasks;
    a benchmark of more than SHARD_WORDS words is dealt into parts by a hash of item_id and takes one pass for each, with the
    frequencies of the whole, so that the parts don't change any row.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in _indexes(docs.sparkSession, benchmark):

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for whole in batches:
                for b in row_slices(whole, 400):
                    ids = b.column(0).to_pylist()
                    hits = [(ids[i], *hit) for i, *hit in _hits(index, b.column(1))]
                    columns = list(zip(*hits)) or [()] * 6
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start"])

        got = own.mapInArrow(lean(work), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long")
        out = got if out is None else out.unionByName(got)
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap", "passage_start"), F.struct("score", "question_overlap", "answer_overlap", -F.col("passage_start")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs(.., text), with all their columns, whose own text holds no verified passage; no other row decides."""
    at = docs.columns.index("text")
    for shared in _indexes(docs.sparkSession, benchmark):

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for whole in batches:
                for b in row_slices(whole, 400):
                    hit = {h[0] for h in _hits(index, b.column(at))}
                    yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(lean(work), docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
