"""Ranked lexical search against a direct scoring of every document."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from compare import spark_rows, sql_rows
from foliant.llm import lexical

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct(docs, items, k=10):
    words = lambda t: TERMS.findall((t or "").translate(FOLD))
    held = [(i, words(t)) for i, t in docs if words(t)]
    n, size = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    queries = {}
    for i, t in dict.fromkeys(items):
        queries.setdefault(i, []).extend(words(t))
    out = []
    for q, terms in queries.items():
        scored = []
        for d, w in held:
            m = 25 + (75 * len(w) * n) // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(x, 0) + 1))) * ((10**9 * w.count(x)) // (1000 * w.count(x) + 8 * m)) for x in terms)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(q, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"query": F.lit("x"), "rank": F.lit(3), "block": F.lit(1)}).repartition(parts)
    q = spark.createDataFrame(items, "query_id long, text string").withColumn("score", F.lit(0))
    rows = lexical.search(lexical.index(d), q, k).collect()
    return sorted([(r.query_id, r["rank"], r.doc_id, r.score) for r in rows], key=str)


def test_against_sql(spark, sf_dir):
    df = lexical.op11_lexical(spark, sf_dir)
    columns, want = sql_rows(lexical.ORACLE_SQL, sf_dir)
    assert sorted(df.columns) == columns and spark_rows(df) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_collections(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "B", "ab", "é", "É", "x1", "日本", "the", "of", "q"]) if r.random() < 0.7 else f"w{r.randrange(300)}"
    text = lambda n: "".join(word() + r.choice([" ", "\n", "-", "_", "  "]) for _ in range(n))
    docs = [(i, text(r.randrange(0, 60))) for i in range(300)]
    items = [(i, text(r.randrange(0, 12))) for i in range(12)]
    assert found(spark, docs, items) == direct(docs, items)


def test_ties_repeats_nulls_and_long_texts(spark):
    docs = [(5, "same words here"), (3, "same words here"), (3, "same words here"), (None, "same words here"), (None, None), (7, ""), (8, " \t-"), (-2, "same words here")]
    docs += [(100 + i, "other text of some length") for i in range(40)] + [(9, "long " * 400_000 + "same")]
    items = [(1, "same WORDS words"), (1, "same WORDS words"), (None, "here"), (2, None), (3, "--"), (4, "unknown"), (5, "other"), (6, "long same"), (1, "here")]
    got = found(spark, docs, items, k=4)
    assert got == direct(docs, items, k=4)
    assert [x[2] for x in sorted(x for x in got if x[0] == 1)] == [-2, 3, 3, 5]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a b")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_passes_and_chunks_change_nothing(spark, monkeypatch):
    r = random.Random(7)
    docs = [(i, " ".join(f"w{min(r.randrange(200), r.randrange(200))}" for _ in range(r.randrange(1, 50)))) for i in range(400)]
    items = [(i, " ".join(f"w{r.randrange(200)}" for _ in range(8))) for i in range(20)]
    want = found(spark, docs, items)
    monkeypatch.setattr(lexical, "SHARD_WORDS", 20)
    monkeypatch.setattr(lexical, "CHUNK", 37)
    assert found(spark, docs, items, parts=5) == want == direct(docs, items)


def test_bounds_hold_and_prune(spark, sf_dir):
    """No document scores over its block's bound, and most pairs of block and query are pruned by the final bars on blocks of like documents."""
    import numpy as np

    r = random.Random(1)
    topic = [[f"t{t}x{i}" for i in range(40)] for t in range(8)]
    docs = [(i, " ".join(r.choice(topic[i % 8]) for _ in range(30))) for i in range(2000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = lexical.index(d)
    items = [" ".join(r.choice(topic[t]) for _ in range(6)) for t in range(8)]
    counts = [lexical.term_counts(t.encode()) for t in items]
    terms = {w: i for i, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
    q = lexical._Queries.of(counts, terms, np.full(len(terms), 1000))
    seen = pruned = 0
    for b in index.blocks.drop("holders").toArrow().to_batches():
        for _, number, row in lexical._blocks(b, q.terms):
            hit = number >= 0
            bounds = q.bounds(number[hit], row["most"][hit])
            block = lexical._Block(row, index.n_docs, index.n_terms, number)
            column_of = np.full(len(terms), len(block.terms))
            column_of[block.terms] = np.arange(len(block.terms))
            for j, (t, w) in enumerate(q.own):
                assert block.scores(column_of, t, w).max() <= bounds[j]
            seen, pruned = seen + len(bounds), pruned + int((bounds == 0).sum())
    assert pruned > seen * 0.7


def test_index_rows_are_read_few_at_a_time(spark):
    """Row groups of the index are bounded, since a task decodes as many rows of a group at once as a batch holds."""
    import pyarrow.parquet as pq

    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.randrange(10**9):x}" for _ in range(2000))) for i in range(1000)]
    whole = lexical.index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    (path,) = [f.removeprefix("file:").replace("//", "/") for f in whole.blocks.inputFiles()]
    meta = pq.ParquetFile(path).metadata
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert len(sizes) > 4 and max(sizes) < 4 * lexical.GROUP_BYTES
