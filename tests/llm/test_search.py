"""op1: exact top-k search against brute force."""

import math
import random

import numpy as np
import pytest

from foliant.llm import topk

SCHEMA = "label string, vec_id long, embedding array<float>, v int, d int"


def brute(rows, k=5):
    held = []
    for _, i, e, *_ in rows:
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e):
            held.append((i, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for q, v in {i: min(v for j, v in held if j == i) for i, _ in held if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in held if i != q and len(x) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect())


def test_edges(spark):
    rng = random.Random(3)
    rows = [(str(i), i, [rng.uniform(-1, 1) for _ in range(7)], 1, 2) for i in range(0, 400)]
    rows += [("x", 500, None, 1, 1), ("x", 550, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0], 1, 1), ("x", 600, [float("nan")] * 7, 1, 1), ("x", 650, [float("inf")] * 7, 1, 1), ("x", 700, [], 1, 1), ("x", None, [0.5] * 7, 1, 1)]
    rows += [("tie", 801 + i, rows[5][2], 1, 1) for i in range(9)] + [rows[7], rows[7]]
    rows += [("short", 1000, [1.0, 2.0], 1, 1), ("short", 1001, [1.0, 2.0], 1, 1)]
    assert found(spark, rows) == brute(rows)


def test_few_and_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [("a", 0, [1.0], 1, 1)]) == []
    assert found(spark, [("a", 0, [1.0], 1, 1), ("b", 3, [-1.0], 1, 1)]) == [(0, 1, 3, -65536)]


@pytest.mark.parametrize("seed", range(4))
def test_block_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (3000, 24)).astype(np.int64) if seed % 2 else rng.integers(-300, 300, (3000, 64)).astype(np.int64)
    ids = rng.permutation(3000).astype(np.int64)
    q_ids, q, v, s = ids[:70], *topk.search_block(ids[:70], x[:70], ids, x, 5)
    for i, own in enumerate(q_ids):
        score = x @ x[i]
        best = sorted((-a, b) for a, b in zip(score, ids) if b != own)[:5]
        assert [(-int(a), int(b)) for a, b in zip(s[q == own], v[q == own])] == [(int(a), int(b)) for a, b in best]
