"""op2 and the near-duplicate groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from foliant.llm import neardup, simhash
from foliant.llm.components import connected_components


def fingerprint(text, n=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 200, 400]))))
    return texts


def test_simhash_groups(spark):
    rng = random.Random(1)
    texts = [*corpus(rng, 120), None, "", " \t\n", "One", "one", "ONE  two", "É one two three four"]
    rows = [(i * 7 + 3, t, "x", i) for i, t in enumerate(texts)] + [(3, texts[0], "again", 0)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string, node int")).collect()}
    fps = [fingerprint(t) for t in texts]
    own = components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == {(i * 7 + 3, f"{f:016x}", own[i] * 7 + 3) for i, f in enumerate(fps)}


def test_simhash_empty_and_null_ids(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e"), (4, "a b c d e"), (None, "something else entirely here")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4)]


def test_long_text_in_parts():
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(1000)) for _ in range(160_000))
    assert len(text) > 1 << 20
    assert int(simhash.fingerprint(text)[0]) == fingerprint(text)


@pytest.mark.parametrize("cell_bits", [6, 9])
def test_ball_meets_all_links(cell_bits, monkeypatch):
    monkeypatch.setattr(simhash, "_MOST_VARIANTS", 20_000)  # so that cells are split further
    rng = random.Random(cell_bits)
    values = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(900):
        v = rng.choice(values)
        for _ in range(rng.randrange(1, 5)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted(set(values))
    fps = np.array(values, np.uint64)
    pairs = set()
    for cell in range(1 << cell_bits):
        a, b = simhash._joined(fps, cell, cell_bits, 64, 2)
        pairs |= {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())}
    assert all((values[i] ^ values[j]).bit_count() <= 4 for i, j in pairs)
    want = components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    label = list(range(len(values)))
    for i, j in sorted(pairs) * 12:
        label[i] = label[j] = min(label[i], label[j])
    assert label == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(words)} if words and len(words) < n else {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_near_duplicates(spark):
    rng = random.Random(11)
    texts = [t for t in corpus(rng, 150)] + ["short one", "short one", "a b c d e f", "a b c d e g", "", None, " "]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(0, texts[0], "again")]
    sets = [shingles(t or "") for t in texts]

    def linked(i, j):
        return (texts[i] or "") == (texts[j] or "") or bool(sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)

    own = components(list(range(len(texts))), linked)
    kept = spark.createDataFrame(rows, "doc_id long, text string, h string")
    out = neardup.deduplicated(kept)
    assert out.columns == ["doc_id", "text", "h"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(own))


def test_near_duplicates_empty(spark):
    assert neardup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
