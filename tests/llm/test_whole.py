"""Cases that a shortcut would lose."""

import random
import textwrap

import numpy as np
import zstandard

import corpus_pipeline
from foliant.llm import html, licenses, neardup
from foliant.llm.common import table


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def together(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component for r in neardup.groups(rows).collect()}


def test_no_pair_at_the_limit_is_missed(spark):
    """400 pairs of 304 words: 300 shingles each, of which 267 in common, so 267/333 = 0.802; and as many with 266, at 0.796."""
    rng = random.Random(5)
    texts = []
    for common in (267, 266):
        for _ in range(400):
            text = words(rng, 304)
            texts += [" ".join(text), " ".join(text[: common + 4] + words(rng, 300 - common))]
    own = together(spark, texts)
    assert [own[i] == own[i + 1] for i in range(0, 1600, 2)] == [True] * 400 + [False] * 400


def test_crowded_meetings(spark):
    """300 pairs at 0.81 whose texts share three quarters of their words with all others, below the limit."""
    rng = random.Random(6)
    base = words(rng, 240)
    texts = []
    for _ in range(300):
        text = base + words(rng, 64)
        texts += [(text, " ".join(text)), (text, " ".join(text[:272] + words(rng, 32)))]
    rng.shuffle(texts)
    own = together(spark, [t for _, t in texts])
    places = {}
    for i, (text, _) in enumerate(texts):
        places.setdefault(text[-1], []).append(own[i])
    assert all(a == b for a, b in places.values()) and len({a for a, _ in places.values()}) == 300


def test_meetings_hold_every_possible_pair():
    rng = np.random.default_rng(7)
    sets = [np.sort(rng.permutation(60)[: rng.integers(48, 58)]).astype(np.uint64) for _ in range(150)]
    n = np.array([len(s) for s in sets])
    part = np.arange(150) // 2
    parity = np.stack([np.packbits((np.bincount(s.astype(int), minlength=neardup.CLASSES) & 1).astype(bool)).view(np.uint64) for s in sets])
    similar = {(i, j) for i in range(150) for j in range(i) if part[i] != part[j] and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    a, b = neardup._meeting(np.zeros(150, np.int64), np.arange(150), part, n, parity, 0.8, False)
    assert similar and similar == {(j, i) for i, j in zip(a.tolist(), b.tolist())}


def test_contaminated_rows_decide_for_themselves(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").first().text
    rows = [(None, item, "en", "s", 1), (None, "clean words of one row", "en", "s", 1), (7, "more clean words", "en", "s", 1), (7, f"x {item} y", "en", "s", 1), (7, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    kept = corpus_pipeline.decontaminate(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == ["", "clean words of one row", "more clean words"]


def found(text):
    plain = zstandard.ZstdCompressor(level=licenses.LEVEL, write_content_size=False, write_checksum=False)
    return [(t.spdx, not missing and not added) for _, t, _, missing, added, _ in licenses.licenses_in(text, licenses.templates(), plain)]


def test_wrapped_notices():
    around = " ".join(["the terms of a work are free of any other use and"] * 30)
    for spdx, form, text in licenses.TEMPLATES:
        if form == "identifier":  # one line by its nature
            continue
        text = text.replace("{year}", "2021").replace("{holder}", "A B")
        for mark in ("", "# ", " * ", "// ", "    "):
            for width in (40, 72):
                lines = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
                block = "\n".join(mark + x for x in lines)
                assert [f[0] for f in found(f"{around}\n{block}\n{around}")] == [spdx], block


def test_several_licenses_side_by_side():
    names = lambda text: [f[0] for f in found(text)]
    assert names("Released under the MIT License. Licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert names("Licensed under CC BY 4.0. All rights reserved.") == ["CC-BY-4.0", "Proprietary"]
    assert names("// SPDX-License-Identifier: Apache-2.0\nx") == ["Apache-2.0"]
    assert names("# SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)\nLicensed under the BSD 2-Clause License.") == ["MIT", "GPL-2.0-or-later", "BSD-2-Clause"]
    assert names("Licensed under the MIT License. " * 50) == ["MIT"] * 50


def texts_of(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return sorted((r.page_id, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_and_borders_do_not_hide_the_template(spark):
    page = lambda body: f"<div>Site name</div><p>{body}</p><div>All about us</div>"
    rows = [(i, f"http://h.com/a/{i:03}", page(f"own {i // 7}")) for i in range(60)] + [(100 + i, f"http://two.com/{i}", page(f"two {i}")) for i in range(2)]
    want = sorted([(i, f"own {i // 7}") for i in range(60)] + [(100, "two 0"), (101, "two 1")])
    for parts in (1, 3, 40):
        assert texts_of(spark, rows, parts) == want


def test_containers_are_compared_as_well(spark):
    page = lambda i: f"<div>Site name</div><div>Teaser {i}</div><article><h1>Title {i}</h1><div>Tell a friend</div><p>A passage that both share.</p><p>Own words {i}</p></article>"
    got = texts_of(spark, [(i, f"http://h.com/{i}", page(i)) for i in range(5)], 2)
    assert got == [(i, f"Teaser {i} Title {i} A passage that both share. Own words {i}") for i in range(5)]


def test_planted_licenses_are_found_with_their_differences():
    """Templates with words dropped (none that makes a candidate) and added, in random text with random breaks: each is found, alone, with
    those very words."""
    import random

    import zstandard

    from foliant.llm import licenses

    known = licenses.templates()
    plain = zstandard.ZstdCompressor(level=licenses.LEVEL, write_content_size=False, write_checksum=False)
    rng = random.Random(5)
    filler = "alpha beta gamma delta system data value table river stone".split()
    long = [t for t in licenses.TEMPLATES if len(t[2].split()) >= 20 and "{" not in t[2]]
    for spdx, form, text in long * 12:
        words, dropped, added = text.split(), [], []
        for at in sorted(rng.sample(range(2, len(words) - 2), rng.randrange(3)), reverse=True):
            if rng.random() < 0.5 and words.count(words[at]) == 1 and not licenses._GATE.search(words[at]):
                dropped = licenses._words(words.pop(at)) + dropped
            else:
                word = f"zz{len(added)}"
                words.insert(at, word)
                added.insert(0, word)
        before, after = (" ".join(rng.choices(filler, k=rng.randrange(400))) for _ in range(2))
        body = "".join(w + rng.choice([" ", " ", "\n", "\n * "]) for w in words)
        found = list(licenses.licenses_in(f"{before}. {body} {after}", known, plain))
        assert [(t.spdx, t.form, missing, more) for _, t, _, missing, more, _ in found] == [(spdx, form, dropped, added)], (text, words)
    for _ in range(20):
        assert not list(licenses.licenses_in(" ".join(rng.choices([*filler, "license", "copyright", "permission"], k=300)), known, plain))
