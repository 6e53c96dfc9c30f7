"""Quality counts against plain Python, and the cascade against testing every rule on every document."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import spark_rows, sql_rows
from foliant.llm import quality
from foliant.llm.quality import Rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def direct(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def counted(spark, docs):
    d = spark.createDataFrame(docs, DOCS).withColumns({"words": F.lit(1), "n_words": F.lit("x"), "kept": F.lit(True)})
    return sorted([(r.doc_id, *(r[c] for c in quality.COUNTS)) for r in quality.counted(d).collect()], key=str)


def test_against_sql(spark, sf_dir):
    df = quality.op13_quality(spark, sf_dir)
    columns, want = sql_rows(quality.ORACLE_SQL, sf_dir)
    assert sorted(df.columns) == columns and spark_rows(df) == want


@pytest.mark.parametrize("seed", range(2))
def test_counts_of_random_texts(spark, seed):
    r = random.Random(seed)
    word = lambda k: r.choice(["a", "b", "B", "é", "#", "<|", "日本", " ", "..."]) if r.random() < k else f"w{r.randrange(5000)}"
    docs = [(i, "".join(word(k) + r.choice([" ", " ", "\t", "\n", "\r\n", "\x0b", "  "]) for _ in range(r.randrange(0, 80)))) for i, k in enumerate([0.1, 0.5, 0.9] * 100)]
    assert counted(spark, docs) == sorted([(i, *direct(t)) for i, t in docs], key=str)


def test_edges(spark):
    docs = [(None, None), (1, ""), (1, ""), (2, " \n\t\r "), (3, "one"), (4, "a b"), (5, "a a a"), (6, "a a a a"), (7, "x y z\nx y z"), (8, "\n\nline\nline\n\nline"), (9, "a b c d a b c")]
    assert counted(spark, docs) == sorted([(i, *direct(t)) for i, t in docs], key=str)
    texts = ("word " * 60_000, "x" * 500_000, " " * 500_000 + "a", "." * 200_000, " ".join(f"w{i % 20_000}" for i in range(60_000)))
    assert counted(spark, list(enumerate(texts))) == [(i, *direct(t)) for i, t in enumerate(texts)]
    assert quality.verdicts(spark.createDataFrame(list(enumerate(texts)), DOCS)).where("NOT kept").count() == 5
    assert counted(spark, []) == [] and quality.verdicts(spark.createDataFrame([], DOCS)).count() == 0


def clean_text(r, n=120):
    return ". ".join(" ".join(r.choice("abcdefghij") + f"{r.choice('klmnop')}{r.choice('qrstuv')}" * r.randrange(1, 3) for _ in range(8)).capitalize() for _ in range(n // 8)) + "."


def test_rules_reject_what_they_name_and_nothing_clean(spark):
    r = random.Random(3)
    bad = {
        "symbols": "".join(w + "### " for w in clean_text(r).split()),
        "word_length": " ".join(a + b + c for a, b, c in zip(*[iter(clean_text(r, 480).split())] * 3)),
        "duplicate_lines": "\n".join([clean_text(r)] + [f"line {k % 2}" for k in range(20)] + [f"other {k}" for k in range(5)]),
        "letters": " ".join(w + f" {k}.{r.randrange(999)}" for k, w in enumerate(clean_text(r).split())),
        "capitals": clean_text(r).upper(),
        "bullets": "\n".join("- " + s for s in clean_text(r, 200).split(". ")),
        "ellipses": "...\n".join(clean_text(r, 200).split(". ")),
        "base": "too short",
    }
    docs = [(i, t) for i, t in enumerate(bad.values())] + [(100 + i, clean_text(r, r.randrange(60, 900))) for i in range(150)]
    got = {x.doc_id: x for x in quality.verdicts(spark.createDataFrame(docs, DOCS)).collect()}
    assert {i: got[i].rejected_by for i in range(len(bad))} == dict(enumerate(bad))
    assert all(got[100 + i].kept for i in range(150))


def test_order_of_the_rules_changes_no_verdict(spark):
    r = random.Random(5)
    docs = [(i, clean_text(r, r.randrange(40, 200)) * r.choice([1, 1, 1, 3]) + "#" * r.choice([0, 0, 30])) for i in range(200)]
    d = spark.createDataFrame(docs, DOCS)
    want = sorted(x.doc_id for x in quality.verdicts(d).where("kept").collect())
    assert sorted(x.doc_id for x in quality.verdicts(d, quality.RULES[::-1], 5).where("kept").collect()) == want
    everything = " OR ".join(f"coalesce({x.rejects}, false)" for x in (quality.BASE, *quality.RULES))
    assert sorted(x.doc_id for x in quality.counted(d).where(f"NOT ({everything})").collect()) == want


def test_cascade_orders_by_rejections_per_second_and_stops_early(spark):
    r = random.Random(6)
    d = spark.createDataFrame([(i, clean_text(r, 80)) for i in range(400)], DOCS)
    slow = "size(filter(transform(sequence(1, 20000), i -> xxhash64(i, text)), h -> h = 0)) >= 0"
    rules = (Rule("slow", slow), Rule("rare", "doc_id % 50 = 0"), Rule("often", "doc_id % 2 = 0"), Rule("never", "doc_id < 0"))
    order = quality.measured(d, rules, 400)
    assert [m.rule.name for m in order][:1] == ["often"] and order[-1].rule.name == "never" and 0.4 < order[0].share < 0.6
    stopping = (Rule("all", "doc_id >= 0"), Rule("fails", "raise_error('evaluated') IS NULL"))
    assert {x[0] for x in quality.counted(d).select(quality._first(stopping)).distinct().collect()} == {"all"}


def test_clean_keeps_every_column(spark):
    r = random.Random(8)
    d = spark.createDataFrame([(1, clean_text(r), "a", 5), (1, clean_text(r), "b", 6), (2, "bad", "c", 7)], "doc_id long, text string, row string, `n words` int")
    got = quality.clean(d)
    assert got.columns == d.columns and sorted(x["row"] for x in got.collect()) == ["a", "b"]


def test_filters_on_counts_stay_linear(spark):
    """A filter moves below the projection that makes the words; a text of 40,000 words must not be split once for each."""
    import time

    text = " ".join(f"w{i % 9_000}" for i in range(40_000))
    d = spark.createDataFrame([(1, text)] * 4, DOCS).repartition(1)
    start = time.perf_counter()
    assert quality.counted(d).where("n_repeat_words > 0 AND n_words > 50").count() == 4
    assert quality.clean(d).count() == 0
    assert time.perf_counter() - start < 60
