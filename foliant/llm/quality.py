"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition that rejects a document. On a sample each rule's share of rejected documents and its time are taken, and the rules are
put in the order of rejections per second: one CASE tests them in that order and stops at the first that rejects, so that costly
rules are only evaluated on what the cheap and strict ones let through. The order decides the time, never the verdict: a document is kept
if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, table, written_at

#: White space between words, and documents of the sample that costs and selectivities are taken from.
_WHITE, SAMPLE_ROWS = r"\x20\x09-\x0D", 2000
#: Counts of every document that rules may use beside `text` and `words`.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named condition, in SQL over the columns of counted(); a document on which it is true is rejected, null rejects nothing."""

    name: str
    rejects: str


#: Always applied first: they use counts that every row has anyway.
BASE = Rule("base", "n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("letters", r"10 * size(filter(words, w -> w rlike r'\p{L}')) < 7 * n_words"),
    Rule("capitals", r"2 * length(regexp_replace(text, r'\P{Lu}+', '')) > length(regexp_replace(text, r'\P{L}+', ''))"),
    Rule("bullets", r"10 * regexp_count(text, r'(?md)^[\x20\x09]*[-*•]') > 9 * n_lines"),
    Rule("ellipses", r"10 * regexp_count(text, r'(?md)(?:\.\.\.|…)[\x20\x09\r]*$') > 3 * n_lines"),
)


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more. If the windows' hashes all differ there is none; else they are sorted with their
    places, so that equal ones are neighbours, and compared word by word.

    The words are bound once: a filter on the count, which moves below the projection that made them, doesn't make them anew for each word."""
    same = lambda a, b: (a["0"] == b["0"]) & (a["1"] == b["1"]) & (a["2"] == b["2"])
    pair = lambda s, x, i: _with(F.get(s, i - 1), lambda before: F.when(same(before, x), F.array(before["3"], x["3"])))
    places = lambda s: F.filter(F.transform(s, lambda x, i: pair(s, x, i)), lambda p: p.isNotNull())

    def found(w: Column) -> Column:
        n = F.size(w)
        windows = F.slice(F.arrays_zip(F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n), F.sequence(F.lit(1), n)), 1, n - 2)
        held = _with(F.sort_array(windows), lambda s: F.flatten(places(s)))
        covered = F.array_distinct(F.flatten(F.transform(held, lambda p: F.array(p, p + 1, p + 2))))
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when((n < 4) | (F.size(F.array_distinct(hashes)) == n), 0).otherwise(F.size(covered))

    return _with(words, found)


def counted(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, the carried columns, text (null: empty), words and COUNTS of docs(doc_id, text, ..): words are `[^\\x20\\x09-\\x0D]+`, word_chars their code
    points, n_symbols characters of `#*$%&|<>`, n_lines the line-feed separated lines with a word, n_dup_lines those equal to an earlier one,
    n_repeat_words the words in three-word windows found twice or more. Rows, repeated ones and null ids too, stay as they are. A text is
    one row's work: some 60 bytes of memory for each of its words' bytes."""
    own = docs.select("doc_id", *carried, F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("words", F.array_remove(F.split("text", f"[{_WHITE}]+"), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{_WHITE}]"))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.regexp_replace("text", f"[{_WHITE}]+", "")),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")),
        "line_counts": _with(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("own"))),
        "n_repeat_words": _repeated(F.col("words")),
    }
    out = own.withColumns({n: c if n == "line_counts" else c.cast("long") for n, c in counts.items()})
    long = lambda c: F.expr(c).cast("long")
    return out.withColumns({"n_lines": long("line_counts.n"), "n_dup_lines": long("line_counts.n - line_counts.own")}).drop("line_counts")


@dataclass(frozen=True)
class Measured:
    """A rule with its share of rejected documents and its seconds over the sample; times below `noise` can't be told apart."""

    rule: Rule
    share: float
    seconds: float
    noise: float = 1e-4

    @property
    def gain(self) -> float:
        return self.share / max(self.seconds, self.noise)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """The rules in the order in which the cascade tests them: falling rejections per second, by name where they are equal.

    The sample is drawn from all rows (about sample_rows, counts and base rule applied as in the cascade) and written once; each rule is timed on it
    alone, less what reading takes, the fastest of three runs; less than half of what reading takes is noise and counts as that half."""
    total = docs.count()
    some = docs.sample(min(1.0, sample_rows / max(1, total)), seed=42)
    held, path = written_at(counted(some).where(f"NOT coalesce({BASE.rejects}, false)").repartition(2), "quality-sample")

    idle = Rule("", "length(text) + size(words) < 0")
    share, seconds = {}, {}
    for r in (idle, *rules) * 3:
        start = time.perf_counter()
        share[r] = held.select(F.avg(F.coalesce(F.expr(r.rejects), F.lit(False)).cast("double"))).first()[0] or 0.0
        seconds[r] = min(seconds.get(r, 1e9), time.perf_counter() - start)
    removed(docs.sparkSession, path)
    found = [Measured(r, share[r], max(0.0, seconds[r] - seconds[idle]), seconds[idle] / 2) for r in rules]
    return sorted(found, key=lambda m: (-m.gain, m.rule.name))


def _first(rules: tuple[Rule, ...]) -> Column:
    """The name of the first rule that rejects, or null; later ones aren't evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(F.expr(r.rejects), r.name).otherwise(out)
    return out


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, rejected_by (the rule that the cascade stopped at, null if none) and kept of every row of docs.

    Which of several rejecting rules is named depends on the order that the sample gives; kept doesn't."""
    order = tuple(m.rule for m in measured(docs, rules, sample_rows))
    out = counted(docs).withColumns({"base_failed": F.coalesce(F.expr(BASE.rejects), F.lit(False)), "rejected_by": _first((BASE, *order))})
    return out.select("doc_id", *COUNTS, "base_failed", "rejected_by", F.col("rejected_by").isNull().alias("kept"))


def clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs(doc_id, text, ..) that no rule rejects, with all their columns, whatever their names."""
    order = tuple(m.rule for m in measured(docs, rules, sample_rows))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return counted(docs, row).where(_first((BASE, *order)).isNull()).select("row.*")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT row_id, i, words[i:i + 2] AS w FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs)),
again AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w) AS n FROM windows),
covered AS (SELECT row_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY row_id),
counted AS (
  SELECT d.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM docs d LEFT JOIN covered c USING (row_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
    OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 2 * n_dup_lines > n_lines
    OR 10 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < 7 * n_words
    OR 2 * length(regexp_replace(text, '\P{Lu}+', '', 'g')) > length(regexp_replace(text, '\P{L}+', '', 'g'))
    OR 10 * len(regexp_extract_all(text, '(?m)^[\x20\x09]*[-*•]')) > 9 * n_lines
    OR 10 * len(regexp_extract_all(text, '(?m)(?:\.\.\.|…)[\x20\x09\r]*$')) > 3 * n_lines) AS kept
FROM judged
"""
