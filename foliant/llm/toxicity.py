"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features are densities of two lexicons (a fixed one and one learned from labelled texts), nearness of such words to the second
person, capitals, punctuation and obfuscation rates. Trees and calibration are fitted on the driver over the features of a bounded
sample of labelled rows; every text is scored whole, where it lies, with the small model in the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, table

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their doc_id.
MAX_TRAINING_ROWS = 12_000
#: Words that the learned lexicon holds at most.
MAX_LEXICON = 400

INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic imbecile stupid stupidity dumb dumbass fool fools loser losers pathetic worthless "
    "trash garbage scum scumbag filth filthy vermin disgusting disgust clown clowns ugly creep freak jerk bastard bastards bitch "
    "bitches asshole assholes ass crap damn shit shitty bullshit fuck fucking fucker fucked dick prick cunt whore slut hate hates "
    "hateful kill die dumbest retard retarded sucker sucks suck liar coward cowards parasite parasites subhuman savage pig pigs "
    "idiota estúpido estúpida imbécil basura asqueroso mierda puta connard connasse salaud ordure débile crétin merde dumm "
    "dummkopf idioten arschloch scheiße abschaum drecksau versager widerlich".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur youre tu te ti tus tú usted ustedes vos vous votre vos toi ton ta du dich dir dein deine ihr euch euer".split())
_LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W\d_]+")
_STRETCHED = re.compile(r"(\w)\1{2,}")
FEATURES = ("fixed_hits", "fixed_density", "learned_hits", "learned_density", "near_second_person", "second_person_rate", "capitals", "shouted", "exclamations", "questions", "punctuation", "obfuscated", "masked_hits", "stretched", "words", "word_length")
_NEAR = 5
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_ALPHA = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 192 for i in range(256)])
_MARKS = np.array([33 <= i <= 47 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 126 for i in range(256)])
_ODD = np.array([chr(i) in "*#@$%&+=~^|\\<>_" for i in range(256)])


#: Tokens that a task remembers at most before it starts anew, and the longest token that it remembers at all.
_MEMO, _TOKEN = 200_000, 64
#: The learned lexicon holds whole words, marked with a final $, and word beginnings of these lengths.
STEMS = (4, 5, 6)


class _Flags(dict):
    """Token to flags: 1 fixed lexicon, 2 learned, 4 second person, 8 only when unmasked, 16 shouted, 32 stretched."""

    def __init__(self, learned: frozenset[str]):
        self.learned = learned

    def __missing__(self, token: str) -> int:
        low, learned = token.lower(), self.learned
        words = (low,) if low.isalpha() else _WORD.findall(low)
        flags = 0
        for w in words:
            if w in INSULTS:
                flags |= 1
            if w in SECOND_PERSON:
                flags |= 4
            if f"{w}$" in learned or w[:4] in learned or w[:5] in learned or w[:6] in learned:
                flags |= 2
        if not flags & 1 and len(low) > 3 and not low.isalpha():
            if "".join(words) in INSULTS or not INSULTS.isdisjoint(_WORD.findall(low.translate(_LEET))):
                flags |= 8
        if len(token) > 2 and token.isupper() and sum(map(len, words)) > 2:
            flags |= 16
        if _STRETCHED.search(low):
            flags |= 32
        if len(token) <= _TOKEN:
            self[token] = flags
        return flags


def _of_part(text: str, flags: _Flags) -> np.ndarray:
    """Counts of one part of a text, which add up over parts."""
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    tokens = text.split()
    if len(flags) > _MEMO:
        flags.clear()
    f = np.frombuffer(bytes(map(flags.__getitem__, tokens)), np.uint8)
    fixed, second = np.flatnonzero(f & 9), np.flatnonzero(f & 4)
    near = 0
    if len(fixed) and len(second):
        j = np.searchsorted(second, fixed)
        gap = np.minimum(np.abs(second[np.maximum(j - 1, 0)] - fixed), np.abs(second[np.minimum(j, len(second) - 1)] - fixed))
        near = int((gap <= _NEAR).sum())
    count = [int(((f & bit) > 0).sum()) for bit in (1, 2, 8, 16, 32)]
    return np.array([len(tokens), count[0], count[1], near, len(second), octets[_UPPER].sum(), octets[_ALPHA].sum(), count[3], octets[33], octets[63], octets[_MARKS].sum(), octets[_ODD].sum(), count[2], count[4], sum(map(len, tokens)), octets.sum()], float)


def features(text: str | None, flags: _Flags) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES; long texts are taken in parts cut at white space."""
    text = text or ""
    if len(text) <= 1 << 20:
        c = _of_part(text, flags)
    else:
        c, at = np.zeros(16), 0
        while at < len(text):
            end = min(len(text), at + (1 << 20))
            while end < len(text) and not text[end].isspace():
                end += 1
            c += _of_part(text[at:end], flags)
            at = end
    n, size = max(1.0, c[0]), max(1.0, c[15])
    return [c[1], c[1] / n, c[2], c[2] / n, c[3], c[4] / n, c[5] / max(1.0, c[6]), c[7] / n, c[8] / n, c[9] / n, c[10] / size, c[11] / size, c[12], c[13] / n, np.log1p(c[0]), c[14] / n]


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the log-odds; node k has children 2k+1 and 2k+2."""

    start: float
    column: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.column.shape[1]
        for column, cut, value in zip(self.column, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, column[at]] > cut[at])
            out += value[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 20.0, ridge: float = 2.0) -> Trees:
    """Second-order boosting for logistic loss, on quantile histograms; a split needs `least` rows on either side."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(d)]
    extra = [np.unique(x[:, j][x[:, j] > 0])[:1] for j in range(d)]  # zero against more than zero is always a split to try
    edges = [np.unique(np.concatenate([e, m[:1] * 0 if len(m) else m])) for e, m in zip(edges, extra)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, d), int)
    width = bins + 2
    flat = binned + np.arange(d) * width
    p = min(max(float(y.mean()) if n else 0.5, 1e-4), 1 - 1e-4)
    start = float(np.log(p / (1 - p)))
    margin = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    columns, cuts, values = [], [], []
    for _ in range(trees if n else 0):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        at = np.zeros(n, np.int64)
        column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(at == node)
                if len(own) >= 2 * least:
                    keys = flat[own].ravel()
                    sums = [np.cumsum(np.bincount(keys, np.repeat(v, d), d * width).reshape(d, width), axis=1) for v in (g[own], h[own], np.ones(len(own)))]
                    (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain[(nl < least) | (nt - nl < least)] = 0
                    for j, e in enumerate(edges):
                        gain[j, len(e) :] = 0
                    j, k = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, k] > 1e-6:
                        column[node], cut[node] = j, edges[j][k]
                at[own] = 2 * node + 1 + (x[own, column[node]] > cut[node])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        columns.append(column)
        cuts.append(cut)
        values.append(value)
    shape = lambda v, k: np.array(v).reshape(-1, k)
    return Trees(start, shape(columns, inner).astype(np.int64), shape(cuts, inner), shape(values, leaves))


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum, count, first, last margin
    for m, v in zip(margin[order], y[order]):
        if pools and pools[-1][3] == m:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([float(v), 1.0, float(m), float(m)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][3] = last
    knots = [(at, s / c) for s, c, first, last in pools for at in dict.fromkeys((first, last))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Model:
    learned: frozenset[str]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        margin = self.trees.margin(x)
        if not len(self.knots[0]):
            return 1 / (1 + np.exp(-margin))
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents that are not held out: those with the smallest hash of their id. Of
    equal texts one stays, with the mean label. Rows with a null id or label take no part."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return joined.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("y")).select("doc_id", "text", (F.col("y") > 0.5).cast("int").alias("y"))


def learned_lexicon(rows: DataFrame) -> frozenset[str]:
    """Words and word beginnings at least eight times as frequent in texts labelled 1, by documents that hold them, and in five of
    those and a hundredth of them at least."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1)))
    whole = F.transform(words, lambda w: F.concat(w, F.lit("$")))
    stems = F.array_distinct(F.concat(whole, F.flatten(F.transform(words, lambda w: F.array(*[F.substring(w, 1, n) for n in STEMS])))))
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    if not total["n"] or not total["k"] or total["k"] == total["n"]:
        return frozenset()
    bad, good = float(total["k"]), float(total["n"] - total["k"])
    counts = rows.select("y", F.explode(stems).alias("w")).groupBy("w").agg(F.sum("y").alias("k"), F.count("*").alias("n")).where(F.col("k") >= max(5.0, bad / 100))
    ratio = ((F.col("k") + 0.5) / bad) / ((F.col("n") - F.col("k") + 0.5) / good)
    return frozenset(r["w"] for r in counts.where(ratio >= 8).orderBy(F.desc("k"), "w").limit(MAX_LEXICON).collect())


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Model:
    """A model from the labelled documents outside the held-out fold. Without any labelled row, every text scores one half."""
    rows = training_rows(docs, labels, most).persist()
    try:
        learned = learned_lexicon(rows)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = _Flags(learned)
            for b in batches:
                x = [features(t.as_py(), flags) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

        got = rows.mapInArrow(lean(work), "doc_id long, y int, x array<double>").orderBy("doc_id").toPandas()
    finally:
        rows.unpersist()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = got["y"].to_numpy(float)
    if len(y) < 100:
        return Model(learned, fit_trees(x, y, least=2.0), (np.empty(0), np.empty(0)))
    parts = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for p in range(3):
        margin[parts == p] = fit_trees(x[parts != p], y[parts != p]).margin(x[parts == p])
    return Model(learned, fit_trees(x, y), fit_isotonic(margin, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text). A null text counts as empty; repeated rows each
    give a row; a null doc_id gives a row with held_out null. Nothing but the text enters a score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _Flags(model.learned)
        for b in batches:
            x = np.array([features(t.as_py(), flags) for t in b.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs(.., text) with a column of that name added; every row and other column stays."""
    columns = docs.columns
    at = columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _Flags(model.learned)
        for b in batches:
            x = np.array([features(t.as_py(), flags) for t in b.column(at)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*columns, name])

    return docs.mapInArrow(lean(work), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
