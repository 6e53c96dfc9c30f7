"""Token counts: the exact histogram of encoded lengths, and suffix sums over it for every context limit."""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, table, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once, and the longest run of white space that is left to the pattern, which takes it up by recursion.
_PART, _RUN = 1 << 20, 1 << 12
#: White space as the pattern's \\s has it, a fixed value.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACE}]{{{_RUN},}}")


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _kind(c: str) -> int:
    """0 white space, 1 a letter, 2 a number, 3 anything else, as the pattern tells them apart."""
    return 0 if c in _SPACE else {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3)


def text_parts(text: str, size: int = _PART) -> Iterator[str]:
    """Cuts a text where the pattern always splits: before white space that follows anything else, and after a letter or number that
    another kind follows."""
    at = 0
    while len(text) - at > size:
        end = at + size
        last = _kind(text[end - 1])
        while end < len(text) and (last in (0, 3) or _kind(text[end]) == last) and not (last == 3 and text[end] in _SPACE):
            last = _kind(text[end])
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def n_tokens(own: tiktoken.Encoding, text: str) -> int:
    """Tokens of a text of any form. Of a run of white space, the pattern makes one piece, but for its last character if more text
    follows; long runs are given to the merges as that piece, the rest goes through the pattern in parts."""
    total = at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += sum(len(own.encode_ordinary(p)) for p in text_parts(text[at : run.start()])) + len(own._encode_single_piece(text[run.start() : end].encode()))
        at = end
    return total + sum(len(own.encode_ordinary(p)) for p in text_parts(text[at:] if at else text))


def token_counts(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs(doc_id, text); a null or empty text has none. Special tokens' strings are text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            counts = [n_tokens(own, t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), "doc_id long, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """(length, n_docs) of counts(n_tokens): one row for each length that occurs."""
    return counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def _bucketed(lengths: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The lengths with their bucket, one row (k, d_after, t_after, d_all, t_all, ..) for every bucket up to the last, and the lengths to a
    bucket: the root of the greatest one, so that buckets and the lengths in one are both few."""
    most = lengths.agg(F.max("length")).first()[0] or 0
    width = max(1, math.isqrt(most))
    b = lengths.withColumns({"bucket": F.floor(F.col("length") / width), "tokens": F.col("length") * F.col("n_docs")})
    every = lengths.sparkSession.range(most // width + 1).select(F.col("id").alias("k"))
    totals = b.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    totals = every.join(totals, every.k == totals.bucket, "left").select("k", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("t", F.lit(0)).alias("t"))
    after = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = [F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"] + [F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"]
    return b, totals.select("k", *sums), width


def with_suffix_sums(lengths: DataFrame) -> DataFrame:
    """Adds to (length, n_docs), for a context limit of exactly `length` tokens:

    docs_longer, tokens_longer (documents longer than the limit and their tokens), docs_fitting, tokens_fitting (the rest),
    truncated_total (tokens left when every document is cut to the limit), tokens_cut (those lost) and quantile (share of documents
    no longer than the limit). Sums run within buckets and then over bucket totals; a task sees the root of the greatest length in rows
    at most. An empty table gives an empty result.
    """
    b, later, _ = _bucketed(lengths)
    inside = Window.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    own = b.withColumns({"d_in": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "t_in": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    j = own.join(later, own.bucket == later.k)
    j = j.withColumns({"docs_longer": F.col("d_in") + F.col("d_after"), "tokens_longer": F.col("t_in") + F.col("t_after")})
    return j.select(
        "length", "n_docs", "docs_longer", "tokens_longer",
        (F.col("d_all") - F.col("docs_longer")).alias("docs_fitting"),
        (F.col("t_all") - F.col("tokens_longer")).alias("tokens_fitting"),
        (F.col("t_all") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")).alias("truncated_total"),
        (F.col("tokens_longer") - F.col("docs_longer") * F.col("length")).alias("tokens_cut"),
        ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("quantile"),
    )


def at_limits(lengths: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, docs_fitting, docs_longer, truncated_total, tokens_cut) of any limits(context_limit long) over lengths(length,
    n_docs, ..): what lies after each limit in its bucket, and the sums over the later buckets. Null and negative limits are left
    out; over an empty table all sums are zero."""
    b, later, width = _bucketed(lengths.select("length", "n_docs"))
    lim = limits.where("context_limit >= 0").select(F.col("context_limit").cast("long").alias("context_limit")).distinct()
    lim = lim.select(F.floor(F.col("context_limit") / width).alias("bucket"), F.col("context_limit").alias("length"), F.lit(0).cast("long").alias("n_docs"), F.lit(0).cast("long").alias("tokens"), F.lit(True).alias("limit"))
    both = b.select("bucket", "length", "n_docs", "tokens", F.lit(False).alias("limit")).unionByName(lim)
    inside = Window.partitionBy("bucket").orderBy(F.desc("length")).rangeBetween(Window.unboundedPreceding, -1)
    own = both.withColumns({"d_in": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "t_in": F.coalesce(F.sum("tokens").over(inside), F.lit(0))}).where("limit")
    every = later.agg(F.coalesce(F.max("d_all"), F.lit(0)).alias("d_all"), F.coalesce(F.max("t_all"), F.lit(0)).alias("t_all")).first()
    j = own.join(later.select("k", "d_after", "t_after"), own.bucket == later.k, "left")
    docs, tokens = F.col("d_in") + F.coalesce("d_after", F.lit(0)), F.col("t_in") + F.coalesce("t_after", F.lit(0))
    j = j.select(F.col("length").alias("context_limit"), (F.lit(every["d_all"]) - docs).alias("docs_fitting"), docs.alias("docs_longer"), tokens.alias("t"))
    return j.select("context_limit", "docs_fitting", "docs_longer", (F.lit(every["t_all"]) - F.col("t") + F.col("docs_longer") * F.col("context_limit")).alias("truncated_total"), (F.col("t") - F.col("docs_longer") * F.col("context_limit")).alias("tokens_cut"))


def op10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(written(histogram(token_counts(table(spark, sf_dir, "documents"))), "lengths"))
