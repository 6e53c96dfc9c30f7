"""Operators over document parts: binaries, pictures, streams, styles and references between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.attributes import entry_number, extension

#: The paths that a rebuilt package keeps.
PACKAGE_PATHS = r"^(?:mimetype$|version\.xml$|settings\.xml$|META-INF/|Contents/|BinData/|Preview/|Scripts/|DocOptions/)"


def is_section(path: Column) -> Column:
    return path.rlike(r"^Contents/section[0-9]+\.xml$")


def section_number(path: Column) -> Column:
    digits = F.regexp_extract(path, "([0-9]+)", 1)
    return F.when(digits != "", digits.cast("int"))


def binary_id(path: Column) -> Column:
    """The leaf of `/BinData/<leaf>` or `BinData/<leaf>`, null for nested or other paths."""
    leaf = F.regexp_extract(path, "^/?BinData/([^/]+)$", 1)
    return F.when(leaf != "", leaf)


def first_difference(left: Column, right: Column) -> Column:
    """The offset of the first byte in which two contents differ; where one begins with the other, the shorter one's length; null where they
    are equal or one is null."""

    @F.pandas_udf("long")
    def offset(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes | None, y: bytes | None) -> int | None:
            if x is None or y is None or x == y:
                return None
            n = min(len(x), len(y))
            other = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
            return int(other[0]) if len(other) else n

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int64")

    return offset(left, right)


def pictures_with_binary(pictures: DataFrame, binaries: DataFrame) -> DataFrame:
    """pictures(doc_id, seq, bin_id) with the first binary of that number, and its number within the document's pictures."""
    found = binaries.withColumn("_n", entry_number(F.col("id"))).groupBy(F.col("doc_id").alias("_d"), "_n").agg(F.min_by("id", "ord").alias("binary"))
    joined = pictures.join(found, (pictures.doc_id == found["_d"]) & (pictures.bin_id == found["_n"]), "left").drop("_d", "_n")
    numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return joined.withColumn("number", numbered).select("doc_id", "seq", "number", "bin_id", "binary", F.coalesce(extension(F.col("binary")), F.lit("bin")).alias("extension"))


def binaries_in_picture_order(pictures: DataFrame, binaries: DataFrame) -> DataFrame:
    """(doc_id, id, place): by first reference; those never referenced last, in their own order."""
    first = pictures.groupBy(F.col("doc_id").alias("_d"), "bin_id").agg(F.min("seq").alias("first"))
    own = binaries.withColumn("_n", entry_number(F.col("id")))
    joined = own.join(first, (own.doc_id == first["_d"]) & (own["_n"] == first.bin_id), "left")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("first").asc_nulls_last(), "ord"))
    return joined.withColumn("place", place).select("doc_id", "id", "place")


def clamped(references: DataFrame, bounds: DataFrame) -> DataFrame:
    """references(doc_id, kind, ref) against bounds(doc_id, kind, n): out of range becomes 0, for border fills 1 if there are two at
    least; a kind without entries, or without a bound, is left alone."""
    b = bounds.select(F.col("doc_id").alias("_d"), F.col("kind").alias("_k"), "n")
    j = references.join(b, (references.doc_id == b["_d"]) & (references.kind == b["_k"]), "left")
    instead = F.when((F.col("kind") == "border_fill") & (F.col("n") >= 2), 1).otherwise(0)
    return j.select("doc_id", "kind", "ref", F.when(F.coalesce("n", F.lit(0)) == 0, F.col("ref")).when(F.col("ref") >= F.col("n"), instead).otherwise(F.col("ref")).alias("clamped"))


def stream_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, state, left_bytes, right_bytes) of parts(name, bytes): equal, differing, missing on the right, or extra there."""
    l, r = left.select(F.col("name").alias("ln"), F.col("bytes").alias("lb")), right.select(F.col("name").alias("rn"), F.col("bytes").alias("rb"))  # noqa: E741
    state = F.when(F.col("rn").isNull(), "missing").when(F.col("ln").isNull(), "extra").when(F.col("lb").eqNullSafe(F.col("rb")), "equal").otherwise("differing")
    return l.join(r, l.ln == r.rn, "full").select(F.coalesce("ln", "rn").alias("name"), state.alias("state"), F.octet_length("lb").alias("left_bytes"), F.octet_length("rb").alias("right_bytes"))


#: Parts of the skeleton of one package, at most.
MOST_DEFAULTS = 256


def with_missing_parts(parts: DataFrame, defaults: DataFrame) -> DataFrame:
    """parts(doc_id, name, body) and, for each document, the default parts(name, body) that it lacks. The defaults are a fixed handful
    of rows carried in the plan as one array; more than MOST_DEFAULTS of them are an error."""
    rows = [(r["name"], r["body"]) for r in defaults.limit(MOST_DEFAULTS + 1).collect()]
    if len(rows) > MOST_DEFAULTS:
        raise ValueError(f"more than {MOST_DEFAULTS} default parts")
    docs = parts.select("doc_id").distinct()
    offered = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("body")) for n, b in rows])).alias("p")).select("doc_id", "p.*")
    return parts.select("doc_id", "name", "body").unionByName(offered.join(parts.select("doc_id", "name"), ["doc_id", "name"], "left_anti"))


def kept_parts(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("name").rlike(PACKAGE_PATHS))


def hoisted_styles(uses: DataFrame) -> DataFrame:
    """(style, uses, class): styles used twice or more, named s0, s1 .. by falling use and then by text. Where uses has a doc_id, each
    document has its own names, numbered in its own group, and the result has the doc_id too."""
    by = [c for c in ("doc_id",) if c in uses.columns]
    counts = uses.groupBy(*by, "style").agg(F.count("*").alias("uses")).where("uses >= 2")
    order = Window.partitionBy(*by).orderBy(F.desc("uses"), "style")
    return counts.withColumn("class", F.concat(F.lit("s"), (F.row_number().over(order) - 1).cast("string")))


def font_slots(counts: DataFrame, faces: DataFrame) -> DataFrame:
    """(doc_id, slot, idx, name): faces in order, dealt to script slots by the counts of each: a range join on running totals."""
    w = Window.partitionBy("doc_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = counts.withColumn("stop", F.sum("n").over(w)).select(F.col("doc_id").alias("_d"), "slot", (F.col("stop") - F.col("n")).alias("start"), "stop")
    j = faces.join(ranges, (faces.doc_id == ranges["_d"]) & (faces.ord >= ranges.start) & (faces.ord < ranges.stop))
    return j.select("doc_id", "slot", (F.col("ord") - F.col("start")).cast("int").alias("idx"), "name")
