"""Version-5 binary documents: compound files of deflated record streams, to rows and back."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.attributes import looks_like_image
from foliant.operators.parts import binary_id
from foliant.spark import batched, lean

from . import body, compound
from . import records as R
from .packages import NODE

#: The signature of the file header, its size, and its flag bits.
SIGNATURE = b"HWP Document File"
HEADER_SIZE, COMPRESSED, ENCRYPTED, DISTRIBUTED = 256, 1, 2, 4
_SECTION = re.compile(r"^/BodyText/Section([0-9]+)$")


def file_header(flags: int = COMPRESSED, version: int = 0x05000300) -> bytes:
    return (SIGNATURE.ljust(32, b"\0") + struct.pack("<II", version, flags)).ljust(HEADER_SIZE, b"\0")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, dict[str, bytes]]]:
    """(document, version, flags, streams as they are stored) of each file of the batches, one after the other."""
    for b in batches:
        for doc, content in zip(b.column(0), b.column(1)):
            held = compound.read(content.as_py())
            head = held.get("/FileHeader", b"")
            if len(head) < 40 or not head.startswith(SIGNATURE):
                raise ValueError("no document header")
            version, flags = struct.unpack_from("<II", head, 32)
            if flags & ENCRYPTED:
                raise ValueError("the document is encrypted")
            yield doc.as_py(), version, flags, held


def inflated(name: str, data: bytes, flags: int) -> bytes:
    return R.inflate(data) if flags & COMPRESSED and data and (name == "/DocInfo" or _SECTION.match(name)) else data


def streams(files: DataFrame) -> DataFrame:
    """(doc_id, stream, bytes, version, flags) of files(doc_id, content): one row for each stream, DocInfo and sections inflated where the
    header says so. Encrypted files raise an error, as does what isn't a document of this kind."""
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int32())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, version, flags, held in opened(batches):
            plain = [inflated(n, x, flags) for n, x in held.items()]
            columns = ([doc] * len(held), list(held), plain, [version] * len(held), [flags] * len(held))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "stream", "bytes", "version", "flags"])

    return files.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "content").mapInArrow(lean(work), "doc_id long, stream string, bytes binary, version long, flags int")


def record_rows(streams: DataFrame) -> DataFrame:
    """(doc_id, stream, seq, tag, level, data) of DocInfo and the sections, of inflated streams."""
    own = streams.where((F.col("stream") == "/DocInfo") | F.col("stream").rlike(_SECTION.pattern))
    return R.records(own, compressed=False)


def record_rows_of_files(files: DataFrame) -> DataFrame:
    """record_rows of the streams of files(doc_id, content), read by one worker a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ((doc, n, inflated(n, x, flags)) for doc, _, flags, held in opened(batches) for n, x in held.items() if n == "/DocInfo" or _SECTION.match(n))
        yield from R.record_batches(own)

    return files.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "content").mapInArrow(lean(work), R.RECORD)


def typed(records: DataFrame, name: str) -> DataFrame:
    """The records of one kind with a slot number in record order and their fields as columns: integers, lists of integers and texts."""
    fields = R.columns_of(name)
    schema = T.StructType([T.StructField(k, T.StringType() if c == "T" else T.ArrayType(T.LongType()) if c[0].isdigit() or "*" in c else T.LongType()) for k, c in fields])

    @F.pandas_udf(schema)
    def fields_of(data: pd.Series) -> pd.DataFrame:
        rows = [R.decode(name, x) for x in data]
        return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k, _ in fields})

    slot = F.row_number().over(Window.partitionBy("doc_id", "stream").orderBy("seq")) - 1
    own = records.where(F.col("tag") == R.TAGS[name]).withColumn("slot", slot)
    return own.select("doc_id", "stream", "slot", "seq", fields_of("data").alias("f")).select("doc_id", "stream", "slot", "seq", "f.*")


def encoded(name: str, values: Column) -> Column:
    """The record data of one kind from a struct of its fields; the way back of typed. Null fields end a record's optional ones."""

    @F.pandas_udf(T.BinaryType())
    def data_of(rows: pd.DataFrame) -> pd.Series:
        plain = lambda v: [int(x) for x in v] if hasattr(v, "__len__") and not isinstance(v, str) else v if isinstance(v, str) else int(v)
        held = ({k: plain(v) for k, v in zip(rows.columns, r) if hasattr(v, "__len__") or pd.notna(v)} for r in rows.itertuples(index=False, name=None))
        return pd.Series([R.encode(name, v) for v in held], dtype=object)

    return data_of(values)


def font_count(counts: Column) -> Column:
    """The number of font faces in all seven slots, of the counts of an ID_MAPPINGS record."""
    return F.aggregate(F.slice(counts, 2, 7), F.lit(0).cast("long"), lambda a, n: a + n)


def paragraphs(records: DataFrame) -> DataFrame:
    """(doc_id, section, seq, level, text) of the section records: a paragraph begins at each PARA_HEADER record and has the text of the
    first PARA_TEXT after it; without one it is empty. A paragraph's own records are found by a running count, not by a join."""

    @F.pandas_udf(T.StringType())
    def text_of(data: pd.Series) -> pd.Series:
        return data.map(lambda x: R.paragraph_text(x), na_action="ignore")

    head, text = F.col("tag") == R.TAGS["PARA_HEADER"], F.col("tag") == R.TAGS["PARA_TEXT"]
    w = Window.partitionBy("doc_id", "stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = records.where(F.col("stream").rlike(_SECTION.pattern)).withColumn("n", F.count_if(head).over(w)).where(F.col("n") > 0)
    held = own.groupBy("doc_id", "stream", "n").agg(F.min("seq").alias("seq"), F.min_by("level", "seq").alias("level"), F.min_by("data", F.when(text, F.col("seq"))).alias("data"), F.count_if(text).alias("texts"))
    data = F.when(F.col("texts") > 0, F.col("data"))
    return held.select("doc_id", F.regexp_extract("stream", _SECTION.pattern, 1).cast("int").alias("section"), "seq", "level", F.coalesce(text_of(data), F.lit("")).alias("text"))


def _node_batches(sections: Iterator[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
    for doc, name, data in sections:
        section = int(_SECTION.match(name)[1])
        rows = [(doc, section, i, path, kind, list(attrs.items()), text) for i, (path, kind, attrs, text) in enumerate(body.nodes_of(R.split(data)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["doc_id", "section", "ord", "path", "kind", "attrs", "text"])


def nodes(streams: DataFrame) -> DataFrame:
    """The sections of inflated streams as rows of packages.NODE: paragraphs, tables, cells, pictures and other controls."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _node_batches((doc.as_py(), name.as_py(), data.as_py() or b"") for b in batches for doc, name, data in zip(*b.columns))

    own = streams.where(F.col("stream").rlike(_SECTION.pattern))
    return own.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "stream", "bytes").mapInArrow(lean(work), NODE)


def nodes_of_files(files: DataFrame) -> DataFrame:
    """nodes of the streams of files(doc_id, content), read by one worker a task; only sections are inflated."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _node_batches((doc, n, inflated(n, x, flags)) for doc, _, flags, held in opened(batches) for n, x in held.items() if _SECTION.match(n))

    return files.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "content").mapInArrow(lean(work), NODE)


def section_records(nodes: DataFrame) -> DataFrame:
    """(doc_id, stream, seq, tag, level, data) of NODE rows: the inverse of nodes, one task to a section."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        rows = body.records_of([(r["path"], r["kind"], dict(r["attrs"] or []), r["text"] or "") for r in t.sort_by("ord").to_pylist()])
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        held = dict(zip(("seq", "tag", "level", "data"), (pa.array(c, k) for c, k in zip(zip(*((i, *r) for i, r in enumerate(rows))) if rows else [()] * 4, kinds))))
        same = {"doc_id": pa.array([key[0].as_py()] * len(rows), pa.int64()), "stream": pa.array([f"/BodyText/Section{key[1].as_py()}"] * len(rows), pa.string())}
        return pa.table(same | held)

    own = nodes.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(section AS INT) AS section", "ord", "path", "kind", "attrs", "text")
    return own.groupBy("doc_id", "section").applyInArrow(work, "doc_id long, stream string, seq int, tag int, level int, data binary")


def is_written_anew(path: Column) -> Column:
    """Whether a stream comes from rows when a document is written: the header, DocInfo, sections and binaries. Others are kept as they are."""
    return path.isin("/FileHeader", "/DocInfo") | path.rlike(_SECTION.pattern) | path.startswith("/BinData/")


def files(streams: DataFrame, compressed: bool = True) -> DataFrame:
    """(doc_id, content) of inflated streams(doc_id, stream, bytes), one task to a document. DocInfo and the sections are deflated; the file
    header is written anew; DocInfo is empty where it lacks. Of two streams of one name the first by content is taken."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        each = ((d.as_py(), n.as_py(), x) for b in batches for d, n, x in zip(*b.columns))
        for doc, own in groupby(each, lambda r: r[0]):
            out: dict[str, bytes] = {}
            for _, name, data in own:
                # Streams come by name and content, so the first of a name counts; each is deflated as it comes.
                if name not in out:
                    plain = data.as_py() or b""
                    out[name] = R.deflate(plain) if compressed and (name == "/DocInfo" or _SECTION.match(name)) else plain
            out.setdefault("/DocInfo", R.deflate(b"") if compressed else b"")
            out["/FileHeader"] = file_header(COMPRESSED if compressed else 0)
            yield doc, compound.write(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows_of(batches), ["doc_id", "content"], (pa.int64(), pa.binary()), 1)

    own = streams.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "stream", "bytes").repartition("doc_id").sortWithinPartitions("doc_id", "stream", F.coalesce("bytes", F.lit("").cast("binary")))
    return own.mapInArrow(lean(work), "doc_id long, content binary")


def binaries(streams: DataFrame) -> DataFrame:
    """(doc_id, id, bytes) of the streams of binaries. In a compressed document the bytes are inflated if that gives an image; else they
    stay as they are."""

    @F.pandas_udf(T.BinaryType())
    def image_of(data: pd.Series) -> pd.Series:
        return data.map(R.inflated_or_none, na_action="ignore")

    own = streams.select("doc_id", binary_id(F.col("stream")).alias("id"), "bytes", "flags").where("id IS NOT NULL")
    plain = F.when(F.col("flags").bitwiseAND(COMPRESSED) != 0, image_of("bytes"))
    held = own.withColumn("_p", plain)
    return held.select("doc_id", "id", F.when(looks_like_image(F.col("_p")), F.col("_p")).otherwise(F.col("bytes")).alias("bytes"))


def documents(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, content) of paragraphs(doc_id, section, seq, text): compound files with a header, an empty DocInfo and deflated sections.
    A text that can't be written, since it holds an object mark or a bare control, raises an error."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        parts: dict[str, list[tuple[int, int, bytes]]] = {}
        for r in sorted(t.to_pylist(), key=lambda r: (r["section"], r["seq"])):
            raw = R.text_record(r["text"] or "")
            if raw is None:
                raise ValueError(f"text of paragraph {r['seq']} of document {r['doc_id']}")
            head = R.encode("PARA_HEADER", {k: 0 for f in R.LAYOUTS["PARA_HEADER"][:9] if f for k in [f[0]]} | {"char_count": len(raw) // 2})
            parts.setdefault(f"/BodyText/Section{r['section']}", []).extend([(R.TAGS["PARA_HEADER"], 0, head), *([(R.TAGS["PARA_TEXT"], 1, raw)] if raw else [])])
        held = {"/FileHeader": file_header(), "/DocInfo": R.deflate(b"")} | {n: R.deflate(R.join(x)) for n, x in parts.items()}
        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([compound.write(held)], pa.binary())})

    return paragraphs.groupBy("doc_id").applyInArrow(work, "doc_id long, content binary")
