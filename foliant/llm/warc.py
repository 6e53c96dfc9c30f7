"""WARC archives: written as segmented records, read back by segment reassembly.

A record's HTTP block, sent in chunked transfer framing, is cut into segments of bounded size: the first is a response (or revisit)
record, the rest continuation records with the first one's id as origin and a running segment number. Archives are written with
Spark's text writer, so they lie on any file system that Spark reaches and a failed task is simply run again; each file holds a
bounded number of records. Reading groups continuations by origin, orders them by segment number, verifies the total length
and the digests, and decodes the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, removed, row_slices, shared_path, table, written, written_at

CRLF = "\r\n"
#: Characters of a segment's block, bytes of an HTTP chunk, and records to a file.
SEGMENT, CHUNK, RECORDS_A_FILE = 65536, 16384, 1024
#: Bytes of an archive that are unpacked at once.
UNPACKED = 1 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def payload_of(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit(b""))


def base32_of(hexed: Column) -> Column:
    """Base32 of a 40-digit SHA-1 in hex: each five digits are four letters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    five = lambda g: F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
    return F.concat(*[F.substr(alphabet, F.shiftright(five(i // 4), 15 - 5 * (i % 4)).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for i in range(32)])


def with_digest(pages: DataFrame) -> DataFrame:
    """Adds payload_bytes and payload_digest to pages(.., html); null html is an empty payload. Built-in functions only."""
    hashed = pages.withColumns({"payload_bytes": F.octet_length(payload_of(F.col("html"))).cast("long"), "_sha1": F.sha1(payload_of(F.col("html")))})
    return hashed.withColumn("payload_digest", base32_of(F.col("_sha1"))).drop("_sha1")


def chunked(payload: str) -> list[str]:
    """HTTP chunks of the payload; sizes count UTF-8 bytes, cuts fall between characters."""
    out = []
    for at in range(0, len(payload), CHUNK):
        part = payload[at : at + CHUNK]
        out.append(f"{len(part.encode('utf-8', 'surrogatepass')):x}{CRLF}{part}{CRLF}")
    return [*out, f"0{CRLF}{CRLF}"]


def decode_chunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken or cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def _url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record_id(key: str, digest: str, number: int = 1) -> str:
    return f"<urn:page:{key}:{digest}:{number}>"


def records_of(key: str, page_id: int | None, url: str | None, html: str | None, n: int, digest: str, refers_to: int | None) -> Iterator[str]:
    """The page's records, without the blank lines that end a record. A revisit has an HTTP header and no payload, and names the response's
    record, whose payload has the same digest."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"
    block = head if revisit else head + "".join(chunked(html or ""))
    pieces = [block[at : at + SEGMENT] for at in range(0, len(block), SEGMENT)]
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    for i, piece in enumerate(pieces):
        lines = ["WARC/1.1", f"WARC-Type: {('revisit' if revisit else 'response') if not i else 'continuation'}", f"WARC-Record-ID: {record_id(key, digest, i + 1)}", f"WARC-Target-URI: {_url(url)}", "WARC-Date: 2024-01-01T00:00:00Z"]
        if len(pieces) > 1:
            lines.append(f"WARC-Segment-Number: {i + 1}")
        if i:
            lines.append(f"WARC-Segment-Origin-ID: {record_id(key, digest)}")
        if i and i == len(pieces) - 1:
            lines.append(f"WARC-Segment-Total-Length: {sum(map(len, raw))}")
        if not i:
            lines += [f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Bytes: {n}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
            if revisit:
                lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(str(refers_to), digest)}"]
        lines += [f"WARC-Block-Digest: sha1:{sha1_base32(raw[i])}", f"Content-Length: {len(raw[i])}"]
        yield CRLF.join(lines) + CRLF + CRLF + piece


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes pages(page_id, url, html) as gzipped WARC files under path.

    Of pages with equal payloads of at least `least` bytes the one with the largest page_id is the response and the others are
    revisits of it; pages without an id are all responses, each under a name of its own. Rows that repeat an id with the same payload
    are alike and share a record id. Copies are found on (page_id, digest) alone; the html is shuffled once, by page_id, however many
    pages share it.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    light, passing = written_at(with_digest(pages).select("page_id", "payload_bytes", "payload_digest"), "digests")
    light = light.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    last = light.groupBy(F.col("payload_digest").alias("d")).agg(F.max("page_id").alias("refers_to"))
    again = light.join(last, (light.payload_digest == last.d) & (light.page_id < last.refers_to)).select(F.col("page_id").alias("p"), "d", "refers_to").distinct()
    dealt = with_digest(pages)
    joined = dealt.join(again, (dealt.page_id == again.p) & (dealt.payload_digest == again.d), "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unnamed = 0
        for whole in batches:
            for b in row_slices(whole, 1000):
                out: list[str] = []
                for page_id, url, html, n, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    key = str(page_id)
                    if page_id is None:
                        key, unnamed = f"none-{TaskContext.get().partitionId()}-{unnamed}", unnamed + 1
                    out += records_of(key, page_id, url, html, n, digest, refers_to)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    lines = joined.mapInArrow(lean(work), "value string")
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)
    removed(spark, passing)


def unpacked(data: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, UNPACKED or fewer at a time; raises ValueError where it is cut short."""
    reader = zlib.decompressobj(31)
    while data:
        yield reader.decompress(data, UNPACKED)
        data = reader.unconsumed_tail
        if reader.eof:
            data = reader.unused_data
            reader = zlib.decompressobj(31)
        elif not data:
            yield reader.flush()
            if not reader.eof:
                raise ValueError("archive cut short")


def split_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file that comes in parts, by Content-Length; raises ValueError on broken framing. Holds one
    record and one part."""
    data, at = bytearray(), 0

    def has(n: int) -> bool:
        """Whether n bytes from the place are there, once parts are read as far as needed."""
        nonlocal at
        if len(data) - at < n:
            del data[:at]
            at = 0
            while len(data) < n and (part := next(parts, None)) is not None:
                data.extend(part)
        return len(data) - at >= n

    while has(1):
        n = 1024
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not has(n) and data.find(b"\r\n\r\n", at) < 0:
                raise ValueError("record cut short")
            n *= 2
        lines = bytes(data[at:end]).decode("utf-8", "surrogatepass").split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError("no record")
        head = dict(re.split(": ?", line, maxsplit=1) for line in lines[1:])
        head_bytes, n = end + 4 - at, int(head["Content-Length"])
        if not has(head_bytes + n + 4) or data[at + head_bytes + n : at + head_bytes + n + 4] != b"\r\n\r\n":
            raise ValueError("record cut short")
        block = bytes(data[at + head_bytes : at + head_bytes + n])
        at += head_bytes + n + 4
        yield head, block


_SEGMENT = "origin string, number int, total long, page_id long, url string, record_type string, refers_to long, refers string, declared_bytes long, declared_digest string, block binary"
_RECORD = "origin string, page_id long, url string, record_type string, refers_to long, refers string, payload_bytes long, payload_digest string, payload binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _records(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """The records under path, their payload null unless asked for. The archives are read twice: records in one segment are decoded where
    they lie; only those in several are shuffled, by origin id, each segment one row, and put in order by segment number."""
    schema, out_schema = _arrow(_SEGMENT), _arrow(_RECORD)

    def records(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[list[dict]]:
        """The records that stand alone, or the segments of the others, a few megabytes at a time."""
        for b in batches:
            for content in b.column("content"):
                rows: list[dict] = []
                size = 0
                for head, block in split_records(unpacked(content.as_py())):
                    if ("WARC-Segment-Number" in head) != several:
                        continue
                    if head["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
                        raise ValueError("block digest of " + head["WARC-Record-ID"])
                    refers, page, total = head.get("WARC-Refers-To"), head.get("X-Page-ID"), head.get("WARC-Segment-Total-Length")
                    values = (head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]), int(head.get("WARC-Segment-Number", 0)), int(total) if total else None, int(page) if page else None, head["WARC-Target-URI"], head["WARC-Type"], int(refers.split(":")[2]) if refers else None, refers, int(head.get("X-Payload-Bytes", -1)), head.get("WARC-Payload-Digest", "sha1:")[5:], block)
                    rows.append(dict(zip(schema.names, values)))
                    size += len(block)
                    if size > 1 << 22:
                        yield rows
                        rows, size = [], 0
                yield rows

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in records(batches, True):
            yield pa.RecordBatch.from_pylist(rows, schema)

    def decoded(first: dict, block: bytes) -> dict:
        head, _, body = block.partition(b"\r\n\r\n")
        row = {k: first[k] for k in ("origin", "page_id", "url", "record_type", "refers_to", "refers")}
        if first["record_type"] == "revisit":
            return row | {"payload": None, "payload_bytes": first["declared_bytes"], "payload_digest": first["declared_digest"]}
        content = decode_chunked(body)
        digest = sha1_base32(content)
        if digest != first["declared_digest"] or len(content) != first["declared_bytes"]:
            raise ValueError(f"payload of {first['origin']}")
        return row | {"payload": content if payload else None, "payload_bytes": len(content), "payload_digest": digest}

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in records(batches, False):
            yield pa.RecordBatch.from_pylist([decoded(r, r["block"]) for r in rows], out_schema)

    def whole(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["number"])
        copies = sum(r["number"] == 1 for r in rows)
        rows = rows[::copies] if copies else rows  # rows that repeat a page are alike, segment by segment
        block = b"".join(r["block"] for r in rows)
        if [r["number"] for r in rows] != list(range(1, len(rows) + 1)) or len(block) != rows[-1]["total"]:
            raise ValueError(f"segments of {key[0].as_py()}")
        return pa.Table.from_pylist([decoded(rows[0], block)] * copies, out_schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content", F.col("_metadata.file_name").alias("file"))
    part = F.regexp_extract("file", r"^part-(\d+)-", 1)
    alone = files.select("content").mapInArrow(lean(single), _RECORD)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for rows in segments(iter([b.slice(i, 1).select(["content"])])):
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([b.column(1)[i].as_py()] * rows.num_rows, pa.string())], names=[*schema.names, "part"])

    # A page's segments were written by one task: copies that other tasks wrote are put together apart.
    cut = files.select("content", part.alias("part")).mapInArrow(lean(parted), _SEGMENT + ", part string")
    return alone.unionByName(cut.groupBy("origin", "part").applyInArrow(lambda key, t: whole(key, t.drop_columns(["part"])), _RECORD))


def _index(spark: SparkSession, path: str) -> DataFrame:
    """The records under path without payloads, written, once every revisit is held against the response that it refers to: those of one
    response that declare alike are one row, so a page with very many copies makes no large group."""
    light = written(_records(spark, path, False).drop("payload"), "records")
    there = light.where("record_type = 'response'").select(F.col("origin").alias("refers"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")).distinct()
    told = light.where("record_type = 'revisit'").select("refers", "payload_bytes", "payload_digest").distinct()
    wrong = told.join(there, "refers", "left").where(~(F.col("n").eqNullSafe(F.col("payload_bytes")) & F.col("d").eqNullSafe(F.col("payload_digest")))).first()
    if wrong:
        raise ValueError(f"revisit of {wrong['refers']}")
    return light


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload binary, payload_bytes, payload_digest) of the archives under path.

    A block digest, total length, framing or payload digest that does not hold raises an error. For a revisit the payload is null;
    length and digest are those of the response that it names by record id. A revisit of a record that isn't there, or that declares
    another length or digest, raises an error.
    """
    _index(spark, path)
    return _records(spark, path, True).select("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    out = _index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    removed(spark, path)
    return out


ORACLE_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest
  FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM m
"""
