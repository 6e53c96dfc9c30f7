"""The binary record stream of version-5 documents: tagged records, their layouts, and paragraph text. One table of layouts serves
both directions, and what a layout doesn't know is kept as an opaque tail."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.spark import batched, lean

RECORD = "doc_id long, stream string, seq int, tag int, level int, data binary"
#: Record tags.
TAGS = {
    "DOCUMENT_PROPERTIES": 0x10, "ID_MAPPINGS": 0x11, "BIN_DATA": 0x12, "FACE_NAME": 0x13, "BORDER_FILL": 0x14, "CHAR_SHAPE": 0x15, "PARA_SHAPE": 0x19, "STYLE": 0x1A,
    "PARA_HEADER": 0x42, "PARA_TEXT": 0x43, "PARA_CHAR_SHAPE": 0x44, "PARA_LINE_SEG": 0x45, "CTRL_HEADER": 0x47, "LIST_HEADER": 0x48, "PAGE_DEF": 0x49, "SHAPE_COMPONENT": 0x4C, "TABLE": 0x4D, "PICTURE": 0x55,
}
#: Fields of the records by tag, little-endian struct codes; T is a counted UTF-16 text, n*code a list as long
#: as the field n says. Fields after a None may be absent.
LAYOUTS: dict[str, list[tuple[str, str] | None]] = {
    "CHAR_SHAPE": [("font_ids", "7H"), ("ratios", "7B"), ("char_spacings", "7b"), ("rel_sizes", "7B"), ("char_offsets", "7b"), ("base_size", "i"), ("attr", "I"), ("shadow_offset_x", "b"), ("shadow_offset_y", "b"), ("color", "I"), ("underline_color", "I"), ("shade_color", "I"), ("shadow_color", "I"), None, ("border_fill_id", "H"), ("strike_color", "I")],
    "PARA_SHAPE": [("attribute", "I"), ("left_margin", "i"), ("right_margin", "i"), ("indent", "i"), ("top_space", "i"), ("bottom_space", "i"), ("line_space_legacy", "i"), ("tab_def_id", "H"), ("heading_id", "H"), ("border_fill_id", "H"), ("border_spaces", "4h"), None, ("attribute2", "I"), ("attribute3", "I"), ("line_spacing", "I")],
    "BORDER_FILL": [("attribute", "H"), ("borders", "24B"), ("diagonal", "6B"), ("fill_kind", "I")],
    "STYLE": [("name", "T"), ("english_name", "T"), ("properties", "B"), ("next_style_id", "B"), ("lang_id", "h"), ("para_shape_id", "H"), ("char_shape_id", "H")],
    "FACE_NAME": [("properties", "B"), ("name", "T")],
    "ID_MAPPINGS": [("counts", "15I"), None, ("count_15", "I"), ("count_16", "I"), ("count_17", "I")],
    "PARA_HEADER": [("char_count", "I"), ("control_mask", "I"), ("para_shape_id", "H"), ("style_id", "B"), ("divide_sort", "B"), ("char_shape_count", "H"), ("range_tag_count", "H"), ("line_align_count", "H"), ("instance_id", "I"), None, ("tracked", "H")],
    "LIST_HEADER": [("para_count", "i"), ("property", "I"), ("col", "H"), ("row", "H"), ("col_span", "H"), ("row_span", "H"), ("width", "I"), ("height", "I"), ("padding", "4H"), ("border_fill_id", "H"), ("text_width", "I")],
    "PAGE_DEF": [("width", "I"), ("height", "I"), ("margins", "7I"), ("attribute", "I")],
    "DOCUMENT_PROPERTIES": [("sections", "H"), ("first_page", "H"), ("first_footnote", "H"), ("first_endnote", "H"), ("first_picture", "H"), ("first_table", "H"), ("first_equation", "H"), ("characters", "I"), ("pages", "I"), None, ("caret", "3I")],
    "TABLE": [("attribute", "I"), ("rows", "H"), ("cols", "H"), ("spacing", "h"), ("padding", "4h"), ("counts", "rows*H"), ("border_fill_id", "H"), None, ("zone_count", "H"), ("zones", "zone_count*5H")],
}
#: BIN_DATA by the low four bits of its property: a link, or a stream of the file, embedded or stored.
_STREAM_FIELDS = [("property", "H"), ("bin_id", "H"), ("extension", "T")]
BIN_DATA = {0: [("property", "H"), ("absolute_path", "T"), ("relative_path", "T")], 1: _STREAM_FIELDS, 2: _STREAM_FIELDS}
#: Size field value that announces a longer size; units of an inline control; the unit that marks a drawn one.
_LONG, _UNITS, _OBJECT = 0xFFF, 8, 11
_READ = {0x18: "\u00ad", 0x1E: "\u00a0", 0x1F: "\u2003"}
_WRITE = {v: chr(k) for k, v in _READ.items()}


def inflate(data: bytes) -> bytes:
    return zlib.decompressobj(-15).decompress(data)


def inflated_or_none(data: bytes) -> bytes | None:
    try:
        return inflate(data)
    except zlib.error:
        return None


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


def split(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, data) of each record; raises ValueError if the stream is cut short."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("record header cut short")
        (head,) = struct.unpack_from("<I", data, at)
        at, size = at + 4, head >> 20
        if size == _LONG:
            if at + 4 > len(data):
                raise ValueError("record size cut short")
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        if at + size > len(data):
            raise ValueError("record cut short")
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


def join(records: list[tuple[int, int, bytes]]) -> bytes:
    out = []
    for tag, level, data in records:
        size = min(len(data), _LONG)
        out.append(struct.pack("<I", tag | level << 10 | size << 20) + (struct.pack("<I", len(data)) if size == _LONG else b"") + data)
    return b"".join(out)


def columns_of(name: str) -> list[tuple[str, str]]:
    """All fields that a record of this kind may have."""
    if name == "BIN_DATA":
        return list(dict(f for fields in BIN_DATA.values() for f in fields).items())
    return [f for f in LAYOUTS[name] if f]


def _fields(name: str, kind: int | None) -> list[tuple[str, str] | None]:
    if name != "BIN_DATA":
        return LAYOUTS[name]
    if kind is None or kind & 15 not in BIN_DATA:
        raise ValueError(f"BIN_DATA of kind {kind}")
    return BIN_DATA[kind & 15]


def decode(name: str, data: bytes) -> dict:
    """Field values by name, optional ones only if present, and `tail`; raises ValueError if a required field is missing."""
    out: dict = {}
    at, optional = 0, False
    for field in _fields(name, struct.unpack_from("<H", data)[0] if len(data) > 1 else None):
        if field is None:
            optional = True
            continue
        key, code = field
        if "*" in code:
            count, code = code.split("*")
            code = f"{out[count] * int(code[:-1] or 1)}{code[-1]}"
        if code == "T":
            n = 2 + 2 * struct.unpack_from("<H", data, at)[0] if at + 2 <= len(data) else len(data) + 1
        else:
            n = struct.calcsize("<" + code)
        if at + n > len(data):
            if optional:
                break
            raise ValueError(f"{name} too short for {key}")
        if code == "T":
            out[key] = data[at + 2 : at + n].decode("utf-16-le", "surrogatepass")
        else:
            got = struct.unpack_from("<" + code, data, at)
            out[key] = list(got) if code[0].isdigit() else got[0]
        at += n
    return out | {"tail": data[at:]}


def encode(name: str, values: dict) -> bytes:
    out = []
    for field in _fields(name, values.get("property")):
        if field is None:
            continue
        key, code = field
        if key not in values:
            break
        v = values[key]
        if "*" in code:
            code = f"{len(v)}{code[-1]}"
        if code == "T":
            raw = v.encode("utf-16-le", "surrogatepass")
            out.append(struct.pack("<H", len(raw) // 2) + raw)
        else:
            out.append(struct.pack("<" + code, *(v if isinstance(v, list) else [v])))
    return b"".join(out) + values.get("tail", b"")


def paragraph_text(data: bytes) -> str:
    """UTF-16 text: paragraph ends go, special spaces and hyphens get their characters, and every inline control of eight units is one
    object mark; one that is cut short ends the text."""
    if len(data) % 2:
        raise ValueError("odd text length")
    units = struct.unpack(f"<{len(data) // 2}H", data)
    out: list[bytes] = []
    at = 0
    while at < len(units):
        u = units[at]
        if u >= 0x20 or u in (9, 10):
            out.append(struct.pack("<H", u))
        elif u in _READ:
            out.append(_READ[u].encode("utf-16-le"))
        elif u != 13:
            if at + _UNITS > len(units):
                break
            out.append("\ufffc".encode("utf-16-le"))
            at += _UNITS - 1
        at += 1
    return b"".join(out).decode("utf-16-le")


def text_record(text: str, controls: list[bytes] | None = None) -> bytes | None:
    """Inverse of paragraph_text; null where the text holds a bare control, or more object marks than the codes of controls that are given."""
    if re.search("[\x00-\x08\x0b-\x1f]", text):
        return None
    first, *rest = ("".join(_WRITE.get(c, c) for c in part).encode("utf-16-le", "surrogatepass") for part in text.split("\ufffc"))
    if len(rest) > len(controls or []):
        return None
    mark = struct.pack("<H", _OBJECT)
    return first + b"".join(mark + code + bytes(8) + mark + part for code, part in zip(controls or [], rest))


def record_batches(streams: Iterator[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    """RECORD rows of (document, name, inflated bytes), a few thousand at a time."""
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return batched(((doc, name, i, *r) for doc, name, data in streams for i, r in enumerate(split(data))), ["doc_id", "stream", "seq", "tag", "level", "data"], kinds)


def records(streams: DataFrame, compressed: bool = True) -> DataFrame:
    """(doc_id, stream, seq, tag, level, data) of streams(doc_id, stream, bytes). A stream that is cut short raises an error."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes]]:
        for b in batches:
            for doc, name, data in zip(*b.columns):
                body = data.as_py() or b""
                yield doc.as_py(), name.as_py(), inflate(body) if compressed and body else body

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches(own(batches))

    return streams.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "stream", "bytes").mapInArrow(lean(work), RECORD)


def streams(records: DataFrame) -> DataFrame:
    """(doc_id, stream, bytes) of records(doc_id, stream, seq, tag, level, data): the way back, not deflated, one task to a stream. Records pass in their
    order and only the bytes of the stream at hand are kept."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for own, rows in groupby(each, lambda r: r[:2]):
            body = bytearray()
            for _, _, tag, level, data in rows:
                body += join([(tag, level, data or b"")])
            yield *own, bytes(body)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows_of(batches), ["doc_id", "stream", "bytes"], (pa.int64(), pa.string(), pa.binary()), 1)

    own = records.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "stream", "seq", "tag", "level", "data").repartition("doc_id", "stream").sortWithinPartitions("doc_id", "stream", "seq")
    return own.select("doc_id", "stream", "tag", "level", "data").mapInArrow(lean(work), "doc_id long, stream string, bytes binary")
