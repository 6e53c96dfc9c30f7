"""The header part of packages: fonts, border fills, character and paragraph shapes and styles as rows, and the way back.

A header holds all entries of its document, so it is never a row: it is written from entries that pass in order, and cut where it is read into pieces
of neighbouring entries, each of which from_xml parses. A header that isn't well-formed has no rows. Of several entries with one id the last
counts; entries without an id have the number 0.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.attributes import CHAR_BITS, bits, colour_hex, tone
from foliant.functions.text import escape_xml, style_heading_level, text_heading_level
from foliant.spark import batched, lean

PART = "Contents/header.xml"
#: Script slots, namespaces, alignments by number, line styles by number, and spacing kinds by number.
SLOTS = ("hangul", "latin", "hanja", "japanese", "other", "symbol", "user")
NAMESPACES = {"hh": "http://www.hancom.co.kr/hwpml/2011/head", "hc": "http://www.hancom.co.kr/hwpml/2011/core"}
ALIGNMENTS = ("JUSTIFY", "LEFT", "RIGHT", "CENTER", "DISTRIBUTE", "DISTRIBUTE_SPACE")
LINES = ("NONE", "SOLID", "DASH", "DOT", "DASH_DOT", "DASH_DOT_DOT", "LONG_DASH", "DOUBLE")
SPACINGS = {1: "FIXED", 2: "BETWEEN_LINE"}
#: Fixed value: a line's height in percent where none is stored.
DEFAULT_SPACING = 160
#: Fixed value: the height of characters where none is given, in hundredths of a point.
DEFAULT_HEIGHT = 1000

_SEVEN = "STRUCT<" + ", ".join(f"_{s}: STRING" for s in SLOTS) + ">"
_LINE = "STRUCT<_shape: STRING, _color: STRING>"
_FACE = "STRUCT<_faceColor: STRING>"
#: The entries of each table of a header.
_ENTRIES = {
    "fontfaces": ("fontface", "_lang: STRING, font: ARRAY<STRUCT<_face: STRING>>"),
    "borderFills": ("borderFill", f"_id: STRING, fillBrush: STRUCT<winBrush: {_FACE}, fillColor: {_FACE}>"),
    "charProperties": ("charPr", f"""_id: STRING, _height: STRING, _textColor: STRING, _shadeColor: STRING, _borderFillIDRef: STRING, bold: STRING, italic: STRING, underline: {_LINE},
  strikeout: {_LINE}, fontRef: {_SEVEN}, ratio: {_SEVEN}, relSz: {_SEVEN}, spacing: {_SEVEN}, offset: {_SEVEN}"""),
    "paraProperties": ("paraPr", "_id: STRING, align: STRUCT<_horizontal: STRING>"),
    "styles": ("style", "_id: STRING, _type: STRING, _name: STRING, _engName: STRING, _paraPrIDRef: STRING, _charPrIDRef: STRING, _nextStyleIDRef: STRING, _langID: STRING"),
}
_NAMES = {table: entry for table, (entry, _) in _ENTRIES.items()}
#: Entries and bytes of a piece of a header, and bytes that are inflated at a time.
PIECE, PIECE_BYTES, CHUNK = 256, 1 << 18, 1 << 16


def _scanned(stream: BinaryIO, started: Callable[[list[str], int], None], ended: Callable[[list[str], int], None]) -> Iterator[tuple[bytes, int]]:
    """Calls started and ended with the names of an element and those around it, as far as an entry's or a font's, and its offset; after each chunk, gives
    it and the offset before which nothing starts any more."""
    parser, names, depth, deepest = expat.ParserCreate("UTF-8"), [], 0, 4
    parser.ordered_attributes = True

    def start(name: str, _: list) -> None:
        nonlocal depth, deepest
        depth += 1
        if depth <= deepest:
            names.append(name.rpartition(":")[2])
            started(names, parser.CurrentByteIndex)
            if depth == 4:
                deepest = 5 if names[3] == "fontface" else 4

    def end(_: str) -> None:
        nonlocal depth
        if depth <= deepest:
            ended(names, parser.CurrentByteIndex)
            names.pop()
        depth -= 1

    parser.StartElementHandler, parser.EndElementHandler = start, end
    while chunk := stream.read(CHUNK):
        parser.Parse(chunk, False)
        yield chunk, max(parser.CurrentByteIndex, 0)
    parser.Parse(b"", True)
    yield b"", max(parser.CurrentByteIndex, 0)


def _table(names: list[str]) -> tuple[str, bool] | None:
    """The table that the innermost element is, and whether it stands in the list of references."""
    listed = len(names) == 3 and names[1] == "refList"
    return (names[-1], listed) if (listed or len(names) == 2) and names[-1] in _NAMES else None


def _chosen(stream: BinaryIO) -> dict[str, int]:
    """By its name, the number of the table that counts, of all tables in their order: the last one in the last list of references or, if that has no
    entries, the last outside. None if the header isn't well-formed."""
    number, last, filled = -1, {}, set()

    def started(names: list[str], _: int) -> None:
        nonlocal number
        if len(names) == 2 and names[1] == "refList":
            for key in [k for k in last if k[1]]:  # the last list counts
                del last[key]
        if key := _table(names):
            number += 1
            last[key] = number
        elif (key := _table(names[:-1])) and names[-1] == _NAMES[key[0]]:
            filled.add(number)

    try:
        for _ in _scanned(stream, started, lambda *_: None):
            filled.intersection_update(last.values())
    except expat.ExpatError:
        return {}
    return {t: next(n for n in own if n in filled) for t in _NAMES if filled.intersection(own := (last.get((t, True)), last.get((t, False))))}


def _pieces(opened: Callable[[], BinaryIO], tables: tuple[str, ...]) -> Iterator[tuple[str, int, int, str]]:
    """(table, at, seq, xml): runs of neighbouring entries of the tables that count, or of one font face's fonts, whose face is the at-th. The header is
    read twice, since it may turn out at its end that it isn't well-formed."""
    with opened() as stream:
        chosen = {n for t, n in _chosen(stream).items() if t in tables}
    if not chosen:
        return
    final = max(chosen)
    out: list[tuple[str, int, int, str]] = []
    held, base = bytearray(), 0
    # Of the table that is open: its name, the offsets where a face and a run start, the face's number and what stands before its fonts.
    number, inside, face, run, count, at, seq, before = -1, None, None, None, 0, -1, 0, b""
    cut = lambda start, stop: bytes(held[start - base : stop - base])

    def leave(stop: int) -> None:
        nonlocal run, count, seq
        if run is not None:
            after = b"</fontface>" if inside == "fontfaces" else b""
            out.append((inside, max(at, 0), seq, (before + cut(run, stop) + after).decode()))
            run, count, seq = None, 0, seq + 1

    def started(names: list[str], offset: int) -> None:
        nonlocal number, inside, face, run, count, at, before
        if key := _table(names):
            number += 1
            inside, at, before = (key[0] if number in chosen else None), -1, b""
        elif inside and (key := _table(names[:-1])) and names[-1] == _NAMES[key[0]] and inside == "fontfaces":
            at, face = at + 1, offset
        elif inside == "fontfaces":
            if names[-1] == "font" and names[-2] == "fontface" and _table(names[:-2]):
                entry(offset)
        elif inside and key and names[-1] == _NAMES[key[0]]:
            entry(offset)

    def entry(offset: int) -> None:
        nonlocal run, count, face, before
        if face is not None:
            # The face's own tag, under the name that closes it here.
            head = cut(face, offset)
            before, face = b"<fontface" + head[min(i for i in (head.find(c) for c in (b" ", b"\t", b"\r", b"\n", b">")) if i > 0) :], None
        if count >= PIECE or (run is not None and offset - run >= PIECE_BYTES):
            leave(offset)
        run, count = offset if run is None else run, count + 1

    def ended(names: list[str], offset: int) -> None:
        nonlocal inside, face
        if inside == "fontfaces" and names[-1] == "fontface" and _table(names[:-1]):
            leave(offset)
            face = None
        elif inside and _table(names):
            leave(offset)
            inside = None

    with opened() as stream:
        # A chunk is there before what starts in it is named.
        for _, done in _scanned(_Kept(stream, held), started, ended):
            yield from out
            out.clear()
            if inside is None and number >= final:
                return
            first = min(x for x in (done, run, face) if x is not None)
            if first - base > PIECE_BYTES:
                del held[: first - base]
                base = first


class _Kept:
    """A stream whose bytes are also appended to held as they are read."""

    def __init__(self, stream: BinaryIO, held: bytearray):
        self.stream, self.held = stream, held

    def read(self, n: int) -> bytes:
        chunk = self.stream.read(n)
        self.held += chunk
        return chunk


_HEADER = ("doc_id", "tbl", "at", "seq", "xml")
_KINDS = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())


def _cut(source: DataFrame, opened: Callable[[pa.Scalar], Callable[[], BinaryIO] | None], tables: tuple[str, ...]) -> DataFrame:
    wanted = tables or tuple(_NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0), b.column(1)):
                if content.is_valid and (open_part := opened(content)):
                    yield from batched(((doc.as_py(), *piece) for piece in _pieces(open_part, wanted)), list(_HEADER), _KINDS, 16)

    return source.mapInArrow(lean(work), "doc_id long, tbl string, at int, seq int, xml string")


def headers(parts: DataFrame, *tables: str) -> DataFrame:
    """(doc_id, tbl, at, seq, xml) of parts(doc_id, name, bytes): the header part in pieces, of these tables or of all."""
    own = parts.where(F.col("name") == PART).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "bytes")
    return _cut(own, lambda content: lambda: io.BytesIO(memoryview(content.as_buffer())), tables)


def headers_of(packages: DataFrame, *tables: str) -> DataFrame:
    """The same of packages(doc_id, content): the header part is inflated as it is cut and never whole."""

    def opened(content: pa.Scalar) -> Callable[[], BinaryIO] | None:
        package = zipfile.ZipFile(pa.BufferReader(content.as_buffer()))
        return (lambda: package.open(PART)) if PART in package.namelist() else None

    return _cut(packages.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "content"), opened, tables)


def _entries(headers: DataFrame, table: str) -> DataFrame:
    """(doc_id, at, seq, i, e): the entries of a table; at, seq and i give their order."""
    entry, fields = _ENTRIES[table]
    options = {"ignoreNamespace": "true", "attributePrefix": "_", "nullValue": "\x00", "mode": "PERMISSIVE"}
    parsed = F.from_xml(F.concat(F.lit("<t>"), "xml", F.lit("</t>")), f"STRUCT<{entry}: ARRAY<STRUCT<{fields}>>>", options)
    return headers.where(F.col("tbl") == table).select("doc_id", "at", "seq", parsed.alias("p")).select("doc_id", "at", "seq", F.posexplode(f"p.{entry}").alias("i", "e"))


def _by_id(headers: DataFrame, table: str) -> DataFrame:
    """(doc_id, id, e): the last entry of each id."""
    own = _entries(headers, table).select("doc_id", F.coalesce(_number(F.col("e._id")), F.lit(0)).alias("id"), "seq", "i", "e")
    return own.withColumn("_next", F.lead("i").over(Window.partitionBy("doc_id", "id").orderBy("seq", "i"))).where("_next IS NULL").select("doc_id", "id", "e")


def _number(x: Column) -> Column:
    n = F.trim(x).try_cast("bigint")
    return F.when(n.between(0, 0xFFFFFFFF), n)


def _colour(x: Column) -> Column:
    """#RRGGBB as the number 0x00BBGGRR, null for anything else."""
    part = lambda at: F.conv(F.substring(F.trim(x), at, 2), 16, 10).cast("bigint")
    return F.when(F.trim(x).rlike(r"^#[0-9A-Fa-f]{6}\z"), part(2) + part(4) * 256 + part(6) * 65536)


def _seven(x: Column, default: int, low: int, high: int) -> Column:
    one = lambda s: F.least(F.greatest(F.coalesce(F.trim(x[f"_{s}"]).try_cast("bigint"), F.lit(default)), F.lit(low)), F.lit(high)).cast("int")
    return F.array(*map(one, SLOTS))


def fonts(headers: DataFrame) -> DataFrame:
    """(doc_id, slot, idx, name): the faces of each script slot in their order; faces of an unknown language are in `other`."""
    slot = F.lower("e._lang")
    faces = _entries(headers, "fontfaces").select("doc_id", F.when(slot.isin(*SLOTS), slot).otherwise("other").alias("slot"), "at", "seq", F.posexplode("e.font").alias("i", "font"))
    place = F.row_number().over(Window.partitionBy("doc_id", "slot").orderBy("at", "seq", "i")) - 1
    return faces.select("doc_id", "slot", place.alias("idx"), F.coalesce("font._face", F.lit("")).alias("name"))


def border_fills(headers: DataFrame) -> DataFrame:
    """(doc_id, id, face): the colour of a solid face as a number 0x00BBGGRR, null without one."""
    rows = _by_id(headers, "borderFills")
    brush = F.col("e.fillBrush")
    return rows.select("doc_id", "id", F.coalesce(_colour(brush["winBrush"]["_faceColor"]), _colour(brush["fillColor"]["_faceColor"])).alias("face"))


def char_shapes(headers: DataFrame) -> DataFrame:
    """(doc_id, id, attr, height, color, shade, border_fill, underline_color, strike_color, fonts, ratios, sizes, spacings, offsets).

    Bold and italic hold by their presence, underline and strike-out unless their shape is NONE; the arrays go by SLOTS."""
    e = F.col("e")
    line = lambda n: e[n].isNotNull() & (F.upper(F.coalesce(e[n]["_shape"], F.lit(""))) != "NONE")
    bit = lambda on, n: F.when(on, 1 << CHAR_BITS[n][0]).otherwise(0)
    attr = bit(e["italic"].isNotNull(), "italic") + bit(e["bold"].isNotNull(), "bold") + bit(line("underline"), "underline_kind") + bit(line("strikeout"), "strike")
    return _by_id(headers, "charProperties").select(
        "doc_id", "id", attr.alias("attr"), F.coalesce(_number(e["_height"]), F.lit(DEFAULT_HEIGHT)).alias("height"), F.coalesce(_colour(e["_textColor"]), F.lit(0)).alias("color"),
        F.coalesce(_colour(e["_shadeColor"]), F.lit(0)).alias("shade"), _number(e["_borderFillIDRef"]).alias("border_fill"), F.coalesce(F.when(line("underline"), _colour(e["underline"]["_color"])), F.lit(0)).alias("underline_color"),
        F.when(line("strikeout"), _colour(e["strikeout"]["_color"])).alias("strike_color"), _seven(e["fontRef"], 0, 0, 65535).alias("fonts"), _seven(e["ratio"], 100, 0, 255).alias("ratios"),
        _seven(e["relSz"], 100, 0, 255).alias("sizes"), _seven(e["spacing"], 0, -128, 127).alias("spacings"), _seven(e["offset"], 0, -128, 127).alias("offsets"),
    )


def para_shapes(headers: DataFrame) -> DataFrame:
    """(doc_id, id, align): the number of the alignment; 1, left, for an unknown one and 0 without one."""
    name = F.upper("e.align._horizontal")
    number = F.array_position(F.array(*map(F.lit, ALIGNMENTS)), name).cast("int") - 1
    return _by_id(headers, "paraProperties").select("doc_id", "id", F.when(name.isNull(), 0).when(number < 0, 1).otherwise(number).alias("align"))


def styles(headers: DataFrame) -> DataFrame:
    """(doc_id, id, is_char, name, english, para_shape, char_shape, next_style, lang)."""
    e = F.col("e")
    number = lambda n: F.coalesce(_number(e[n]), F.lit(0))
    text = lambda n: F.coalesce(e[n], F.lit(""))
    return _by_id(headers, "styles").select(
        "doc_id", "id", (text("_type") == "CHAR").alias("is_char"), text("_name").alias("name"), text("_engName").alias("english"), number("_paraPrIDRef").alias("para_shape"), number("_charPrIDRef").alias("char_shape"),
        number("_nextStyleIDRef").alias("next_style"), F.coalesce(e["_langID"].try_cast("smallint"), F.lit(0)).cast("int").alias("lang"),
    )


# What sections refer to


def with_heading_levels(nodes: DataFrame, styles: DataFrame, known: bool = False) -> DataFrame:
    """NODE rows with level: of a paragraph's style by its names, else of its number; null for text and for other nodes. A paragraph
    without a style has style 0. With known, only nodes whose style is there."""
    own = styles.where("NOT is_char").select(F.col("doc_id").alias("_d"), F.col("id").alias("_s"), style_heading_level(F.col("name"), F.col("english")).alias("_l"))
    joined = nodes.join(own, (F.col("doc_id") == F.col("_d")) & (F.coalesce(F.col("attrs")["style"].try_cast("bigint"), F.lit(0)) == F.col("_s")), "inner" if known else "left")
    return joined.withColumn("level", F.when(F.col("kind") == "paragraph", F.coalesce("_l", text_heading_level(F.col("text"))))).drop("_d", "_s", "_l")


def cell_tones(nodes: DataFrame, fills: DataFrame) -> DataFrame:
    """(doc_id, section, path, face, tone) of the cells: their fill's colour as #RRGGBB and its tone, none without a fill."""
    own = fills.select(F.col("doc_id").alias("_d"), F.col("id").alias("_b"), "face")
    cells = nodes.where("kind = 'cell'")
    joined = cells.join(own, (F.col("doc_id") == F.col("_d")) & (F.coalesce(F.col("attrs")["border"].try_cast("bigint"), F.lit(0)) == F.col("_b")), "left")
    r, g, b = (bits(F.col("face"), at, 8) for at in (0, 8, 16))
    return joined.select("doc_id", "section", "path", F.when(F.col("face").isNotNull(), colour_hex(F.col("face"))).alias("face"), F.coalesce(F.when(F.col("face").isNotNull(), tone(r, g, b, F.lit(255))), F.lit("none")).alias("tone"))


def text_runs(nodes: DataFrame, shapes: DataFrame) -> DataFrame:
    """(doc_id, section, path, run, text, bold, italic, underline, strike, height, color): the runs of paragraphs with their shapes.
    A paragraph without runs is one run of shape 0; a shape that the header lacks is plain text of the default height."""
    split = F.transform(F.filter(F.split(F.coalesce(F.col("attrs")["runs"], F.lit("")), r"\|"), lambda r: r != ""), lambda r: F.split(r, ":").cast("array<bigint>"))
    runs = nodes.where("kind = 'paragraph'").select("doc_id", "section", "path", F.encode(F.coalesce("text", F.lit("")), "UTF-16LE").alias("raw"), split.alias("s"))
    ends = F.transform("s", lambda r, i: F.struct(r[0].alias("start"), F.coalesce(F.get("s", i + 1)[0], (F.octet_length("raw") / 2).cast("bigint")).alias("stop"), r[1].alias("shape")))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), (F.octet_length("raw") / 2).cast("bigint").alias("stop"), F.lit(0).cast("bigint").alias("shape")))
    rows = runs.select("doc_id", "section", "path", "raw", F.posexplode(F.when(F.size("s") > 0, ends).otherwise(whole)).alias("run", "r"))
    text = F.decode(F.substring(F.col("raw"), (F.col("r.start") * 2 + 1).cast("int"), ((F.col("r.stop") - F.col("r.start")) * 2).cast("int")), "UTF-16LE")
    cut = rows.select("doc_id", "section", "path", "run", text.alias("text"), F.col("r.shape").alias("_c"))
    own = shapes.select(F.col("doc_id").alias("_d"), F.col("id").alias("_i"), "attr", "height", "color")
    joined = cut.join(own, (F.col("doc_id") == F.col("_d")) & (F.col("_c") == F.col("_i")), "left")
    has = lambda n: (F.coalesce(bits(F.col("attr"), *CHAR_BITS[n]), F.lit(0)) > 0).alias(n.partition("_")[0])
    return joined.select("doc_id", "section", "path", "run", "text", has("bold"), has("italic"), has("underline_kind"), has("strike"), F.coalesce("height", F.lit(DEFAULT_HEIGHT)).alias("height"), colour_hex(F.coalesce("color", F.lit(0))).alias("color"))


# Writing


def _tag(name: str, attrs: dict[str, Column | str], *inside: Column) -> Column:
    """An element as a string expression. An attribute whose value is null is left out."""
    pairs = [F.coalesce(F.concat(F.lit(f' {k}="'), v if isinstance(v, Column) else F.lit(v), F.lit('"')), F.lit("")) for k, v in attrs.items()]
    return F.concat(F.lit(f"<{name}"), *pairs, *((F.lit(">"), *inside, F.lit(f"</{name}>")) if inside else (F.lit("/>"),)))


def _text(x: str) -> Column:
    return F.col(x).cast("string")


def _slots(name: str, values: str, zero: int = 0) -> Column:
    value = lambda i: F.coalesce(F.when(F.get(values, F.lit(i)) != 0, F.get(values, F.lit(i))), F.lit(zero)).cast("string")
    return _tag(f"hh:{name}", {s: value(i) for i, s in enumerate(SLOTS)})


def style_xml() -> Column:
    """Of a row of styles."""
    kind = F.when(F.col("is_char"), "CHAR").otherwise("PARA")
    return _tag("hh:style", {"id": _text("id"), "type": kind, "name": escape_xml(F.col("name")), "engName": escape_xml(F.col("english")), "paraPrIDRef": _text("para_shape"), "charPrIDRef": _text("char_shape"), "lockForm": "0", "nextStyleIDRef": _text("next_style"), "langID": _text("lang")})


def char_shape_xml() -> Column:
    """Of a row of char_shapes. No shade, or all bits of it, is `none`; a ratio or size of 0 is 100."""
    shade = F.when(F.col("shade").isin(0, 0xFFFFFFFF), "none").otherwise(colour_hex(F.col("shade")))
    on = lambda n: bits(F.col("attr"), *CHAR_BITS[n]) > 0
    mark = lambda n: F.when(on(n), f"<hh:{n}/>").otherwise("")
    line = lambda name, n, colour: _tag(f"hh:{name}", {"shape": F.when(on(n), "SOLID").otherwise("NONE"), "color": colour_hex(F.coalesce(colour, F.lit(0)))})
    head = {"id": _text("id"), "height": _text("height"), "textColor": colour_hex(F.col("color")), "shadeColor": shade, "borderFillIDRef": _text("border_fill")}
    arrays = [_slots("fontRef", "fonts"), _slots("ratio", "ratios", 100), _slots("relSz", "sizes", 100), _slots("spacing", "spacings"), _slots("offset", "offsets")]
    return _tag("hh:charPr", head, *arrays, mark("bold"), mark("italic"), line("strikeout", "strike", F.col("strike_color")), line("underline", "underline_kind", F.col("underline_color")))


def para_shape_xml(margins: dict[str, Column] | None = None, spacing: Column | None = None, spacing_kind: Column | None = None) -> Column:
    """Of a row of para_shapes; margins by intent, left, right, prev and next, in document units, and the line spacing with its kind."""
    align = F.coalesce(F.get(F.array(*map(F.lit, ALIGNMENTS)), F.col("align")), F.lit("LEFT"))
    given = {k: F.coalesce((margins or {}).get(k, F.lit(0)).cast("string"), F.lit("0")) for k in ("intent", "left", "right", "prev", "next")}
    kind = F.coalesce(spacing_kind if spacing_kind is not None else F.lit(0), F.lit(0))
    value = F.coalesce(spacing if spacing is not None else F.lit(0), F.lit(0))
    named = F.when(kind == 1, SPACINGS[1]).when(kind == 2, SPACINGS[2]).otherwise("PERCENT")
    shown = F.when(~kind.isin(*SPACINGS) & (value <= 0), DEFAULT_SPACING).otherwise(value).cast("string")
    return _tag("hh:paraPr", {"id": _text("id"), "snapToGrid": "1"}, _tag("hh:align", {"horizontal": align, "vertical": "BASELINE"}), _tag("hh:margin", given), _tag("hh:lineSpacing", {"type": named, "value": shown, "unit": "HWPUNIT"}))


def border_xml(name: str, kind: Column, width: Column, colour: Column) -> Column:
    """A border line: its style by number, its width in tenths of a millimetre, at least one, and its colour."""
    style = F.coalesce(F.get(F.array(*map(F.lit, LINES)), kind.cast("int")), F.lit("SOLID"))
    return _tag(f"hh:{name}", {"type": style, "width": F.format_string("%.2f mm", F.greatest(width, F.lit(1)).cast("double") / 10), "color": colour_hex(colour)})


def border_fill_xml() -> Column:
    """Of a row of border_fills; white is no fill."""
    brush = _tag("hc:fillBrush", {}, _tag("hc:winBrush", {"faceColor": colour_hex(F.col("face")), "hatchColor": "#000000", "hatchStyle": "NONE", "alpha": "0"}))
    lines = [border_xml(n, F.lit(0), F.lit(1), F.lit(0)) for n in ("leftBorder", "rightBorder", "topBorder", "bottomBorder", "diagonal")]
    return _tag("hh:borderFill", {"id": _text("id"), "threeD": "0", "shadow": "0", "centerLine": "NONE"}, *lines, F.when(F.col("face").isNotNull() & (F.col("face") != 0xFFFFFF), brush).otherwise(""))


def header_pieces(fonts: DataFrame, fills: DataFrame, chars: DataFrame, paras: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, name, place, bytes): the header part of each document in any of the tables, in pieces that make it up in the order of place: its entries,
    and the tags around them; each container holds the count of its children."""
    slot = F.array_position(F.array(*map(F.lit, SLOTS)), F.col("slot")).cast("bigint")
    # In a container 0 opens it, 1 are its children and 2 closes it; so do the last three of a font face among these.
    place = lambda t, part=1, a=None, slot=None, inner=1, b=None, name=None: F.struct(
        F.lit(t).alias("t"), F.lit(part).alias("part"), (F.lit(None).cast("bigint") if a is None else a).alias("a"), F.upper(F.lit(slot) if slot is None else slot).cast("string").alias("lang"), (F.lit(slot) if slot is None else slot).cast("string").alias("slot"),
        F.lit(inner).alias("inner"), F.lit(b).cast("bigint").alias("b") if b is None else F.col(b).cast("bigint").alias("b"), F.lit(None).cast("string").alias("name") if name is None else F.col(name).alias("name"),
    )
    piece = lambda df, at, xml: df.select("doc_id", at.alias("place"), xml.alias("xml"))
    faces = fonts.groupBy("doc_id", "slot").agg(F.count("*").alias("n"))
    font = F.concat(F.lit('<hh:font id="'), _text("idx"), F.lit('" face="'), escape_xml(F.col("name")), F.lit('"/>'))
    face_tag = F.concat(F.lit("<hh:fontface"), F.coalesce(F.concat(F.lit(' lang="'), F.upper("slot"), F.lit('"')), F.lit("")), F.lit(' fontCnt="'), _text("n"), F.lit('">'))
    at_slot = lambda inner, **more: place(0, 1, slot, F.col("slot"), inner, **more)
    tables = {"fontfaces": faces, "borderFills": fills, "charProperties": chars, "paraProperties": paras, "styles": styles}
    rows = piece(faces, at_slot(0), face_tag).unionByName(piece(fonts, at_slot(1, b="idx", name="name"), font)).unionByName(piece(faces, at_slot(2), F.lit("</hh:fontface>")))
    counted = faces.select("doc_id", F.lit(0).alias("t"))
    for i, (t, xml) in enumerate(zip([fills, chars, paras, styles], [border_fill_xml(), char_shape_xml(), para_shape_xml(), style_xml()]), 1):
        rows = rows.unionByName(piece(t, place(i, b="id"), xml))
        counted = counted.unionByName(t.select("doc_id", F.lit(i).alias("t")))
    spaces = "".join(f' xmlns:{k}="{v}"' for k, v in NAMESPACES.items())
    around = [F.struct(place(-1).alias("place"), F.lit(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><hh:head{spaces}><hh:refList>').alias("xml"))]
    for i, name in enumerate(tables):
        around.append(F.struct(place(i, 0).alias("place"), F.concat(F.lit(f'<hh:{name} itemCnt="'), _text(f"_{i}"), F.lit('">')).alias("xml")))
        around.append(F.struct(place(i, 2).alias("place"), F.lit(f"</hh:{name}>").alias("xml")))
    around.append(F.struct(place(len(tables)).alias("place"), F.lit("</hh:refList></hh:head>").alias("xml")))
    tags = counted.groupBy("doc_id").agg(*(F.count_if(F.col("t") == i).alias(f"_{i}") for i in range(len(tables)))).select("doc_id", F.inline(F.array(*around)))
    return rows.unionByName(tags).select("doc_id", F.lit(PART).alias("name"), "place", F.encode(F.coalesce("xml", F.lit("")), "UTF-8").alias("bytes"))
