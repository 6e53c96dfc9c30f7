"""Section trees of binary documents: the flat, levelled records of a section as the node rows that packages give, and back.

What has no field of its own stays with its node as records, so that a section that nobody edited is written as it was read.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from . import records as R

Node = tuple[str, str, dict[str, str], str]
#: Codes of tables, drawn shapes and pictures, stored back to front; where a shape's size and a picture's number stand.
TABLE, SHAPE, PICTURE = "tbl ", "gso ", "$pic"
_SIZE_AT, _NUMBER_AT, _SHAPE_BYTES = 16, 71, 40
#: Bit of the division byte for a page break; bytes after a cell's fields; entries of runs and of lines.
_PAGE_BREAK, _CELL_TAIL = 4, 9
RUN, LINE = "<2I", "<I7iI"


def code_of(data: bytes) -> str:
    """The readable code at the start of a control's or shape's record; what isn't printable is a dot. Empty where there are no four bytes."""
    return "".join(chr(b) if 0x20 <= b <= 0x7E else "." for b in data[3::-1]) if len(data) >= 4 else ""


def shape_size(data: bytes) -> tuple[int, int]:
    """Width and height of a drawn shape's control; zeros where it is too short."""
    return struct.unpack_from("<2I", data, _SIZE_AT) if len(data) >= _SIZE_AT + 8 else (0, 0)


def picture_number(data: bytes) -> int | None:
    return struct.unpack_from("<H", data, _NUMBER_AT)[0] if len(data) >= _NUMBER_AT + 2 else None


def entries(data: bytes, code: str) -> str:
    """Equal entries of numbers as text, a:b|a:b; raises ValueError if the last one is cut short."""
    if len(data) % struct.calcsize(code):
        raise ValueError("entries cut short")
    return "|".join(":".join(map(str, e)) for e in struct.iter_unpack(code, data))


def entry_bytes(text: str, code: str) -> bytes:
    return b"".join(struct.pack(code, *map(int, e.split(":"))) for e in text.split("|") if e)


@dataclass
class _Record:
    tag: int
    level: int
    data: bytes
    at: int
    end: int = 0
    kids: list[_Record] = field(default_factory=list)


def _forest(rows: list[tuple[int, int, bytes]]) -> list[_Record]:
    """The records by level: each belongs to the nearest one before it that stands higher; at and end bound its rows."""
    top = _Record(-1, -1, b"", -1)
    stack = [top]
    for i, (tag, level, data) in enumerate(rows):
        while stack[-1].level >= level:
            stack.pop().end = i
        own = _Record(tag, level, data, i)
        stack[-1].kids.append(own)
        stack.append(own)
    for r in stack:
        r.end = len(rows)
    return top.kids


def _packed(rows: list[tuple[int, int, bytes]], base: int) -> dict[str, str]:
    return {"records": " ".join(f"{tag}:{level - base}:{data.hex()}" for tag, level, data in rows)} if rows else {}


def _unpacked(attrs: dict[str, str], base: int, name: str = "records") -> list[tuple[int, int, bytes]]:
    return [(int(t), base + int(n), bytes.fromhex(d)) for t, n, d in (x.split(":") for x in attrs.get(name, "").split())]


def nodes_of(records: Iterable[tuple[int, int, bytes]]) -> list[Node]:
    """(path, kind, attributes, text) in document order of (tag, level, data).

    A paragraph's text, runs, lines and controls stand one level below it, a table's cells one below its control, a cell's paragraphs at
    the level of its list header. Of several texts of a paragraph the last counts. Records outside every paragraph are nodes `loose`;
    controls that are neither a table nor a picture are nodes `control`. Raises ValueError for records that are cut short.
    """
    rows = list(records)
    out: list[list] = []
    T = R.TAGS

    def paragraph(r: _Record, path: str) -> None:
        h = R.decode("PARA_HEADER", r.data)
        attrs = {"para": str(h["para_shape_id"]), "style": str(h["style_id"]), "page_break": str(int(bool(h["divide_sort"] & _PAGE_BREAK))), "header": r.data.hex()}
        node = [path, "paragraph", attrs, ""]
        out.append(node)
        kept, seen = [], {"t": 0, "i": 0, "x": 0}
        for k in r.kids:
            if k.level != r.level + 1:
                kept += rows[k.at : k.end]
            elif k.tag == T["PARA_TEXT"]:
                node[3] = R.paragraph_text(k.data)
                attrs.pop("raw", None)
                if R.text_record(node[3]) != k.data:
                    attrs["raw"] = k.data.hex()
            elif k.tag == T["PARA_CHAR_SHAPE"]:
                attrs["runs"] = entries(k.data, RUN)
            elif k.tag == T["PARA_LINE_SEG"]:
                attrs["lines"] = entries(k.data, LINE)
            elif k.tag == T["CTRL_HEADER"]:
                control(k, path, seen)
            else:
                kept += rows[k.at : k.end]
        attrs |= _packed(kept, r.level)

    def control(r: _Record, path: str, seen: dict[str, int]) -> None:
        code = code_of(r.data)
        own = [k for k in r.kids if k.level == r.level + 1]
        attrs = {"code": code, "data": r.data.hex()}
        first = next((k for k in own if k.tag == T["TABLE"]), None) if code == TABLE else None
        if first:
            letter, kind = "t", "table"
            t = R.decode("TABLE", first.data)
            attrs |= {"rows": str(t["rows"]), "cols": str(t["cols"]), "border": str(t["border_fill_id"]), "spacing": str(t["spacing"]), "table": first.data.hex()} | _packed(rows[r.at + 1 : first.at], r.level)
        else:
            letter, kind = "x", "control"
            attrs |= _packed(rows[r.at + 1 : r.end], r.level)
            shape = next((k for k in own if k.tag == T["SHAPE_COMPONENT"]), None) if code == SHAPE else None
            if shape:
                begin = next((k.at for k in own if k.tag == T["LIST_HEADER"] and k.at < shape.at), shape.at)
                words = (R.paragraph_text(data).strip() for tag, level, data in rows[begin : shape.at] if tag == T["PARA_TEXT"] and level > r.level + 1)
                attrs |= {"caption": c for c in [" ".join(filter(None, words))] if c}
                number = next((picture_number(k.data) for k in shape.kids if k.tag == T["PICTURE"]), None)
                if code_of(shape.data) == PICTURE and number is not None:
                    width, height = shape_size(r.data)
                    letter, kind, attrs = "i", "picture", attrs | {"bin": str(number), "width": str(width), "height": str(height)}
        path = f"{path}/{letter}{seen[letter]}"
        seen[letter] += 1
        out.append([path, kind, attrs, ""])
        if first:
            cells(r, first, path, attrs)

    def cells(r: _Record, table: _Record, path: str, attrs: dict[str, str]) -> None:
        after, cell, n, inside = rows[table.at + 1 : table.end], {}, -1, 0
        for k in (k for k in r.kids if k.at > table.at):
            if k.level == r.level + 1 and k.tag == T["LIST_HEADER"]:
                c = R.decode("LIST_HEADER", k.data)
                n, inside = n + 1, 0
                cell = {"row": str(c["row"]), "col": str(c["col"]), "row_span": str(c["row_span"]), "col_span": str(c["col_span"]), "width": str(c["width"]), "height": str(c["height"]), "border": str(c["border_fill_id"]), "list": k.data.hex()} | _packed(rows[k.at + 1 : k.end], r.level)
                out.append([f"{path}/c{n}", "cell", cell, ""])
            elif k.level == r.level + 1 and k.tag == T["PARA_HEADER"] and n >= 0:
                paragraph(k, f"{path}/c{n}/p{inside}")
                inside += 1
            else:
                after = after + rows[k.at : k.end]
        attrs |= {"after": x for x in _packed(after, r.level).values()}

    count, loose = 0, []
    for r in _forest(rows):
        if r.tag == T["PARA_HEADER"] and r.level == 0:
            paragraph(r, f"p{count}")
            count += 1
        else:
            loose += rows[r.at : r.end]
            if not (out and out[-1][1] == "loose"):
                out.append([f"x{count}", "loose", {}, ""])
                loose = rows[r.at : r.end]
            out[-1][2] |= _packed(loose, 0)
    return [tuple(n) for n in out]


def records_of(nodes: list[Node]) -> list[tuple[int, int, bytes]]:
    """(tag, level, data) of one section's nodes in document order; the inverse of nodes_of. Nodes of packages will do: what they lack is
    zero or empty. A paragraph whose stored text held controls keeps that text, whatever text says now. Raises ValueError for a text with
    a bare control, or with more object marks than its paragraph has controls."""
    kids: dict[str, list[Node]] = {}
    for n in nodes:
        kids.setdefault(n[0].rpartition("/")[0], []).append(n)
    out: list[tuple[int, int, bytes]] = []
    T = R.TAGS

    def put(name: str, level: int, data: bytes) -> None:
        out.append((T[name], level, data))

    def paragraph(n: Node, level: int) -> None:
        path, _, a, text = n
        held = [k for k in kids.get(path, []) if k[1] in ("table", "picture", "control")]
        codes = [bytes.fromhex(k[2]["data"])[:4] if "data" in k[2] else {"table": TABLE, "picture": SHAPE}[k[1]].encode()[::-1] for k in held]
        raw = bytes.fromhex(a["raw"]) if "raw" in a else R.text_record(text, codes)
        if raw is None:
            raise ValueError(f"text of paragraph {path}")
        runs, lines = entry_bytes(a.get("runs", ""), RUN), entry_bytes(a.get("lines", ""), LINE)
        blank = {f[0]: 0 for f in R.LAYOUTS["PARA_HEADER"][:9]} | {"char_count": len(raw) // 2, "char_shape_count": len(runs) // 8, "line_align_count": len(lines) // 36}
        h = R.decode("PARA_HEADER", bytes.fromhex(a["header"])) if "header" in a else blank
        breaks = h["divide_sort"] & ~_PAGE_BREAK | (_PAGE_BREAK if a.get("page_break", "0") == "1" else 0)
        put("PARA_HEADER", level, R.encode("PARA_HEADER", h | {"para_shape_id": int(a.get("para", 0)), "style_id": int(a.get("style", 0)), "divide_sort": breaks}))
        for name, data in (("PARA_TEXT", raw), ("PARA_CHAR_SHAPE", runs), ("PARA_LINE_SEG", lines)):
            if data:
                put(name, level + 1, data)
        out.extend(_unpacked(a, level))
        for k in held:
            {"table": table, "picture": picture, "control": control}[k[1]](k, level + 1)

    def control(n: Node, level: int) -> None:
        put("CTRL_HEADER", level, bytes.fromhex(n[2]["data"]))
        out.extend(_unpacked(n[2], level))

    def picture(n: Node, level: int) -> None:
        a = n[2]
        data = bytearray(bytes.fromhex(a["data"]) if "data" in a else SHAPE.encode()[::-1] + bytes(_SHAPE_BYTES - 4))
        if len(data) >= _SIZE_AT + 8:
            struct.pack_into("<2I", data, _SIZE_AT, int(a.get("width", 0)), int(a.get("height", 0)))
        put("CTRL_HEADER", level, bytes(data))
        number = int("".join(filter(str.isdigit, a["bin"])) or 0)
        for tag, at, body in _unpacked(a, level) or [(T["SHAPE_COMPONENT"], level + 1, PICTURE.encode()[::-1]), (T["PICTURE"], level + 2, bytes(_NUMBER_AT + 2))]:
            if tag == T["PICTURE"] and len(body) >= _NUMBER_AT + 2:
                body = body[:_NUMBER_AT] + struct.pack("<H", number) + body[_NUMBER_AT + 2 :]
            out.append((tag, at, body))

    def table(n: Node, level: int) -> None:
        path, _, a, _ = n
        held = [k for k in kids.get(path, []) if k[1] == "cell"]
        rows = int(a["rows"])
        per = Counter(int(c[2].get("row", 0)) for c in held)
        counts = [per[i] for i in range(rows)]
        t = R.decode("TABLE", bytes.fromhex(a["table"])) if "table" in a else {"attribute": 0, "padding": [0] * 4, "counts": counts, "zone_count": 0, "zones": []}
        if t.get("rows", rows) != rows:
            t["counts"] = counts
        put("CTRL_HEADER", level, bytes.fromhex(a["data"]) if "data" in a else TABLE.encode()[::-1])
        out.extend(_unpacked(a, level))
        put("TABLE", level + 1, R.encode("TABLE", t | {"rows": rows, "cols": int(a["cols"]), "spacing": int(a.get("spacing", 0)), "border_fill_id": int(a.get("border", 0))}))
        out.extend(_unpacked(a, level, "after"))
        for c in held:
            b = c[2]
            own = [k for k in kids.get(c[0], []) if k[1] == "paragraph"]
            stored = R.decode("LIST_HEADER", bytes.fromhex(b["list"])) if "list" in b else {"property": 0, "padding": [0] * 4, "text_width": 0, "tail": bytes(_CELL_TAIL)}
            place = {k: int(b.get(k, d)) for k, d in (("row", 0), ("col", 0), ("row_span", 1), ("col_span", 1), ("width", 0), ("height", 0))}
            put("LIST_HEADER", level + 1, R.encode("LIST_HEADER", stored | place | {"para_count": len(own), "border_fill_id": int(b.get("border", 0))}))
            out.extend(_unpacked(b, level))
            for k in own:
                paragraph(k, level + 1)

    for n in kids.get("", []):
        if n[1] == "paragraph":
            paragraph(n, 0)
        elif n[1] == "loose":
            out.extend(_unpacked(n[2], 0))
    return out
