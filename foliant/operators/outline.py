"""Addressable record lines to node rows and back: PARAGRAPH, TABLE, CELL, FIGURE and TEXT lines, with END TABLE closing a table.

Reading walks the lines of one document with a stack of open tables, in the task that holds its text; writing is string expressions and one
gathering of each document's lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import WHITE, clean_text, escape_record
from foliant.sources.packages import NODE
from foliant.spark import parts_of

ANCHOR = "￼"
#: Nodes of an Arrow batch, a document's last ones aside.
NODES = 4096
_HEAD = re.compile(r"(SECTION|PARAGRAPH|TABLE|CELL|FIGURE|END TABLE|TEXT)(?:\[([^\]]*)\])?(:?)(.*)", re.S)
_ATX = re.compile(r"(#{1,6}) (.*)", re.S)
_ESCAPE = re.compile(r"\\([\\nt])")
_PLAIN = {"\\": "\\", "n": "\n", "t": "\t"}
#: A table cell's attributes: name in a record, name in a node, least value and value where there is none.
_CELL = (("row", "row", 0, 0), ("col", "col", 0, 0), ("rowspan", "row_span", 1, 1), ("colspan", "col_span", 1, 1), ("border_fill", "border", 0, 1), ("width", "width", 0, 0), ("height", "height", 0, 0), ("text_width", "text_width", 0, 0))


def _attributes(inside: str | None) -> dict[str, str]:
    return {k.strip(): v.strip() for k, eq, v in (p.partition("=") for p in (inside or "").split(",")) if eq}


def _number(a: dict[str, str], key: str, default: int = 0) -> int:
    v = a.get(key)
    return default if v is None else int(v) if re.fullmatch(r"[+-]?[0-9]{1,18}", v) else default


class _Table:
    """An open table: where its row stands, and the cell that takes what follows."""

    def __init__(self, path: str, row: int):
        self.path, self.row, self.cells, self.inside, self.extent = path, row, 0, 0, [0, 0]

    @property
    def cell(self) -> str | None:
        return f"{self.path}/c{self.cells - 1}" if self.cells else None


def nodes_of_records(text: str) -> Iterator[tuple[int, int, str, str, dict[str, str], str]]:
    """(section, ord, path, kind, attributes, text) of one document's records. What stands outside a cell in a table is dropped, a cell
    without content holds an empty paragraph, and a table that isn't closed ends with its section."""
    section, count, out = 0, 0, []
    tables: list[_Table] = []
    waiting: dict[str, str] | None = None

    def paragraph(body: str, style: int, para: int, char: int, a: dict[str, str], anchor: bool = False) -> str | None:
        """Adds a paragraph where the next one belongs; its path, or None where it belongs nowhere."""
        nonlocal count
        if tables:
            cell = tables[-1].cell
            if cell is None:
                return None
            path = f"{cell}/p{tables[-1].inside}"
            tables[-1].inside += 1
        else:
            path = f"p{count}"
            count += 1
        shape = char or (0 if anchor else style)
        attrs = {"para": str(para or (0 if anchor else style)), "style": str(style), "page_break": "1" if _number(a, "page_break") else "0", "runs": f"0:{shape}" if shape else ""}
        out.append((path, "paragraph", attrs | ({"lineseg": a["lineseg"]} if a.get("lineseg") and not anchor else {}), body))
        return path

    def settle() -> None:
        """The waiting paragraph gets no text."""
        nonlocal waiting
        if waiting is not None:
            a, waiting = waiting, None
            paragraph("", min(max(_number(a, "level"), 0), 6), _number(a, "para_shape"), _number(a, "char_shape"), a)

    def filled() -> None:
        if tables[-1].cells and not tables[-1].inside:
            paragraph("", 0, 0, 0, {})

    def closed() -> None:
        filled()
        t = tables.pop()
        path, kind, attrs, _ = out[t.row]
        out[t.row] = (path, kind, attrs | {"rows": str(t.extent[0]), "cols": str(t.extent[1])}, "")

    def finished() -> None:
        settle()
        while tables:
            closed()

    def anchored() -> str | None:
        nonlocal waiting
        a, waiting = waiting or {}, None
        return paragraph(ANCHOR, 0, _number(a, "para_shape"), _number(a, "char_shape"), a, anchor=True)

    for line in text.split("\n"):
        m = _HEAD.match(line.strip(WHITE))
        if not m or (m[1] != "TEXT" and m[2] is None and m[1] != "END TABLE") or (m[1] == "TEXT" and not m[3]):
            continue
        kind, a = m[1], _attributes(m[2])
        if kind in ("SECTION", "PARAGRAPH"):
            finished()
            if kind == "PARAGRAPH":
                waiting = a
            elif out:
                yield from ((section, i, *r) for i, r in enumerate(out))
                section, count, out = section + 1, 0, []
        elif kind == "TABLE":
            path = anchored()
            if path is not None:
                tables.append(_Table(f"{path}/t0", len(out)))
                out.append((f"{path}/t0", "table", {"border": str(max(_number(a, "border_fill"), 0)), "spacing": str(_number(a, "cell_spacing"))}, ""))
        elif kind == "END TABLE":
            if tables:
                closed()
        elif kind == "FIGURE":
            path = anchored()
            if path is not None:
                size = {k: str(int(max(_number(a, f"{k}_mm"), 0) * 7200 / 25.4 + 0.5)) for k in ("width", "height")}
                out.append((f"{path}/i0", "picture", {"bin": str(max(_number(a, "bin_id"), 0))} | size, ""))
        elif kind == "CELL":
            if tables:
                filled()
                t = tables[-1]
                attrs = {own: max(_number(a, k, default), least) for k, own, least, default in _CELL}
                t.cells, t.inside = t.cells + 1, 0
                t.extent = [max(t.extent[0], attrs["row"] + attrs["row_span"]), max(t.extent[1], attrs["col"] + attrs["col_span"])]
                out.append((t.cell or "", "cell", {k: str(v) for k, v in attrs.items()}, ""))
        else:
            body = _ESCAPE.sub(lambda e: _PLAIN[e[1]], m[4].removeprefix(" "))
            if waiting is not None:
                held, waiting = waiting, None
                level = min(max(_number(held, "level"), 0), 6)
                atx = None if level else _ATX.match(body)
                if atx:
                    level, body = len(atx[1]), atx[2]
                paragraph(body, level, _number(held, "para_shape"), _number(held, "char_shape"), held if held.get("lineseg") else held | {k: v for k, v in a.items() if k == "lineseg"})
            else:
                paragraph(body, 0, _number(a, "para_shape"), _number(a, "char_shape"), a)
    finished()
    yield from ((section, i, *r) for i, r in enumerate(out))


def nodes(records: DataFrame) -> DataFrame:
    """NODE rows of records(doc_id, records). A null text has none. Documents are read one at a time, so memory follows the longest; the nodes of many
    short ones share a batch."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
    names = ["doc_id", "section", "ord", "path", "kind", "attrs", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows += [(doc, s, i, path, kind, list(attrs.items()), body) for s, i, path, kind, attrs, body in nodes_of_records(text.as_py() or "")]
                if len(rows) >= NODES:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    return records.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "records").mapInArrow(work, NODE)


def to_records(nodes: DataFrame) -> DataFrame:
    """(doc_id, records) of NODE rows; nodes() reads them again. Texts are cleaned as every text of a record is; a paragraph's first run gives
    its character shape; an anchor of a table or picture has no line of its own text."""
    a = lambda k, d="0": F.coalesce(F.col("attrs")[k], F.lit(d))
    plain = clean_text(F.coalesce("text", F.lit("")))
    place = F.concat(F.lit("s"), F.col("section").cast("string"), F.lit("-"), F.replace(F.col("path"), F.lit("/"), F.lit("-")))
    shape = F.regexp_extract(a("runs", ""), r"^[0-9]+:([0-9]+)", 1)
    part = lambda name, value, on: F.when(on, F.concat(F.lit(f",{name}="), value)).otherwise("")
    level = a("style").try_cast("int")
    held = F.coalesce(F.col("attrs")["lineseg"], F.lit(""))
    own = F.concat(part("para_shape", a("para"), a("para") != "0"), part("char_shape", shape, ~shape.isin("", "0")), part("lineseg", held, held != ""), part("page_break", F.lit("1"), a("page_break") == "1"))
    top = F.concat(F.lit("PARAGRAPH[id=par-"), place, part("level", level.cast("string"), level.between(1, 6)), own, F.lit("]"), F.when(plain != "", F.concat(F.lit("\nTEXT: "), escape_record(plain))).otherwise(""))
    inner = F.when((plain != "") | ~F.coalesce(F.col("text").contains(ANCHOR), F.lit(False)), F.concat(F.lit("TEXT[par-"), place, own, F.lit("]: "), escape_record(plain)))
    table = F.concat(F.lit("TABLE[id=tbl-"), place, F.lit(",rows="), a("rows"), F.lit(",cols="), a("cols"), F.lit(",border_fill="), a("border"), part("cell_spacing", a("spacing"), a("spacing") != "0"), F.lit("]"))
    cell = F.concat(F.lit("CELL[id=cell-"), place, *[F.concat(F.lit(f",{k}="), a(n, str(d))) for k, n, _, d in _CELL], F.lit("]"))
    mm = lambda k: F.floor(a(k).try_cast("double") * 25.4 / 7200 + 0.5).cast("string")
    figure = F.concat(F.lit("FIGURE[id=fig-"), place, F.lit(",bin_id="), F.regexp_extract(a("bin"), "([0-9]*)$", 1), F.lit(",width_mm="), F.coalesce(mm("width"), F.lit("0")), F.lit(",height_mm="), F.coalesce(mm("height"), F.lit("0")), F.lit("]"))
    nested = F.col("path").contains("/")
    line = F.when(F.col("kind") == "paragraph", F.when(nested, inner).otherwise(top)).when(F.col("kind") == "table", table).when(F.col("kind") == "cell", cell).when(F.col("kind") == "picture", figure)
    # Everything comes from one pass over the nodes, dealt out by document: a line for each node, and for each table that holds it, or is it, an end,
    # of which the last counts. Deeper tables end first: the deepest has the smallest number after one node.
    steps = F.split("path", "/")
    above = F.transform(F.filter(F.sequence(F.lit(1), F.size(steps)), lambda i: F.get(steps, i - 1).startswith("t")), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    close = lambda t: F.concat(F.lit("END TABLE[tbl-s"), F.col("section").cast("string"), F.lit("-"), F.replace(t, F.lit("/"), F.lit("-")), F.lit("]"))
    ends = F.transform(above, lambda t: F.struct(t.alias("t"), (F.lit(1_000_000) - F.size(F.split(t, "/"))).alias("after"), close(t).alias("line")))
    dealt = nodes.select("doc_id", "section", "ord", line.alias("line"), ends.alias("ends")).repartition(parts_of(nodes.sparkSession), "doc_id")
    # A line has its node's number for a table, so that it stays by itself.
    rows = dealt.select("doc_id", "section", "ord", F.inline(F.concat(F.array(F.struct(F.concat(F.lit("#"), F.col("ord").cast("string")).alias("t"), F.lit(0).alias("after"), F.col("line").alias("line"))), "ends")))
    last = rows.groupBy("doc_id", "section", "t").agg(F.max("ord").alias("ord"), F.first("after").alias("after"), F.first("line").alias("line"))
    whole = last.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "ord", "after", "line"))).alias("l"))
    head = lambda x, i: F.when((i == 0) | (F.get("l", i - 1)["section"] != x["section"]), F.concat(F.lit("SECTION[id=sec-"), x["section"].cast("string"), F.lit("]")))
    return whole.select("doc_id", F.concat(F.array_join(F.flatten(F.transform("l", lambda x, i: F.array(head(x, i), x["line"]))), "\n"), F.lit("\n")).alias("records"))
