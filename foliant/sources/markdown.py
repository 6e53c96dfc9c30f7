"""Markdown import: blocks of a text as rows, by a small line-oriented reader."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.spark import batched, lean

_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ *\|? *:?-+:? *(?:\| *:?-+:? *)*\|? *$")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)(?:\{[^}]*\})?")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")


def cells_of(line: str) -> list[str]:
    """Cells of a pipe row; escaped pipes are text."""
    inner = line.strip()
    inner = inner[1:] if inner.startswith("|") else inner
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


def blocks(text: str | None) -> list[tuple[str, int, int, int, str]]:
    """(kind, level, row, col, text): heading with its level, paragraph, code, image (the address as text), and cell of table number
    `level`. Lines of a paragraph are joined by a space."""
    out: list[tuple[str, int, int, int, str]] = []
    lines = (text or "").split("\n")
    held: list[str] = []
    tables = at = 0

    def flush() -> None:
        whole = " ".join(x.strip() for x in held)
        held.clear()
        for m in _IMAGE.finditer(whole):
            out.append(("image", 0, 0, 0, m[2]))
        if rest := _IMAGE.sub("", whole).strip():
            out.append(("paragraph", 0, 0, 0, rest))

    while at < len(lines):
        line = lines[at]
        if fence := _FENCE.match(line):
            flush()
            stop = next((i for i in range(at + 1, len(lines)) if lines[i].lstrip().startswith(fence[1])), len(lines))
            out.append(("code", 0, 0, 0, "\n".join(lines[at + 1 : stop])))
            at = stop
        elif m := _HEADING.match(line):
            flush()
            out.append(("heading", len(m[1]), 0, 0, (m[2] or "").strip()))
        elif "|" in line and at + 1 < len(lines) and "-" in lines[at + 1] and _RULE.match(lines[at + 1]) and len(cells_of(line)) == len(cells_of(lines[at + 1])):
            flush()
            stop = at + 2
            while stop < len(lines) and "|" in lines[stop]:
                stop += 1
            width = len(cells_of(line))
            for r, row in enumerate([line, *lines[at + 2 : stop]]):
                out.extend(("cell", tables, r, c, x) for c, x in enumerate((cells_of(row) + [""] * width)[:width]))
            tables += 1
            at = stop - 1
        elif not line.strip():
            flush()
        else:
            held.append(line)
        at += 1
    flush()
    return out


def import_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, level, row, col, text) of docs(doc_id, text); a null text has no blocks."""
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc.as_py(), i, *x) for b in batches for doc, text in zip(*b.columns) for i, x in enumerate(blocks(text.as_py())))
        yield from batched(rows, ["doc_id", "seq", "kind", "level", "row", "col", "text"], kinds)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(lean(work), "doc_id long, seq int, kind string, level int, row int, col int, text string")
