"""ZIP packages of XML word-processor documents: parts, section trees as rows, and the way back.

A section's tree becomes one row for each paragraph, table, cell and picture, with a path that names its place: p0, p0/t0, p0/t0/c1,
p0/t0/c1/p0 .. Rows can be filtered, joined and edited as any table; the writer puts them together again by path.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.spark import lean, parts_of, trimmed

#: The media type part and the XML namespaces.
MIMETYPE = b"application/hwp+zip"
NAMESPACES = {"hp": "http://www.hancom.co.kr/hwpml/2011/paragraph", "hs": "http://www.hancom.co.kr/hwpml/2011/section", "hc": "http://www.hancom.co.kr/hwpml/2011/core"}
#: Bytes of a document from which on a worker gives back what writing it took.
LARGE = 1 << 20
NODE = "doc_id long, section int, ord int, path string, kind string, attrs map<string,string>, text string"
_SECTION = re.compile(r"^Contents/section([0-9]+)\.xml$")


def unzipped(data: bytes | memoryview) -> Iterator[tuple[str, bytes]]:
    """The parts one after the other; each is inflated when it is asked for."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            if not n.endswith("/"):
                yield n, z.read(n)


def unzip(data: bytes) -> list[tuple[str, bytes]]:
    return list(unzipped(data))


def zip_parts(parts: list[tuple[str, bytes | memoryview]]) -> bytes:
    """The package: the media type first and stored, then the others in their order, deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in sorted(parts, key=lambda p: p[0] != "mimetype"):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, body)
    return out.getvalue()


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element) -> str:
    return (e.text or "") + "".join(("\n" if _local(k) == "lineBreak" else "") + (k.tail or "") for k in e)


def nodes_of(xml: bytes) -> list[tuple[str, str, dict[str, str], str]]:
    """(path, kind, attributes, text) in document order. Unknown elements are passed over; a run's shape starts at the UTF-16 offset of
    its text, and runs= lists offset:shape with equal neighbours as one."""
    out: list[tuple[str, str, dict[str, str], str]] = []

    def paragraph(p: ElementTree.Element, path: str) -> None:
        at = len(out)
        out.append((path, "paragraph", {}, ""))
        text, runs, tables, pictures = "", [], 0, 0
        for run in (k for k in p if _local(k) == "run"):
            shape = run.get("charPrIDRef")
            if shape is not None and (not runs or runs[-1][1] != shape):
                runs.append((len(text.encode("utf-16-le")) // 2, shape))
            for k in run:
                kind = _local(k)
                if kind == "t":
                    text += _text(k)
                elif kind == "lineBreak":
                    text += "\n"
                elif kind == "tbl":
                    table(k, f"{path}/t{tables}")
                    tables += 1
                elif kind == "pic":
                    image = next((x for x in k.iter() if _local(x) == "img"), None)
                    size = {n: next((x for x in k if _local(x) == n), None) for n in ("curSz", "orgSz")}
                    own = next((s for s in (size["curSz"], size["orgSz"]) if s is not None and int(s.get("width", 0)) > 0), None)
                    attrs = {"bin": image.get("binaryItemIDRef", "") if image is not None else ""}
                    out.append((f"{path}/i{pictures}", "picture", attrs | ({"width": own.get("width", "0"), "height": own.get("height", "0")} if own is not None else {}), ""))
                    pictures += 1
        attrs = {"para": p.get("paraPrIDRef", "0"), "style": p.get("styleIDRef", "0"), "page_break": p.get("pageBreak", "0"), "runs": "|".join(f"{a}:{s}" for a, s in runs)}
        out[at] = (path, "paragraph", attrs, text)

    def table(t: ElementTree.Element, path: str) -> None:
        out.append((path, "table", {"rows": t.get("rowCnt", "0"), "cols": t.get("colCnt", "0"), "border": t.get("borderFillIDRef", "0"), "spacing": t.get("cellSpacing", "0")}, ""))
        for i, c in enumerate(own_cells(t)):
            held = {_local(k): k for k in c}
            get = lambda name, key, other: held[name].get(key, other) if name in held else other
            attrs = {"row": get("cellAddr", "rowAddr", "0"), "col": get("cellAddr", "colAddr", "0"), "row_span": get("cellSpan", "rowSpan", "1"), "col_span": get("cellSpan", "colSpan", "1"), "width": get("cellSz", "width", "0"), "height": get("cellSz", "height", "0"), "border": c.get("borderFillIDRef", "0")}
            out.append((f"{path}/c{i}", "cell", attrs, ""))
            inner = held.get("subList")
            for j, p in enumerate(x for x in (inner if inner is not None else []) if _local(x) == "p"):
                paragraph(p, f"{path}/c{i}/p{j}")

    def own_cells(t: ElementTree.Element) -> list[ElementTree.Element]:
        return [c for k in t for c in (list(k) if _local(k) == "tr" else [k]) if _local(c) == "tc"]

    for i, p in enumerate(x for x in ElementTree.fromstring(xml) if _local(x) == "p"):
        paragraph(p, f"p{i}")
    return out


def section_xml(nodes: list[tuple[str, str, dict[str, str], str]]) -> bytes:
    """Section XML of one section's nodes in document order; the inverse of nodes_of for what it knows."""
    kids: dict[str, list[int]] = {}
    for i, (path, *_) in enumerate(nodes):
        kids.setdefault(path.rpartition("/")[0], []).append(i)

    def attr(**named: str) -> str:
        return "".join(f" {k}={quoteattr(v)}" for k, v in named.items())

    def words(x: str) -> str:
        return f"<hp:t>{escape(x).replace(chr(10), '<hp:lineBreak/>')}</hp:t>" if x else ""

    def inner(path: str) -> str:
        return "".join(map(one, kids.get(path, [])))

    def one(i: int) -> str:
        path, kind, a, text = nodes[i]
        if kind == "paragraph":
            raw = text.encode("utf-16-le")
            runs = [r.split(":") for r in a.get("runs", "").split("|") if r] or [["0", "0"]]
            ends = [*(int(r[0]) for r in runs[1:]), len(raw) // 2]
            parts = [f"<hp:run{attr(charPrIDRef=s)}>{words(raw[2 * int(b) : 2 * e].decode('utf-16-le'))}" for (b, s), e in zip(runs, ends)]
            return f"<hp:p{attr(id=str(i), paraPrIDRef=a.get('para', '0'), styleIDRef=a.get('style', '0'), pageBreak=a.get('page_break', '0'))}>" + "</hp:run>".join(parts) + inner(path) + "</hp:run></hp:p>"
        if kind == "table":
            rows: dict[int, list[int]] = {}
            for c in kids.get(path, []):
                rows.setdefault(int(nodes[c][2]["row"]), []).append(c)
            body = "".join("<hp:tr>" + "".join(map(one, cells)) + "</hp:tr>" for _, cells in sorted(rows.items()))
            return f"<hp:tbl{attr(rowCnt=a['rows'], colCnt=a['cols'], cellSpacing=a['spacing'], borderFillIDRef=a['border'])}>{body}</hp:tbl>"
        if kind == "cell":
            place = f"<hp:cellAddr{attr(colAddr=a['col'], rowAddr=a['row'])}/><hp:cellSpan{attr(colSpan=a['col_span'], rowSpan=a['row_span'])}/><hp:cellSz{attr(width=a['width'], height=a['height'])}/>"
            return f"<hp:tc{attr(borderFillIDRef=a['border'])}><hp:subList>{inner(path)}</hp:subList>{place}</hp:tc>"
        size = f"<hp:curSz{attr(width=a['width'], height=a['height'])}/>" if "width" in a else ""
        return f"<hp:pic>{size}<hc:img{attr(binaryItemIDRef=a['bin'])}/></hp:pic>"

    spaces = "".join(f' xmlns:{k}="{v}"' for k, v in NAMESPACES.items())
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><hs:sec{spaces}>{inner("")}</hs:sec>'.encode()


def parts(files: DataFrame) -> DataFrame:
    """(doc_id, name, bytes) of files(doc_id, content): one row for each part. What isn't a package raises an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0), b.column(1)):
                # A part leaves on its own and isn't copied: the next one is inflated once this one is gone.
                for name, body in unzipped(memoryview(content.as_buffer())):
                    held = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(struct.pack("<2i", 0, len(body))), pa.py_buffer(body)])
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([name], pa.string()), held], names=["doc_id", "name", "bytes"])
                    del body, held

    return files.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "content").mapInArrow(lean(work), "doc_id long, name string, bytes binary")


def section_nodes(parts: DataFrame) -> DataFrame:
    """NODE rows of the section parts."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, name, body in zip(*(c.to_pylist() for c in b.columns)):
                number = int(_SECTION.match(name)[1])
                rows.extend((doc, number, i, path, kind, list(attrs.items()), text) for i, (path, kind, attrs, text) in enumerate(nodes_of(body)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["doc_id", "section", "ord", "path", "kind", "attrs", "text"])

    return parts.where(F.col("name").rlike(_SECTION.pattern)).select("doc_id", "name", "bytes").mapInArrow(work, NODE)


def sections(nodes: DataFrame) -> DataFrame:
    """(doc_id, name, bytes): the section parts of NODE rows, one task to a section."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["ord"])
        body = section_xml([(r["path"], r["kind"], dict(r["attrs"] or []), r["text"] or "") for r in rows])
        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "name": [f"Contents/section{key[1].as_py()}.xml"], "bytes": pa.array([body], pa.binary())})

    return nodes.groupBy("doc_id", "section").applyInArrow(work, "doc_id long, name string, bytes binary")


def packages(parts: DataFrame) -> DataFrame:
    """(doc_id, content) of parts(doc_id, name, bytes); the media type part is added where it lacks. Of two parts of one name the first by
    content is taken."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        # Parts are read where they lie; only those of one name are compared.
        held: dict[str, memoryview | bytes] = {}
        for name, body in zip(t.column("name"), t.column("bytes")):
            n, x = name.as_py(), memoryview(body.as_buffer())
            held[n] = x if n not in held else min(held[n], x, key=bytes)
        held.setdefault("mimetype", MIMETYPE)
        out = pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([zip_parts(sorted(held.items(), key=lambda p: p[0]))], pa.binary())})
        if t.nbytes > LARGE:
            trimmed()
        return out

    return parts.groupBy("doc_id").applyInArrow(work, "doc_id long, content binary")


def packages_of(pieces: DataFrame) -> DataFrame:
    """(doc_id, content) of pieces(doc_id, name, place, bytes): a part's pieces follow each other by place and are deflated as they pass, so that no part
    is ever whole; the media type part is added where it lacks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, package, part, at = io.BytesIO(), None, None, None

        def begun(name: str):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            return package.open(info, "w", force_zip64=True)

        def done() -> pa.RecordBatch:
            part.close()
            package.close()
            size = out.tell()
            held = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(struct.pack("<2i", 0, size)), pa.py_buffer(out.getbuffer()[:size])])
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), held], names=["doc_id", "content"])

        for b in batches:
            keys, body = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), b.column(2)
            start = 0
            while start < len(keys):
                key = keys[start]
                stop = next((i for i in range(start + 1, len(keys)) if keys[i] != key), len(keys))
                if at is None or key[0] != at[0]:
                    if at is not None:
                        yield done()
                    out = io.BytesIO()
                    package = zipfile.ZipFile(out, "w")
                    if key[1] != "mimetype":
                        package.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), MIMETYPE)
                    part, at = begun(key[1]), key
                elif key != at:
                    part.close()
                    part, at = begun(key[1]), key
                part.write(b"".join(body.slice(start, stop - start).to_pylist()))
                start = stop
        if at is not None:
            yield done()

    own = pieces.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "name", "place", "coalesce(bytes, X'') AS bytes").repartition(parts_of(pieces.sparkSession), "doc_id")
    return own.sortWithinPartitions("doc_id", F.col("name") != "mimetype", "name", "place", "bytes").select("doc_id", "name", "bytes").mapInArrow(lean(work), "doc_id long, content binary")
