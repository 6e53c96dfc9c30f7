"""Tables inside tables, to any depth, without a loop over levels.

A node's path names all its ancestors (p3/t0/c1/p0/t1 ..), so rows sorted by path are met as the tree is walked, and what a node needs of its ancestors
is carried along on a stack. Rows are dealt out in ranges of that order; the few ancestors of a range's first row come to it from the ranges before. Order
is an array of numbers, one for each step of the path, with a cell's row and column in place of its number; arrays that share a beginning sort as the
tree is walked, and so do the bytes that stand for them. A document is then written as events, what opens and what closes at a node's place, sorted by
these bytes across all tasks, joined to pieces where they lie and gathered as pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import clean_text, escape_html, has_visible_body, text_heading_level
from foliant.operators import tables as T
from foliant.operators.styling import KEYS, paragraph_style
from foliant.sources.files import shared_folder
from foliant.spark import batched, lean, parts_of

#: A row's share of the numbers that order a table's cells, and the number after all of a node's children.
ROW, LAST = 1 << 20, 1 << 60
#: Paragraphs whose text counts for a table's topic, and the characters of a list item's text that fit into its line.
TOPIC_BUDGET, INLINE = 64, 200
#: Characters after which a piece of a document is complete.
PIECE = 1 << 20
_NUMBER = re.compile(r"[+-]?[0-9]+")


def _attr(name: str, default: int, least: int = 0) -> Column:
    return F.greatest(F.coalesce(F.try_element_at("attrs", F.lit(name)).try_cast("int"), F.lit(default)), F.lit(least))


def prefixes(path: Column, kind: str) -> Column:
    """The path's prefixes that end in a step of the kind (p, t or c), itself included, outermost first, as (level, prefix)."""
    steps = F.split(path, "/")
    all_ = F.transform(steps, lambda s, i: F.struct((i + 1).alias("level"), F.array_join(F.slice(steps, 1, i + 1), "/").alias("prefix"), s.alias("s")))
    return F.transform(F.filter(all_, lambda x: F.startswith(x["s"], F.lit(kind))), lambda x: F.struct(x["level"].alias("level"), x["prefix"].alias("prefix")))


def _shared(df: DataFrame) -> DataFrame:
    """Written and read again, since several of the events of a document are made from it; a plan that held it anew each time would double with every join."""
    folder = shared_folder(df.sparkSession, "shared")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def carried(rows: DataFrame, value: Column, make: Callable[[tuple | None, str, object, int], tuple], fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """rows(doc_id, section, path, ..) with the fields (DDL and Arrow type by name) that make(above, rest, value, section) gives of a row: above is what it
    gave the nearest ancestor whose value isn't null, rest the path after that one's. Rows of one path have what its first one with a value has;
    rows without section or path are left out."""
    order = ["doc_id", "section", "_walked"]
    named = rows.where("section IS NOT NULL AND path IS NOT NULL").withColumns({"_value": value, "_walked": F.translate("path", "/", "\x01")})
    dealt = named.repartitionByRange(parts_of(rows.sparkSession), *order).sortWithinPartitions(*order, F.col("_value").isNull()).drop("_walked")
    own = dealt.withColumns({"_range": F.spark_partition_id(), "_first": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0}).persist(StorageLevel.MEMORY_AND_DISK)
    steps = F.split("path", "/")
    firsts = own.where("_first").select(F.col("_range").alias("_r"), F.col("doc_id").alias("_d"), F.col("section").alias("_s"), F.explode(F.transform(F.slice(steps, F.lit(1), F.size(steps) - 1), lambda s, i: F.array_join(F.slice(steps, 1, i + 1), "/"))).alias("_p"))
    met = own.where("_value IS NOT NULL").join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("section") == F.col("_s")) & (F.col("path") == F.col("_p")))
    above = met.groupBy("_r").agg(F.array_sort(F.collect_list(F.struct(F.length("path").alias("n"), F.col("path").alias("path"), F.col("_value").alias("value")))).alias("_above"))
    met = own.join(F.broadcast(above), F.col("_range") == F.col("_r"), "left").withColumn("_above", F.when(F.col("_first"), F.col("_above")))
    kept = [c for c in rows.columns]
    met = met.select(*kept, "_value", "_above")
    names, kinds = list(fields), [k for _, k in fields.values()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, tuple]] = []
        at = None

        def given(path: str, val: object, section: int) -> tuple:
            while stack and not (path.startswith(stack[-1][1]) or path == stack[-1][0]):
                stack.pop()
            if stack and path == stack[-1][0]:
                return stack[-1][2]
            out = make(stack[-1][2], path[len(stack[-1][1]) :], val, section) if stack else make(None, path, val, section)
            if val is not None:
                stack.append((path, path + "/", out))
            return out

        for b in batches:
            column = lambda n: b.column(b.schema.get_field_index(n)).to_pylist()  # noqa: B023, E731
            made = []
            for doc, section, path, val, before in zip(*map(column, ("doc_id", "section", "path", "_value", "_above"))):
                if (doc, section) != at or before is not None:
                    at = doc, section
                    stack.clear()
                    for x in before or []:
                        given(x["path"], x["value"], section)
                made.append(given(path, val, section))
            new = [pa.array(c, k) for c, k in zip(zip(*made), kinds)] if made else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *new], names=[*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"`{n}` {d}" for n, (d, _) in fields.items())])
    return met.mapInArrow(lean(work), schema)


def _number(token: str) -> int | None:
    n = int(token[1:].strip()) if _NUMBER.fullmatch(token[1:].strip()) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def _bytes(n: int | None) -> bytes:
    """A number so that bytes sort as numbers do, none first, and none's bytes begin another's."""
    if n is None:
        return b"\x00"
    if n < 0:
        return b"\x7f" + n.to_bytes(8, "big", signed=True)
    size = max(1, (n.bit_length() + 7) // 8)
    return bytes([0x80 + size]) + n.to_bytes(size, "big")


def _coded(n: Column) -> Column:
    """The same of a column."""
    raw = F.unhex(F.hex(n.cast("bigint")))
    return F.coalesce(F.when(n < 0, F.concat(F.lit(b"\x7f"), raw)).otherwise(F.concat(F.unhex(F.hex(F.octet_length(raw) + 0x80)), raw)), F.lit(b"\x00"))


def _placed(above: tuple | None, rest: str, cell: dict | None, section: int) -> tuple:
    key, sort, place = above if above else ([section], _bytes(section), f"s{section}")
    steps = rest.split("/")
    numbers, tokens = [], []
    for i, s in enumerate(steps):
        n = _number(s)
        if not s.startswith("c"):
            numbers.append(n or 0)
            tokens.append("c" + s[1:] if s.startswith("t") else s)
        elif cell is not None and i == len(steps) - 1:
            numbers.append(cell["row"] * ROW + cell["col"] + 1)
            tokens.append(f"r{cell['row']}c{cell['col']}")
        else:
            numbers.append(None if n is None else n + 1)
            tokens.append(s)
    return key + numbers, sort + b"".join(map(_bytes, numbers)), "-".join([place, *tokens])


def with_places(nodes: DataFrame) -> DataFrame:
    """Adds key (array<bigint>, order in the tree), sort (bytes of the same order), place (the id's end: `s0-p3-c0-r1c2-p0`), parent and depth (steps of the
    path). Cells stand by row and column, then by number. Nodes of a path that isn't unique in its section keep what their path gives."""
    cell = F.when((F.col("kind") == "cell") & F.col("path").rlike("(^|/)c[^/]*$"), F.struct(_attr("row", 0).alias("row"), _attr("col", 0).alias("col")))
    out = carried(nodes, cell, _placed, {"key": ("array<bigint>", pa.list_(pa.int64())), "sort": ("binary", pa.binary()), "place": ("string", pa.string())})
    return out.withColumns({"parent": F.regexp_replace("path", "/?[^/]*$", ""), "depth": F.size(F.split("path", "/"))})


def table_corpora(nodes: DataFrame, budget: int = TOPIC_BUDGET) -> DataFrame:
    """(doc_id, section, path, corpus) of every table at any depth: the texts of its cells' paragraphs and of the tables in them, each ended by a line feed.

    A paragraph of the table itself counts if it is among the first `budget`; the table in a paragraph gets what the budget has left after that
    paragraph, and the table's own later paragraphs don't pay for it. So a paragraph counts if its rank among its table's paragraphs and the ranks of
    the paragraphs that hold it, up to the table, add up to no more than the budget."""
    placed = with_places(nodes)
    own = placed.where("kind = 'paragraph' AND depth > 1").select(*KEYS, F.regexp_replace("parent", "/[^/]*$", "").alias("_table"), F.col("sort").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "section", "_table").orderBy("key")))

    def paid(above: tuple | None, rest: str, value: dict, section: int) -> tuple:
        """From the paragraph outward: the tables that hold it and the ranks up to each, as far as the budget goes."""
        held = [{"root": value["tbl"], "paid": value["rank"]}, *({"root": x["root"], "paid": x["paid"] + value["rank"]} for x in (above[0] if above else []))]
        return ([x for x in held if x["paid"] <= budget],)

    kind = pa.list_(pa.struct([("root", pa.string()), ("paid", pa.int64())]))
    lines = carried(ranked, F.struct(F.col("_table").alias("tbl"), "rank"), paid, {"roots": ("array<struct<root:string,paid:bigint>>", kind)}).select("doc_id", "section", F.explode("roots.root").alias("path"), "key", "text")
    made = lines.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("corpus"))
    tables = nodes.where("kind = 'table'").select(*KEYS)
    return tables.join(made, KEYS, "left").select(*KEYS, F.coalesce("corpus", F.lit("")).alias("corpus"))


def any_nested(nodes: DataFrame, flagged: DataFrame, levels: int = 1) -> DataFrame:
    """(doc_id, section, path, found) of every table: whether it, or a table at most `levels` tables inside it, is in flagged(doc_id, section, path)."""
    up = flagged.select(*KEYS, prefixes(F.col("path"), "t").alias("ts"))
    near = up.select("doc_id", "section", F.explode(F.slice("ts", F.greatest(F.size("ts") - levels, F.lit(1)), F.lit(levels + 1))).alias("t")).select("doc_id", "section", F.col("t.prefix").alias("path"), F.lit(True).alias("found")).distinct()
    return nodes.where("kind = 'table'").select(*KEYS).join(near, KEYS, "left").select(*KEYS, F.coalesce("found", F.lit(False)).alias("found"))


# Writing


def _written(events: DataFrame, column: str, before: str = "", after: str = "") -> DataFrame:
    """(doc_id, column) of events(doc_id, key, text): sorted across all tasks and joined to pieces there, so that only a document's pieces meet in one row."""
    kind = events.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, held, size, i = None, [], 0, 0
        for b in batches:
            for doc, part, text in zip(*(c.to_pylist() for c in b.columns)):
                if held and (size > PIECE or doc != at):
                    yield at, part, i, "".join(held)
                    held, size, i = [], 0, i + 1
                at = doc
                held.append(text or "")
                size += len(held[-1])
                last = part
        if held:
            yield at, last, i, "".join(held)

    own = events.repartitionByRange(parts_of(events.sparkSession), "doc_id", "key").sortWithinPartitions("doc_id", "key", "text").select("doc_id", F.spark_partition_id().alias("part"), "text")
    doc = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    work = lambda batches: batched(pieces(batches), ["doc_id", "part", "i", "piece"], (doc, pa.int32(), pa.int32(), pa.string()), 8)
    joined = own.mapInArrow(lean(work), f"doc_id {kind}, part int, i int, piece string")
    whole = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "i", "piece"))).alias("all"))
    return whole.select("doc_id", F.array_join(F.concat(F.array(F.lit(before)), F.col("all.piece"), F.array(F.lit(after))), "").alias(column))


def _last(key: Column) -> Column:
    return F.concat(key, _coded(F.lit(LAST)))


def chapters(paragraphs: DataFrame, levels: int = 6) -> DataFrame:
    """Adds closes (chapters that end before the paragraph), open_after (chapters open once it is written) and level_here (the level of the last heading, 0 before
    the first) to paragraphs(doc_id, section, key, level): level 1 to `levels` of a heading, else null.

    A heading ends the open chapters of its level and deeper ones. Chapter l is open where the last heading of level l stands after the last
    one of each lower level; so the stack is read off the last places of the few levels, which one window carries along."""
    before = Window.partitionBy("doc_id", "section").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("doc_id", "section").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # key ends in the paragraph's number; places are compared as they are.
    last = lambda lv, w: F.last(F.when(F.col("level") == lv, F.col("key")), ignorenulls=True).over(w)
    own = paragraphs.withColumns({f"_b{lv}": last(lv, before) for lv in range(1, levels + 1)} | {f"_h{lv}": last(lv, here) for lv in range(1, levels + 1)} | {"level_here": F.coalesce(F.last("level", ignorenulls=True).over(here), F.lit(0))})

    def open_(lv: int, of: str) -> Column:
        out = F.col(f"{of}{lv}").isNotNull()
        for lower in range(1, lv):
            out = out & (F.col(f"{of}{lower}").isNull() | (F.col(f"{of}{lower}") < F.col(f"{of}{lv}")))
        return out

    closes = sum(((open_(lv, "_b") & (F.col("level") <= lv)).cast("int") for lv in range(1, levels + 1)), F.lit(0))
    left = sum((open_(lv, "_h").cast("int") for lv in range(1, levels + 1)), F.lit(0))
    return own.withColumns({"closes": F.when(F.col("level").isNotNull(), closes).otherwise(0), "open_after": left}).drop(*(f"_{w}{lv}" for w in "bh" for lv in range(1, levels + 1)))


def to_html_tree(nodes: DataFrame, styled: DataFrame | None = None, aligns: DataFrame | None = None) -> DataFrame:
    """(doc_id, html): an article of sections, chapters as nested sections, headings, paragraphs and tables to any depth.

    styled(doc_id, section, path, html) has the paragraphs' inner HTML (operators.styling), else their clean text is shown; aligns(doc_id, section, path,
    align) their alignment. A column `level` of the nodes gives the headings' levels (1 to 6), else number prefixes do. What follows a heading is
    indented by its level. Paragraphs that show nothing leave nothing; other kinds of nodes aren't written."""
    placed = _shared(with_places(nodes).drop("key").withColumnRenamed("sort", "key"))
    plain = escape_html(clean_text(F.coalesce("text", F.lit(""))))
    for extra, column in ((styled, "html"), (aligns, "align")):
        if extra is not None:
            placed = placed.join(extra.select(*KEYS, F.col(column).alias(f"_{column}")), KEYS, "left")
    body = F.coalesce("_html", plain) if styled is not None else plain
    align = F.col("_align") if aligns is not None else F.lit(None).cast("int")
    texts = placed.where("kind = 'paragraph'").select(*KEYS, "key", "place", "parent", "depth", body.alias("body"), align.alias("align"), (F.col("level") if "level" in nodes.columns else text_heading_level(F.coalesce("text", F.lit("")))).cast("int").alias("level"))
    texts = texts.withColumn("seen", has_visible_body(F.col("body")))

    top = chapters(texts.where("depth = 1"))
    indent = F.when(F.col("level").isNotNull(), F.greatest(F.col("level") - 1, F.lit(0))).otherwise(F.col("level_here"))
    tag = F.when(F.col("level").isNotNull(), F.concat(F.lit("h"), F.greatest(F.least("level", F.lit(6)), F.lit(1)).cast("string"))).otherwise("p")
    block = F.when(F.col("seen"), F.concat(F.lit("<"), tag, F.lit(' id="par-'), "place", F.lit('"'), paragraph_style(indent, F.col("align")), F.lit(">"), "body", F.lit("</"), tag, F.lit(">\n"))).otherwise("")
    opening = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("</section>\n"), F.col("closes")), F.lit('<section class="chapter lv-'), F.col("level").cast("string"), F.lit('" id="sec-'), "place", F.lit('">\n'))).otherwise("")
    events = top.select("doc_id", "key", F.concat(opening, block).alias("text"))
    ends = top.groupBy("doc_id", "section").agg(F.max_by("open_after", "key").alias("open"))
    number = F.col("section").cast("bigint")
    events = events.unionByName(ends.select("doc_id", _coded(number).alias("key"), F.concat(F.lit('<section id="sec-'), F.col("section").cast("string"), F.lit('">\n')).alias("text")))
    events = events.unionByName(ends.select("doc_id", _last(_coded(number)).alias("key"), F.repeat(F.lit("</section>\n"), F.col("open") + 1).alias("text")))

    # In cells: a line break between paragraphs that show something.
    shown_before = F.coalesce(F.max(F.col("seen").cast("int")).over(Window.partitionBy("doc_id", "section", "parent").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    inner = texts.where("depth > 1").withColumn("later", shown_before).where("seen")
    events = events.unionByName(inner.select("doc_id", "key", F.concat(F.when(F.col("later"), "<br>").otherwise(""), "body").alias("text")))

    # Tables stand as deep as the heading above the paragraph that holds them.
    holders = top.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "level_here")
    tables = placed.where("kind = 'table'").select(*KEYS, "key", "place", "parent", "depth", _attr("rows", 0).alias("rows"))
    held = tables.join(holders, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("section") == F.col("_section")) & (F.col("parent") == F.col("_path")), "left").withColumn("deep", F.coalesce("level_here", F.lit(0)))
    div = F.when(F.col("deep") > 0, F.concat(F.lit('<div class="indent" style="padding-left:'), F.col("deep").cast("string"), F.lit('em">'))).otherwise("")
    events = events.unionByName(held.select("doc_id", "key", F.concat(div, F.lit('<table id="tbl-'), "place", F.lit('">\n')).alias("text")))
    events = events.unionByName(held.select("doc_id", _last(F.col("key")).alias("key"), F.concat(F.lit("</table>\n"), F.when(F.col("deep") > 0, "</div>\n").otherwise("")).alias("text")))
    lines = held.where("rows > 0").select("doc_id", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows").cast("bigint") - 1)).alias("r"))
    events = events.unionByName(lines.select("doc_id", F.concat("key", _coded(F.col("r") * ROW)).alias("key"), F.lit("  <tr>\n").alias("text")))
    events = events.unionByName(lines.select("doc_id", F.concat("key", _coded(F.col("r") * ROW + ROW - 1)).alias("key"), F.lit("  </tr>\n").alias("text")))

    cells = placed.where("kind = 'cell'")
    span = lambda n, a: F.when(_attr(n, 1) > 1, F.concat(F.lit(f' {a}="'), _attr(n, 1).cast("string"), F.lit('"'))).otherwise("")
    events = events.unionByName(cells.select("doc_id", "key", F.concat(F.lit('    <td id="cell-'), "place", F.lit('"'), span("row_span", "rowspan"), span("col_span", "colspan"), F.lit(">")).alias("text")))
    events = events.unionByName(cells.select("doc_id", _last(F.col("key")).alias("key"), F.lit("</td>\n").alias("text")))
    return _written(events, "html", "<article>\n", "</article>\n")


def _cell_facts(placed: DataFrame) -> DataFrame:
    """Cells of all tables: tbl (their table's path), row, col, spans, lines (texts that show something), text, controls and nested (tables inside)."""
    texts = placed.where("kind = 'paragraph' AND depth > 1").select("doc_id", "section", F.col("parent").alias("path"), "key", clean_text(F.coalesce("text", F.lit(""))).alias("x"))
    lines = texts.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "x"))), lambda p: p["x"]).alias("all"))
    inside = placed.where("kind IN ('table', 'picture') AND depth > 2").select("doc_id", "section", F.regexp_replace("parent", "/[^/]*$", "").alias("path"), "kind")
    counts = inside.groupBy(*KEYS).agg(F.count("*").cast("int").alias("controls"), F.count_if(F.col("kind") == "table").cast("int").alias("nested"))
    own = placed.where("kind = 'cell'").select(*KEYS, "key", F.col("parent").alias("tbl"), *(_attr(n, d, d).alias(n) for n, d in (("row", 0), ("col", 0), ("row_span", 1), ("col_span", 1))))
    none = F.array().cast("array<string>")
    joined = own.join(lines, KEYS, "left").join(counts, KEYS, "left").withColumns({"all": F.coalesce("all", none), "controls": F.coalesce("controls", F.lit(0)), "nested": F.coalesce("nested", F.lit(0))})
    flat = F.filter(F.transform("all", lambda x: F.replace(x, F.lit("\n"), F.lit(" "))), lambda x: x != "")
    return joined.withColumns({"lines": flat, "text": F.array_join("all", " ")}).drop("all")


def to_markdown_tree(nodes: DataFrame, styled: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): top-level paragraphs as headings and text; tables as pipe grids where they are plain grids, as a heading or a passage where
    they only frame one, else as lists whose items hold the tables inside them, to any depth.

    styled(doc_id, section, path, markdown) has the top-level paragraphs' text. A cell that only wraps one table leaves that table in its own table's
    place. Item texts are joined by ` · ` up to INLINE characters, else each is an item below; two or more plain empty cells side by side are one item."""
    placed = _shared(with_places(nodes).drop("key").withColumnRenamed("sort", "key"))
    if styled is not None:
        placed = placed.join(styled.select(*KEYS, F.col("markdown").alias("_m")), KEYS, "left")
    shown = F.coalesce("_m", clean_text(F.coalesce("text", F.lit("")))) if styled is not None else clean_text(F.coalesce("text", F.lit("")))
    level = F.col("level") if "level" in nodes.columns else text_heading_level(F.coalesce("text", F.lit("")))
    top = placed.where("kind = 'paragraph' AND depth = 1").select("doc_id", "key", shown.alias("x"), level.cast("int").alias("level")).where("x <> ''")
    events = top.select("doc_id", "key", F.concat(F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).otherwise(""), "x", F.lit("\n\n")).alias("text"))

    named = lambda df: df.withColumn("_t", F.to_json(F.struct("doc_id", "section", "tbl"))).drop("tbl").withColumnRenamed("_t", "tbl")
    cells = _cell_facts(placed)
    tables = placed.where("kind = 'table'").select("doc_id", "section", "key", F.col("path").alias("tbl"), _attr("rows", 0).alias("rows"), _attr("cols", 0).alias("cols"))
    wraps = cells.groupBy("doc_id", "section", "tbl").agg((F.count("*") == 1).alias("one"), F.sum(F.size("lines")).alias("n"), F.sum("nested").alias("k"), F.sum("controls").alias("c"))
    wraps = wraps.where("one AND n = 0 AND k = 1 AND c = 1").select(F.col("doc_id").alias("_doc_id"), F.col("section").alias("_section"), F.col("tbl").alias("_wrap"))
    # A table's depth: the tables around it that aren't mere wrappers.
    met = tables.join(wraps, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("section") == F.col("_section")) & (F.col("tbl") == F.col("_wrap")), "left")
    met = met.select("doc_id", "section", F.col("tbl").alias("path"), "key", "rows", "cols", F.col("_wrap").isNotNull().alias("_mere"))

    def inside(above: tuple | None, rest: str, mere: bool, section: int) -> tuple:
        depth = above[1] if above else 0
        return depth, depth + (not mere)

    tables = carried(met, F.col("_mere"), inside, {"depth": ("int", pa.int32()), "_below": ("int", pa.int32())}).withColumnRenamed("path", "tbl").drop("_mere", "_below")
    all_tables, all_cells = _shared(named(tables)), _shared(named(cells))
    forms = T.table_form(all_cells, all_tables).select("tbl", "form", "level", F.col("text").alias("said"))
    grids = T.markdown_grid(all_cells, all_tables)
    how = all_tables.join(forms, "tbl").join(grids, "tbl", "left").select("doc_id", "section", "tbl", "key", "rows", "cols", "depth", "form", "level", "said", "markdown")
    how = _shared(how.withColumn("listed", (F.col("form") == "table") & F.col("markdown").isNull()))
    indent = F.repeat(F.lit("  "), F.col("depth"))
    head = F.concat(indent, F.lit("<!-- table "), F.col("rows").cast("string"), F.lit("×"), F.col("cols").cast("string"), F.lit(" (ragged/merged) -->\n"))
    whole = (
        F.when(F.col("form") == "unwrap", "")
        .when(F.col("form") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "said", F.lit("\n\n")))
        .when(F.col("form") == "passage", F.concat("said", F.lit("\n\n")))
        .otherwise(F.coalesce("markdown", head))
    )
    events = events.unionByName(how.select("doc_id", "key", whole.alias("text")))
    events = events.unionByName(how.where("listed").select("doc_id", _last(F.col("key")).alias("key"), F.lit("\n").alias("text")))

    listed = all_cells.join(how.where("listed").select("tbl", "depth"), "tbl")
    runs = T.empty_runs(listed).select(F.col("tbl").alias("_tbl"), F.col("row").alias("_row"), "first_col", "last_col")
    item = listed.join(runs, (F.col("tbl") == F.col("_tbl")) & (F.col("row") == F.col("_row")) & F.col("col").between(F.col("first_col"), F.col("last_col")), "left").where("first_col IS NULL OR first_col = col")
    inline = F.array_join("lines", " · ")
    below = F.concat(F.lit("\n"), F.array_join(F.transform("lines", lambda x: F.concat(indent, F.lit("  - "), x, F.lit("\n"))), ""))
    said = F.when(F.size("lines") == 0, "\n").when((F.size("lines") == 1) | (F.length(inline) <= INLINE), F.concat(F.lit(" "), inline, F.lit("\n"))).otherwise(below)
    span = F.when((F.col("col_span") != 1) | (F.col("row_span") != 1), F.concat(F.lit(" span "), F.col("row_span").cast("string"), F.lit("×"), F.col("col_span").cast("string"))).otherwise("")
    at = F.concat(indent, F.lit("- ["), F.col("row").cast("string"), F.lit(","), F.col("col").cast("string"))
    line = F.when(F.col("first_col").isNotNull(), F.concat(at, F.lit(".."), F.col("last_col").cast("string"), F.lit("]: (empty)\n"))).otherwise(F.concat(at, F.lit("]"), span, F.lit(":"), said))
    return _written(events.unionByName(item.select("doc_id", "key", line.alias("text"))), "markdown")
