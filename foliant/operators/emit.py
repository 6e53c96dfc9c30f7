"""Documents as text: node rows (see sources.packages) to Markdown, to addressable record lines and to HTML.

Text is made bottom-up by depth: cells take their paragraphs, tables their cells, the document its top-level blocks. Each level is one
aggregate over (doc_id, section, parent), so nothing larger than a table's row list is held at once until the final text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import clean_text, escape_cell, escape_html, escape_record, text_heading_level


def _joined(order: str, text: Column, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("x")))), lambda p: p["x"]), by)


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent (path), depth (number of steps) and the plain text."""
    return nodes.withColumns({"parent": F.regexp_replace("path", "/?[^/]*$", ""), "depth": F.size(F.split("path", "/")), "plain": clean_text(F.coalesce("text", F.lit("")))})


def _cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, section, tbl, row, col, col_span, row_span, text) of the cells of top-level tables; text is that of the cell's own paragraphs."""
    n = with_parents(nodes)
    keys = ["doc_id", "section"]
    inner = n.where("kind = 'paragraph' AND depth > 1").groupBy(*keys, F.col("parent").alias("path")).agg(_joined("ord", F.col("plain"), " ").alias("text"))
    at = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)).try_cast("int"), F.lit(0)).alias(k)
    cells = n.where("kind = 'cell' AND depth = 3").select(*keys, "path", F.col("parent").alias("tbl"), *[at(k) for k in ("row", "col", "row_span", "col_span")])
    return cells.join(inner, [*keys, "path"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def _blocks(nodes: DataFrame, paragraph: Column, cell: Column, row: tuple[str, str, str], table: tuple[str, str], first: Column | None = None) -> DataFrame:
    """(doc_id, section, ord, block) of top-level paragraphs and tables, by templates."""
    n = with_parents(nodes)
    keys = ["doc_id", "section"]
    lines = _cells(nodes).groupBy(*keys, "tbl", "row").agg(F.concat(F.lit(row[0]), _joined("col", cell, row[1]), F.lit(row[2])).alias("line"), F.sum(F.greatest("col_span", F.lit(1))).alias("width"))
    if first is not None:
        lines = lines.withColumn("line", F.when(F.col("row") == 0, F.concat("line", first)).otherwise(F.col("line")))
    made = lines.groupBy(*keys, F.col("tbl").alias("path")).agg(F.concat(F.lit(table[0]), _joined("row", F.col("line"), ""), F.lit(table[1])).alias("block"))
    tables = n.where("kind = 'table' AND depth = 2").select(*keys, "ord", "path").join(made, [*keys, "path"]).select(*keys, "ord", "block")
    return n.where("kind = 'paragraph' AND depth = 1 AND plain <> ''").select(*keys, "ord", paragraph.alias("block")).unionByName(tables)


def _document(blocks: DataFrame, by: str, column: str) -> DataFrame:
    whole = F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "block"))), lambda b: b["block"])
    return blocks.groupBy("doc_id").agg(F.array_join(whole, by).alias(column))


def to_markdown(nodes: DataFrame) -> DataFrame:
    """(doc_id, markdown): headings by their number prefix, tables as pipe rows with the first as head; blank paragraphs leave nothing."""
    level = text_heading_level(F.col("plain"))
    paragraph = F.concat(F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).otherwise(F.lit("")), "plain")
    cell = F.concat(escape_cell(F.col("text")), F.repeat(F.lit(" |"), F.greatest(F.col("col_span"), F.lit(1)) - 1))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width").cast("int")), F.lit("\n"))
    return _document(_blocks(nodes, paragraph, cell, ("| ", " | ", " |\n"), ("", ""), rule), "\n\n", "markdown")


def to_html(nodes: DataFrame) -> DataFrame:
    """(doc_id, html): an article of h1 to h6, p and table elements, with spans."""
    level = text_heading_level(F.col("plain"))
    tag = F.coalesce(F.concat(F.lit("h"), level.cast("string")), F.lit("p"))
    paragraph = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("plain")), F.lit("</"), tag, F.lit(">"))
    span = lambda k, a: F.when(F.col(k) > 1, F.concat(F.lit(f' {a}="'), F.col(k).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    cell = F.concat(F.lit("<td"), span("row_span", "rowspan"), span("col_span", "colspan"), F.lit(">"), escape_html(F.col("text")), F.lit("</td>"))
    out = _document(_blocks(nodes, paragraph, cell, ("<tr>", "", "</tr>"), ("<table>", "</table>")), "", "body")
    return out.select("doc_id", F.concat(F.lit("<article>"), "body", F.lit("</article>")).alias("html"))


def to_records(nodes: DataFrame) -> DataFrame:
    """(doc_id, records): a line for each node with its path as id and its attributes, and a TEXT line for each text."""
    n = nodes.withColumn("plain", F.coalesce("text", F.lit("")))
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))), lambda e: F.concat(F.lit(","), e["key"], F.lit("="), e["value"])), "")
    line = F.concat(F.upper("kind"), F.lit("[id=s"), F.col("section").cast("string"), F.lit("-"), F.replace(F.col("path"), F.lit("/"), F.lit("-")), attrs, F.lit("]"), F.when(F.col("plain") != "", F.concat(F.lit("\nTEXT: "), escape_record(F.col("plain")))).otherwise(F.lit("")))
    return _document(n.select("doc_id", "section", "ord", line.alias("block")), "\n", "records")


def document_summary(nodes: DataFrame) -> DataFrame:
    """(doc_id, sections, paragraphs, tables, cells, pictures): counts by kind, with partial aggregation."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return nodes.groupBy("doc_id").agg(F.count_distinct("section").alias("sections"), kind("paragraph").alias("paragraphs"), kind("table").alias("tables"), kind("cell").alias("cells"), kind("picture").alias("pictures"))
