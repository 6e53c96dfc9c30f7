"""Operators over plain documents: paragraphs with positional ids, record lines, headings, chapters and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import atx_level, atx_text, clean_lines, cleaned_heading_level, escape_html, escape_record, visible


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, path, text): one row for each line, with its positional id. A null text has no lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")).select("doc_id", "seq", F.concat(F.lit("par-s0-p"), F.col("seq").cast("string")).alias("path"), "text")


def record_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, records): each paragraph a PARAGRAPH line with id and heading level, and a TEXT line if it has text.

    A document's lines never leave its row: no shuffle, however long the text. Lines are cleaned once, before any of them is read."""

    def record(line: Column, i: Column) -> Column:
        level = cleaned_heading_level(line)
        head = F.concat(F.lit("PARAGRAPH[id=par-s0-p"), i.cast("string"), F.coalesce(F.concat(F.lit(",level="), level.cast("string")), F.lit("")), F.lit("]"))
        return F.concat(head, F.when(line != "", F.concat(F.lit("\nTEXT: "), escape_record(line))).otherwise(""))

    lines = F.col("lines")
    own = docs.select("doc_id", clean_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    return own.select("doc_id", F.size(lines).alias("n_paragraphs"), F.concat(F.lit("SECTION[id=sec-0]\n"), F.array_join(F.transform(lines, record), "\n"), F.lit("\n")).alias("records"))


def parsed_records(records: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, attrs, body) of records(doc_id, records): kind before `[` or `:`, attributes up to the first `]`."""
    lines = records.select("doc_id", F.posexplode(F.split("records", "\n")).alias("line_no", "line")).where("line <> ''")
    return lines.select("doc_id", "line_no", F.regexp_extract("line", "^([A-Z_]+(?: TABLE)?)", 1).alias("kind"), attributes(F.col("line")).alias("attrs"), text_body(F.col("line")).alias("body"))


def record_counts(records: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, texts, characters) of records(doc_id, records): PARAGRAPH and TEXT lines, and the length of all text as
    written. A document's lines stay in its row: no shuffle."""
    lines = records.select("doc_id", F.split(F.coalesce("records", F.lit("")), "\n").alias("lines"))
    headed = F.filter("lines", lambda x: x.rlike(r"^PARAGRAPH(?![A-Z_])"))
    parsed = lines.select("doc_id", F.size(headed).cast("long").alias("paragraphs"), F.filter(F.transform("lines", text_body), lambda x: x.isNotNull()).alias("bodies"))
    return parsed.select("doc_id", "paragraphs", F.size("bodies").cast("long").alias("texts"), F.aggregate("bodies", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("characters"))


def attributes(line: Column) -> Column:
    """The map of `KIND[k=v,k=v]`; what lies after the first `]` doesn't count, nor does a part without `=`."""
    inside = F.regexp_extract(line, r"^[^\[:]*\[([^\]]*)", 1)
    parts = F.transform(F.filter(F.split(inside, ","), lambda p: p.contains("=")), lambda p: F.split(p, "=", 2))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("key"), F.trim(F.get(p, F.lit(1))).alias("value"))))


def text_body(line: Column) -> Column:
    """Of `TEXT: x`, `TEXT:`, `TEXT[..]: x` and `TEXT[..]:`, x or the empty text; null for other lines."""
    return F.when(line.rlike(r"^TEXT(?:\[[^\]]*\])?:"), F.regexp_extract(line, r"^TEXT(?:\[[^\]]*\])?: ?(.*)$", 1))


def resolved_headings(lines: DataFrame) -> DataFrame:
    """Adds level and plain: an explicit level above 0 wins, else a run of up to six `#` before a space, which then goes."""
    explicit = F.col("level") > 0
    return lines.withColumns({"resolved": F.when(explicit, F.col("level")).otherwise(F.coalesce(atx_level(F.col("text")), F.lit(0))), "plain": F.when(explicit, F.col("text")).otherwise(atx_text(F.col("text")))})


def chapter_depth(lines: DataFrame) -> DataFrame:
    """Adds depth: the level of the last heading at or before each line of its document, 0 before the first."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("depth", F.coalesce(F.last("level", ignorenulls=True).over(w), F.lit(0)))


def chapter_depths(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, depth) of whole texts, as chapter_depth of their lines: each row parts its lines at its headings, so there is
    neither shuffle nor window. A null text has no lines."""
    lines = docs.where("text IS NOT NULL").select("doc_id", clean_lines(F.col("text")).alias("lines"))
    place = lambda x, i: F.struct(i.alias("at"), cleaned_heading_level(x).alias("level"))
    marks = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("level"))), F.filter(F.transform("lines", place), lambda h: h["level"].isNotNull()))
    marked = lines.select("doc_id", F.size("lines").alias("n"), marks.alias("marks"))
    last = lambda i: F.coalesce(F.get("marks", i + 1)["at"], F.col("n")) - 1
    spans = F.filter(F.transform("marks", lambda h, i: F.struct(h["at"].alias("first"), last(i).alias("last"), h["level"].alias("depth"))), lambda s: s["last"] >= s["first"])
    return marked.select("doc_id", F.inline(spans)).select("doc_id", F.explode(F.sequence("first", "last")).alias("seq"), "depth")


def chapter_html(docs: DataFrame) -> DataFrame:
    """(doc_id, html) of whole texts: headings open chapters, nested sections that end at the next heading of their level or a lower one; lines below a heading
    are indented by its level. Lines that show nothing leave nothing; a null text is an empty document.

    A text's headings are folded over a stack of open levels, in the row that holds it: no shuffle, and lines are only gathered by chapter."""
    mark = "struct<at:int,level:int>"
    own = docs.select("doc_id", clean_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    heads = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), cleaned_heading_level(x).alias("level")).cast(mark)), lambda h: h["level"].isNotNull())
    own = own.withColumn("heads", heads)
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("closes"))

    def step(acc: Column, h: Column) -> Column:
        kept = F.filter(acc["open"], lambda lv: lv < h["level"])
        return F.struct(F.concat(kept, F.array(h["level"])).alias("open"), F.concat(acc["closes"], F.array(F.size(acc["open"]) - F.size(kept))).alias("closes"))

    own = own.withColumn("stack", F.aggregate("heads", start, step))
    number = lambda i: i.cast("string")

    def element(x: Column, i: Column, tag: Column, indent: Column) -> Column:
        style = F.when(indent > 0, F.concat(F.lit(' style="padding-left:'), number(indent), F.lit('em"'))).otherwise("")
        return F.when(visible(x) != "", F.concat(F.lit("<"), tag, F.lit(' id="par-s0-p'), number(i), F.lit('"'), style, F.lit(">"), escape_html(x), F.lit("</"), tag, F.lit(">\n"))).otherwise("")

    def body(first: Column, stop: Column, level: Column) -> Column:
        """Lines from first to before stop, none of them a heading."""
        rows = F.slice("lines", first + 1, F.greatest(stop - first, F.lit(0)))
        return F.array_join(F.transform(rows, lambda x, i: element(x, first + i, F.lit("p"), level)), "")

    def chapter(h: Column, i: Column) -> Column:
        close = F.repeat(F.lit("</section>\n"), F.get("stack.closes", i))
        open_ = F.concat(F.lit('<section class="chapter lv-'), number(h["level"]), F.lit('" id="sec-s0-p'), number(h["at"]), F.lit('">\n'))
        title = element(F.get("lines", h["at"]), h["at"], F.concat(F.lit("h"), number(h["level"])), h["level"] - 1)
        return F.concat(close, open_, title, body(h["at"] + 1, F.coalesce(F.get("heads", i + 1)["at"], F.size("lines")), h["level"]))

    lead = body(F.lit(0), F.coalesce(F.get("heads", F.lit(0))["at"], F.size("lines")), F.lit(0))
    whole = F.concat(F.lit('<article>\n<section id="sec-0">\n'), lead, F.array_join(F.transform("heads", chapter), ""), F.repeat(F.lit("</section>\n"), F.size("stack.open") + 1), F.lit("</article>\n"))
    return own.select("doc_id", whole.alias("html"))


def run_bounds(runs: DataFrame) -> DataFrame:
    """(par, start, stop, char_shape_id): equal neighbours are one run, and a run ends where the next begins, the last at null."""
    w = Window.partitionBy("par").orderBy("start")
    first = F.lag("char_shape_id").over(w)
    kept = runs.withColumn("_before", first).where(F.col("_before").isNull() | (F.col("_before") != F.col("char_shape_id"))).drop("_before")
    return kept.withColumn("stop", F.lead("start").over(w)).select("par", "start", "stop", "char_shape_id")


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, blank, characters, utf16_units, widest) of each document's lines, in its own row."""
    text = F.coalesce("text", F.lit(""))
    total = lambda f: F.aggregate(F.transform("lines", f), F.lit(0), lambda a, x: a + x)
    own = docs.select("doc_id", F.split(text, "\n").alias("lines"), clean_lines(text).alias("cleaned"))
    return own.select(
        "doc_id", F.size("lines").alias("paragraphs"), F.size(F.filter("cleaned", lambda x: x == "")).alias("blank"), total(F.length).alias("characters"),
        total(lambda x: (F.octet_length(F.encode(x, "UTF-16LE")) / 2).cast("int")).alias("utf16_units"), F.array_max(F.transform("lines", F.length)).alias("widest"),
    )
