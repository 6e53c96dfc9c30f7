"""Queries of styled text, nested tables, edited tables and chapters, with their SQL. All read the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import attributes as A
from foliant.operators import catalogue as C
from foliant.operators import documents as D
from foliant.operators import edited as E
from foliant.operators import nested as N
from foliant.operators import styling as Y

from . import sql as S
from .registry import query, table

# Styled text: each conversation is a document whose turns have four runs, of the shapes 0 to 11 that a catalogue made from the same rows holds (shapes
# 12 and 13 are in none). Offsets stand at quarters of the text and fall into surrogate pairs and onto each other in short turns.


def styled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, size = F.col("conv_id"), F.col("turn"), F.length("text")
    shape = lambda k: ((c * 3 + n * 5 + k * F.floor(c / 4)) % 14).cast("string")
    at = lambda k: F.floor(size * k / 4).cast("string")
    listed = F.concat_ws("|", *[F.concat_ws(":", at(k), shape(k)) for k in range(4)])
    runs = F.when(n % 5 == 4, F.lit("")).when(n % 5 == 3, F.concat_ws("|", F.concat_ws(":", at(2), shape(0)), F.concat_ws(":", at(1), shape(1)))).otherwise(listed)
    spaced = F.replace("text", F.lit(". "), F.lit(".\u00a0 \ufffc<b>&'\""))
    return table(spark, sf_dir, "conversations").select(c.alias("doc_id"), F.lit(0).alias("section"), n.cast("int").alias("ord"), F.concat(F.lit("p"), n.cast("string")).alias("path"), F.lit("paragraph").alias("kind"), F.create_map(F.lit("runs"), runs, F.lit("para"), (n % 7).cast("string")).alias("attrs"), spaced.alias("text"), (n % 3).cast("int").alias("indent"))


def styled_catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shapes, fonts, paragraph shapes) of the conversations."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    ids, k = own.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("id")), F.col("id")
    bit = lambda name, m: F.when(k % m == 0, F.lit(1 << A.CHAR_BITS[name][0])).otherwise(0)
    shapes = ids.select("doc_id", "id", (bit("strike", 4) + bit("bold", 2) + bit("italic", 3)).alias("attr"), F.when(k % 5 == 0, 1000).otherwise(800 + k * 37 + F.col("doc_id") % 50).alias("height"), F.when(k % 2 == 0, 0).otherwise((F.col("doc_id") * 7919 + k * 65537) % 16777216).alias("color"), F.array((k % 4).cast("int")).alias("fonts"))
    fonts = own.select("doc_id", F.lit("hangul").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx")).withColumn("name", F.when(F.col("idx") == 2, "").otherwise(F.concat(F.lit("O'Font & \\Co "), F.col("idx").cast("string"))))
    return shapes, fonts, own.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("id")).withColumn("align", F.col("id").cast("int"))


@query(S.STYLED)
def styled_text(spark, sf_dir):
    """Turns with their runs as Markdown and as HTML paragraphs with alignment and indent."""
    nodes, (shapes, fonts, paras) = styled_nodes(spark, sf_dir), styled_catalogue(spark, sf_dir)
    html = Y.html_paragraphs(nodes, shapes, paras, fonts).select(*Y.KEYS, "block")
    text = Y.styled_paragraphs(nodes, shapes, fonts).select(*Y.KEYS, "markdown")
    return text.join(html, Y.KEYS, "left").select("doc_id", "path", "markdown", "block")


# Tables in tables: customers as trees of which 15 are roots, documents. Customer k stands in a cell of a table in the paragraph of customer k div 2; every tenth
# holds its two in tables of their own. Cells stand in rows or in columns, some in the other order than they are numbered.


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("k"), F.col("q")
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment", F.concat(F.lit("tel "), F.col("c_nationkey").cast("string")).alias("c_phone"))
    own = own.withColumns({"q": F.floor(k / 2), "up": F.greatest(F.length(F.bin("k")) - 4, F.lit(0))})
    step = lambda q, i: F.when(q % 10 == 5, F.concat(F.lit("/t"), i.cast("string"), F.lit("/c0"))).otherwise(F.concat(F.lit("/t0/c"), i.cast("string")))
    at = lambda j: F.floor(k / F.pow(F.lit(2), F.col("up") - 1 - j)).cast("long")
    down = F.transform(F.when(F.col("up") > 0, F.sequence(F.lit(0), F.col("up") - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.concat(step(F.floor(at(j) / 2), at(j) % 2), F.lit("/p0")))
    own = own.withColumns({"doc_id": F.floor(k / F.pow(F.lit(2), "up")).cast("long"), "path": F.concat(F.lit("p0"), F.array_join(down, ""))})
    cell = F.regexp_replace("path", "/p0$", "")
    i, apart, tall = k % 2, q % 10 == 5, q % 3 == 0
    j = F.when(apart, 0).when(q % 3 == 1, 1 - i).otherwise(i)
    text = F.when(k % 5 == 0, "").when(k % 7 == 0, F.concat(F.lit("2. "), "c_name")).otherwise(F.concat("c_mktsegment", F.lit("  <"), k.cast("string"), F.lit("> & |")))
    nothing = F.create_map().cast("map<string,string>")
    node = lambda df, path, kind, attrs, text: df.select("doc_id", F.lit(0).alias("section"), k.cast("int").alias("ord"), path.alias("path"), F.lit(kind).alias("kind"), attrs.alias("attrs"), text.alias("text"))
    pairs = lambda **kv: F.create_map(*[x for n, v in kv.items() for x in (F.lit(n), v.cast("string"))])
    out = node(own, F.col("path"), "paragraph", nothing, text)
    out = out.unionByName(node(own.where(k % 4 == 1), F.regexp_replace("path", "p0$", "p1"), "paragraph", nothing, F.col("c_phone")))
    inner = own.where("k >= 16")
    out = out.unionByName(node(inner, cell, "cell", pairs(row=F.when(tall, j).otherwise(0), col=F.when(tall, 0).otherwise(j), col_span=F.when((q % 6 == 1) & (j == 1), 2).otherwise(1)), F.lit(None).cast("string")))
    held = inner.where(apart | (i == 0))
    return out.unionByName(node(held, F.regexp_replace(cell, "/c[0-9]$", ""), "table", pairs(rows=F.when(tall & ~apart, 2).otherwise(1), cols=F.when(tall | apart, 1).otherwise(2)), F.lit(None).cast("string")))


@query(S.TREE + S.TREE_CORPUS)
def nested_corpus(spark, sf_dir):
    return N.table_corpora(tree_nodes(spark, sf_dir), 7).select("doc_id", "path", "corpus")


@query(S.TREE + """SELECT t.doc_id, t.path, bool_or(coalesce(o.rows, 0) = 2) AS found FROM tables t LEFT JOIN tables o ON o.doc_id = t.doc_id AND (o.path = t.path OR (o.path LIKE t.path || '/%' AND o.level = t.level + 1)) GROUP BY t.doc_id, t.path""")
def nested_any(spark, sf_dir):
    """Whether a table, or one directly in it, has two rows."""
    nodes = tree_nodes(spark, sf_dir)
    return N.any_nested(nodes, nodes.where("kind = 'table' AND attrs['rows'] = '2'")).select("doc_id", "path", "found")


@query(S.TREE + S.TREE_HTML)
def nested_html(spark, sf_dir):
    return N.to_html_tree(tree_nodes(spark, sf_dir))


@query(S.TREE + S.TREE_MARKDOWN)
def nested_markdown(spark, sf_dir):
    return N.to_markdown_tree(tree_nodes(spark, sf_dir))


# Edited tables: each customer's orders as paragraphs with a table of line items, of which some hold another table; the edit leaves out styles, changes and
# removes cells, adds others, and gives every tenth customer one table more.


def order_nodes(spark: SparkSession, sf_dir: str, edited: bool) -> DataFrame:
    o, n, c = F.col("l_orderkey"), F.col("l_linenumber"), F.col("doc_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    # Line numbers repeat in an order, so lines are numbered anew.
    lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(lines).alias("l_linenumber"), "l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag").join(orders, "l_orderkey")
    pairs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string") if not isinstance(v, str) else F.lit(v))])
    one = lambda path, kind, attrs, text: F.struct(F.lit(0).alias("section"), path.alias("path"), F.lit(kind).alias("kind"), attrs.alias("attrs"), text.alias("text"))
    node = lambda df, *of: df.select("doc_id", F.inline(F.array(one(*of))))
    par, nul = F.concat(F.lit("p"), o.cast("string")), F.lit(None).cast("string")
    cell = lambda i: F.concat(par, F.lit("/t0/c"), (n * 2 + i).cast("string"))
    looks = (lambda x: pairs(style=(x % 5), para=(x % 4), runs=F.concat(F.lit("0:"), (x % 6).cast("string")), page_break=(x % 2))) if not edited else lambda x: pairs(style=F.when(x % 3 == 0, "9").otherwise("0"))
    border = pairs(border=(o % 9 + 1), padding="1,2,3,4", spacing=(o % 3)) if not edited else pairs(border=F.when(o % 4 == 0, "7").otherwise("0"), padding="0,0,0,0")
    said = F.concat("l_returnflag", F.lit(" "), F.col("l_partkey").cast("string"), F.lit("\nmore"))
    if edited:
        said = F.when(n % 2 == 0, F.concat("l_returnflag", F.col("l_partkey").cast("string"))).otherwise(said)
    amount = F.when((F.col("q") > 40) & F.lit(edited), F.col("q") + 1).otherwise(F.col("q")).cast("string")
    # A line's row is dealt out to the nodes made of it, those of its order to the first line's; each then makes only its own columns.
    first, third, kept = n == 1, n % 3 == 0, n < 7 if edited else F.lit(True)
    made = [(first, F.concat(par, F.lit("/t0")), "table", border, nul)]
    for i, text in ((0, said), (1, amount)):
        made += [(kept, cell(i), "cell", pairs(row=n - 1, col=F.lit(i)), nul), (kept, F.concat(cell(i), F.lit("/p0")), "paragraph", looks(n + i), text)]
    made.append((third, F.concat(cell(1), F.lit("/p0/t0")), "table", pairs(border=(n + 2)) if not edited else pairs(border="0"), nul))
    made.append((third, F.concat(cell(1), F.lit("/p0/t0/c0")), "cell", pairs(row="0", col="0"), nul))
    made.append((third, F.concat(cell(1), F.lit("/p0/t0/c0/p0")), "paragraph", looks(n), F.col("l_returnflag")))
    if edited:
        made.append((first & (o % 7 == 0), F.concat(par, F.lit("/t0/c99")), "cell", pairs(row="98", col="0"), nul))
    whens, paths, kinds, attrs, texts = zip(*made)

    def chosen(values):
        out = F
        for i, x in enumerate(values):
            out = out.when(F.col("_i") == i, x)
        return out

    dealt = items.withColumn("_i", F.explode(F.array(*map(F.lit, range(len(made)))))).where(chosen(whens))
    of_lines = dealt.select("doc_id", F.lit(0).alias("section"), chosen(paths).alias("path"), chosen(map(F.lit, kinds)).alias("kind"), chosen(attrs).alias("attrs"), chosen(texts).alias("text"))
    out = of_lines.unionByName(node(orders, par, "paragraph", looks(o), F.col("o_orderpriority")))
    if edited:
        out = out.unionByName(node(orders.where(c % 10 == 3).select("doc_id").distinct(), F.lit("p0/t9"), "table", pairs(border="0"), nul))
    return out


@query(S.EDITED + S.EDITED_CELLS)
def edited_cells(spark, sf_dir):
    """Cells of paired tables that the edit kept, took away or added."""
    own = E.paired_cells(order_nodes(spark, sf_dir, False), order_nodes(spark, sf_dir, True))
    state = F.when(F.col("path").isNull(), "removed").when(F.col("old_path").isNull(), "added").otherwise("kept")
    return own.select("doc_id", "tbl", "row", "col", state.alias("state"))


@query(S.EDITED + S.EDITED_NODES)
def edited_nodes(spark, sf_dir):
    """All nodes of the edit with what they take over from the original."""
    own = E.taken_over(order_nodes(spark, sf_dir, False), order_nodes(spark, sf_dir, True))
    look = [F.try_element_at("attrs", F.lit(n)).alias(n) for n in ("style", "para", "runs", "page_break", "border", "padding", "spacing")]
    return own.select("doc_id", "path", "kind", *look, "text")


# Chapters: the lines of documents, of which every seventh starts with a number of one to four parts


@query(S.CHAPTERS)
def chapter_html(spark, sf_dir):
    doc, part = F.col("doc_id"), lambda i, k: ((i * k + F.col("doc_id")) % 9 + 1).cast("string")
    numbered = lambda x, i: F.when((i + doc) % 7 == 0, F.concat(F.array_join(F.slice(F.array(part(i, 1), part(i, 2), part(i, 3), part(i, 5)), F.lit(1), ((i * 3 + F.floor(i / 7) + doc) % 4 + 1).cast("int")), "."), F.lit(" "), F.substring(x, 1, 60))).otherwise(x)
    return D.chapter_html(table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), numbered), "\n").alias("text")))


# Files: packages and texts with assets made from pages, written by the sink and read again by the source


@query("""SELECT 'd' || page_id || '.zip' AS document, 'Contents/section' || s || '.xml' AS part, octet_length(encode(CASE s WHEN 0 THEN coalesce(html, '') ELSE url END)) AS size,
  md5(CASE s WHEN 0 THEN coalesce(html, '') ELSE url END) AS digest FROM pages, (VALUES (0), (1)) v(s)""")
def parts_read(spark, sf_dir):
    """The sections of packages that also hold an image and settings; only sections are inflated."""
    from foliant.sources import files as L
    from foliant.sources import packages as Z

    L.register(spark)
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"), F.encode("url", "UTF-8").alias("url"))
    part = lambda name, column: F.struct(F.lit(name).alias("name"), F.col(column).alias("bytes"))
    parts = own.select("doc_id", F.inline(F.array(part("Contents/section0.xml", "html"), part("Contents/section1.xml", "url"), part("BinData/image1.png", "html"), part("settings.xml", "url"))))
    folder = L.shared_folder(spark, "packages")
    Z.packages(parts).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("file"), F.col("content").alias("bytes")).write.format("document_files").mode("append").save(folder)
    read = spark.read.format("document_parts").load(folder).where("kind = 'section'")
    return read.select("document", "part", "size", F.md5("bytes").alias("digest"))


@query("""SELECT 'page-' || page_id || '.md' AS file, md5(coalesce(html, '')) AS digest FROM pages
UNION ALL SELECT 'page-' || page_id || '.assets/' || CASE i WHEN 0 THEN 'an-image.png' WHEN 1 THEN 'An-Image~2.png' WHEN 2 THEN 'an-image~3.png' ELSE 'file' END, md5(url || CASE i WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END) FROM pages, (VALUES (0), (1), (2), (3)) v(i)""")
def files_roundtrip(spark, sf_dir):
    """Pages as texts, each with four assets of which three names clash, committed together and read back."""
    from foliant.sources import files as L

    L.register(spark)
    own = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("document"), "html", "url")
    names = F.array(*map(F.lit, ("x/An Image.png", "y\\an image.png", "../an-image.png", "...")))
    assets = own.select("document", "url", F.posexplode(names).alias("i", "name")).select("document", "name", F.encode(F.concat("url", F.col("i").cast("string")), "UTF-8").alias("bytes"))
    folder = L.shared_folder(spark, "texts")
    L.companions(own.select("document", F.col("html").alias("text")), assets).write.format("document_files").mode("append").save(folder)
    return spark.read.format("document_files").load(folder).select("file", F.md5("bytes").alias("digest"))


# Catalogues: parts as the shapes and styles of 25 documents, in two halves of which one is merged into the other


def half_catalogue(spark: SparkSession, sf_dir: str, second: bool) -> dict[str, DataFrame]:
    k, i = F.col("p_partkey"), F.floor(F.col("p_partkey") / 50)
    own = table(spark, sf_dir, "part").where((k % 50 >= 25) == F.lit(second)).select((k % 25).alias("doc_id"), i.alias("id"), k.alias("k"), "p_brand")
    n = F.col("k")
    return {
        "chars": own.select("doc_id", "id", (n % 4 * 2).cast("int").alias("attr"), (800 + n % 3 * 100).alias("height"), F.when(n % 5 == 0, 255).otherwise(0).cast("long").alias("color")),
        "paras": own.select("doc_id", "id", (n % 6).cast("int").alias("align")),
        "styles": own.select("doc_id", "id", "p_brand", F.col("id").alias("char_shape"), (F.col("id") % 7).alias("para_shape"), (F.col("id") % 3).alias("next_style")),
    }


@query(S.CATALOGUE + S.CATALOGUE_STYLES)
def catalogue_styles(spark, sf_dir):
    """Styles of the merged catalogues with the shapes that they refer to."""
    t, _ = C.merged(half_catalogue(spark, sf_dir, False), half_catalogue(spark, sf_dir, True))
    chars = t["chars"].select("doc_id", F.col("id").alias("char_shape"), "attr", "height", "color")
    return t["styles"].join(chars, ["doc_id", "char_shape"]).join(t["paras"].select("doc_id", F.col("id").alias("para_shape"), "align"), ["doc_id", "para_shape"], "left")


@query(S.CATALOGUE + S.CATALOGUE_NODES)
def catalogue_references(spark, sf_dir):
    """Paragraphs made of customers that refer to the second half's entries, moved to the merged ones."""
    c = F.col("c_custkey")
    pairs = F.create_map(F.lit("style"), (c % 5).cast("string"), F.lit("para"), (c % 9).cast("string"), F.lit("runs"), F.concat(F.lit("0:"), (c % 4).cast("string"), F.lit("|7:"), (c % 999).cast("string")))
    nodes = table(spark, sf_dir, "customer").select((c % 30).alias("doc_id"), c.alias("path"), pairs.alias("attrs"))
    _, maps = C.merged(half_catalogue(spark, sf_dir, False), half_catalogue(spark, sf_dir, True))
    return C.with_references(nodes, maps).select("doc_id", "path", *(F.col("attrs")[n].alias(n) for n in ("style", "para", "runs")))


@query("""WITH c AS (SELECT p_partkey % 25 AS doc_id, p_partkey // 50 AS id, CAST(p_partkey % 4 * 2 AS INTEGER) AS attr, 800 + p_partkey % 3 * 100 AS height, CASE WHEN p_partkey % 5 = 0 THEN 255 ELSE 0 END AS color FROM part WHERE p_partkey % 50 < 25),
f AS (SELECT doc_id, min(id) AS base, max(id) + 1 AS fresh FROM c GROUP BY doc_id)
SELECT c.*, NULL AS edit_shape FROM c UNION ALL SELECT doc_id, fresh, attr, height, CASE WHEN doc_id % 2 = 0 THEN 16777216 // 4 + 18 + 52 * 256 ELSE 255 END, fresh FROM c JOIN f USING (doc_id) WHERE id = base""")
def edit_shape(spark, sf_dir):
    """A shape for edited text in each document: a copy of the first one in another colour."""
    chars = half_catalogue(spark, sf_dir, False)["chars"]
    colours = chars.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "#123440").otherwise("#12").alias("colour"))
    shapes, ids = C.with_edit_shape(chars, colours)
    return shapes.join(ids.select(F.col("doc_id").alias("_d"), "edit_shape"), (F.col("doc_id") == F.col("_d")) & (F.col("id") == F.col("edit_shape")), "left").drop("_d")


@query("""SELECT DISTINCT conv_id AS doc_id, id, CASE WHEN id = 0 THEN '본문' ELSE '개요 ' || id END AS name, CASE WHEN id = 0 THEN 'Body' ELSE 'Outline ' || id END AS english,
  [1000, 2000, 1700, 1500, 1300, 1200, 1100][id + 1] AS height, id > 0 AS bold, id AS level FROM conversations, unnest(range(0, 7)) AS u(id)""")
def heading_catalogue(spark, sf_dir):
    """Styles for imported headings with their shapes, for each conversation."""
    chars, paras, styles = C.heading_catalogue(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")))
    chars = chars.select("doc_id", F.col("id").alias("char_shape"), F.col("height").cast("int").alias("height"), (A.bits(F.col("attr"), *A.CHAR_BITS["bold"]) > 0).alias("bold"))
    paras = paras.select("doc_id", F.col("id").alias("para_shape"), A.bits(F.col("attr"), *A.PARA_BITS["heading_level"]).cast("long").alias("level"))
    return styles.join(chars, ["doc_id", "char_shape"]).join(paras, ["doc_id", "para_shape"]).select("doc_id", "id", "name", "english", "height", "bold", "level")


# Styles as classes: pages with a span before every fifth tag, in seven styles and one of the page's own


@query(S.HOISTED)
def hoisted_html(spark, sf_dir):
    """Repeated styles as classes, and back."""
    i = lambda k: (k * F.col("page_id") % 7).cast("string")
    span = lambda k: F.when(k % 35 == 5, F.concat(F.lit('<span style="one:'), k.cast("string"), F.lit('">'))).when(k % 5 == 0, F.concat(F.lit('<span style="w:'), i(k), F.lit('">'))).otherwise("")
    html = F.array_join(F.transform(F.split(F.coalesce("html", F.lit("")), "<"), lambda x, k: F.concat(F.when(k == 0, "").otherwise(F.concat(span(k), F.lit("<"))), x)), "")
    own = table(spark, sf_dir, "pages").select("page_id", html.alias("html")).withColumn("classed", Y.hoisted(F.col("html")))
    return own.select("page_id", F.md5("classed").alias("digest"), (Y.expanded(F.col("classed")) == F.col("html")).alias("same"), F.length("classed").cast("long").alias("n"))
