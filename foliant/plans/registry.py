"""All queries of the document operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import attributes as A
from foliant.functions import text as X
from foliant.operators import documents as D
from foliant.operators import parts as P
from foliant.operators import tables as T
from foliant.sources import headers as H
from foliant.spark import spread

from . import sql as S
from .fixtures import fixture, nodes, values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Documents


@query(S.RECORD_LINES)
def record_lines(spark, sf_dir):
    return D.record_lines(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, 'par-s0-p' || (i - 1) AS path, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)")
def para_split(spark, sf_dir):
    return D.paragraphs(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, {S.clean('text')} AS cleaned, {S.visible('text')} AS visible FROM documents")
def clean_text_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"), X.visible(F.col("text")).alias("visible"))


@query(f"SELECT id, {S.clean('x')} AS cleaned, {S.visible('x')} AS visible, regexp_replace(x, '^(?:그림|표|Figure|Table) [.] ', '') AS caption FROM {values('snippet')}")
def clean_text_v(spark, sf_dir):
    x = F.col("x")
    return fixture(spark, "snippet").select("id", X.clean_text(x).alias("cleaned"), X.visible(x).alias("visible"), X.strip_caption_label(x).alias("caption"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) AS lines, count({S.text_level('x')}) AS headings, count({S.box_level('x')}) AS boxes FROM l GROUP BY doc_id")
def heading_prefix_docs(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"), X.clean_lines(F.col("text")).alias("c"))
    known = lambda a, f: F.size(F.filter(a, lambda x: f(x).isNotNull())).cast("long")
    return lines.select("doc_id", F.size("l").cast("long").alias("lines"), known("c", X.cleaned_heading_level).alias("headings"), known("l", X.box_heading_level).alias("boxes"))


@query(f"SELECT id, {S.text_level('x')} AS level, {S.box_level('x')} AS box FROM {values('snippet')}")
def heading_prefix_v(spark, sf_dir):
    return fixture(spark, "snippet").select("id", X.text_heading_level(F.col("x")).alias("level"), X.box_heading_level(F.col("x")).alias("box"))


@query(f"SELECT par, coalesce({S.style_level('name')}, {S.style_level('english')}) AS level FROM {values('styled')} p LEFT JOIN {values('style')} s USING (style_id)")
def style_heading(spark, sf_dir):
    joined = fixture(spark, "styled").join(fixture(spark, "style"), "style_id", "left")
    return joined.select("par", X.style_heading_level(F.col("name"), F.col("english")).alias("level"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) FILTER (WHERE {S.numeric('x')}) AS numeric_lines FROM l GROUP BY doc_id")
def numeric_ratio(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, X.is_mostly_numeric)).cast("long").alias("numeric_lines"))


@query(f"SELECT id, {S.numeric('x')} AS numeric, {S.time_token('x')} AS time_token, {S.visible(S.untagged('x'))} <> '' AS has_body FROM {values('snippet')}")
def text_predicates(spark, sf_dir):
    x = F.col("x")
    return fixture(spark, "snippet").select("id", X.is_mostly_numeric(x).alias("numeric"), X.is_time_token(x).alias("time_token"), X.has_visible_body(x).alias("has_body"))


@query(f"SELECT id, {S.atx_level('x')} AS level, regexp_replace(x, '^#{{1,6}} ', '') AS plain FROM {values('snippet')}")
def atx_heading(spark, sf_dir):
    return fixture(spark, "snippet").select("id", X.atx_level(F.col("x")).alias("level"), X.atx_text(F.col("x")).alias("plain"))


@query(f"WITH r AS (SELECT doc_id, {S.escape_record('text')} AS escaped, text FROM documents) SELECT doc_id, escaped, true AS same FROM r")
def escape_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("escaped", X.escape_record(F.col("text")))
    return docs.select("doc_id", "escaped", (X.unescape_record(F.col("escaped")) == F.col("text")).alias("same"))


@query("SELECT page_id, " + S.escapes("html", "&#39;") + " AS as_html, " + S.escapes("html", "&apos;") + " AS as_xml FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.escape_html(F.col("html")).alias("as_html"), X.escape_xml(F.col("html")).alias("as_xml"))


@query(f"SELECT id, {S.markdown_kind('x')} AS kind FROM {values('markdown')}")
def md_dispatch(spark, sf_dir):
    return fixture(spark, "markdown").select("id", X.markdown_kind(F.col("x")).alias("kind"))


@query(f"""WITH l AS (SELECT doc_id, l, i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)),
h AS (SELECT doc_id, i, {S.text_level('l[i]')} AS level FROM l)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 0) AS depth FROM h""")
def chapter_depth(spark, sf_dir):
    return D.chapter_depths(table(spark, sf_dir, "documents"))


@query(S.SUMMARY)
def ir_summary(spark, sf_dir):
    return D.summary(table(spark, sf_dir, "documents"))


@query(f"SELECT par, start, lead(start) OVER w AS stop, char_shape_id FROM (SELECT *, lag(char_shape_id) OVER (PARTITION BY par ORDER BY start) AS b FROM {values('run')}) WHERE b IS NULL OR b <> char_shape_id WINDOW w AS (PARTITION BY par ORDER BY start)")
def run_bounds(spark, sf_dir):
    return D.run_bounds(fixture(spark, "run"))


# Records


@query(S.RECORD_ATTRS)
def record_attrs(spark, sf_dir):
    line = F.col("line")
    own = fixture(spark, "record").withColumn("a", D.attributes(line))
    return own.select("id", F.explode_outer("a").alias("k", "v"), D.text_body(line).alias("body"))


@query(S.RECORD_PARSE)
def record_parse(spark, sf_dir):
    return D.record_counts(D.record_lines(table(spark, sf_dir, "documents")))


@query(f"""WITH l AS (SELECT doc_id, i, {S.clean('l[i]')} AS c, {S.text_level('l[i]')} AS level FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, 'p' || (i - 1) AS path, CAST(coalesce(level, {S.atx_level('c')}, 0) AS INTEGER) AS level, CASE WHEN level IS NULL THEN regexp_replace(c, '^#{{1,6}} ', '') ELSE c END AS text FROM l""")
def record_import(spark, sf_dir):
    """The records of all documents as node rows."""
    from foliant.operators import outline as O

    rows = O.nodes(D.record_lines(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "ord", "path", F.col("attrs")["style"].cast("int").alias("level"), "text")


@query("""SELECT p_partkey AS doc_id, 2 AS rows, 2 AS cols, 6 AS cells, 'nested ' || p_name AS deepest, 2 AS pictures, p_name AS heading FROM part""")
def record_tree(spark, sf_dir):
    """A heading, a table with a table inside and two figures for each part, as records, as nodes, and as records and nodes again."""
    from foliant.operators import outline as O

    line = F.concat(
        F.lit("SECTION[id=sec-0]\nPARAGRAPH[id=x,para_shape=4]\nTEXT: ## "), "p_name", F.lit("\nPARAGRAPH[id=y,page_break=1]\nTABLE[id=t,border_fill=2]\nCELL[id=c,row=0,col=0,colspan=2]\nTEXT: head\nTEXT[par-z,char_shape=3]: more\nCELL[id=d,row=1,col=0]\nTABLE[id=u]\nCELL[row=0,col=0]\nTEXT: nested "), "p_name",
        F.lit("\nCELL[row=0,col=1]\nFIGURE[id=f,bin_id=3,width_mm=10,height_mm=20]\nCELL[row=1,col=0]\nEND TABLE[u]\nCELL[row=1,col=1]\nEND TABLE[t]\nFIGURE[id=g,bin_id=4]\n"),
    )
    first = O.nodes(spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), line.alias("records")))
    back = O.nodes(O.to_records(first))
    of = lambda path, x: F.max(F.when(F.col("path") == path, x))
    return back.groupBy("doc_id").agg(
        of("p1/t0", F.col("attrs")["rows"].cast("int")).alias("rows"), of("p1/t0", F.col("attrs")["cols"].cast("int")).alias("cols"), F.count_if(F.col("kind") == "cell").cast("int").alias("cells"),
        of("p1/t0/c1/p0/t0/c0/p0", F.col("text")).alias("deepest"), F.count_if(F.col("kind") == "picture").cast("int").alias("pictures"), of("p0", F.col("text")).alias("heading"),
    )


@query(f"SELECT id, CASE WHEN level > 0 THEN level ELSE coalesce({S.atx_level('text')}, 0) END AS resolved, CASE WHEN level > 0 THEN text ELSE regexp_replace(text, '^#{{1,6}} ', '') END AS plain FROM {values('heading_line')}")
def resolve_heading(spark, sf_dir):
    return D.resolved_headings(fixture(spark, "heading_line")).select("id", "resolved", "plain")


@query(S.LAYOUT)
def lineseg_codec(spark, sf_dir):
    return fixture(spark, "layout").withColumn("s", A.line_segments(F.col("x"))).select("id", F.size("s").cast("long").alias("segments"), A.line_segments_text(F.col("s")).alias("encoded"))


# Tables


@query(S.BG_TONE)
def bg_tone(spark, sf_dir):
    c = [F.col(x) for x in "rgb"]
    return fixture(spark, "fill").select("slot", A.luminance(*c).alias("luminance"), A.tone(*c, F.col("a")).alias("tone"))


@query(S.CELL_ROLES)
def cell_roles(spark, sf_dir):
    roles = T.cell_roles(T.fingerprints(fixture(spark, "cell"), fixture(spark, "fill")))
    return roles.select("tbl", "row", "col", "tone", "role", T.editable(F.col("role"), F.col("paragraphs"), F.col("controls"), F.col("text")).alias("editable"))


@query(S.KEYWORD_COUNT)
def keyword_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[X.substring_count(F.lower("text"), F.lit(w)).cast("long").alias(f"n_{w}") for w in S.COUNTED])


@query(S.TABLE_DOMAIN)
def table_domain(spark, sf_dir):
    return T.table_domain(fixture(spark, "cell"), fixture(spark, "tbl"))


@query(S.GRID_SLOTS)
def grid_slots(spark, sf_dir):
    return T.grid_slots(fixture(spark, "cell"), fixture(spark, "tbl"))


@query(S.GRID_FOLD)
def grid_fold(spark, sf_dir):
    return T.markdown_grid(fixture(spark, "cell"), fixture(spark, "tbl"))


@query("""WITH n AS (SELECT n_regionkey AS tbl, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, n_nationkey AS k, n_name AS s FROM nation)
SELECT tbl, '| ' || max(k) FILTER (WHERE row = 0) || ' | ' || max(s) FILTER (WHERE row = 0) || ' |' || chr(10) || '| --- | --- |' || chr(10)
  || coalesce(string_agg('| ' || k || ' | ' || s || ' |' || chr(10), '' ORDER BY row) FILTER (WHERE row > 0), '') || chr(10) AS markdown FROM n GROUP BY tbl""")
def gfm_table(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").withColumn("row", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    cells = n.select(F.col("n_regionkey").alias("tbl"), "row", F.posexplode(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("col", "text")).withColumns({"row_span": F.lit(1), "col_span": F.lit(1), "controls": F.lit(0)})
    return T.markdown_grid(cells, cells.groupBy("tbl").agg((F.max("row") + 1).alias("rows"), F.lit(2).alias("cols")))


@query(f"""WITH e AS (SELECT tbl, row, col, col - row_number() OVER (PARTITION BY tbl, row ORDER BY col) AS i FROM {values('cell')} WHERE row_span = 1 AND col_span = 1 AND controls = 0 AND {S.clean('text')} = '')
SELECT tbl, row, min(col) AS first_col, max(col) AS last_col FROM e GROUP BY tbl, row, i HAVING max(col) > min(col)""")
def empty_runs(spark, sf_dir):
    return T.empty_runs(fixture(spark, "cell"))


@query(S.TABLE_FORM)
def table_form(spark, sf_dir):
    return T.table_form(fixture(spark, "cell"), fixture(spark, "tbl"))


@query(f"""WITH j AS (SELECT c.*, cols FROM {values('cell')} c JOIN {values('tbl')} USING (tbl)),
w AS (SELECT *, CASE WHEN width = 0 THEN 42000 // greatest(cols, 1) * col_span ELSE width END AS w2 FROM j)
SELECT tbl, row, col, w2 AS width, CASE WHEN height = 0 THEN 1500 * row_span ELSE height END AS height, CASE WHEN text_width = 0 THEN greatest(w2 - 200, 0) ELSE text_width END AS text_width FROM w""")
def cell_sizes(spark, sf_dir):
    return T.with_default_sizes(fixture(spark, "cell"), fixture(spark, "tbl")).select("tbl", "row", "col", "width", "height", "text_width")


@query(f"""WITH r AS (SELECT tbl, row, max(height) AS h, CASE WHEN row = 0 THEN sum(width) END AS w FROM {values('cell')} GROUP BY tbl, row)
SELECT tbl, CAST(greatest(coalesce(sum(w), 0), 1) AS BIGINT) AS width, CAST(greatest(sum(h), 1) AS BIGINT) AS height FROM r GROUP BY tbl""")
def table_extent(spark, sf_dir):
    return T.table_extent(fixture(spark, "cell"))


# Parts, pictures and references


@query(f"""WITH e AS (SELECT *, {S.entry_number('id')} AS n FROM {values('entry')}), f AS (SELECT doc_id, n, arg_min(id, ord) AS b FROM e GROUP BY doc_id, n)
SELECT p.doc_id, seq, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY seq) AS INTEGER) AS number, bin_id, b AS binary, coalesce(lower(regexp_extract(b, '[.]([^.]*)$', 1)), 'bin') AS extension
FROM {values('picture')} p LEFT JOIN f ON p.doc_id = f.doc_id AND bin_id = n""")
def bin_lookup(spark, sf_dir):
    return P.pictures_with_binary(fixture(spark, "picture"), fixture(spark, "entry"))


@query(f"""WITH f AS (SELECT doc_id, bin_id, min(seq) AS first FROM {values('picture')} GROUP BY ALL)
SELECT e.doc_id, id, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY first NULLS LAST, ord) AS INTEGER) AS place FROM {values('entry')} e LEFT JOIN f ON e.doc_id = f.doc_id AND {S.entry_number('id')} = bin_id""")
def picture_order(spark, sf_dir):
    return P.binaries_in_picture_order(fixture(spark, "picture"), fixture(spark, "entry"))


@query(f"""SELECT doc_id, kind, ref, CASE WHEN coalesce(n, 0) = 0 THEN ref WHEN ref >= n THEN CASE WHEN kind = 'border_fill' AND n >= 2 THEN 1 ELSE 0 END ELSE ref END AS clamped
FROM {values('ref')} LEFT JOIN {values('bound')} USING (doc_id, kind)""")
def dangling_refs(spark, sf_dir):
    return P.clamped(fixture(spark, "ref"), fixture(spark, "bound"))


@query(f"""SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'extra' WHEN a.body = b.body THEN 'equal' ELSE 'differing' END AS state,
CAST(octet_length(encode(a.body)) AS INTEGER) AS left_bytes, CAST(octet_length(encode(b.body)) AS INTEGER) AS right_bytes FROM {values('part_a')} a FULL JOIN {values('part_b')} b ON a.name = b.name""")
def stream_diff(spark, sf_dir):
    own = lambda n: fixture(spark, n).select("name", F.col("body").cast("binary").alias("bytes"))
    return P.stream_difference(own("part_a"), own("part_b"))


@query(f"""WITH d AS (SELECT 1 AS doc_id, name, body FROM {values('part_a')}) SELECT * FROM d WHERE regexp_matches(name, '{P.PACKAGE_PATHS}')
UNION ALL SELECT 1, name, body FROM {values('part_b')} b WHERE regexp_matches(name, '{P.PACKAGE_PATHS}') AND NOT EXISTS (SELECT 1 FROM d WHERE d.name = b.name)""")
def package_parts(spark, sf_dir):
    return P.kept_parts(P.with_missing_parts(fixture(spark, "part_a").select(F.lit(1).alias("doc_id"), "name", "body"), fixture(spark, "part_b")))


@query(f"""SELECT name, regexp_matches(name, '^Contents/section[0-9]+[.]xml$') AS is_section, CAST(nullif(regexp_extract(name, '([0-9]+)', 1), '') AS INTEGER) AS number,
nullif(regexp_extract(name, '^/?BinData/([^/]+)$', 1), '') AS binary_id FROM {values('part_b')}""")
def part_names(spark, sf_dir):
    n = F.col("name")
    return fixture(spark, "part_b").select("name", P.is_section(n).alias("is_section"), P.section_number(n).alias("number"), P.binary_id(n).alias("binary_id"))


@query("""WITH c AS (SELECT source AS style, count(*) AS uses FROM documents GROUP BY source HAVING count(*) >= 2)
SELECT style, uses, 's' || (row_number() OVER (ORDER BY uses DESC, style) - 1) AS class FROM c""")
def style_hoist(spark, sf_dir):
    return P.hoisted_styles(table(spark, sf_dir, "documents").select(F.col("source").alias("style")))


@query(f"""WITH r AS (SELECT doc_id, slot, sum(n) OVER (PARTITION BY doc_id ORDER BY slot) - n AS a, sum(n) OVER (PARTITION BY doc_id ORDER BY slot) AS b FROM {values('slot_count')})
SELECT f.doc_id, slot, CAST(ord - a AS INTEGER) AS idx, name FROM {values('face')} f JOIN r ON f.doc_id = r.doc_id AND ord >= a AND ord < b""")
def font_slots(spark, sf_dir):
    return P.font_slots(fixture(spark, "slot_count"), fixture(spark, "face"))


# Headers: the parts of the sample data as the shapes of fifty documents, written as header parts into packages and read from these


def header_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    k = F.col("p_partkey")
    own = spread(table(spark, sf_dir, "part")).select((k % 50).alias("doc_id"), k.alias("id"), "p_name", "p_brand")
    n = F.col("id")
    seven = lambda m, a: F.array(*[((n * (i + 3)) % m + a).cast("int") for i in range(7)])
    attr = sum((F.when(n % m == 0, F.lit(1 << A.CHAR_BITS[b][0])).otherwise(0) for b, m in S.HEADER_BITS.items()), F.lit(0))
    colour = lambda f: n * f % 16777216
    return {
        "fonts": own.select("doc_id", F.element_at(F.array(*map(F.lit, H.SLOTS)), (F.floor(n / 50) % 7 + 1).cast("int")).alias("slot"), n.alias("idx"), F.concat("p_brand", F.lit(" & <"), n.cast("string")).alias("name")),
        "fills": own.select("doc_id", "id", F.when(n % 3 > 0, colour(7919)).alias("face")),
        "chars": own.select(
            "doc_id", "id", attr.alias("attr"), (n % 4000 + 1).alias("height"), colour(31).alias("color"), F.when(n % 2 == 0, colour(77)).otherwise(0).alias("shade"), F.when(n % 5 > 0, n % 9).alias("border_fill"),
            colour(5).alias("underline_color"), colour(11).alias("strike_color"), seven(90, 0).alias("fonts"), seven(200, 1).alias("ratios"), seven(150, 1).alias("sizes"), seven(200, -100).alias("spacings"), seven(60, -30).alias("offsets"),
        ),
        "paras": own.select("doc_id", "id", (n % 6).cast("int").alias("align")),
        "styles": own.select("doc_id", "id", (n % 4 == 0).alias("is_char"), F.concat(F.lit("개요 "), (n % 9).cast("string")).alias("name"), F.concat(F.col("p_name"), F.lit("'\"&")).alias("english"), (n % 11).alias("para_shape"), (n % 13).alias("char_shape"), (n % 7).alias("next_style"), (n % 1042).cast("int").alias("lang")),
    }


def stored_headers(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the headers, which are written and read whole."""
    from foliant.sources import packages as Z

    t = header_tables(spark, sf_dir)
    return H.headers_of(Z.packages_of(H.header_pieces(t["fonts"], t["fills"], t["chars"], t["paras"], t["styles"])), table)


@query(S.HEADER_FONTS)
def header_fonts(spark, sf_dir):
    return H.fonts(stored_headers(spark, sf_dir, "fontfaces"))


@query("SELECT p_partkey % 50 AS doc_id, p_partkey AS id, CASE WHEN p_partkey % 3 > 0 AND p_partkey * 7919 % 16777216 <> 16777215 THEN p_partkey * 7919 % 16777216 END AS face FROM part")
def header_fills(spark, sf_dir):
    return H.border_fills(stored_headers(spark, sf_dir, "borderFills"))


@query(S.HEADER_CHARS)
def header_chars(spark, sf_dir):
    return H.char_shapes(stored_headers(spark, sf_dir, "charProperties"))


@query("SELECT p_partkey % 50 AS doc_id, p_partkey AS id, CAST(p_partkey % 6 AS INTEGER) AS align FROM part")
def header_paras(spark, sf_dir):
    return H.para_shapes(stored_headers(spark, sf_dir, "paraProperties"))


@query("""SELECT p_partkey % 50 AS doc_id, p_partkey AS id, p_partkey % 4 = 0 AS is_char, '개요 ' || p_partkey % 9 AS name, p_name || chr(39) || '"&' AS english, p_partkey % 11 AS para_shape, p_partkey % 13 AS char_shape, p_partkey % 7 AS next_style, CAST(p_partkey % 1042 AS INTEGER) AS lang FROM part""")
def header_styles(spark, sf_dir):
    return H.styles(stored_headers(spark, sf_dir, "styles"))


def shaped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as paragraphs whose style is their conversation's number, with two runs, read from packages."""
    from foliant.sources import packages as Z

    c, n = F.col("conv_id"), F.col("turn")
    half = F.floor(F.length("text") / 2).cast("string")
    runs = F.when(F.length("text") > 1, F.concat(F.lit("0:"), n.cast("string"), F.lit("|"), half, F.lit(":"), (n + 50).cast("string"))).otherwise(F.concat(F.lit("0:"), n.cast("string")))
    own = table(spark, sf_dir, "conversations").select(c.alias("doc_id"), F.lit(0).alias("section"), n.cast("int").alias("ord"), F.concat(F.lit("p"), n.cast("string")).alias("path"), F.lit("paragraph").alias("kind"), F.create_map(F.lit("style"), (c + 50 * n).cast("string"), F.lit("runs"), runs).alias("attrs"), "text")
    return Z.section_nodes(Z.parts(Z.packages(Z.sections(own))))


@query(f"""SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS ord, coalesce(CASE WHEN (conv_id + 50 * turn) % 9 BETWEEN 1 AND 6 THEN CAST((conv_id + 50 * turn) % 9 AS INTEGER) END, {S.text_level('text')}) AS level
FROM conversations WHERE conv_id > 0 AND conv_id < 50 AND (conv_id + 50 * turn) % 4 <> 0 AND conv_id + 50 * turn <= (SELECT max(p_partkey) FROM part)""")
def styled_headings(spark, sf_dir):
    """Paragraphs of fifty packages whose paragraph style the header knows, with the levels that the style's names give."""
    nodes = shaped_nodes(spark, sf_dir).where("doc_id > 0 AND doc_id < 50")
    styles = H.styles(stored_headers(spark, sf_dir, "styles"))
    return H.with_heading_levels(nodes, styles, known=True).select("doc_id", "ord", "level")


# Assets


def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.operators import assets as E

    page = F.col("page_id")
    own = table(spark, sf_dir, "pages").select(page.alias("doc_id"), F.encode("html", "UTF-8").alias("bytes"), "url")
    binaries = own.select("doc_id", F.lit(0).alias("ord"), F.concat(F.lit("image"), page_number(F.col("doc_id")), F.lit(".png")).alias("id"), "bytes")
    sections = own.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("section"), "bytes")
    streams = own.where("doc_id % 3 = 0").select("doc_id", F.lit("Preview/PrvText.txt").alias("name"), F.encode("url", "UTF-8").alias("bytes"))
    return E.assets_block(binaries, sections, streams)


def page_number(x):
    return (x % 1000).cast("string")


@query(S.ASSETS)
def assets_footer(spark, sf_dir):
    return page_assets(spark, sf_dir)


@query(S.ASSET_ROWS)
def assets_import(spark, sf_dir):
    """The footer of each page, read again."""
    from foliant.operators import assets as E

    rows = E.asset_rows(page_assets(spark, sf_dir))
    return rows.select("doc_id", "kind", "name", "mime", F.octet_length("bytes").cast("long").alias("n"), F.md5("bytes").alias("digest"))


# Attributes


@query("SELECT l_orderkey, l_linenumber, CAST(floor(CAST(l_partkey * 37 AS DOUBLE) * 25.4 / 7200 + 0.5) AS INTEGER) AS mm FROM lineitem")
def hwpunit_mm(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.to_mm(F.col("l_partkey") * 37).alias("mm"))


@query(S.STORED_NUMBERS)
def stored_numbers(spark, sf_dir):
    n = (F.col("l_orderkey") * 2654435761 + F.col("l_partkey")) % 4294967296
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"))
    points = A.to_points(F.col("n") % 100000).alias("points")
    return own.select("l_orderkey", "l_linenumber", points, *A.bit_columns(F.col("n"), A.FILL_BITS), A.binary_kind(F.col("n")).alias("kind"), *A.binary_kind_columns(F.col("n")), A.char_count(F.col("n")).alias("chars"), A.has_marker(F.col("n")).alias("marker"))


@query(S.ASSET_NAMES)
def asset_names(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.element_at(F.array(*map(F.lit, S.NAME_STEMS)), (k % len(S.NAME_STEMS)).cast("int") + 1), k.cast("string"), F.element_at(F.array(*map(F.lit, S.NAME_ENDS)), (k % len(S.NAME_ENDS)).cast("int") + 1))
    content = F.unhex(F.concat(F.element_at(F.array(*map(F.lit, S.HEADS)), (k % len(S.HEADS)).cast("int") + 1), F.lpad(F.hex(k), 4, "0")))
    own = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), content.alias("content"))
    x = F.col("name")
    return own.select("p_partkey", A.safe_entry_id(x).alias("safe"), A.png_id(x).alias("png"), A.is_web_native(A.extension(x)).alias("web"), A.css_font(x).alias("font"), A.json_text(x).alias("json"), A.looks_like_image(F.col("content")).alias("image"))


@query(S.COLOUR_HEX)
def color_hex(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 16777216).alias("n")).withColumn("hex", A.colour_hex(F.col("n")))
    return own.select("p_partkey", "hex", A.colour_number(F.col("hex")).cast("long").alias("back"))


@query("SELECT o_orderkey, " + ", ".join(f"CAST((o_orderkey * 2654435 >> {a}) & {(1 << w) - 1} AS INTEGER) AS {n}" for n, (a, w) in {**A.CHAR_BITS, **A.PARA_BITS}.items()) + " FROM orders")
def attr_bits(spark, sf_dir):
    x = F.col("o_orderkey") * 2654435
    return table(spark, sf_dir, "orders").select("o_orderkey", *A.bit_columns(x, A.CHAR_BITS), *A.bit_columns(x, A.PARA_BITS))


@query(f"SELECT doc_id, id, {S.entry_number('id')} AS number, {S.mime('id')} AS mime FROM {values('entry')}")
def entry_ids(spark, sf_dir):
    return fixture(spark, "entry").select("doc_id", "id", A.entry_number(F.col("id")).alias("number"), A.mime_of(F.col("id"), "application/octet-stream").alias("mime"))


@query("SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS uri FROM pages")
def data_uri(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", A.data_uri(F.lit("text/html"), F.encode("html", "UTF-8")).alias("uri"))


# Emission


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a one-section document of paragraphs."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("section"), F.col("turn").cast("int").alias("ord"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("path"), F.lit("paragraph").alias("kind"), F.create_map(F.lit("role"), F.col("role")).alias("attrs"), "text")


@query(f"SELECT conv_id AS doc_id, string_agg(CASE WHEN {S.text_level('text')} IS NULL THEN '' ELSE repeat('#', {S.text_level('text')}) || ' ' END || {S.clean('text')}, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE {S.clean('text')} <> '') AS markdown FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE {S.clean('text')} <> '') > 0")
def markdown_emit(spark, sf_dir):
    from foliant.operators.emit import to_markdown

    return to_markdown(conversation_nodes(spark, sf_dir))


@query(f"""WITH t AS (SELECT *, {S.clean('text')} AS c, coalesce('h' || ({S.text_level('text')}), 'p') AS tag FROM conversations)
SELECT conv_id AS doc_id, '<article>' || string_agg('<' || tag || '>' || {S.escapes('c', '&#39;')} || '</' || tag || '>', '' ORDER BY turn) || '</article>' AS html FROM t WHERE c <> '' GROUP BY conv_id""")
def html_emit(spark, sf_dir):
    from foliant.operators.emit import to_html

    return to_html(conversation_nodes(spark, sf_dir))


@query(f"""SELECT conv_id AS doc_id, string_agg('PARAGRAPH[id=s0-p' || turn || ',role=' || role || ']' || CASE WHEN text <> '' THEN chr(10) || 'TEXT: ' || {S.escape_record('text')} ELSE '' END, chr(10) ORDER BY turn) AS records FROM conversations GROUP BY conv_id""")
def record_emit(spark, sf_dir):
    from foliant.operators.emit import to_records

    return to_records(conversation_nodes(spark, sf_dir))


@query("""SELECT * FROM (VALUES (1, 2, 8, 1, 3, 1), (2, 1, 1, 0, 0, 0)) AS t(doc_id, sections, paragraphs, tables, cells, pictures)""")
def document_summary(spark, sf_dir):
    from foliant.operators.emit import document_summary as summary

    return summary(nodes(spark))


# Decoders and encoders, by Arrow-batched Python; tests hold them against round trips


@query(None)
def latex(spark, sf_dir):
    from foliant.functions.formula import to_latex, to_tokens

    return fixture(spark, "equation").select("id", to_latex("script").alias("latex"), to_tokens("script").alias("tokens"))


@query(None)
def gfm_import(spark, sf_dir):
    from foliant.sources.markdown import import_blocks

    return import_blocks(table(spark, sf_dir, "documents"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS paragraphs, true AS same FROM conversations GROUP BY conv_id")
def package_roundtrip(spark, sf_dir):
    """Each conversation as a section of paragraphs, written as a package, read again and compared."""
    from foliant.sources import packages as Z

    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(0).alias("section"), F.col("turn").cast("int").alias("ord"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("path"), F.lit("paragraph").alias("kind"),
        F.create_map(F.lit("style"), F.lit("1"), F.lit("runs"), F.lit("0:2|3:4")).alias("attrs"), "text",
    )
    back = Z.section_nodes(Z.parts(Z.packages(Z.sections(rows)))).select(F.col("doc_id").alias("conv_id"), "ord", F.col("text").alias("t"))
    own = rows.select(F.col("doc_id").alias("conv_id"), "ord", "text")
    return own.join(back, ["conv_id", "ord"], "full").groupBy("conv_id").agg(F.count("*").alias("paragraphs"), F.bool_and(F.col("text").eqNullSafe(F.col("t"))).alias("same"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS records, text FROM documents")
def record_roundtrip(spark, sf_dir):
    """Each document's lines as paragraph-text records in a deflated stream, split and decoded again."""
    from pyspark.sql import types as PT

    from foliant.sources import records as R

    @F.pandas_udf(PT.BinaryType())
    def stream(lines: pd.Series) -> pd.Series:
        return lines.map(lambda text: R.deflate(R.join([(R.TAGS["PARA_TEXT"], 1, R.text_record(x)) for x in text.split("\n")])))

    @F.pandas_udf(PT.StringType())
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(R.paragraph_text)

    own = table(spark, sf_dir, "documents").select("doc_id", F.lit("BodyText/Section0").alias("stream"), stream("text").alias("bytes"))
    rows = R.records(own).select("doc_id", "seq", decoded("data").alias("line"))
    lines = rows.groupBy("doc_id").agg(F.count("*").alias("records"), F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return lines.select("doc_id", "records", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


@query(None)
def align_edit(spark, sf_dir):
    """Each conversation against itself with every third turn reworded and a new one after each fifth."""
    from foliant.operators.edit import merged

    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("section"), F.col("turn").cast("int").alias("seq"), "text", F.lit(1).alias("style_id"), (F.col("turn") == 2).alias("page_break"))
    typed = own.withColumns({"text": F.when(F.col("seq") % 3 == 1, F.concat(F.lit("new "), "text")).otherwise(F.col("text")), "style_id": F.lit(0), "page_break": F.lit(False)})
    added = own.where("seq % 5 = 4").select("section", (F.col("seq") * 1000 + 1).alias("seq"), F.lit("added").alias("text"), F.lit(3).alias("style_id"), F.lit(False).alias("page_break"))
    return merged(own, typed.withColumn("seq", F.col("seq") * 1000).unionByName(added))


@query("SELECT conv_id, turn AS seq, text, length(text) AS n_chars FROM conversations")
def binary_roundtrip(spark, sf_dir):
    """Each conversation as the paragraphs of a binary document, written as a compound file and scanned again."""
    from pyspark.sql import Window

    from foliant.sources import binary as B

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("section"), F.col("turn").alias("seq"), "text")
    back = B.paragraphs(B.record_rows(B.streams(B.documents(rows))))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "seq")) - 1
    return back.select(F.col("doc_id").alias("conv_id"), number.cast("long").alias("seq"), "text", F.length("text").cast("long").alias("n_chars"))


# Binary documents: customers as tables of a hundred rows, parts as the tables of a DocInfo, pages as binaries


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hundred customers a document: a paragraph with a table of names and segments, and one with a picture and two runs."""
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(F.floor(k / 100).cast("long").alias("doc_id"), (k % 100).cast("int").alias("row"), "c_name", "c_mktsegment")
    text = lambda **a: F.create_map(*[x for n, v in a.items() for x in (F.lit(n), v.cast("string"))])
    no = F.lit("")
    pairs = own.select("doc_id", "row", F.posexplode(F.array("c_name", "c_mktsegment")).alias("col", "text"))
    place = F.col("row") * 2 + F.col("col")
    path = F.concat(F.lit("p0/t0/c"), place.cast("string"))
    cells = pairs.select("doc_id", (place * 2 + 2).alias("ord"), path.alias("path"), F.lit("cell").alias("kind"), text(row=F.col("row"), col=F.col("col"), border=F.col("col") + 1).alias("attrs"), no.alias("text"))
    inner = pairs.select("doc_id", (place * 2 + 3).alias("ord"), F.concat(path, F.lit("/p0")).alias("path"), F.lit("paragraph").alias("kind"), text(style=F.col("col")).alias("attrs"), "text")
    one = own.select("doc_id").distinct()
    d = F.col("doc_id")
    fixed = (
        (0, "p0", "paragraph", text(style=F.lit(0)), F.lit("\ufffc")),
        (1, "p0/t0", "table", text(rows=F.lit(100), cols=F.lit(2)), no),
        (1000, "p1", "paragraph", text(style=F.lit(1), runs=F.concat(F.lit("0:1|3:"), (d % 7 + 2).cast("string"))), F.concat(F.lit("fig\ufffc"), d.cast("string"))),
        (1001, "p1/i0", "picture", text(bin=d % 1000, width=d % 999 + 1, height=d % 777 + 1), no),
    )
    frames = [cells, inner, *(one.select("doc_id", F.lit(o).alias("ord"), F.lit(p).alias("path"), F.lit(kind).alias("kind"), a.alias("attrs"), t.alias("text")) for o, p, kind, a, t in fixed)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    return rows.withColumn("section", F.lit(0))


def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.sources import binary as B
    from foliant.sources import records as R

    # Files are dealt out before they are read: a task then holds one Python worker, and a share of the files that parts_of bounds.
    return B.nodes_of_files(spread(B.files(R.streams(B.section_records(customer_nodes(spark, sf_dir))))))


def beside(rows: DataFrame, owner: str, place: Column, held: Column, *own: Column) -> DataFrame:
    """doc_id, the fields of held and own fields of nodes for which their section has a node of the owner's kind at the same place; held is the
    owner's. Both meet in one window, so that what makes the nodes runs once and not for either side of a join."""
    w = Window.partitionBy("doc_id", "section", "_p")
    few = rows.select("doc_id", "section", "kind", place.alias("_p"), F.when(F.col("kind") == owner, held).alias("_h"), *own)
    return few.withColumn("_h", F.first("_h", ignorenulls=True).over(w)).where((F.col("kind") != owner) & F.col("_h").isNotNull()).drop("section", "kind", "_p")


@query("""SELECT c_custkey // 100 AS doc_id, CAST(c_custkey % 100 AS INTEGER) AS row, 0 AS col, 0 AS style, 1 AS border, c_name AS text FROM customer
UNION ALL SELECT c_custkey // 100, CAST(c_custkey % 100 AS INTEGER), 1, 1, 2, c_mktsegment FROM customer""")
def binary_tables(spark, sf_dir):
    """The cells of tables that were written into binary documents, with the text of their paragraphs."""
    number = lambda n: F.col("attrs")[n].cast("int").alias(n)
    rows = stored_nodes(spark, sf_dir).where("kind = 'cell' OR (kind = 'paragraph' AND path LIKE '%/c%')")
    cell = F.when(F.col("kind") == "cell", F.col("path")).otherwise(F.regexp_replace("path", "/p[0-9]+$", ""))
    return beside(rows, "cell", cell, F.struct(*map(number, ("row", "col", "border"))), number("style"), F.col("text")).select("doc_id", "_h.*", "style", "text")


@query("""SELECT DISTINCT c_custkey // 100 AS doc_id, CAST(c_custkey // 100 % 1000 AS INTEGER) AS bin, CAST(c_custkey // 100 % 999 + 1 AS INTEGER) AS width, CAST(c_custkey // 100 % 777 + 1 AS INTEGER) AS height,
'0:1|3:' || (c_custkey // 100 % 7 + 2) AS runs, 'fig' || chr(65532) || (c_custkey // 100) AS text FROM customer""")
def binary_pictures(spark, sf_dir):
    """Pictures of binary documents with the text and the runs of the paragraphs that hold them."""
    number = lambda n: F.col("attrs")[n].cast("int").alias(n)
    rows = stored_nodes(spark, sf_dir).where("kind IN ('picture', 'paragraph')")
    paragraph = F.regexp_replace("path", "/i[0-9]+$", "")
    held = F.struct(F.col("attrs")["runs"].alias("runs"), "text")
    return beside(rows, "paragraph", paragraph, held, number("bin"), number("width"), number("height")).select("doc_id", "bin", "width", "height", "_h.*")


def info_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DocInfo records of fifty documents: properties, counts, and a binary for each part, every third one a link."""
    from foliant.sources import binary as B
    from foliant.sources import records as R

    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select((k % 50).alias("doc_id"), k.alias("k"), "p_name", "p_brand")
    row = lambda df, seq, name, values: df.select("doc_id", F.lit("/DocInfo").alias("stream"), seq.alias("seq"), F.lit(R.TAGS[name]).alias("tag"), F.lit(0).alias("level"), B.encoded(name, values).alias("data"))
    link, held = own.where("k % 3 = 0"), own.where("k % 3 > 0")
    per = own.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p_name")).alias("chars"))
    numbers = F.struct(F.lit(1).alias("sections"), *[F.lit(i).alias(f"first_{w}") for i, w in enumerate(("page", "footnote", "endnote", "picture", "table", "equation"))], F.col("chars").alias("characters"), F.col("n").alias("pages"))
    counts = F.struct(F.array(F.col("n"), *[F.col("doc_id") + i for i in range(7)], *[F.lit(0).cast("long")] * 7).alias("counts"))
    zero = F.lit(0).cast("long")
    return (
        row(per, zero, "DOCUMENT_PROPERTIES", numbers).unionByName(row(per, zero + 1, "ID_MAPPINGS", counts))
        .unionByName(row(link, F.col("k") + 2, "BIN_DATA", F.struct(F.lit(0x10).alias("property"), F.col("p_name").alias("absolute_path"), F.col("p_brand").alias("relative_path"))))
        .unionByName(row(held, F.col("k") + 2, "BIN_DATA", F.struct((F.col("k") % 3).alias("property"), (F.col("k") % 60000).alias("bin_id"), F.col("p_brand").alias("extension"))))
    )


def stored_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.sources import binary as B
    from foliant.sources import records as R

    return B.record_rows_of_files(spread(B.files(R.streams(info_records(spark, sf_dir)))))


@query("""SELECT p_partkey % 50 AS doc_id, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) - 1 AS slot, CASE WHEN p_partkey % 3 = 0 THEN 16 ELSE p_partkey % 3 END AS property,
CASE WHEN p_partkey % 3 = 0 THEN p_name END AS absolute_path, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS relative_path, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 60000 END AS bin_id, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS extension FROM part""")
def info_binaries(spark, sf_dir):
    from foliant.sources import binary as B

    rows = B.typed(stored_info(spark, sf_dir), "BIN_DATA")
    return rows.select("doc_id", F.col("slot").cast("long").alias("slot"), "property", "absolute_path", "relative_path", "bin_id", "extension")


@query("""SELECT p_partkey % 50 AS doc_id, CAST(count(*) AS BIGINT) AS pages, CAST(sum(length(p_name)) AS BIGINT) AS characters, CAST(4 AS BIGINT) AS first_table, CAST(7 * (p_partkey % 50) + 21 AS BIGINT) AS fonts FROM part GROUP BY p_partkey % 50""")
def info_properties(spark, sf_dir):
    from foliant.sources import binary as B

    rows = stored_info(spark, sf_dir)
    counts = B.typed(rows, "ID_MAPPINGS").select("doc_id", B.font_count(F.col("counts")).alias("fonts"))
    return B.typed(rows, "DOCUMENT_PROPERTIES").select("doc_id", "pages", "characters", "first_table").join(counts, "doc_id")


@query("""SELECT page_id AS doc_id, page_id % 2 = 0 AS image, CASE WHEN page_id % 2 = 0 THEN md5(unhex('89504E47') || encode(coalesce(html, ''))) END AS digest FROM pages""")
def stored_binaries(spark, sf_dir):
    """Each page as a deflated binary of a binary document; what inflates to an image is read inflated."""
    from foliant.sources import binary as B
    from foliant.sources import records as R

    @F.pandas_udf("binary")
    def deflated(data: pd.Series) -> pd.Series:
        return data.map(R.deflate)

    even = F.col("page_id") % 2 == 0
    content = F.concat(F.when(even, F.unhex(F.lit("89504E47"))).otherwise(F.unhex(F.lit("00"))), F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("/BinData/BIN0001.png").alias("stream"), deflated(content).alias("bytes"))
    rows = B.binaries(B.streams(B.files(own)))
    image = A.looks_like_image(F.col("bytes"))
    return rows.select("doc_id", image.alias("image"), F.when(image, F.md5("bytes")).alias("digest"))


@query("""SELECT doc_id, CASE WHEN length(text) > 3 AND substr(text, length(text) // 2 + 1, 1) <> '~' THEN octet_length(encode(substr(text, 1, length(text) // 2))) END AS offset FROM documents""")
def first_difference(spark, sf_dir):
    """Where each document begins to differ from itself with its middle character changed."""
    x, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    other = F.when(F.length(x) > 3, F.concat(F.substring(x, F.lit(1), half), F.lit("~"), F.substring(x, half + 2, F.length(x)))).otherwise(x)
    return table(spark, sf_dir, "documents").select("doc_id", P.first_difference(F.encode(x, "UTF-8"), F.encode(other, "UTF-8")).alias("offset"))


# Queries of their own module register themselves
from . import rendering  # noqa: E402, F401
