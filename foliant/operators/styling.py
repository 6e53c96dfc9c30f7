"""Styled text: the runs of paragraphs as nested emphasis in Markdown and HTML.

A paragraph's runs (`offset:shape|offset:shape`, in UTF-16 units) are swept once inside its row into intervals: a run ends where the next one
begins, runs without a character vanish, and neighbours of one shape are one interval. The intervals alone meet the catalogue of
character shapes, by document and id; then each interval's text is wrapped, strike outside bold outside italic, and a paragraph's intervals
are joined again in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.attributes import CHAR_BITS, bits, colour_hex
from foliant.functions.text import BULLETS_FROM, BULLETS_TO, clean_text, escape_html, has_visible_body, trim_all

#: The size of characters that needs no mention, in hundredths of a point, and alignments by number that do need one.
BODY_SIZE = 1000
ALIGN_CSS = {0: "justify", 2: "right", 3: "center", 4: "justify", 5: "justify"}
_RUN = "array<struct<start:bigint,shape:bigint>>"
KEYS = ["doc_id", "section", "path"]


def parsed_runs(text: Column) -> Column:
    """`0:1|7:2` as an array of (start, shape); what isn't two numbers is left out, null is empty."""
    pairs = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda r: F.transform(F.split(r, ":"), lambda x: x.try_cast("bigint")))
    right = F.filter(pairs, lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.isNotNull()))
    return F.transform(right, lambda p: F.struct(p[0].alias("start"), p[1].alias("shape")))


def _in_order(runs: Column) -> Column:
    """Runs as they take effect: at each place the last listed run that has begun. Lists are in order as a rule; of others, those that a later
    listed run covers whole are taken out."""
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(runs) - 1, F.lit(1))), lambda i: F.coalesce(F.get(runs, i)["start"] >= F.get(runs, i - 1)["start"], F.lit(True)))
    kept = F.filter(runs, lambda r, i: ~F.exists(F.slice(runs, i + 2, F.size(runs)), lambda k: k["start"] <= r["start"]))
    return F.when(rising, runs).otherwise(kept)


def cut_runs(nodes: DataFrame) -> DataFrame:
    """(doc_id, section, path, run, shape, piece, plain) of each paragraph's intervals in their order; shape is null before the first run. A paragraph
    without runs is one plain interval. An offset inside a surrogate pair counts from the character after it."""
    own = nodes.where("kind = 'paragraph'").select(*KEYS, F.coalesce("text", F.lit("")).alias("text"), parsed_runs(F.try_element_at("attrs", F.lit("runs"))).alias("listed"))
    own = own.withColumns({"raw": F.encode("text", "UTF-16LE"), "plain": F.size("listed") == 0}).drop("text")
    # The second byte of a low surrogate is DC to DF.
    high = lambda at: F.hex(F.substring(F.col("raw"), (at * 2 + 2).cast("int"), F.lit(1)))
    whole = lambda at: F.when(at <= 0, F.lit(0)).otherwise(F.when(high(at).isin("DC", "DD", "DE", "DF"), at + 1).otherwise(at)).cast("bigint")
    units = (F.octet_length("raw") / 2).cast("bigint")
    own = own.withColumn("listed", _in_order(F.col("listed")))
    own = own.withColumn("placed", F.filter(F.transform("listed", lambda r: F.struct(whole(r["start"]).alias("start"), r["shape"].alias("shape"))), lambda r: r["start"] < units))
    filled = F.filter("placed", lambda r, i: F.coalesce(F.get("placed", i + 1)["start"] > r["start"], F.lit(True)))
    own = own.withColumn("filled", filled)
    first = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("shape"))).cast(_RUN)
    led = F.when(F.coalesce(F.get("filled", F.lit(0))["start"] == 0, F.lit(False)), F.col("filled")).otherwise(F.concat(first, F.col("filled")))
    own = own.withColumn("led", led)
    merged = F.filter("led", lambda r, i: (i == 0) | ~F.get("led", i - 1)["shape"].eqNullSafe(r["shape"]))
    own = own.withColumn("merged", merged)
    ends = F.transform("merged", lambda r, i: F.struct(r["start"].alias("start"), F.coalesce(F.get("merged", i + 1)["start"], units).alias("stop"), r["shape"].alias("shape")))
    rows = own.select(*KEYS, "raw", "plain", F.posexplode(ends).alias("run", "r"))
    text = F.decode(F.substring(F.col("raw"), (F.col("r.start") * 2 + 1).cast("int"), ((F.col("r.stop") - F.col("r.start")) * 2).cast("int")), "UTF-16LE")
    return rows.select(*KEYS, "run", "r.shape", text.alias("piece"), "plain")


def shown(x: Column) -> Column:
    """Characters as clean_text shows them, one by one: nothing is squeezed or trimmed."""
    return F.translate(x, BULLETS_FROM + "\u00a0\u2003\ufffc\u00ad", BULLETS_TO + "  ")


def point_size(hundredths: Column) -> Column:
    """`12pt`, or `10.5pt` where the fraction is a twentieth or more; in single precision, halves to even."""
    points = (hundredths.cast("double") / 100).cast("float").cast("double")
    part = points - F.floor(points)
    return F.concat(F.when(part < float.fromhex("0x1.99999ap-5"), F.floor(points).cast("string")).otherwise(F.format_string("%.1f", F.bround(points, 1))), F.lit("pt"))


def span_style(shapes: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, strike, bold, italic, css) of shapes(doc_id, id, attr, height, color, fonts). css names what differs from black text of 10 points, and
    the font of the Hangul slot, from fonts(doc_id, slot, idx, name); quotes and backslashes of a font's name are left out."""
    on = lambda n: bits(F.col("attr"), *CHAR_BITS[n]) > 0
    named = shapes.withColumn("font", F.lit(None).cast("string"))
    if fonts is not None:
        faces = fonts.where("slot = 'hangul'").select(F.col("doc_id").alias("_d"), F.col("idx").cast("int").alias("_i"), F.translate("name", "'\\", "").alias("font"))
        named = shapes.join(faces, (F.col("doc_id") == F.col("_d")) & (F.get("fonts", F.lit(0)) == F.col("_i")), "left").drop("_d", "_i")
    parts = F.array(
        F.when(F.col("color") != 0, F.concat(F.lit("color:"), F.lower(colour_hex(F.col("color"))))),
        F.when(F.col("height") != BODY_SIZE, F.concat(F.lit("font-size:"), point_size(F.col("height")))),
        F.when(F.col("font") != "", F.concat(F.lit("font-family:'"), escape_html(F.col("font")), F.lit("'"))),
    )
    return named.select("doc_id", "id", on("strike").alias("strike"), on("bold").alias("bold"), on("italic").alias("italic"), F.array_join(parts, ";").alias("css"))


def styled_paragraphs(nodes: DataFrame, shapes: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, path, markdown, html) of the paragraphs, with emphasis and spans; (doc_id, id) is unique in shapes.

    A shape that the catalogue lacks, and the text before the first run, is plain. Markdown has runs of spaces squeezed and its ends trimmed; HTML
    keeps the spaces of a paragraph that has runs. Repeated paragraphs of one path are told apart by nothing and shown once each only if
    their key is unique."""
    look = span_style(shapes, fonts).select(F.col("doc_id").alias("_d"), F.col("id").alias("_s"), "strike", "bold", "italic", "css")
    rows = cut_runs(nodes).join(look, (F.col("doc_id") == F.col("_d")) & (F.col("shape") == F.col("_s")), "left")

    def wrapped(inner: Column, marks: tuple[tuple[str, str, str], ...]) -> Column:
        for flag, left, right in marks:
            inner = F.concat(F.when(F.col(flag), left).otherwise(""), inner, F.when(F.col(flag), right).otherwise(""))
        return inner

    mark = wrapped(shown(F.col("piece")), (("italic", "*", "*"), ("bold", "**", "**"), ("strike", "~~", "~~")))
    tag = wrapped(escape_html(shown(F.col("piece"))), (("italic", "<em>", "</em>"), ("bold", "<strong>", "</strong>"), ("strike", "<s>", "</s>")))
    spanned = F.when(F.coalesce("css", F.lit("")) != "", F.concat(F.lit('<span style="'), F.col("css"), F.lit('">'), tag, F.lit("</span>"))).otherwise(tag)
    html = F.when(F.col("plain"), escape_html(clean_text(F.col("piece")))).otherwise(spanned)
    one = rows.select(*KEYS, F.struct("run", mark.alias("m"), html.alias("h")).alias("x"))
    whole = one.groupBy(*KEYS).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    squeezed = trim_all(F.regexp_replace(F.array_join(F.transform("xs", lambda x: x["m"]), ""), "  +", " "))
    return whole.select(*KEYS, squeezed.alias("markdown"), F.array_join(F.transform("xs", lambda x: x["h"]), "").alias("html"))


def paragraph_style(indent: Column, align: Column) -> Column:
    """` style="padding-left:2em;text-align:center"`, or nothing: an indent of 0 and text that stands left need no mention."""
    css = F.create_map(*[F.lit(x) for kv in ALIGN_CSS.items() for x in kv])
    parts = F.array(F.when(indent > 0, F.concat(F.lit("padding-left:"), indent.cast("string"), F.lit("em"))), F.concat(F.lit("text-align:"), F.try_element_at(css, align.cast("int"))))
    return F.when(F.array_join(parts, ";") != "", F.concat(F.lit(' style="'), F.array_join(parts, ";"), F.lit('"'))).otherwise("")


def html_paragraphs(nodes: DataFrame, shapes: DataFrame, paras: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, path, block): `<p>` elements of the paragraphs that show something, with alignment and with the indent that column `indent`
    of the nodes asks for (0 without one); paras(doc_id, id, align) are met by the attribute `para`."""
    indent = F.col("indent") if "indent" in nodes.columns else F.lit(0)
    own = nodes.where("kind = 'paragraph'").select(*KEYS, F.coalesce(F.try_element_at("attrs", F.lit("para")).try_cast("bigint"), F.lit(0)).alias("_p"), indent.alias("indent"))
    looks = paras.select(F.col("doc_id").alias("_d"), F.col("id").alias("_i"), "align")
    aligned = own.join(looks, (F.col("doc_id") == F.col("_d")) & (F.col("_p") == F.col("_i")), "left").select(*KEYS, paragraph_style(F.col("indent"), F.col("align")).alias("style"))
    text = styled_paragraphs(nodes, shapes, fonts).where(has_visible_body(F.col("html")))
    return text.join(aligned, KEYS).select(*KEYS, F.concat(F.lit("<p"), "style", F.lit(">"), "html", F.lit("</p>")).alias("block"))


# Styles as classes

_SPAN, _CLASS = '<span style="', '<span class="'
#: A rule of the style block that hoisting writes; the block ends at its own line.
_RULE = r"(?m)^article \.(s[0-9]+) \{ ([^\n]*) \}$"


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _swapped(html: Column, head: str, other: str, known: Column) -> Column:
    """html with `head` X `">` become `other` map[X] `">` wherever the map has X."""
    name = lambda p: F.substring_index(p, '"', 1)
    found = lambda p: F.when(F.startswith(F.substring(p, F.length(name(p)) + 1, F.lit(2)), F.lit('">')), F.try_element_at(known, name(p)))
    rest = lambda p: F.substring(p, F.length(name(p)) + 1, F.length(p))
    return F.array_join(F.transform(F.split(html, head), lambda p, i: F.when(i == 0, p).otherwise(F.coalesce(F.concat(F.lit(other), found(p), rest(p)), F.concat(F.lit(head), p)))), "")


def hoisted(html: Column) -> Column:
    """A document with the styles of its spans that stand twice or more as classes s0, s1 .., most frequent first, equal ones by their text; the rules stand before
    it. Without such styles it stays as it is. Null stays null. Counting sorts the styles in the row, and each is looked up as the text is cut."""
    styles = F.transform(F.slice(F.split(html, _SPAN), F.lit(2), F.size(F.split(html, _SPAN))), lambda p: F.substring_index(p, '"', 1))

    def counted(s: Column) -> Column:
        """(-count, style) of each style, sorted."""
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        sizes = lambda b: F.transform(b, lambda i, k: F.struct((i - F.coalesce(F.get(b, k + 1), F.size(s))).alias("n"), F.get(s, i).alias("style")))
        return F.when(F.size(s) == 0, F.array().cast("array<struct<n:int,style:string>>")).otherwise(F.array_sort(_bound(starts, sizes)))

    def written(top: Column) -> Column:
        names = F.map_from_entries(F.transform(top, lambda x, i: F.struct(x["style"], F.concat(F.lit("s"), i.cast("string")))))
        rules = F.array_join(F.transform(top, lambda x, i: F.concat(F.lit("article .s"), i.cast("string"), F.lit(" { "), x["style"], F.lit(" }\n"))), "")
        return F.when(F.size(top) == 0, html).otherwise(F.concat(F.lit("<style>\n"), rules, F.lit("</style>\n"), _bound(names, lambda m: _swapped(html, _SPAN, _CLASS, m))))

    return _bound(F.filter(_bound(F.sort_array(styles), counted), lambda x: x["n"] <= -2), written)


def expanded(html: Column) -> Column:
    """Inverse of hoisted() for documents whose own spans have no class s0, s1 ..: each such class is its rule's style again and the rules go."""
    block = F.regexp_extract(html, r"^<style>\n((?:article \.s[0-9]+ \{ [^\n]* \}\n)+)</style>\n", 1)
    rest = F.substring(html, F.length(block) + len("<style>\n</style>\n") + 1, F.length(html))
    names = F.map_from_arrays(F.regexp_extract_all(block, F.lit(_RULE), 1), F.regexp_extract_all(block, F.lit(_RULE), 2))
    return F.when(block == "", html).otherwise(_bound(names, lambda m: _swapped(rest, _CLASS, _SPAN, m)))
