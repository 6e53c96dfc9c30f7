import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions.formula import latex, tokens
from foliant.operators.edit import align
from foliant.sources import compound, markdown, packages, records


@pytest.mark.parametrize(
    ("script", "want"),
    [
        ("a over b", r"\frac{a}{b}"),
        ("sqrt {x^2}", r"\sqrt{x^{2}}"),
        ("sum from {i=1} to n {x_i}", r"\sum_{i = 1}^{n} {x_{i}}"),
        ("ROOT {3} {x}", r"\sqrt[3]{x}"),
        ("LEFT { a RIGHT }", r"\left\{ a \right\}"),
        ("matrix {a & b ## c & d}", r"\begin{pmatrix} a & b  \\  c & d \end{pmatrix}"),
        ("x != abc", r"x \neq \mathit{abc}"),
        ("Omega >= pi", r"\Omega \geq \pi"),
        ("", ""),
        ("   ", ""),
    ],
)
def test_latex(script, want):
    assert latex(script) == want


def test_tokens():
    assert tokens("a##b<=3.5") == ["a", "##", "b", "<=", "3.5"]
    assert tokens(None) == []


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_latex_never_fails(script):
    assert isinstance(latex(script), str)


@given(st.lists(st.tuples(st.integers(0, 1023), st.integers(0, 1023), st.binary(max_size=50)), max_size=20))
@settings(max_examples=100, deadline=None)
def test_records_round_trip(rows):
    assert list(records.split(records.join(rows))) == rows


def test_long_and_broken_records():
    rows = [(0x43, 1, b"x" * 5000), (0x42, 0, b"")]
    data = records.join(rows)
    assert list(records.split(data)) == rows
    with pytest.raises(ValueError):
        list(records.split(data[:-6]))


@pytest.mark.parametrize("name", list(records.LAYOUTS))
def test_layouts_are_inverse(name):
    rng = random.Random(name)
    if name == "TABLE":
        values = {"attribute": 1, "rows": 2, "cols": 3, "spacing": -4, "padding": [1, 2, 3, 4], "counts": [3, 2], "border_fill_id": 5, "zone_count": 1, "zones": [1, 2, 3, 4, 5], "tail": b"z"}
    elif name in ("STYLE", "FACE_NAME"):
        values = {k: "이름 x" if c == "T" else 3 for k, c in records.LAYOUTS[name]} | {"tail": b"zz"}
    else:
        values = records.decode(name, bytes(rng.randrange(256) for _ in range(90)))
    assert records.decode(name, records.encode(name, values)) == values


def test_paragraph_text():
    control = b"\x02\x00" + b"ABCDEFGHIJKL" + b"\x02\x00"
    data = "a".encode("utf-16-le") + control + "b\r".encode("utf-16-le") + b"\x1e\x00\x18\x00\x1f\x00"
    assert records.paragraph_text(data) == "a￼b\xa0­ "
    assert records.text_record("a￼") is None
    assert records.text_record("a\x02") is None
    assert records.paragraph_text(records.text_record("x\t\n\xa0­ 😀")) == "x\t\n\xa0­ 😀"


def test_compound_round_trip():
    rng = random.Random(5)
    for _ in range(10):
        streams = {f"/{'a/b' if i % 2 else 'BodyText'}/x{i}": rng.randbytes(rng.choice([0, 1, 64, 65, 4095, 4096, 70000])) for i in range(rng.randrange(1, 12))}
        assert compound.read(compound.write(streams)) == dict(sorted(streams.items()))
    big = {"/big": rng.randbytes(9_000_000)}  # more sectors than the header's list of tables covers
    assert compound.read(compound.write(big)) == big
    with pytest.raises(ValueError):
        compound.read(b"PK\x03\x04")


def test_package_nodes():
    nodes = [
        ("p0", "paragraph", {"para": "1", "style": "2", "page_break": "1", "runs": "0:5|3:6"}, "가나다<b>\n&"),
        ("p0/t0", "table", {"rows": "1", "cols": "2", "border": "3", "spacing": "0"}, ""),
        ("p0/t0/c0", "cell", {"row": "0", "col": "0", "row_span": "1", "col_span": "2", "width": "10", "height": "20", "border": "1"}, ""),
        ("p0/t0/c0/p0", "paragraph", {"para": "0", "style": "0", "page_break": "0", "runs": "0:0"}, "cell"),
        ("p0/i0", "picture", {"bin": "image3", "width": "5", "height": "6"}, ""),
        ("p1", "paragraph", {"para": "0", "style": "0", "page_break": "0", "runs": "0:0"}, ""),
    ]
    assert packages.nodes_of(packages.section_xml(nodes)) == nodes
    parts = [("Contents/section0.xml", packages.section_xml(nodes)), ("mimetype", packages.MIMETYPE)]
    assert packages.unzip(packages.zip_parts(parts)) == parts[::-1]


def test_markdown_blocks():
    text = "# A #\n\none\ntwo\n\n| a | b\\|c |\n| --- | --- |\n| 1 |\n\n![x](img.png) tail\n```\n# code\n```\n###### f"
    assert markdown.blocks(text) == [
        ("heading", 1, 0, 0, "A"), ("paragraph", 0, 0, 0, "one two"), ("cell", 0, 0, 0, "a"), ("cell", 0, 0, 1, "b|c"), ("cell", 0, 1, 0, "1"), ("cell", 0, 1, 1, ""),
        ("image", 0, 0, 0, "img.png"), ("paragraph", 0, 0, 0, "tail"), ("code", 0, 0, 0, "# code"), ("heading", 6, 0, 0, "f"),
    ]
    assert markdown.blocks(None) == []


def test_align():
    assert align(["a", "", "b"], ["a", "b"]) == [(0, 0), (1, None), (2, 1)]
    assert align(["a", "b"], ["a", "new", "b"]) == [(0, 0), (None, 1), (1, 2)]
    assert align(["a", "gone", "b"], ["a", "b"]) == [(0, 0), (2, 1)]
    assert align(["a", "old", "b"], ["a", "edited", "b"]) == [(0, 0), (1, 1), (2, 2)]
    assert align([], ["x"]) == [(None, 0)]
    assert align(["x"], []) == []


def test_emission(spark):
    from foliant.operators.emit import to_html, to_markdown, to_records
    from foliant.plans.fixtures import nodes

    tree = nodes(spark)
    md = {r.doc_id: r.markdown for r in to_markdown(tree).collect()}
    assert md == {1: "# 1. 개요\n\na <b> & c\n\n| head\\|er | |\n| --- | --- |\n| x y |  |\n\n\n## 1.2 next", 2: "only"}
    html = {r.doc_id: r.html for r in to_html(tree).collect()}
    assert html[1] == '<article><h1>1. 개요</h1><p>a &lt;b&gt; &amp; c</p><table><tr><td colspan="2">head|er</td></tr><tr><td>x y</td><td></td></tr></table><h2>1.2 next</h2></article>'
    assert {r.doc_id: r.records for r in to_records(tree).collect()}[2] == "PARAGRAPH[id=s0-p0]\nTEXT: only"


def test_package_stream(spark, tmp_path):
    from foliant.streaming.folder import package_stream

    body = packages.section_xml([("p0", "paragraph", {"runs": "0:1"}, "streamed")])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.hwpx").write_bytes(packages.zip_parts([("mimetype", packages.MIMETYPE), ("Contents/section0.xml", body)]))
    q = package_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("nodes_seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert [r.text for r in spark.sql("SELECT text FROM nodes_seen").collect()] == ["streamed"]
    finally:
        q.stop()


def test_typed_records(spark):
    from foliant.sources import binary

    style = {"name": "바탕글", "english_name": "Normal", "properties": 0, "next_style_id": 1, "lang_id": 1042, "para_shape_id": 2, "char_shape_id": 3}
    info = records.join([(records.TAGS["STYLE"], 0, records.encode("STYLE", style)), (records.TAGS["BIN_DATA"], 0, b"xx"), (records.TAGS["STYLE"], 0, records.encode("STYLE", style | {"name": "본문"}))])
    held = {"/FileHeader": binary.file_header(), "/DocInfo": records.deflate(info), "/BinData/BIN0001.png": b"\x89PNG"}
    files = spark.createDataFrame([(7, bytearray(compound.write(held)))], "doc_id long, content binary")
    streams = binary.streams(files)
    assert {(r.stream, r.flags) for r in streams.collect()} == {("/FileHeader", 1), ("/DocInfo", 1), ("/BinData/BIN0001.png", 1)}
    got = binary.typed(binary.record_rows(streams), "STYLE").orderBy("slot").collect()
    assert [(r.slot, r.name, r.lang_id) for r in got] == [(0, "바탕글", 1042), (1, "본문", 1042)]


def test_align_against_brute_force():
    import random
    from functools import lru_cache

    from foliant.operators.edit import _names, _shown, anchors

    rng = random.Random(7)
    for _ in range(300):
        frozen, typed = ([rng.choice(["a", "b", "c\nd", "c", "", " ", "e"]) for _ in range(rng.randrange(9))] for _ in range(2))

        @lru_cache(None)
        def longest(i, j):
            if i == len(frozen) or j == len(typed):
                return 0
            hit = 1 + longest(i + 1, j + 1) if _shown(typed[j]) in _names(frozen[i]) else 0
            return max(hit, longest(i + 1, j), longest(i, j + 1))

        assert len(anchors(frozen, typed)) == longest(0, 0)
        got = align(frozen, typed)
        old, new = ([p[k] for p in got if p[k] is not None] for k in (0, 1))
        assert old == sorted(set(old)) and new == list(range(len(typed)))
        assert set(anchors(frozen, typed)) <= set(got)
        put_back = [i for i, j in got if j is None]
        assert all(not _shown(frozen[i]) for i in put_back)
        dropped = [i for i in range(len(frozen)) if i not in old]
        assert all(_shown(frozen[i]) for i in dropped if old and i < old[-1])
    assert align(["x", ""], ["", "y"]) == [(None, 0), (0, 1), (1, None)]
    assert align(["a", "x", "b"], ["a", "", "b"]) == [(0, 0), (1, 1), (2, 2)]


def test_styles_are_named_within_documents(spark):
    from foliant.operators.parts import hoisted_styles

    uses = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "b"), (2, "a"), (2, "a"), (2, "a")], "doc_id long, style string")
    assert {tuple(r) for r in hoisted_styles(uses).collect()} == {(1, "a", 2, "s0"), (2, "a", 3, "s0"), (2, "b", 2, "s1")}
    assert {tuple(r) for r in hoisted_styles(uses.drop("doc_id")).collect()} == {("a", 5, "s0"), ("b", 3, "s1")}


def test_lines_cleaned_whole_equal_lines_cleaned_alone(spark):
    from pyspark.sql import functions as F

    from foliant.functions import text as X
    from foliant.operators import documents as D

    space = "\t\x0b\r \x85   　"
    texts = [None, "", "\n", " \n ", "a  b\n\n 1. x \n", f"{space}\n{space}1.2 a{space}\nb{space}", "\n\t\n\r\n1.\tx다.\n­1 ­ y", "\x1d a \x1d\n" + "\t" * 50_000 + "x\n" + " " * 50_000, "2 a\n\n3.1 b\nc\n4.1.2 d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alone = F.transform(F.split("text", "\n"), X.clean_text)
    levels = F.transform(F.split("text", "\n"), X.text_heading_level)
    got = docs.select(X.clean_lines(F.col("text")).alias("a"), alone.alias("b"), F.transform(X.clean_lines(F.col("text")), X.cleaned_heading_level).alias("c"), levels.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
    lines = D.paragraphs(docs).withColumn("level", X.text_heading_level(F.col("text")))
    assert sorted(D.chapter_depth(lines).select("doc_id", "seq", "depth").collect()) == sorted(D.chapter_depths(docs).collect())
    parsed = D.parsed_records(D.record_lines(docs)).groupBy("doc_id").agg(F.count_if(F.col("kind") == "PARAGRAPH"), F.count_if(F.col("kind") == "TEXT"), F.coalesce(F.sum(F.length("body")), F.lit(0)))
    assert sorted(map(tuple, parsed.collect())) == sorted(map(tuple, D.record_counts(D.record_lines(docs)).collect()))


def test_headers_of_odd_packages(spark):
    from pyspark.sql import functions as F

    from foliant.sources import headers as H

    xml = """<?xml version="1.0"?><h:head xmlns:h="x" xmlns:c="y"><h:refList>
<h:fontfaces><h:fontface lang="LATIN"><h:font face="A&amp;B"/><h:font face="C"><h:substFont face="no"/></h:font></h:fontface><h:fontface lang="KLINGON"><h:font/></h:fontface></h:fontfaces>
<h:borderFills><h:borderFill id="1"/><h:borderFill id="3"><c:fillBrush><c:winBrush faceColor="none"/></c:fillBrush></h:borderFill><h:borderFill id="4"><c:fillBrush><c:winBrush faceColor="#6E6E6E"/></c:fillBrush></h:borderFill></h:borderFills>
<h:charProperties><h:charPr id="2" height="900" textColor="#FF0000" shadeColor="none"><h:bold/><h:underline shape="none" color="#00FF00"/><h:strikeout shape="SOLID" color="#0000FF"/><h:ratio hangul="90" latin="999"/><h:spacing hangul="-5"/></h:charPr>
<h:charPr id="2" height="x"><h:italic/><h:underline/></h:charPr><h:charPr/></h:charProperties>
<h:paraProperties><h:paraPr id="0"><h:align horizontal="center"/></h:paraPr><h:paraPr id="1"><h:align horizontal="UP"/></h:paraPr><h:paraPr id="2"/></h:paraProperties>
<h:styles><h:style id="0" type="PARA" name="개요 2" engName="" langID="9999999"/><h:style id="7" type="CHAR" name="x"/></h:styles></h:refList></h:head>"""
    rows = [(1, H.PART, xml.encode()), (2, H.PART, b"<h:head><broken"), (3, H.PART, b""), (4, H.PART, None), (5, "other.xml", b"<a/>"), (6, H.PART, b"<head><refList/></head>")]
    head = H.headers(spark.createDataFrame(rows, "doc_id long, name string, bytes binary"))
    assert {tuple(r) for r in H.fonts(head).collect()} == {(1, "latin", 0, "A&B"), (1, "latin", 1, "C"), (1, "other", 0, "")}
    fills = H.border_fills(head)
    assert {tuple(r) for r in fills.collect()} == {(1, 1, None), (1, 3, None), (1, 4, 0x6E6E6E)}
    shapes = H.char_shapes(head)
    got = {r.id: r for r in shapes.collect()}
    assert set(got) == {0, 2} and (got[2].attr, got[2].height, got[2].underline_color) == (1 | 4, 1000, 0) and got[0].ratios == [100] * 7 and got[0].attr == 0
    assert {tuple(r) for r in H.para_shapes(head).collect()} == {(1, 0, 3), (1, 1, 1), (1, 2, 0)}
    styles = H.styles(head)
    assert {(r.id, r.is_char, r.lang) for r in styles.collect()} == {(0, False, 0), (7, True, 0)}

    nodes = [
        (1, 0, 0, "p0", "paragraph", {"style": "0", "runs": "0:2|3:9"}, "a\U0001d54fbc"), (1, 0, 1, "p1", "paragraph", {}, None), (1, 0, 2, "p1/t0", "table", {}, ""), (1, 0, 3, "p1/t0/c0", "cell", {"border": "4"}, ""),
        (1, 0, 4, "p1/t0/c1", "cell", {"border": "3"}, ""), (9, 0, 0, "p0", "paragraph", {"style": "0"}, "1.2 x"),
    ]
    nodes = spark.createDataFrame(nodes, "doc_id long, section int, ord int, path string, kind string, attrs map<string,string>, text string")
    assert {(r.doc_id, r.path, r.level) for r in H.with_heading_levels(nodes, styles).collect() if r.level} == {(1, "p0", 2), (1, "p1", 2), (9, "p0", 2)}
    assert {tuple(r)[2:] for r in H.cell_tones(nodes, fills).collect()} == {("p1/t0/c0", "#6E6E6E", "dark"), ("p1/t0/c1", None, "none")}
    runs = {(r.doc_id, r.path, r.run): (r.text, r.italic, r.bold, r.height) for r in H.text_runs(nodes, shapes).collect()}
    assert runs == {(1, "p0", 0): ("a\U0001d54f", True, False, 1000), (1, "p0", 1): ("bc", False, False, 1000), (1, "p1", 0): ("", False, False, 1000), (9, "p0", 0): ("1.2 x", False, False, 1000)}

    one = spark.range(1).select(F.lit(3).alias("id"), F.lit(9).alias("align"))
    kinds = [H.para_shape_xml(spacing=F.lit(v), spacing_kind=F.lit(k)) for v, k in ((0, 0), (0, 1), (5, 2), (150, None))]
    found = one.select(*kinds, H.border_xml("leftBorder", F.lit(7), F.lit(0), F.lit(255))).collect()[0]
    assert [x.split("lineSpacing ")[1].split(" unit")[0] for x in found[:4]] == ['type="PERCENT" value="160"', 'type="FIXED" value="0"', 'type="BETWEEN_LINE" value="5"', 'type="PERCENT" value="150"']
    assert all('horizontal="LEFT"' in x for x in found[:4]) and found[4] == '<hh:leftBorder type="DOUBLE" width="0.10 mm" color="#FF0000"/>'


def test_assets_of_odd_documents(spark):
    from foliant.operators import assets as E

    binaries = spark.createDataFrame([(1, 0, "BIN000A.png", b"x"), (1, 1, "logo", b"\x00\xff"), (1, 2, "empty.png", b""), (2, 0, "a.png", None)], "doc_id long, ord int, id string, bytes binary")
    sections = spark.createDataFrame([(1, 10, b"s10"), (1, 9, b"s9"), (3, 0, None)], "doc_id long, section int, bytes binary")
    streams = spark.createDataFrame([(4, "META-INF/container.rdf", b"r" * 500)], "doc_id long, name string, bytes binary")
    block = E.assets_block(binaries, sections, streams)
    rows = {(r.doc_id, r.kind, r.name, r.mime, bytes(r.bytes)) for r in E.asset_rows(block).collect()}
    assert rows == {
        (1, "ASSET", "BIN000A.png", "image/png", b"x"), (1, "ASSET", "logo", E.OCTETS, b"\x00\xff"), (1, "SECTION_BYTES", "section-9", E.OCTETS, b"s9"),
        (1, "SECTION_BYTES", "section-10", E.OCTETS, b"s10"), (4, "UNKNOWN_STREAM", "META-INF/container.rdf", E.OCTETS, b"r" * 500),
    }
    text = {r.doc_id: r.assets for r in block.collect()}
    assert set(text) == {1, 4} and text[1].index("bin_id=10,") < text[1].index("bin_id=logo,") < text[1].index("section-9,") < text[1].index("section-10,")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ASSET[id=a,source_id=b.png]\nDATA: data:image/png;base64,!!"), (4, "ASSET[id=a]\nno data\nASSET[id=b]")], "doc_id long, assets string")
    assert [tuple(r) for r in E.asset_rows(odd).collect()] == [(3, "ASSET", "b.png", "image/png", None)]


def test_record_trees(spark):
    import random

    from foliant.operators import outline as O

    r = random.Random(7)

    def lines(depth: int) -> list[str]:
        out = [f"TABLE[id=t,border_fill={r.randrange(4)},cell_spacing={r.randrange(2)}]"]
        for i in range(r.randrange(4)):
            out.append(f"CELL[row={i},col={r.randrange(3)},rowspan={r.randrange(3)},colspan=2,width={r.randrange(9)}]")
            for _ in range(r.randrange(4)):
                out += [lambda: [f"TEXT[par-x,para_shape={r.randrange(3)},char_shape={r.randrange(3)}]: c\\\\{r.random()}\\ty"], lambda: lines(depth + 1) if depth < 3 else ["TEXT:"], lambda: [f"FIGURE[bin_id={r.randrange(9)},width_mm=12]"]][r.randrange(3)]()
        return [*out, "END TABLE[t]"] if r.random() < 0.9 or depth else out

    def section() -> list[str]:
        out = ["SECTION[id=s]"]
        for _ in range(r.randrange(6)):
            head = f"PARAGRAPH[id=p,para_shape={r.randrange(3)},char_shape={r.randrange(3)},page_break={r.randrange(2)}" + r.choice(["", ",level=3", ",lineseg=1:2:3:4:5:6:7:8:9"]) + "]"
            out += [head, *r.choice([[], ["TEXT: plain"], ["TEXT: ### atx"], ["TEXT: line\\nbreak"]])] if r.random() < 0.6 else r.choice([lambda: [head, *lines(0)], lambda: lines(0), lambda: ["FIGURE[bin_id=2]"]])()
        return out

    texts = ["\n".join(x for _ in range(r.randrange(1, 4)) for x in section()) for _ in range(150)]
    odd = [None, "", "nothing", "END TABLE[x]\nCELL[row=0]\nTEXT: loose", "TABLE[a]\nTEXT: dropped\nFIGURE[bin_id=1]\nTABLE[lost]\nCELL[row=9999999999999999999999,col=-4]", "PARAGRAPH[level=99]\nTEXT: x", "PARAGRAPH[id=a", "TEXT[a]", "SECTION[a]\nSECTION[b]\nTEXT: one"]
    docs = spark.createDataFrame(list(enumerate(odd + texts)), "doc_id long, records string")
    first = O.nodes(docs)
    rows = lambda d: sorted((x.doc_id, x.section, x.ord, x.path, x.kind, sorted(x.attrs.items()), x.text.replace("\n", " ")) for x in d.collect())
    got = rows(first)
    assert len(got) > 1000 and any(x[3].count("t") > 2 for x in got)
    held = {d: [(x[1], x[3], x[4], x[6]) for x in got if x[0] == d] for d in range(len(odd))}
    assert [held[i] for i in (0, 1, 2, 6, 7)] == [[]] * 2 + [[]] + [[]] * 2
    assert held[3] == [(0, "p0", "paragraph", "loose")] and held[8] == [(0, "p0", "paragraph", "one")] and held[5] == [(0, "p0", "paragraph", "x")]
    assert held[4] == [(0, "p0", "paragraph", O.ANCHOR), (0, "p0/t0", "table", ""), (0, "p0/t0/c0", "cell", ""), (0, "p0/t0/c0/p0", "paragraph", "")]
    written = O.to_records(first)
    assert got == rows(O.nodes(written))
    counts = {d.doc_id: d.records.count("\nEND TABLE[") for d in written.collect()}
    assert all(counts[d] == sum(x[0] == d and x[4] == "table" for x in got) for d in counts)
    plan = written._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1, "the nodes are read once"


def test_binary_data_records():
    for values in ({"property": 0x10, "absolute_path": "C:\\x", "relative_path": "", "tail": b""}, {"property": 0x21, "bin_id": 7, "extension": "png", "tail": b"t"}, {"property": 2, "bin_id": 0, "extension": "", "tail": b""}):
        assert records.decode("BIN_DATA", records.encode("BIN_DATA", values)) == values
    for broken in (b"\x03\x00\x00\x00", b"", b"\x01\x00\x07\x00\x09\x00a"):
        with pytest.raises(ValueError):
            records.decode("BIN_DATA", broken)


def random_section(rng, depth=0):
    """Random records of paragraphs at a level, as the writer orders them: text, runs, lines, other records, controls."""
    T, out = records.TAGS, []
    level = 2 * depth
    for _ in range(rng.randrange(1, 4)):
        head = dict(records.decode("PARA_HEADER", bytes(22))) | {"para_shape_id": rng.randrange(9), "style_id": rng.randrange(9), "divide_sort": rng.randrange(8), "char_count": 1 << 31}
        out.append((T["PARA_HEADER"], level, records.encode("PARA_HEADER", head)))
        words = rng.choice([b"", "a\r".encode("utf-16-le"), "가b".encode("utf-16-le"), records.text_record("x￼y", [b" lbt"])])
        own = [("PARA_TEXT", words), ("PARA_CHAR_SHAPE", b"".join(rng.randrange(99).to_bytes(4, "little") for _ in range(2 * rng.randrange(3)))), ("PARA_LINE_SEG", bytes(36 * rng.randrange(3)))]
        out += [(T[n], level + 1, data) for n, data in own if data]
        if rng.random() < 0.3:
            out += [(0x46, level + 1, b"range"), (0x60, level + 3, b"deep")]
        for kind in rng.choices(["table", "picture", "line", "note"], k=rng.randrange(3)):
            if kind == "table":
                out += [(T["CTRL_HEADER"], level + 1, b" lbtdata"), *([(T["LIST_HEADER"], level + 2, b"caption")] if rng.random() < 0.3 else [])]
                out.append((T["TABLE"], level + 2, records.encode("TABLE", {"attribute": 3, "rows": 1, "cols": 2, "spacing": 0, "padding": [1] * 4, "counts": [2], "border_fill_id": 4})))
                for col in range(2):
                    inner = random_section(rng, depth + 1) if depth < 2 else []
                    n = sum(r[0] == T["PARA_HEADER"] and r[1] == level + 2 for r in inner)
                    cell = records.decode("LIST_HEADER", bytes(47)) | {"para_count": n, "col": col, "row_span": 1, "border_fill_id": 9, "padding": [col] * 4}
                    out.append((T["LIST_HEADER"], level + 2, records.encode("LIST_HEADER", cell)))
                    out += inner
            elif kind == "note":
                out += [(T["CTRL_HEADER"], level + 1, b"  nf"), (T["LIST_HEADER"], level + 2, b"x"), (T["PARA_HEADER"], level + 2, bytes(22)), (T["PARA_TEXT"], level + 3, b"n\0")]
            else:
                out += [(T["CTRL_HEADER"], level + 1, b" osg" + bytes(36)), (T["LIST_HEADER"], level + 2, b""), (T["PARA_HEADER"], level + 2, bytes(22)), (T["PARA_TEXT"], level + 3, " cap ".encode("utf-16-le"))]
                out += [(T["SHAPE_COMPONENT"], level + 2, b"cip$more" if kind == "picture" else b"nil$"), (T["PICTURE"], level + 3, bytes(71) + b"\x05\x01zz")]
    return out


def test_section_trees_of_random_records():
    from foliant.sources import body

    rng = random.Random(11)
    kinds = set()
    for i in range(200):
        rows = ([(0x4A, 0, b"prelude"), (0x49, 1, b"page")] if i % 3 == 0 else []) + random_section(rng)
        nodes = body.nodes_of(rows)
        assert body.records_of(nodes) == rows
        assert len({n[0] for n in nodes}) == len(nodes)
        kinds |= {n[1] for n in nodes}
        shapes = [n for n in nodes if n[2].get("code") == "gso "]
        assert all(n[2]["caption"] == "cap" for n in shapes)
        assert all((n[2]["bin"], n[2]["width"]) == ("261", "0") for n in shapes if n[1] == "picture")
        # Every paragraph header outside notes and captions is a paragraph node.
        hidden = sum(r[0] == records.TAGS["CTRL_HEADER"] and r[2][:4] in (b"  nf", b" osg") for r in rows)
        assert sum(n[1] == "paragraph" for n in nodes) == sum(r[0] == records.TAGS["PARA_HEADER"] for r in rows) - hidden
    assert kinds == {"loose", "paragraph", "table", "cell", "picture", "control"}


def test_edited_section_trees():
    from foliant.sources import body

    nodes = [("p0", "paragraph", {"page_break": "1"}, "new\xa0text"), ("p1", "paragraph", {}, "￼￼"), ("p1/t0", "table", {"rows": "1", "cols": "1"}, ""), ("p1/t0/c0", "cell", {}, ""), ("p1/t0/c0/p0", "paragraph", {"runs": "0:3|2:4"}, "abc"), ("p1/i0", "picture", {"bin": "12", "width": "3"}, "")]
    back = body.nodes_of(records.split(records.join(body.records_of(nodes))))
    assert [(n[0], n[1], n[3]) for n in back] == [(n[0], n[1], n[3]) for n in nodes]
    assert back[0][2]["page_break"] == "1" and back[4][2]["runs"] == "0:3|2:4" and back[5][2]["bin"] == "12"
    back[0] = (*back[0][:3], "edited")
    back[5] = (*back[5][:2], back[5][2] | {"bin": "700", "height": "8"}, "")
    again = body.nodes_of(body.records_of(back))
    assert again[0][3] == "edited" and (again[5][2]["bin"], again[5][2]["width"], again[5][2]["height"]) == ("700", "3", "8")
    assert body.records_of([]) == [] and body.nodes_of([]) == []
    for bad in ("￼", "\x01"):
        with pytest.raises(ValueError):
            body.records_of([("p0", "paragraph", {}, bad)])
    with pytest.raises(ValueError):
        body.nodes_of([(records.TAGS["PARA_HEADER"], 0, bytes(22)), (records.TAGS["PARA_LINE_SEG"], 1, bytes(35))])


def test_first_difference(spark):
    from foliant.operators.parts import first_difference

    rows = [(b"abc", b"abd"), (b"ab", b"abc"), (b"", b""), (b"", b"x"), (None, b"x"), (b"same", b"same")]
    df = spark.createDataFrame([tuple(bytearray(x) if x is not None else None for x in r) for r in rows], "a binary, b binary")
    assert [r.x for r in df.select(first_difference(df.a, df.b).alias("x")).collect()] == [2, 2, None, 0, None, None]


def test_readers_hold_no_whole_batch():
    import pyarrow as pa

    from foliant.spark import batched

    taken = []
    rows = ((taken.append(i) or i, str(i)) for i in range(10_000))
    made = batched(rows, ["i", "s"], (pa.int64(), pa.string()), 1000)
    assert next(made).num_rows == 1000 and len(taken) == 1000
    assert sum(b.num_rows for b in made) == 9000 and not list(batched(iter(()), ["i"], (pa.int64(),)))


def test_parts_are_inflated_one_by_one():
    """Reading a package holds one part at a time, and writing takes bytes where they lie."""
    import tracemalloc

    from foliant.sources import packages

    data = packages.zip_parts([(f"p{i}", memoryview(bytes(4 << 20))) for i in range(8)])
    tracemalloc.start()
    try:
        assert [(n, len(x)) for n, x in packages.unzipped(memoryview(data))] == [(f"p{i}", 4 << 20) for i in range(8)]
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()


def test_files_are_read_once_by_one_worker_a_task(spark, sf_dir):
    from foliant.plans import registry
    from foliant.sources import binary, compound, records

    section = records.join([(records.TAGS["PARA_HEADER"], 0, bytes(22)), (records.TAGS["PARA_TEXT"], 1, "a\nb".encode("utf-16-le"))])
    info = records.join([(records.TAGS["FACE_NAME"], 0, b"\0" * 5)])
    for flags, packed in ((binary.COMPRESSED, records.deflate), (0, bytes)):
        held = {"/FileHeader": binary.file_header(flags), "/DocInfo": packed(info), "/BodyText/Section0": packed(section), "/BodyText/Section12": b"", "/BinData/BIN0001.png": b"x"}
        files = spark.createDataFrame([(7, bytearray(compound.write(held)))], "doc_id long, content binary")
        streams = binary.streams(files)
        assert sorted(map(str, binary.nodes_of_files(files).collect())) == sorted(map(str, binary.nodes(streams).collect())) != []
        assert sorted(map(str, binary.record_rows_of_files(files).collect())) == sorted(map(str, binary.record_rows(streams).collect())) != []
    for flags in (binary.ENCRYPTED, None):
        files = spark.createDataFrame([(7, bytearray(compound.write({"/FileHeader": binary.file_header(flags)} if flags else {"/x": b"y"})))], "doc_id long, content binary")
        with pytest.raises(Exception, match="encrypted|no document header"):
            binary.nodes_of_files(files).collect()
    for name in ("binary_tables", "binary_pictures", "info_binaries"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        steps = re.findall("MapInArrow|Exchange", plan)
        assert steps.count("MapInArrow") == 3 and ("MapInArrow", "MapInArrow") not in zip(steps, steps[1:]), steps


def test_headers_pass_in_pieces(spark):
    import io
    import zipfile
    from xml.etree import ElementTree

    from pyspark.sql import functions as F

    from foliant.sources import headers as H
    from foliant.sources import packages as Z

    n = 3000
    own = spark.range(n).select(F.when(F.col("id") < n - 2, 1).otherwise(None).cast("long").alias("doc_id"), "id")
    fonts = own.select("doc_id", F.when(F.col("id") % 2 == 0, "latin").otherwise("user").alias("slot"), F.col("id").alias("idx"), F.concat(F.lit("<&\""), F.col("id").cast("string")).alias("name"))
    fills, paras = own.select("doc_id", "id", F.col("id").alias("face")), own.select("doc_id", "id", (F.col("id") % 6).cast("int").alias("align"))
    seven = F.array(*[F.lit(9)] * 7)
    chars = own.select("doc_id", "id", F.lit(1).alias("attr"), *(F.col("id").alias(c) for c in ("height", "color", "shade", "border_fill", "underline_color", "strike_color")), *(seven.alias(c) for c in ("fonts", "ratios", "sizes", "spacings", "offsets")))
    styles = own.where("doc_id = 1").select("doc_id", "id", F.lit(False).alias("is_char"), F.lit("가").alias("name"), F.repeat(F.lit("x"), 300).alias("english"), *(F.col("id").alias(c) for c in ("para_shape", "char_shape", "next_style")), F.lit(0).alias("lang"))
    pieces = H.header_pieces(fonts, fills, chars, paras, styles)
    packages = Z.packages_of(pieces).persist()
    # Neither a piece that is written nor one that is read holds more than a part of the header, and no row gathers them.
    for df in (pieces, packages, H.headers_of(packages)):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert pieces.agg(F.max(F.octet_length("bytes"))).first()[0] < 2000
    assert H.headers_of(packages).agg(F.max(F.octet_length("xml"))).first()[0] < H.PIECE_BYTES + 2000
    for r in packages.collect():
        own_n = n - 2 if r.doc_id == 1 else 2
        package = zipfile.ZipFile(io.BytesIO(r.content))
        assert package.namelist() == ["mimetype", H.PART] and package.read("mimetype") == Z.MIMETYPE
        root = ElementTree.fromstring(package.read(H.PART))
        got = {t.tag.rpartition("}")[2]: (t.get("itemCnt"), len(t)) for t in root[0]}
        assert list(got) == ["fontfaces", "borderFills", "charProperties", "paraProperties", "styles"]
        assert got["fontfaces"] == ("2", 2) and got["charProperties"] == (str(own_n), own_n) and got["styles"] == ((str(own_n), own_n) if r.doc_id else ("0", 0))
        assert [int(e.get("id")) for e in root[0][1]] == list(range(own_n) if r.doc_id else range(n - 2, n)) and [f.get("lang") for f in root[0][0]] == ["LATIN", "USER"]
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    faces = [(d, s, i, f'<&"{k}') for d, ids in ((1, range(n - 2)), (None, range(n - 2, n))) for s, m in (("latin", 0), ("user", 1)) for i, k in enumerate(k for k in ids if k % 2 == m)]
    assert rows(H.fonts(H.headers_of(packages, "fontfaces")), "doc_id", "slot", "idx", "name") == sorted(faces, key=str)
    assert rows(H.para_shapes(H.headers_of(packages)), "doc_id", "id", "align") == rows(paras, "doc_id", "id", "align")
    assert rows(H.styles(H.headers_of(packages, "styles")), "doc_id", "id", "name", "english") == rows(styles, "doc_id", "id", "name", "english")
    assert rows(H.char_shapes(H.headers(Z.parts(packages))), "doc_id", "id", "height", "sizes") == rows(chars, "doc_id", "id", F.when(F.col("height") > -1, F.col("height")), F.array(*[F.lit(9)] * 7))


def test_pieces_of_odd_headers(monkeypatch):
    import io

    from foliant.sources import headers as H

    def read(xml, *tables):
        return [(t, at, x) for t, at, _, x in H._pieces(lambda: io.BytesIO(xml.encode()), tables or tuple(H._NAMES))]

    for chunk, piece in ((1, 1), (7, 2), (1 << 16, 256)):
        monkeypatch.setattr(H, "CHUNK", chunk)
        monkeypatch.setattr(H, "PIECE", piece)
        monkeypatch.setattr(H, "PIECE_BYTES", 1 << 18 if chunk > 7 else 5)
        joined = lambda xml, *t: "".join(x for _, _, x in read(xml, *t))
        # The last of several tables counts, those in the list of references before others, and an empty one not.
        assert joined("<h><styles><style id='1'/></styles><styles><style id='2'/></styles><refList><styles/></refList></h>") == "<style id='2'/>"
        assert joined("<h><styles><style id='1'/></styles><refList><styles><style id='2'/><a><style id='9'/></a></styles></refList></h>") == "<style id='2'/><a><style id='9'/></a>"
        assert joined("<h><refList><styles><style id='1'/></styles></refList><refList><paraProperties><paraPr/></paraProperties></refList></h>") == "<paraPr/>"
        assert joined("<h><x:refList xmlns:x='y'><x:styles><!-- <style id='1'> --><x:style name='a>b'><![CDATA[</style>]]></x:style>가</x:styles></x:refList></h>") == "<x:style name='a>b'><![CDATA[</style>]]></x:style>가"
        # Every piece of a font face has the face's own tag.
        xml = "<h><refList><fontfaces><f:fontface xmlns:f='g'\n lang='LATIN'><font face='1'/><font face='2'/><font face='3'/></f:fontface><fontface/><fontface><font/></fontface></fontfaces><styles><style/></styles></refList></h>"
        got = read(xml, "fontfaces")
        assert [at for _, at, _ in got] == sorted(at for _, at, _ in got) and {at for _, at, _ in got} == {0, 2}
        assert all(x.startswith("<fontface xmlns:f='g'\n lang='LATIN'>") and x.endswith("</fontface>") for _, at, x in got if at == 0)
        assert "".join(x for _, at, x in got if at == 0).count("<font ") == 3 and joined(xml, "fontfaces").endswith("<fontface><font/></fontface>")
        # What isn't well-formed has none, however late that shows.
        for end in ("", "</refList>", "</refList></h><x>", "</refList></h>x", "</refList>&no;</h>"):
            assert read("<h><refList><styles><style/></styles>" + "<a/>" * 50 + end) == []


def test_headings_of_known_styles_read_the_headers_once(spark, sf_dir):
    from foliant.plans import registry
    from foliant.sources import headers as H

    nodes = spark.createDataFrame([(1, "a", "paragraph", {"style": "3"}, "x"), (1, "b", "paragraph", {"style": "4"}, "1. x"), (1, "c", "paragraph", {}, "1. x"), (2, "d", "table", {"style": "3"}, None)], "doc_id long, path string, kind string, attrs map<string,string>, text string")
    styles = spark.createDataFrame([(1, 3, False, "개요 2", ""), (1, 4, True, "", ""), (1, 0, False, "", ""), (2, 3, False, "개요 1", "")], "doc_id long, id long, is_char boolean, name string, english string")
    assert {(r.path, r.level) for r in H.with_heading_levels(nodes, styles, known=True).collect()} == {("a", 2), ("c", 1), ("d", None)}
    plan = registry.QUERIES["styled_headings"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # Sections and headers are each read by two steps in Python.
    assert plan.count("MapInArrow") == 4
