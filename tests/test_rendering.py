"""Styled runs, nested tables and chapters against direct walks."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.attributes import CHAR_BITS
from foliant.operators import nested as N
from foliant.operators import styling as Y

NODE = "doc_id long, section int, ord int, path string, kind string, attrs map<string,string>, text string"
SHAPES = "doc_id long, id long, attr int, height long, color long, fonts array<int>"
FLAGS = {"strike": ("~~", "s"), "bold": ("**", "strong"), "italic": ("*", "em")}


def shape(i, *flags, height=1000, color=0):
    return (1, i, sum(1 << CHAR_BITS[f][0] for f in flags), height, color, [0])


def walked(text, runs, shapes, html):
    """Character by character: the last listed run that has begun at the character's UTF-16 offset."""
    known = {s[1]: s for s in shapes}
    out, active, at, stack = "", None, 0, []
    for c in text:
        now = next((s for start, s in reversed(runs) if start <= at), None)
        if now != active:
            out += "".join(reversed(stack))
            stack, active = [], now
            for flag, (mark, tag) in FLAGS.items():
                if now in known and known[now][2] >> CHAR_BITS[flag][0] & 1:
                    out += f"<{tag}>" if html else mark
                    stack.append(f"</{tag}>" if html else mark)
        out += "" if c in "￼­" else " " if c in "  " else {"&": "&amp;", "<": "&lt;"}.get(c, c) if html else c
        at += len(c.encode("utf-16-le")) // 2
    out += "".join(reversed(stack))
    while not html and "  " in out:
        out = out.replace("  ", " ")
    return out if html else out.strip()


def test_runs_against_a_walk(spark):
    r = random.Random(4)
    shapes = [shape(0), shape(1, "bold"), shape(2, "italic", "bold"), shape(3, "strike"), shape(4, "strike", "bold", "italic"), shape(5, "bold")]
    cases = []
    for i in range(400):
        text = "".join(r.choice("ab <&  ￼­😀한\U0010ffff") for _ in range(r.randrange(0, 14)))
        starts = [r.randrange(0, 16) for _ in range(r.randrange(1, 6))]
        cases.append((text, [(s, r.randrange(0, 8)) for s in (sorted(starts) if i % 3 else starts)]))
    rows = [(1, 0, i, f"p{i}", "paragraph", {"runs": "|".join(f"{a}:{b}" for a, b in runs)}, text) for i, (text, runs) in enumerate(cases)]
    got = {x.path: (x.markdown, x.html) for x in Y.styled_paragraphs(spark.createDataFrame(rows, NODE).repartition(3), spark.createDataFrame(shapes, SHAPES)).collect()}
    assert got == {f"p{i}": (walked(t, runs, shapes, False), walked(t, runs, shapes, True)) for i, (t, runs) in enumerate(cases)}


def test_spans_fonts_and_odd_runs(spark):
    shapes = [shape(1, "bold", height=1050, color=0x0000FF), shape(2, height=1200), shape(3, height=1003)]
    fonts = spark.createDataFrame([(1, "hangul", 0, "A'B\\ \"C")], "doc_id long, slot string, idx int, name string")
    css = {x.id: x.css for x in Y.span_style(spark.createDataFrame(shapes, SHAPES), fonts).collect()}
    assert css == {1: "color:#ff0000;font-size:10.5pt;font-family:'AB &quot;C'", 2: "font-size:12pt;font-family:'AB &quot;C'", 3: "font-size:10pt;font-family:'AB &quot;C'"}
    rows = [(1, 0, i, f"p{i}", "paragraph", a, "one two") for i, a in enumerate([None, {}, {"runs": ""}, {"runs": "x:y|3"}, {"runs": "0:1|junk"}])] + [(None, 0, 0, "p0", "paragraph", {"runs": "0:1"}, None), (1, 0, 9, "p0/t0", "table", {}, None)]
    got = {(x.doc_id, x.path): x.html for x in Y.styled_paragraphs(spark.createDataFrame(rows, NODE), spark.createDataFrame([shape(1, "bold")], SHAPES)).collect()}
    assert got == {**{(1, f"p{i}"): "one two" for i in range(4)}, (1, "p4"): "<strong>one two</strong>"} | {k: v for k, v in got.items() if k[0] is None}


def place(path):
    return [int(x[1:]) for x in path.split("/")]


def random_tree(r, doc):
    """Nodes of one document with tables to depth 6, and the same as nested lists: [(path, text, [tables])], a table being (path, cells), a cell (path, row, col, paragraphs)."""
    rows = []

    def paragraphs(prefix, n, depth):
        out = []
        for i in range(n):
            path = f"{prefix}p{i}"
            text = r.choice(["", "a", "b <c>", "1. Head", "1.2 Sub", "text\nmore", "  "])
            rows.append((doc, 0, len(rows), path, "paragraph", {}, text))
            out.append((path, text, [table(f"{path}/t{t}", depth + 1) for t in range(r.choice([0, 0, 1, 2]) if depth < 6 else 0)]))
        return out

    def table(path, depth):
        n, m = r.randrange(1, 3), r.randrange(1, 3)
        rows.append((doc, 0, len(rows), path, "table", {"rows": str(n), "cols": str(m)}, None))
        spots = [(a, b) for a in range(n) for b in range(m)]
        r.shuffle(spots)
        cells = []
        for k, (a, b) in enumerate(spots):
            rows.append((doc, 0, len(rows), f"{path}/c{k}", "cell", {"row": str(a), "col": str(b)}, None))
            cells.append((f"{path}/c{k}", a, b, paragraphs(f"{path}/c{k}/", r.choice([0, 1, 1, 2]) if depth < 6 else 1, depth)))
        return path, sorted(cells, key=lambda c: c[1:3])

    return rows, paragraphs("", r.randrange(1, 7), 0)


def corpora(tree, budget):
    out = {}

    def collect(table, left):
        text = ""
        for _, _, _, paragraphs in table[1]:
            for _, own, tables in paragraphs:
                if left == 0:
                    return text
                left -= 1
                text += own + "\n" + "".join(collect(t, left) for t in tables)
        return text

    def each(paragraphs):
        for _, _, tables in paragraphs:
            for t in tables:
                out[t[0]] = collect(t, budget)
                for c in t[1]:
                    each(c[3])

    each(tree)
    return out


def test_corpora_of_random_trees(spark):
    r = random.Random(9)
    trees = [random_tree(r, d) for d in range(12)]
    nodes = spark.createDataFrame([x for rows, _ in trees for x in rows], NODE).repartition(3)
    for budget in (1, 3, 64):
        got = {(x.doc_id, x.path): x.corpus for x in N.table_corpora(nodes, budget).collect()}
        assert got == {(d, p): c for d, (_, tree) in enumerate(trees) for p, c in corpora(tree, budget).items()}


def html(tree, levels):
    out, stack, depth = "<article>\n<section id=\"sec-0\">\n", [], 0

    def shown(text):
        return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").strip()

    def table(t, place):
        s = f'<table id="tbl-{place}">\n'
        n = 1 + max(c[1] for c in t[1])
        for row in range(n):
            s += "  <tr>\n"
            for _, a, b, paragraphs in t[1]:
                if a == row:
                    cell = f"{place}-r{a}c{b}"
                    s += f'    <td id="cell-{cell}">'
                    wrote = False
                    for i, (_, text, tables) in enumerate(paragraphs):
                        if shown(text):
                            s += "<br>" * wrote + shown(text)
                            wrote = True
                        s += "".join(table(x, f"{cell}-p{i}-c{k}") for k, x in enumerate(tables))
                    s += "</td>\n"
            s += "  </tr>\n"
        return s + "</table>\n"

    for i, (_, text, tables) in enumerate(tree):
        level = levels(text)
        if level:
            while stack and stack[-1] >= level:
                stack.pop()
                out += "</section>\n"
            out += f'<section class="chapter lv-{level}" id="sec-s0-p{i}">\n'
            stack.append(level)
            depth = level
        indent = level - 1 if level else depth
        style = f' style="padding-left:{indent}em"' if indent else ""
        tag = f"h{level}" if level else "p"
        if shown(text):
            out += f'<{tag} id="par-s0-p{i}"{style}>{shown(text)}</{tag}>\n'
        for k, t in enumerate(tables):
            out += (f'<div class="indent" style="padding-left:{depth}em">' if depth else "") + table(t, f"s0-p{i}-c{k}") + ("</div>\n" if depth else "")
    return out + "</section>\n" * len(stack) + "</section>\n</article>\n"


def test_html_of_random_trees(spark):
    r = random.Random(11)
    trees = [random_tree(r, d) for d in range(12)]
    nodes = spark.createDataFrame([x for rows, _ in trees for x in rows], NODE).repartition(3)
    got = {x.doc_id: x.html for x in N.to_html_tree(nodes).collect()}
    assert got == {d: html(tree, {"1. Head": 1, "1.2 Sub": 2}.get) for d, (_, tree) in enumerate(trees)}


def test_chapters_close_as_a_stack_does(spark):
    r = random.Random(2)
    rows, want = [], {}
    for d in range(30):
        stack = []
        for i in range(40):
            level = r.choice([None, None, 1, 2, 3, 4, 5, 6])
            closed = 0
            while level and stack and stack[-1] >= level:
                stack.pop()
                closed += 1
            stack += [level] if level else []
            rows.append((d, 0, [0, i], level))
            want[d, i] = (closed, len(stack))
    got = N.chapters(spark.createDataFrame(rows, "doc_id long, section int, key array<bigint>, level int").repartition(3)).collect()
    assert {(x.doc_id, x.key[1]): (x.closes, x.open_after) for x in got} == want


@pytest.mark.parametrize("levels", (0, 1, 9))
def test_flags_reach_outer_tables(spark, levels):
    rows = [(1, 0, i, p, "table", {}, None) for i, p in enumerate(["p0/t0", "p0/t0/c0/p0/t0", "p0/t0/c0/p0/t0/c1/p0/t3", "p1/t0"])]
    nodes = spark.createDataFrame(rows, NODE)
    got = {x.path: x.found for x in N.any_nested(nodes, nodes.where(F.col("path").endswith("t3")), levels).collect()}
    assert [got[p] for _, _, _, p, *_ in rows] == [levels > 1, levels > 0, True, False]


def test_hoisting_and_back(spark):
    r = random.Random(12)
    plain = ["", None, "no span", '<span style="a:1">x</span>', '<span style="a:1">x<span style="a:1">', '<span style="b">1<span style="a">2<span style="a">3<span style="b">4', '<span style="a" id="q"><span style="a">', '<span style="a"><span style="a', '<span class="own"><span style=""><span style="">', "<style>\nother\n</style>\n<p>"]
    cases = plain + ["".join(r.choice(['<span style="c:%d">' % r.randrange(15), "text ", "</span>", "\n", '<b class="s1">']) for _ in range(r.randrange(0, 80))) for _ in range(150)]

    def classed(html):
        if html is None:
            return None
        styles = [p.split('"')[0] for p in html.split('<span style="')[1:]]
        top = [s for s in sorted(set(styles), key=lambda s: (-styles.count(s), s)) if styles.count(s) > 1]
        body = html
        for i, s in enumerate(top):
            body = body.replace(f'<span style="{s}">', f'<span class="s{i}">')
        return "<style>\n" + "".join(f"article .s{i} {{ {s} }}\n" for i, s in enumerate(top)) + "</style>\n" + body if top else html

    df = spark.createDataFrame(list(enumerate(cases)), "i int, html string").withColumn("classed", Y.hoisted(F.col("html")))
    got = {x.i: (x.html, x.classed, x.back) for x in df.withColumn("back", Y.expanded(F.col("classed"))).collect()}
    assert {i: (h, c) for i, (h, c, _) in got.items()} == {i: (h, classed(h)) for i, h in enumerate(cases)}
    assert all(b == h for h, _, b in got.values())


def test_chapters_of_texts(spark):
    r = random.Random(13)
    lines = lambda n: "\n".join(r.choice(["", "plain <b>", "1. Head", "1.2 Sub", "1.2.3 Deep", "  spaced  ", "끝이다."]) for _ in range(n))
    from foliant.operators.documents import chapter_html

    docs = [(i, lines(r.randrange(0, 30))) for i in range(60)] + [(60, None), (61, "")]
    got = {x.doc_id: x.html for x in chapter_html(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    level = {"1. Head": 1, "1.2 Sub": 2, "1.2.3 Deep": 3}.get
    assert got == {i: html([(None, x, []) for x in (t or "").split("\n")], lambda x: level(x.strip())) for i, t in docs}


def test_ancestors_reach_other_ranges(spark):
    """Twelve tables deep and dealt out in forty ranges, nodes have what their paths say, a document of many pieces is whole, and plans don't double."""
    rows, path, key, place = [], "p0", [0, 0], "s0-p0"
    want = {path: (key, place)}
    rows.append((1, 0, path, "paragraph", {}, "top"))
    for d in range(12):
        for c in range(3):
            rows.append((1, 0, f"{path}/t0/c{c}", "cell", {"row": str(c), "col": str(2 - c)}, None))
            rows.append((1, 0, f"{path}/t0/c{c}/p0", "paragraph", {}, f"x{d}-{c}"))
            want[f"{path}/t0/c{c}/p0"] = (key + [0, c * N.ROW + 2 - c + 1, 0], f"{place}-c0-r{c}c{2 - c}-p0")
        rows.append((1, 0, f"{path}/t0", "table", {"rows": "3", "cols": "3"}, None))
        path = f"{path}/t0/c1/p0"
        key, place = want[path]
    nodes = spark.createDataFrame(rows, NODE.replace("ord int, ", "")).repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions"), N.PIECE
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        N.PIECE = 20
        got = N.with_places(nodes).collect()
        assert {x.path: (x.key, x.place) for x in got if x.kind == "paragraph"} == want
        assert [x.path for x in sorted(got, key=lambda x: x.key)] == [x.path for x in sorted(got, key=lambda x: bytes(x.sort))]
        (html,) = [x.html for x in N.to_html_tree(nodes).collect()]
        assert [html.count(f">x{d}-{c}") for d in range(12) for c in range(3)] == [1] * 36
        assert html.count("<table") == html.count("</table>") == 12
        told = N.to_markdown_tree(nodes)
        assert len(told._jdf.queryExecution().optimizedPlan().toString()) < 1_000_000
        assert told.count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        N.PIECE = old[1]
