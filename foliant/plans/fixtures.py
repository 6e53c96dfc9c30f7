"""Small typed tables as SQL VALUES, read alike by Spark and by the SQL that checks it. The sample tables hold no office documents,
so what needs cells, pictures, styles or Korean words is exercised on these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, tuple[str, str]] = {
    "snippet": ("id, x", """
(1, '\u00a0 a  b\u2003 c  '), (2, '\ufffc\u00ad'), (3, '\U000f02b1 첫째  셋째\uf2c4\ufffc'), (4, '1. 개요'), (5, '1.2.3 세부 사항'), (6, '1.2.3만 원'), (7, '3. 이것은 문장이다.'),
(8, '(가) 항목'), (9, '(12) 항목'), (10, '(a b) no'), (11, '12. title'), (12, '12.title'), (13, '12월'), (14, '3 분기'), (15, '2024'), (16, '7'), (17, '1Q'), (18, '년'),
(19, '1,234.50 %'), (20, '12 명'), (21, ''), (22, '그림 . 조감도'), (23, 'Table . figures'), (24, '표 . 예산'), (25, '... x'), (26, '1..2 x'), (27, '2. a
b'), (28, '<p> </p>'), (29, '<b>x</b>'), (30, '# one'), (31, '###### six'), (32, '####### seven'), (33, '#none'), (34, '1-2/3')"""),
    "style": ("style_id, name, english", """
(0, '바탕글', 'Normal'), (1, '개요 1', 'Outline 1'), (2, '개요 7', 'Outline 3'), (3, '차례 제목', 'x'), (4, 'x', 'TOC Heading'), (5, '본문', 'Outline 6')"""),
    "styled": ("par, style_id", "('p0', 1), ('p1', 2), ('p2', 0), ('p3', 4), ('p4', 9), ('p5', 5), ('p6', 3)"),
    "tbl": ("tbl, rows, cols, depth, owner_text", """
('t1', 1, 2, 0, '표'), ('t2', 2, 5, 0, ''), ('t3', 2, 3, 0, '(단위: 천원)'), ('t4', 2, 2, 0, ''), ('t5', 2, 2, 1, ''), ('t6', 1, 1, 0, ''), ('t7', 1, 3, 0, ''), ('t8', 2, 2, 0, '참여연구원 참여율'), ('t9', 1, 1, 0, '사업자 123-45-67890'), ('t10', 2, 3, 0, '')"""),
    "cell": ("tbl, ord, row, col, row_span, col_span, text, paragraphs, controls, nested, border_fill_id, width, height, text_width", """
('t1', 0, 0, 0, 1, 1, '기관명', 1, 0, 0, 1, 100, 10, 0), ('t1', 1, 0, 1, 1, 1, '사업자등록번호', 1, 0, 0, 2, 200, 20, 90),
('t2', 0, 0, 0, 1, 1, '구분', 1, 0, 0, 3, 0, 0, 0), ('t2', 1, 0, 1, 1, 1, '1월', 1, 0, 0, 3, 0, 0, 0), ('t2', 2, 0, 2, 1, 1, '2월', 1, 0, 0, 3, 0, 0, 0), ('t2', 3, 0, 3, 1, 1, '3월', 1, 0, 0, 3, 0, 0, 0), ('t2', 4, 0, 4, 1, 1, '4월', 1, 0, 0, 3, 0, 0, 0),
('t2', 5, 1, 0, 1, 1, '설계', 1, 0, 0, 4, 0, 0, 0), ('t2', 6, 1, 1, 1, 1, '', 1, 0, 0, 0, 0, 0, 0), ('t2', 7, 1, 2, 1, 1, ' ', 1, 0, 0, 0, 0, 0, 0), ('t2', 8, 1, 3, 1, 1, 'x', 1, 0, 0, 0, 0, 0, 0), ('t2', 9, 1, 4, 1, 1, '', 1, 0, 0, 0, 0, 0, 0),
('t3', 0, 0, 0, 1, 2, '항목|값', 1, 0, 0, 5, 300, 30, 0), ('t3', 1, 0, 2, 1, 1, '금액', 1, 0, 0, 5, 0, 40, 0), ('t3', 2, 1, 0, 1, 1, '가
나', 2, 0, 0, 0, 10, 5, 0), ('t3', 3, 1, 1, 1, 1, '12,000', 1, 0, 0, 0, 0, 0, 0), ('t3', 4, 1, 2, 1, 1, '', 1, 0, 0, 0, 0, 0, 0),
('t4', 0, 0, 0, 2, 1, '목표', 1, 0, 0, 6, 0, 0, 0), ('t4', 1, 0, 1, 1, 1, '실적', 1, 0, 0, 7, 0, 0, 0), ('t4', 2, 1, 1, 1, 1, '90', 1, 0, 0, 0, 0, 0, 0),
('t5', 0, 0, 0, 1, 1, '성명', 1, 0, 0, 8, 0, 0, 0), ('t5', 1, 0, 1, 1, 1, '소속', 1, 0, 0, 9, 0, 0, 0), ('t5', 2, 1, 0, 1, 1, '', 1, 1, 0, 0, 0, 0, 0), ('t5', 3, 1, 1, 1, 1, '', 1, 0, 0, 0, 0, 0, 0),
('t6', 0, 0, 0, 1, 1, '', 1, 1, 1, 0, 0, 0, 0), ('t7', 0, 0, 0, 1, 1, '1. 연구 개요', 1, 0, 0, 0, 0, 0, 0), ('t7', 1, 0, 1, 1, 1, '', 1, 0, 0, 0, 0, 0, 0), ('t7', 2, 0, 2, 1, 1, ' ', 1, 0, 0, 0, 0, 0, 0),
('t8', 0, 0, 0, 1, 1, 'a', 1, 0, 0, 1, 0, 0, 0), ('t8', 1, 0, 1, 1, 1, 'b', 1, 0, 0, 1, 0, 0, 0), ('t8', 2, 1, 0, 1, 1, 'c', 1, 0, 0, 1, 0, 0, 0), ('t8', 3, 1, 1, 1, 1, 'd', 1, 0, 0, 1, 0, 0, 0),
('t9', 0, 0, 0, 1, 1, '안내문', 1, 0, 0, 0, 0, 0, 0), ('t10', 0, 0, 0, 1, 2, 'o', 1, 0, 0, 0, 0, 0, 0), ('t10', 1, 0, 1, 2, 2, 'p', 1, 0, 0, 0, 0, 0, 0)"""),
    "fill": ("slot, r, g, b, a", """
(0, 255, 255, 0, 255), (1, 250, 250, 250, 255), (2, 100, 100, 100, 255), (3, 220, 220, 220, 255), (4, 150, 150, 155, 255), (5, 200, 230, 255, 255), (6, 255, 200, 200, 255), (7, 40, 90, 200, 255), (8, 10, 10, 10, 0)"""),
    "entry": ("doc_id, ord, id", "(1, 0, 'BIN0001.png'), (1, 1, 'image3.JPG'), (1, 2, 'BIN000A.bmp'), (1, 3, 'BIN0001.gif'), (2, 0, 'logo.svg'), (2, 1, 'image12.webp')"),
    "picture": ("doc_id, seq, bin_id, w, h", "(1, 0, 10, 7200, 3600), (1, 1, 1, 100, 141), (1, 2, 10, 59528, 84188), (1, 3, 7, 1, 0), (2, 0, 12, 14400, 7200)"),
    "ref": ("doc_id, kind, ref", "(1, 'char', 0), (1, 'char', 5), (1, 'border_fill', 9), (1, 'border_fill', 1), (2, 'border_fill', 4), (2, 'style', 3), (3, 'para', 8), (1, 'para', 2)"),
    "bound": ("doc_id, kind, n", "(1, 'char', 5), (1, 'border_fill', 3), (2, 'border_fill', 1), (2, 'style', 0), (1, 'para', 3)"),
    "part_a": ("name, body", "('mimetype', 'application/hwp+zip'), ('Contents/section0.xml', '<a/>'), ('Contents/header.xml', '<h/>'), ('BinData/image1.png', 'x'), ('tmp/x', 'y')"),
    "part_b": ("name, body", "('mimetype', 'application/hwp+zip'), ('Contents/section0.xml', '<b/>'), ('Preview/PrvText.txt', 'hi'), ('BinData/image1.png', 'x'), ('BinData/a/b.png', 'z')"),
    "run": ("par, start, char_shape_id", "('a', 0, 1), ('a', 4, 1), ('a', 9, 2), ('a', 12, 1), ('b', 0, 7), ('c', 0, 3), ('c', 2, 4)"),
    "slot_count": ("doc_id, slot, n", "(1, 0, 2), (1, 1, 1), (1, 2, 0), (1, 3, 2), (2, 0, 1)"),
    "face": ("doc_id, ord, name", "(1, 0, '함초롬'), (1, 1, '바탕'), (1, 2, 'Arial'), (1, 3, 'HG'), (1, 4, 'SimSun'), (1, 5, 'none'), (2, 0, '돋움')"),
    "record": ("id, line", """
(1, 'PARAGRAPH[id=par-s0-p1,level=2,para_shape=3]'), (2, 'TEXT: hello: world'), (3, 'TEXT:'), (4, 'TEXT[ps=1,cs=2]: x'), (5, 'CELL[id=c, row=0,col=1,note=a=b] tail [k=v]'), (6, 'END TABLE'), (7, 'TABLE[flag,rows=2]'), (8, 'FIGURE[]'), (9, 'TEXTUAL: no')"""),
    "heading_line": ("id, level, text", "(1, 0, '## two'), (2, 3, '# kept'), (3, 0, 'plain'), (4, 0, '####### seven'), (5, 1, 'x')"),
    "markdown": ("id, x", """
(1, '<!-- doc:llm v1 -->
SECTION[id=sec-0]'), (2, '

<!-- doc:human v1 -->
# a'), (3, '<!-- my-tool:assets -->'), (4, 'SECTION[id=sec-0]
'), (5, '# plain'), (6, ''), (7, '<!-- note -->
SECTION[id=')"""),
    "layout": ("id, x", "(1, '0:1:2:3:4:5:6:7:8|9:8:7:6:5:4:3:2:1'), (2, '1:2'), (3, ''), (4, 'a:1:2:3:4:5:6:7:8|-1:0:0:0:0:0:0:0:5')"),
    "equation": ("id, script", "(1, 'a over b'), (2, 'sqrt {x^2 + y^2}'), (3, 'sum from {i=1} to n {x_i}'), (4, 'alpha times beta'), (5, 'LEFT ( a RIGHT )'), (6, ''), (7, 'lim _{x -> 0} f'), (8, 'matrix {a & b ## c & d}')"),
}


def values(name: str) -> str:
    """The fixture as a SQL table expression."""
    columns, rows = FIXTURES[name]
    return f"(SELECT * FROM (VALUES {rows}) AS t({columns}))"


def fixture(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = FIXTURES[name]
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


#: A package's tree: headings, a table with a span, a nested paragraph and a picture.
NODES = [
    (1, 0, 0, "p0", "paragraph", {"style": "1"}, "1. 개요"),
    (1, 0, 1, "p1", "paragraph", {"style": "0"}, "a <b> & c"),
    (1, 0, 2, "p2", "paragraph", {}, "￼"),
    (1, 0, 3, "p2/t0", "table", {"rows": "2", "cols": "2"}, ""),
    (1, 0, 4, "p2/t0/c0", "cell", {"row": "0", "col": "0", "row_span": "1", "col_span": "2"}, ""),
    (1, 0, 5, "p2/t0/c0/p0", "paragraph", {}, "head|er"),
    (1, 0, 6, "p2/t0/c1", "cell", {"row": "1", "col": "0", "row_span": "1", "col_span": "1"}, ""),
    (1, 0, 7, "p2/t0/c1/p0", "paragraph", {}, "x"),
    (1, 0, 8, "p2/t0/c1/p1", "paragraph", {}, "y"),
    (1, 0, 9, "p2/t0/c2", "cell", {"row": "1", "col": "1", "row_span": "1", "col_span": "1"}, ""),
    (1, 0, 10, "p3", "paragraph", {}, ""),
    (1, 0, 11, "p3/i0", "picture", {"bin": "image1"}, ""),
    (1, 1, 0, "p0", "paragraph", {}, "1.2 next"),
    (2, 0, 0, "p0", "paragraph", {}, "only"),
]


def nodes(spark: SparkSession) -> DataFrame:
    from foliant.sources.packages import NODE

    return spark.createDataFrame(NODES, NODE)
