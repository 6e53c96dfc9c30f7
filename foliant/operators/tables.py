"""Operators over table cells: roles, editability, domain, grids, and the rules that turn a table into text.

Cells come as (tbl, row, col, row_span, col_span, text ..); every operator groups by tbl, with partial aggregates where it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.attributes import luminance, tone
from foliant.functions.text import box_heading_level, clean_text, escape_cell, is_mostly_numeric, is_time_token, substring_count

#: Words that tell a table's domain, in order of precedence.
DOMAIN_WORDS = {
    "institution": ("기관명", "기관 구분", "기관구분", "대표자", "사업자", "소재지", "사업자등록번호", "대표번호", "법인등록번호", "설립일", "주관연구개발기관", "위탁연구개발기관"),
    "budget": ("연구비", "정부지원", "정부 지원", "기관 현금", "기관 현물", "기관현금", "기관현물", "총 사업비", "예산", "집행계획", "지원금", "매칭"),
    "schedule": ("추진일정", "추진 일정", "연구개발 일정", "연차별", "분기별", "월별", "단계별", "착수일", "종료일", "개발 기간", "수행 기간"),
    "performance": ("성능지표", "성능 지표", "최종 개발목표", "개발 목표", "성과목표", "성과 목표", "측정 방법", "측정방법", "달성도", "TRL", "핵심 지표", "핵심지표"),
    "personnel": ("연구책임자", "연구 책임자", "참여연구원", "참여 연구원", "연구원 구성", "인력 구성", "직위", "직급", "담당 업무", "참여율"),
}
#: Least keyword score; money units; labels of people's roles.
LEAST_SCORE = 2
MONEY_UNITS = ("백만원", "천원", "만원", "억원")
ROLE_LABELS = ("소속", "직위", "직급", "역할", "담당")
REGISTRATION = r"(?:^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{5}(?:[^0-9]|$)"


def fingerprints(cells: DataFrame, fills: DataFrame) -> DataFrame:
    """cells(tbl, row, col, border_fill_id) with r, g, b, a, tone, first_row, first_col; fills(slot, r, g, b, a) is keyed from 0, ids from 1.
    A missing fill is transparent."""
    f = fills.select(F.col("slot").alias("_slot"), "r", "g", "b", "a")
    joined = cells.join(f, cells.border_fill_id - 1 == f["_slot"], "left").drop("_slot").fillna(0, ["r", "g", "b", "a"])
    return joined.withColumns({"tone": tone(F.col("r"), F.col("g"), F.col("b"), F.col("a")), "first_row": F.col("row") == 0, "first_col": F.col("col") == 0})


def label_tone() -> Column:
    """Yellow, or another accent but red that is light."""
    t = F.col("tone")
    return (t == "accent_yellow") | (F.startswith(t, F.lit("accent_")) & (t != "accent_red") & (luminance(F.col("r"), F.col("g"), F.col("b")) >= 200))


def cell_roles(prints: DataFrame) -> DataFrame:
    """Adds role header, label or content; the rules are tried in order, and some ask whether the table has any label-like cell."""
    t = F.col("tone")
    coded = F.max(F.when(label_tone() | t.isin("mid", "dark"), True).otherwise(False)).over(Window.partitionBy("tbl"))
    role = (
        F.when(t == "dark", "header")
        .when(label_tone(), "label")
        .when((t == "mid") & F.col("_coded"), "label")
        .when((t == "pale") & F.col("first_col") & F.col("_coded"), "label")
        .when((t == "pale") & F.col("first_row"), "header")
        .when(F.col("first_row") & ~F.col("first_col"), "header")
        .when(F.col("first_col") & F.col("_coded"), "label")
        .otherwise("content")
    )
    return prints.withColumn("_coded", coded).withColumn("role", role).drop("_coded")


def editable(role: Column, paragraphs: Column, controls: Column, text: Column) -> Column:
    """true, false or unknown: a content cell of one plain paragraph that is empty or not a number can be filled in."""
    plain = clean_text(text)
    return (
        F.when(role.isNull(), "unknown")
        .when(role != "content", "false")
        .when((paragraphs > 1) | (controls > 0), "false")
        .when(plain == "", "true")
        .when(is_mostly_numeric(plain), "false")
        .otherwise("true")
    )


def keyword_domain(corpora: DataFrame) -> DataFrame:
    """(tbl, corpus, score, domain): the best-scoring domain, the earlier one on a tie, null below LEAST_SCORE. One pass over each text:
    the words are few and fixed, so no join or explode is needed."""
    scores = {d: sum((substring_count(F.col("corpus"), F.lit(w)) for w in words), F.lit(0)) for d, words in DOMAIN_WORDS.items()}
    best = F.greatest(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, (d, s) in enumerate(scores.items())])
    return corpora.withColumn("_b", best).select("tbl", "corpus", F.col("_b.s").alias("score"), F.when(F.col("_b.s") >= LEAST_SCORE, F.col("_b.d")).alias("domain"))


def table_domain(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(tbl, domain) of cells(tbl, row, col, text) and tables(tbl, rows, cols, owner_text): by words, else by the budget, performance,
    personnel, schedule and institution shapes in that order, else unknown. Texts run in (row, col) order after the owner's."""
    has = lambda x: F.col("text").contains(x)
    first = F.col("row") == 0
    filled = first & (clean_text(F.col("text")) != "")
    shapes = cells.groupBy("tbl").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda c: F.concat(c["text"], F.lit("\n"))), "").alias("body"),
        F.bool_or(first & has("목표")).alias("goal"),
        F.bool_or(first & (has("실적") | has("달성"))).alias("actual"),
        F.bool_or(first & has("성명")).alias("name"),
        F.bool_or(first & F.greatest(*[has(w) for w in ROLE_LABELS])).alias("job"),
        F.count_if(filled).alias("heads"),
        F.count_if(filled & is_time_token(F.col("text"))).alias("times"),
    )
    t = tables.join(shapes, "tbl", "left").withColumn("corpus", F.concat(F.coalesce("owner_text", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))))
    known = keyword_domain(t.select("tbl", "corpus")).select("tbl", "domain")
    money = F.exists(F.split("corpus", "\n"), lambda line: line.contains("단위") & F.greatest(*[line.contains(u) for u in MONEY_UNITS]))
    schedule = (F.col("rows") >= 2) & (F.col("cols") >= 4) & (F.col("heads") >= 3) & (F.col("times") * 10 >= F.col("heads") * 7)
    shape = (
        F.when(money, "budget")
        .when(F.col("goal") & F.col("actual"), "performance")
        .when(F.col("name") & F.col("job"), "personnel")
        .when(schedule, "schedule")
        .when(F.col("corpus").rlike(REGISTRATION), "institution")
        .otherwise("unknown")
    )
    return t.join(known, "tbl").select("tbl", F.coalesce("domain", shape).alias("domain"))


def grid_slots(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(tbl, row, col, owner_row, owner_col) of every slot of each table; later cells win where spans overlap, what lies outside is
    clipped, a slot without an owner has nulls. cells carry ord, their order."""
    span = lambda at, n: F.explode(F.sequence(at, F.col(at) + F.greatest(F.col(n), F.lit(1)) - 1))
    put = cells.withColumn("r", span("row", "row_span")).withColumn("c", span("col", "col_span"))
    won = put.groupBy("tbl", "r", "c").agg(F.max_by(F.struct("row", "col"), "ord").alias("o")).select(F.col("tbl").alias("t"), "r", "c", "o")
    all_slots = tables.where("rows > 0 AND cols > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    j = all_slots.join(won, (all_slots.tbl == won.t) & (all_slots.row == won.r) & (all_slots.col == won.c), "left")
    return j.select("tbl", "row", "col", F.col("o.row").alias("owner_row"), F.col("o.col").alias("owner_col"))


def markdown_grid(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(tbl, markdown) of the tables that are plain grids: no row spans, nothing nested, no overlap, no hole, nothing outside.

    A cell over several columns shows its text in the first. One aggregate by table, whose lists are as long as the table."""
    put = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("col_span"), F.lit(1)) - 1)))
    put = put.select("tbl", "row", (F.col("col") + F.col("i")).alias("c"), F.when(F.col("i") == 0, escape_cell(clean_text(F.col("text")))).otherwise("").alias("x"), "row_span", "controls")
    lines = put.groupBy("tbl", "row").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("l"), F.max("row_span").alias("rs"), F.sum("controls").alias("k"))
    made = lines.select(
        "tbl", "row", "rs", "k", F.transform("l", lambda x: x["c"]).alias("cs"), F.concat(F.lit("| "), F.array_join(F.transform("l", lambda x: x["x"]), " | "), F.lit(" |\n")).alias("line")
    )
    whole = made.groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("m"), F.collect_list("cs").alias("all"), F.max("rs").alias("rs"), F.sum("k").alias("k"))
    t = tables.join(whole, "tbl")
    full = F.sequence(F.lit(0), F.col("cols") - 1)
    right = (F.col("rs") <= 1) & (F.col("k") == 0) & (F.transform("m", lambda x: x["row"]) == F.sequence(F.lit(0), F.col("rows") - 1)) & F.forall("all", lambda a: a == full)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("cols")), F.lit("\n"))
    rows = F.transform("m", lambda x: x["line"])
    return t.where("rows > 0 AND cols > 0").where(right).select("tbl", F.concat(F.element_at(rows, 1), rule, F.array_join(F.slice(rows, F.lit(2), F.size(rows)), ""), F.lit("\n")).alias("markdown"))


def empty_runs(cells: DataFrame) -> DataFrame:
    """(tbl, row, first_col, last_col) of two or more plain empty cells side by side: islands of col less its rank."""
    empty = cells.where((F.col("row_span") == 1) & (F.col("col_span") == 1) & (F.col("controls") == 0) & (clean_text(F.col("text")) == ""))
    island = F.col("col") - F.row_number().over(Window.partitionBy("tbl", "row").orderBy("col"))
    runs = empty.withColumn("island", island).groupBy("tbl", "row", "island").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"))
    return runs.where("last_col > first_col").drop("island")


def table_form(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(tbl, form, level, text): how a table is written: unwrap (one empty cell around one table), heading (one cell of text with a
    number prefix), passage (a single row with one cell of text, at the top level), else table. Rules in that order."""
    text = clean_text(F.col("text"))
    seen = cells.groupBy("tbl").agg(
        F.count("*").alias("n"), F.count_if(text != "").alias("filled"), F.max(F.when(text != "", text)).alias("text"),
        F.sum("controls").alias("controls"), F.sum("nested").alias("nested"),
    )
    t = tables.join(seen, "tbl", "left")
    one = (F.col("filled") == 1) & (F.col("controls") == 0)
    level = box_heading_level(F.col("text"))
    form = (
        F.when((F.col("n") == 1) & (F.col("filled") == 0) & (F.col("nested") == 1), "unwrap")
        .when(one & (F.length("text") <= 80) & level.isNotNull(), "heading")
        .when(one & (F.col("depth") == 0) & (F.col("rows") == 1) & (F.length("text") <= 100) & ~F.col("text").contains("\n"), "passage")
        .otherwise("table")
    )
    return t.withColumn("form", form).select("tbl", "form", F.when(F.col("form") == "heading", level).alias("level"), F.when(F.col("form").isin("heading", "passage"), F.col("text")).alias("text"))


def with_default_sizes(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Zero widths, heights and text widths filled from the table's shape."""
    j = cells.join(tables.select("tbl", "cols"), "tbl")
    width = F.when(F.col("width") == 0, F.floor(F.lit(42000) / F.greatest("cols", F.lit(1))) * F.col("col_span")).otherwise(F.col("width"))
    out = j.withColumns({"width": width.cast("int"), "height": F.when(F.col("height") == 0, F.col("row_span") * 1500).otherwise(F.col("height")).cast("int")})
    return out.withColumn("text_width", F.when(F.col("text_width") == 0, F.greatest(F.col("width") - 200, F.lit(0))).otherwise(F.col("text_width")).cast("int")).drop("cols")


def table_extent(cells: DataFrame) -> DataFrame:
    """(tbl, width, height): the first row's widths, and the greatest height of each row, summed; at least 1."""
    rows = cells.groupBy("tbl", "row").agg(F.max("height").alias("h"), F.sum(F.when(F.col("row") == 0, F.col("width"))).alias("w"))
    return rows.groupBy("tbl").agg(F.greatest(F.coalesce(F.sum("w"), F.lit(0)), F.lit(1)).cast("long").alias("width"), F.greatest(F.sum("h"), F.lit(1)).cast("long").alias("height"))
