"""Tables of an edited document against the original's: which correspond, how their cells changed, and what the edit takes over.

Edits of text neither add nor remove tables, so the n-th table of a section, counted as the tree is walked and whatever the depth, is the n-th of the
original where both have as many; a section where they don't has no pairs. Cells of paired tables meet by row and column, and the
paragraphs of paired cells by their visible text first, the n-th of a text with the n-th, then what is left one for one. Both sides
are dealt out once, by section, and meet there as sorted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import visible
from foliant.operators.styling import KEYS
from foliant.spark import parts_of

#: What a table takes over, with the values that mean that the edit carried none.
TABLE_DEFAULTS = {"border": ("0", ""), "padding": ("0,0,0,0", "0", ""), "spacing": ("0", "")}
#: What a paragraph takes over.
PARAGRAPH_DEFAULTS = {"style": ("0", ""), "para": ("0", ""), "runs": ("",)}
SECTION = ["doc_id", "section"]


def tree_order(path: Column) -> Column:
    """The numbers of a path's steps: arrays of them sort as the tree is walked."""
    return F.transform(F.split(path, "/"), lambda s: F.coalesce(F.substring(s, F.lit(2), F.length(s)).try_cast("bigint"), F.lit(0).cast("bigint")))


def _up(path: Column) -> Column:
    """The path without its last step."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def comparable_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, section, text) of each section with paragraphs: their visible text, those in tables included, as the tree is walked."""
    own = nodes.where("kind = 'paragraph'").select(*SECTION, F.struct(tree_order(F.col("path")).alias("key"), visible(F.coalesce("text", F.lit(""))).alias("x")).alias("p"))
    return own.groupBy(*SECTION).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]), "").alias("text"))


def changed_sections(frozen: DataFrame, typed: DataFrame) -> DataFrame:
    """(doc_id, section, changed) of the edit's sections: whether their comparable text differs from the original's; a new section has changed. Only hashes
    of the texts meet."""
    told = lambda nodes: comparable_text(nodes).select(*SECTION, F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    old = told(frozen).select(F.col("doc_id").alias("_d"), F.col("section").alias("_s"), F.col("h").alias("_h"))
    return told(typed).join(old, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("section").eqNullSafe(F.col("_s")), "left").select(*SECTION, (~F.col("h").eqNullSafe(F.col("_h"))).alias("changed"))


def _grid_rows(nodes: DataFrame, side: int) -> DataFrame:
    """(doc_id, section, side, tbl, step, row, col) of the tables and cells, with the last step of a cell's path; a table has no step."""
    at = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)).try_cast("int"), F.lit(0)).alias(n)
    head, step = F.col("kind") == "table", F.substring_index("path", "/", -1)
    table = F.when(head, F.col("path")).otherwise(F.substring("path", F.lit(1), F.length("path") - F.length(step) - 1))
    own = nodes.where("kind IN ('table', 'cell') AND doc_id IS NOT NULL AND section IS NOT NULL")
    return own.select(*SECTION, F.lit(side).alias("side"), table.alias("tbl"), F.when(~head, step).alias("step"), at("row"), at("col"))


def paired_cells(frozen: DataFrame, typed: DataFrame) -> DataFrame:
    """(doc_id, section, tbl, old_tbl, row, col, path, old_path) of all cells of paired tables: path is null where the edit took a cell away, old_path where
    it added one. Of several cells at one place the first counts.

    Both sides are dealt out once, by section; there, each cell stands behind its table as the tables are walked, and what has one rank, row and column meets."""
    both = _grid_rows(frozen, 0).unionByName(_grid_rows(typed, 1)).repartition(parts_of(typed.sparkSession), *SECTION)
    head = F.col("step").isNull()
    # A table stands before its cells: nulls come first.
    walk = Window.partitionBy(*SECTION, "side").orderBy("_k", "tbl", F.col("step").asc_nulls_first())
    ranked = both.withColumn("_k", tree_order(F.col("tbl"))).withColumns({"rank": F.count_if(head).over(walk), "_t": F.last(F.when(head, F.col("tbl")), ignorenulls=True).over(walk)})
    tables = lambda side: F.count_if(head & (F.col("side") == side)).over(Window.partitionBy(*SECTION))
    met = ranked.withColumns({"_old": tables(0), "_new": tables(1)}).where((F.col("_old") == F.col("_new")) & (F.col("_t") == F.col("tbl")))
    number = F.coalesce(F.substring("step", F.lit(2), F.length("step")).try_cast("bigint"), F.lit(0))
    of = lambda side, x: F.when(F.col("side") == side, x)
    # The tables themselves are kept until all their cells have both names.
    spots = met.groupBy(*SECTION, "rank", head.alias("head"), "row", "col").agg(
        F.max(of(1, F.col("tbl"))).alias("_tbl"), F.max(of(0, F.col("tbl"))).alias("_old_tbl"),
        F.min(of(1, F.struct(number, "step"))).alias("_s"), F.min(of(0, F.struct(number, "step"))).alias("_o"),
    )
    pair = Window.partitionBy(*SECTION, "rank")
    named = spots.withColumns({"tbl": F.max("_tbl").over(pair), "old_tbl": F.max("_old_tbl").over(pair)}).where("NOT head")
    path = lambda table, s: F.when(F.col(s).isNotNull(), F.concat(table, F.lit("/"), F.col(s)["step"]))
    return named.select(*SECTION, "tbl", "old_tbl", "row", "col", path("tbl", "_s").alias("path"), path("old_tbl", "_o").alias("old_path"))


def _last_number(path: Column) -> Column:
    step = F.substring_index(path, "/", -1)
    return F.coalesce(F.substring(step, F.lit(2), F.length(step)).try_cast("bigint"), F.lit(0))


def _with_taken(nodes: DataFrame, source: str, defaults: dict[str, tuple[str, ...]]) -> DataFrame:
    """The nodes whose attrs take what they carry no value for from the map in source, where that has one."""
    value = lambda column, n: F.try_element_at(column, F.lit(n))
    none = lambda column, n: value(column, n).isNull() | value(column, n).isin(*defaults[n])
    filled = [F.when(none("attrs", n) & ~none(source, n), F.create_map(F.lit(n), value(source, n))).otherwise(F.create_map().cast("map<string,string>")) for n in defaults]
    entries = nodes.withColumn("_e", F.when(F.col(source).isNotNull(), F.map_concat(*filled)))
    put = F.map_concat(F.map_filter("attrs", lambda k, v: ~F.map_contains_key("_e", k)), "_e")
    return entries.withColumn("attrs", F.when(F.size("_e") > 0, put).otherwise(F.col("attrs"))).drop("_e")


def _both_sides(frozen: DataFrame, typed: DataFrame) -> DataFrame:
    """(doc_id, section, path, kind, attrs, text, side, rest) of both, the edit's as side 1 with its other columns in rest, dealt out by section."""
    nothing = F.create_map().cast("map<string,string>")
    own = [*KEYS, "kind", F.coalesce("attrs", nothing).alias("attrs"), "text"]
    rest = F.struct(F.lit(True).alias("_"), *(c for c in typed.columns if c not in (*KEYS, "kind", "attrs", "text"))).alias("rest")
    both = frozen.select(*own, F.lit(0).alias("side")).unionByName(typed.select(*own, F.lit(1).alias("side"), rest), allowMissingColumns=True)
    # Smaller parts than one for each task: a part is sorted several times over.
    return both.repartition(4 * parts_of(typed.sparkSession), *SECTION)


def _placed(both: DataFrame) -> DataFrame:
    """both with rank, a table's place among its section's tables as the tree is walked, and spot (rank, row, col) and cell (number, path) of the cells
    and the paragraphs in cells; all are null in a section that has not as many tables on either side, and for what stands elsewhere."""
    path, table, cell = F.col("path"), F.col("kind").eqNullSafe("table"), F.col("kind").eqNullSafe("cell")
    at = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)).try_cast("int"), F.lit(0)).alias(n)
    up = both.withColumn("_up", _up(path))
    up = up.withColumns({"_t": F.nullif(F.when(table, path).when(cell, F.col("_up")).when(F.col("kind") == "paragraph", _up(F.col("_up"))), F.lit("")), "_c": F.when(cell, path).when(F.col("kind") == "paragraph", F.col("_up"))})
    # A table stands before its cells, and a cell before its paragraphs: nulls come first, and kinds by their names.
    order = ["_k", "_t", "_c", "kind"]
    walked = up.withColumn("_k", tree_order(F.col("_t"))).sortWithinPartitions(*SECTION, "side", *order)
    walk = Window.partitionBy(*SECTION, "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda on, x: F.last(F.when(on, x), ignorenulls=True).over(walk)
    walked = walked.withColumns({"rank": F.count_if(table).over(walk), "_table": last(table, path), "_cell": last(cell, F.struct(path.alias("path"), at("row"), at("col"), _last_number(path).alias("number")))})
    tables = lambda side: F.count_if(table & (F.col("side") == side)).over(Window.partitionBy(*SECTION))
    walked = walked.withColumns({"_old": tables(0), "_new": tables(1)})
    known = F.col("doc_id").isNotNull() & F.col("section").isNotNull() & (F.col("_old") == F.col("_new")) & (F.col("_t") == F.col("_table"))
    inside = known & (F.col("_cell")["path"] == F.col("_c"))
    spot = F.struct("rank", F.col("_cell")["row"].alias("row"), F.col("_cell")["col"].alias("col"))
    return walked.select(*both.columns, "_up", F.when(known & table, F.col("rank")).alias("rank"), F.when(inside, spot).alias("spot"), F.when(inside, F.struct(F.col("_cell")["number"].alias("number"), F.col("_cell")["path"].alias("path"))).alias("cell"))


def _with_tables(placed: DataFrame) -> DataFrame:
    """placed whose tables, and paragraphs that hold tables, of side 1 have taken over what they take from the original's."""
    table, old = F.col("kind").eqNullSafe("table"), F.col("side") == 0
    # What holds tables stands before them, with the place of the last of them.
    held = placed.withColumns({"_at": F.when(table, F.col("_up")).otherwise(F.col("path")), "_is": table}).sortWithinPartitions(*SECTION, "side", "_at", "_is")
    group = Window.partitionBy(*SECTION, "side", "_at")
    whole = group.orderBy("_is").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = held.withColumns({"_host": F.nth_value(F.when(~table & old, F.col("attrs")), 1).over(whole), "_last": F.max("rank").over(whole)}).where(~old | table | F.col("spot").isNotNull())
    # An original's table stands before the table of its place and before what holds that.
    met = held.withColumn("_m", F.when(table, F.col("rank")).when(~old, F.col("_last"))).sortWithinPartitions(*SECTION, "_m", "side", "_is")
    place = Window.partitionBy(*SECTION, "_m").orderBy("side", "_is")
    back = lambda x, n: F.lag(F.when(table & old, F.col(x)), n).over(place)
    source = lambda on, x: F.when(~old & on & F.col("_m").isNotNull(), F.coalesce(back(x, 1), back(x, 2)))
    met = met.withColumns({"_of_table": source(table, "attrs"), "_of_host": source(~table, "_host")}).where(~old | F.col("spot").isNotNull()).drop("_host", "_last", "_m", "_at", "_is", "_up", "rank")
    return _with_taken(_with_taken(met, "_of_table", TABLE_DEFAULTS), "_of_host", PARAGRAPH_DEFAULTS).drop("_of_table", "_of_host")


def _with_originals(placed: DataFrame) -> DataFrame:
    """Side 1 of placed with old (attrs, text) of the paragraphs in paired cells that have an original.

    First those whose visible text the original cell has too, the n-th with the n-th; then, of what is left in both, the first with the first. Of
    several cells at one place the first counts."""
    spot, old, order = [*SECTION, "spot"], F.col("side") == 0, ["_i", "path"]
    inside = F.col("spot").isNotNull() & (F.col("kind") == "paragraph")
    own = placed.withColumns({"_seen": F.when(inside, visible(F.coalesce("text", F.lit("")))), "_i": F.when(inside, _last_number(F.col("path")))})
    own = own.sortWithinPartitions(*spot, "_seen", "side", "cell", *order)
    own = own.withColumn("_nth", F.row_number().over(Window.partitionBy(*spot, "_seen", "side", "cell").orderBy(*order)))
    first = lambda side: F.min(F.when(F.col("side") == side, F.col("cell"))).over(Window.partitionBy(*spot))
    own = own.withColumns({"_f0": first(0), "_f1": first(1)})
    own = own.withColumn("_live", inside & F.col("_f0").isNotNull() & F.col("_f1").isNotNull() & (F.col("cell") == F.when(old, F.col("_f0")).otherwise(F.col("_f1"))))
    count = lambda side: F.count_if(F.col("_live") & (F.col("side") == side)).over(Window.partitionBy(*spot, "_seen"))
    own = own.withColumns({"_n0": count(0), "_n1": count(1)}).where(~old | F.col("_live"))
    own = own.withColumn("_same", F.when(F.col("_live"), F.col("_nth") <= F.least("_n0", "_n1"))).drop("_f0", "_f1", "_n0", "_n1", "_live", "cell")
    own = own.sortWithinPartitions(*spot, "_same", "side", *order)
    own = own.withColumn("_rest", F.row_number().over(Window.partitionBy(*spot, "_same", "side").orderBy(*order)))
    own = own.withColumns({"_seen": F.when(F.col("_same"), F.col("_seen")), "_nth": F.when(F.col("_same"), F.col("_nth")).when(~F.col("_same"), F.col("_rest"))})
    own = own.sortWithinPartitions(*spot, "_seen", "_nth", "side")
    pair = Window.partitionBy(*spot, "_seen", "_nth").orderBy("side")
    own = own.withColumn("old", F.lag(F.when(old, F.struct("attrs", "text"))).over(pair))
    return own.where(~old).withColumn("old", F.when(F.col("_nth").isNotNull(), F.col("old"))).select(*KEYS, "kind", "attrs", "text", "rest", "old")


def taken_over(frozen: DataFrame, typed: DataFrame) -> DataFrame:
    """The edit's nodes with what they take over; explicit values of the edit win.

    A paired table takes border, padding and spacing, the paragraph that holds it style, shape and runs of the original's holder (of several tables, by the
    last). A paragraph of a paired cell takes the same, a page break, and the whole text where the edit holds only the first line of it.

    Both sides are dealt out once, by section; there, each row meets its original as rows sorted by what both have pass in order."""
    # What a cell's paragraph takes from its own original comes after what it takes as the holder of a table.
    own = _with_originals(_with_tables(_placed(_both_sides(frozen, typed))))
    own = own.withColumns({"_attrs": F.col("old")["attrs"], "_text": F.col("old")["text"]})
    first = visible(F.substring_index("_text", "\n", 1))
    cut = F.coalesce(F.col("_text").contains("\n") & (visible(F.coalesce("text", F.lit(""))) == first), F.lit(False))
    broken = F.coalesce(F.try_element_at("_attrs", F.lit("page_break")) == "1", F.lit(False))
    own = _with_taken(own, "_attrs", PARAGRAPH_DEFAULTS).withColumns({"_cut": cut, "_broken": broken})
    own = own.withColumn("attrs", F.when(F.col("_broken"), F.map_concat(F.map_filter("attrs", lambda k, v: k != "page_break"), F.create_map(F.lit("page_break"), F.lit("1")))).otherwise(F.col("attrs")))
    own = own.withColumn("attrs", F.when(F.col("_cut"), F.map_concat(F.map_filter("attrs", lambda k, v: k != "runs"), F.map_filter("_attrs", lambda k, v: k == "runs"))).otherwise(F.col("attrs")))
    own = own.withColumn("text", F.when(F.col("_cut"), F.col("_text")).otherwise(F.col("text")))
    return own.select(*(F.col(c) if c in (*KEYS, "kind", "attrs", "text") else F.col("rest")[c].alias(c) for c in typed.columns))
