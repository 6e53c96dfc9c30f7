"""Catalogues of shapes and styles: new entries beside a document's own, merging without clashes, and rewriting of what refers to them.

Ids are dense numbers after each document's greatest one, given by one window over the new entries. Entries of the same content are one entry: what
a catalogue has already is not added again. References follow by joins on document and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.attributes import CHAR_BITS, PARA_BITS, colour_number

#: Sizes of body text and of the headings 1 to 6, in hundredths of a point, and the names of their styles.
SIZES = (1000, 2000, 1700, 1500, 1300, 1200, 1100)
BODY, HEADING = ("본문", "Body"), ("개요", "Outline")


def heading_catalogue(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(character shapes, paragraph shapes, styles) for documents(doc_id): entry 0 is body text, 1 to 6 are bold headings by level. Repeated ids count once."""
    own = documents.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("id"))
    head = F.col("id") > 0
    hundred = F.array(*[F.lit(100)] * 7)
    chars = own.select("doc_id", "id", F.when(head, 1 << CHAR_BITS["bold"][0]).otherwise(0).alias("attr"), F.element_at(F.array(*map(F.lit, SIZES)), (F.col("id") + 1).cast("int")).cast("long").alias("height"), F.lit(0).cast("long").alias("color"), hundred.alias("ratios"), hundred.alias("sizes"))
    paras = own.select("doc_id", "id", F.shiftleft(F.col("id"), PARA_BITS["heading_level"][0]).alias("attr"))
    named = lambda i: F.when(head, F.concat(F.lit(HEADING[i] + " "), F.col("id").cast("string"))).otherwise(BODY[i])
    return chars, paras, own.select("doc_id", "id", named(0).alias("name"), named(1).alias("english"), F.col("id").alias("para_shape"), F.col("id").alias("char_shape"))


def with_copies(entries: DataFrame, copies: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """entries(doc_id, id, ..) and a new entry for each row of copies(doc_id, base, nth, ..): a copy of entry `base` with the changed columns, numbered after
    the document's greatest id in order of nth. changes are expressions over the entry's columns and those of copies; a base that the
    document lacks gives no entry. Entries themselves stay as they are."""
    most = entries.groupBy("doc_id").agg(F.max("id").alias("_most"))
    wanted = copies.withColumnRenamed("doc_id", "_d")
    own = entries.join(wanted, (F.col("doc_id") == F.col("_d")) & (F.col("id") == F.col("base"))).drop("_d").join(most, "doc_id")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "base"))
    return entries.unionByName(own.withColumns(changes).withColumn("id", F.col("_most") + number).select(*entries.columns))


def with_edit_shape(chars: DataFrame, colours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(character shapes, (doc_id, edit_shape)): each document of colours(doc_id, colour) gets a copy of its first shape in that colour, `#RRGGBB` or red, for
    paragraphs that an edit adds or changes. Documents without shapes get none."""
    first = chars.groupBy("doc_id").agg(F.min("id").alias("base"), (F.max("id") + 1).alias("edit_shape"))
    own = colours.groupBy("doc_id").agg(F.min("colour").alias("colour")).join(first, "doc_id")
    shapes = with_copies(chars, own.select("doc_id", "base", F.lit(1).alias("nth"), "colour"), {"color": colour_number(F.col("colour")).cast("long")})
    return shapes, own.select("doc_id", "edit_shape")


def _content(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def mapping(target: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, old, new, added): where each entry of source(doc_id, id, columns) stands once it is merged into the target of the same doc_id.

    An entry whose columns equal those of one in the target is that one (the least id); others are numbered after the target's greatest id in the order
    of their ids, equal ones as one, and `added` marks the entry that is to be added. A document that the target lacks begins at 0."""
    known = target.groupBy("doc_id", _content(columns).alias("_c")).agg(F.min("id").alias("_known"))
    most = target.groupBy("doc_id").agg(F.max("id").alias("_most"))
    own = source.select("doc_id", F.col("id").alias("old"), _content(columns).alias("_c"))
    firsts = own.groupBy("doc_id", "_c").agg(F.min("old").alias("_first")).join(known, ["doc_id", "_c"], "left").join(most, "doc_id", "left")
    fresh = F.col("_known").isNull()
    number = F.sum(fresh.cast("long")).over(Window.partitionBy("doc_id").orderBy("_first"))
    placed = firsts.withColumn("new", F.when(fresh, F.coalesce("_most", F.lit(-1).cast("long")) + number).otherwise(F.col("_known")))
    return own.join(placed.select("doc_id", "_c", "_first", "new", fresh.alias("_fresh")), ["doc_id", "_c"]).select("doc_id", "old", "new", (F.col("_fresh") & (F.col("old") == F.col("_first"))).alias("added"))


def _added(target: DataFrame, source: DataFrame, moved: DataFrame) -> DataFrame:
    new = moved.where("added").select(F.col("doc_id").alias("_d"), F.col("old").alias("_o"), "new")
    taken = source.join(new, (F.col("doc_id") == F.col("_d")) & (F.col("id") == F.col("_o"))).withColumn("id", F.col("new"))
    return target.unionByName(taken.select(*target.columns))


def _referring(df: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """df with a column of ids moved along; an id that the map lacks stays."""
    own = moved.select(F.col("doc_id").alias("_d"), F.col("old").alias("_o"), F.col("new").alias("_n"))
    joined = df.join(own, (F.col("doc_id") == F.col("_d")) & (F.col(column) == F.col("_o")), "left")
    return joined.withColumn(column, F.coalesce("_n", column)).drop("_d", "_o", "_n")


def merged(target: dict[str, DataFrame], source: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables, maps) of the target's chars, paras and styles with the source's merged in, document by document; each table has unique (doc_id, id).

    Shapes are merged first; then the source's styles refer to the merged shapes and are merged themselves, by all but their next style, which
    follows. maps (doc_id, old, new, added) by kind say where the source's entries are now."""
    maps, tables = {}, {}
    for kind in ("chars", "paras"):
        maps[kind] = mapping(target[kind], source[kind], [c for c in target[kind].columns if c not in ("doc_id", "id")])
        tables[kind] = _added(target[kind], source[kind], maps[kind])
    styles = _referring(_referring(source["styles"], "char_shape", maps["chars"]), "para_shape", maps["paras"])
    maps["styles"] = mapping(target["styles"], styles, [c for c in target["styles"].columns if c not in ("doc_id", "id", "next_style")])
    if "next_style" in target["styles"].columns:
        styles = _referring(styles, "next_style", maps["styles"])
    tables["styles"] = _added(target["styles"], styles, maps["styles"])
    return tables, maps


def with_references(nodes: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """nodes whose attributes style, para and runs refer to the merged entries; ids that the maps lack stay. References meet the maps by document and id;
    of runs each document's different values do, once."""
    known = {kind: m.select(F.col("doc_id").alias(f"_{kind}_d"), F.col("old").cast("string").alias(f"_{kind}_o"), F.col("new").cast("string").alias(f"_{kind}")) for kind, m in maps.items()}
    meet = lambda df, kind, x: df.join(known[kind], (F.col("doc_id") == F.col(f"_{kind}_d")) & (x == F.col(f"_{kind}_o")), "left").drop(f"_{kind}_d", f"_{kind}_o")
    value = lambda n: F.try_element_at("attrs", F.lit(n))
    listed = nodes.select("doc_id", value("runs").alias("_was")).where("_was IS NOT NULL").distinct().select("doc_id", "_was", F.posexplode(F.split("_was", r"\|")).alias("_i", "_r"))
    met = meet(listed.withColumn("_id", F.regexp_extract("_r", "^[^:]*:?(.*)$", 1)), "chars", F.col("_id"))
    run = F.concat(F.regexp_extract("_r", "^([^:]*:?)", 1), F.coalesce("_chars", "_id"))
    runs = met.groupBy(F.col("doc_id").alias("_d"), "_was").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", run.alias("x")))), lambda r: r["x"]), "|").alias("_runs"))
    joined = meet(meet(nodes, "styles", value("style")), "paras", value("para")).join(runs, (F.col("doc_id") == F.col("_d")) & (value("runs") == F.col("_was")), "left")
    to = lambda k, v: F.when(k == "style", F.coalesce("_styles", v)).when(k == "para", F.coalesce("_paras", v)).when(k == "runs", F.coalesce("_runs", v)).otherwise(v)
    return joined.withColumn("attrs", F.transform_values("attrs", to)).select(*nodes.columns)
