"""Merged catalogues against a direct merge."""

import random

from foliant.operators import catalogue as C


def merge(target, source, moved=lambda row: row):
    """(merged rows by id, old id -> new id) of {id: row} of one document."""
    out, to = dict(target), {}
    for i in sorted(source):
        row = moved(source[i])
        to[i] = min((j for j, x in out.items() if x[:3] == row[:3]), default=None)
        if to[i] is None:
            to[i] = max(out, default=-1) + 1
            out[to[i]] = row
    return out, to


def test_random_merges(spark):
    r = random.Random(3)
    chars, paras, styles = "doc_id long, id long, attr int, height long, color long", "doc_id long, id long, align int", "doc_id long, id long, name string, char_shape long, para_shape long, next_style long"
    sides = [{"chars": {}, "paras": {}, "styles": {}} for _ in range(2)]
    for side in sides:
        for d in range(12):
            for kind, make in (("chars", lambda: (r.randrange(2), r.randrange(2), r.choice([0, None]))), ("paras", lambda: (r.randrange(4),)), ("styles", lambda: (r.choice("ab"), r.randrange(5), r.randrange(5), r.randrange(9)))):
                side[kind][d] = {i: make() for i in r.sample(range(9), r.randrange(0, 7))}
    frames = [{k: spark.createDataFrame([(d, i, *x) for d, rows in side[k].items() for i, x in rows.items()], schema) for k, schema in (("chars", chars), ("paras", paras), ("styles", styles))} for side in sides]
    tables, maps = C.merged(*frames)
    got = {k: {} for k in tables}
    for k, t in tables.items():
        for x in t.collect():
            assert (x.doc_id, x.id) not in got[k]
            got[k][x.doc_id, x.id] = tuple(x[2:])
    nodes = spark.createDataFrame([(d, f"p{i}", {"style": str(i), "para": str(i), "runs": f"0:{i}|5:{9 - i}|x", "other": str(i)}) for d in range(13) for i in range(10)], "doc_id long, path string, attrs map<string,string>")
    moved = {(x.doc_id, x.path): x.attrs for x in C.with_references(nodes, maps).collect()}
    for d in range(12):
        c, to_c = merge(sides[0]["chars"][d], sides[1]["chars"][d])
        p, to_p = merge(sides[0]["paras"][d], sides[1]["paras"][d])
        s, to_s = merge(sides[0]["styles"][d], sides[1]["styles"][d], lambda x: (x[0], to_c.get(x[1], x[1]), to_p.get(x[2], x[2]), x[3]))
        s = {i: x if sides[0]["styles"][d].get(i) is x else (*x[:3], to_s.get(x[3], x[3])) for i, x in s.items()}
        for k, want in (("chars", c), ("paras", p), ("styles", s)):
            assert {i: x for (doc, i), x in got[k].items() if doc == d} == want
        for i in range(10):
            assert moved[d, f"p{i}"] == {"style": str(to_s.get(i, i)), "para": str(to_p.get(i, i)), "runs": f"0:{to_c.get(i, i)}|5:{to_c.get(9 - i, 9 - i)}|x", "other": str(i)}
    assert moved[12, "p3"]["runs"] == "0:3|5:6|x"


def test_copies_are_numbered_after_the_greatest(spark):
    entries = spark.createDataFrame([(1, 0, "a"), (1, 7, "b"), (2, 3, "c")], "doc_id long, id long, x string")
    copies = spark.createDataFrame([(1, 7, 2, "new"), (1, 0, 1, "first"), (2, 9, 1, "no base"), (3, 0, 1, "no document")], "doc_id long, base long, nth int, y string")
    from pyspark.sql import functions as F

    got = sorted(tuple(x) for x in C.with_copies(entries, copies, {"x": F.concat("x", F.lit(" "), "y")}).collect())
    assert got == [(1, 0, "a"), (1, 7, "b"), (1, 8, "a first"), (1, 9, "b new"), (2, 3, "c")]


def test_references_of_a_large_catalogue(spark):
    """A document of 40,000 entries is no row of maps that each of its nodes is looked up in."""
    from pyspark.sql import functions as F

    one = spark.range(40000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("old"), (F.col("id") + 7).alias("new"), F.lit(True).alias("added"))
    attrs = F.create_map(F.lit("style"), F.col("id").cast("string"), F.lit("para"), F.lit("none"), F.lit("runs"), F.concat(F.lit("0:"), F.col("id").cast("string"), F.lit("|4:x|9")))
    nodes = spark.range(39990, 40010).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("path"), attrs.alias("attrs"))
    moved = C.with_references(nodes, dict.fromkeys(("chars", "paras", "styles"), one))
    assert "map_from_entries" not in moved._jdf.queryExecution().optimizedPlan().toString()
    to = lambda n: n + 7 if n < 40000 else n
    assert {(x.path, x.attrs["style"], x.attrs["para"], x.attrs["runs"]) for x in moved.collect()} == {(n, str(to(n)), "none", f"0:{to(n)}|4:x|9") for n in range(39990, 40010)}
