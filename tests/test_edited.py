"""Edited tables against a walk over both trees."""

import random

from foliant.operators import edited as E

NODE = "doc_id long, section int, path string, kind string, attrs map<string,string>, text string"


def seen(text):
    return "".join(c for c in text or "" if not c.isspace() and c != "￼")


def tree(r, doc, base=None):
    """Nodes of a document; with a base, an edit of it: texts change, styles go, cells come and go, now and then a table too."""
    out = {}

    def paragraph(path, depth):
        out[path] = ("paragraph", {"style": str(r.randrange(4)), "para": str(r.randrange(3)), "runs": r.choice(["", "0:1"]), "page_break": r.choice("01")}, r.choice(["", "a", "b", "c\nd", "long text"]))
        for t in range(r.choice([0, 0, 1, 2]) if depth < 3 else 0):
            table(f"{path}/t{t}", depth + 1)

    def table(path, depth):
        out[path] = ("table", {"border": str(r.randrange(3)), "padding": r.choice(["0,0,0,0", "1,2,3,4"]), "spacing": str(r.randrange(2))}, None)
        for i, (a, b) in enumerate([(a, b) for a in range(r.randrange(1, 3)) for b in range(2)]):
            out[f"{path}/c{i}"] = ("cell", {"row": str(a), "col": str(b)}, None)
            for p in range(r.randrange(1, 4)):
                paragraph(f"{path}/c{i}/p{p}", depth)

    if base is None:
        for p in range(r.randrange(1, 4)):
            paragraph(f"p{p}", 0)
        return out
    for path, (kind, attrs, text) in base.items():
        gone = any(path == g or path.startswith(g + "/") for g in base["gone"]) if "gone" in base else False
        if path != "gone" and not gone:
            keep = {k: v for k, v in attrs.items() if kind == "cell" or r.random() < 0.4}
            out[path] = (kind, keep, text if text is None or r.random() < 0.6 else r.choice(["c", "a", "new", ""]))
    return out


def order(path):
    return [int(s[1:]) for s in path.split("/")]


def direct(old, new):
    up = lambda p, n=1: "/".join(p.split("/")[:-n])
    walk = lambda nodes, kind: sorted((p for p, x in nodes.items() if x[0] == kind), key=order)
    result = {p: [k, dict(a), t] for p, (k, a, t) in new.items()}
    unset = {"border": ("0", ""), "padding": ("0,0,0,0", "0", ""), "spacing": ("0", ""), "style": ("0", ""), "para": ("0", ""), "runs": ("",)}

    def take(path, source, names):
        for n in names:
            if result[path][1].get(n, "") in ("", *unset[n]) and source.get(n, "") not in ("", *unset[n]):
                result[path][1][n] = source[n]

    ours, theirs = walk(new, "table"), walk(old, "table")
    pairs = dict(zip(ours, theirs)) if len(ours) == len(theirs) else {}
    holders = {}
    for a, b in pairs.items():
        take(a, old[b][1], ("border", "padding", "spacing"))
        holders[up(a)] = up(b)
    for a, b in holders.items():
        take(a, old[b][1], ("style", "para", "runs"))
    for a, b in pairs.items():
        cells = lambda nodes, t: {(int(x[1]["row"]), int(x[1]["col"])): p for p, x in sorted(nodes.items(), key=lambda i: order(i[0]), reverse=True) if x[0] == "cell" and up(p) == t}
        mine, his = cells(new, a), cells(old, b)
        for spot in mine.keys() & his.keys():
            inside = lambda nodes, c: [p for p in walk(nodes, "paragraph") if up(p) == c]
            left, right = inside(new, mine[spot]), inside(old, his[spot])
            met = []
            for p in list(left):
                same = next((q for q in right if seen(old[q][2]) == seen(new[p][2])), None)
                if same:
                    met.append((p, same))
                    left.remove(p)
                    right.remove(same)
            for p, q in met + list(zip(left, right)):
                take(p, old[q][1], ("style", "para", "runs"))
                if old[q][1].get("page_break") == "1":
                    result[p][1]["page_break"] = "1"
                if "\n" in (old[q][2] or "") and seen(new[p][2]) == seen(old[q][2].split("\n")[0]):
                    result[p][2] = old[q][2]
                    result[p][1].pop("runs", None)
                    if "runs" in old[q][1]:
                        result[p][1]["runs"] = old[q][1]["runs"]
    return result


def test_take_over_of_random_edits(spark):
    r = random.Random(8)
    olds, news = [], []
    for d in range(25):
        old = tree(r, d)
        cells = [p for p, x in old.items() if x[0] == "cell"]
        base = dict(old)
        if cells and d % 3 == 0:
            base["gone"] = r.sample(cells, 1)
        gone = base.pop("gone", [])
        base = {p: x for p, x in base.items() if not any(p == g or p.startswith(g + "/") for g in gone)}
        olds.append(old)
        news.append(tree(r, d, base))
    frame = lambda all_: spark.createDataFrame([(d, 0, p, k, a, t) for d, nodes in enumerate(all_) for p, (k, a, t) in nodes.items()], NODE).repartition(3)
    got = {}
    for x in E.taken_over(frame(olds), frame(news)).collect():
        got.setdefault(x.doc_id, {})[x.path] = [x.kind, x.attrs, x.text]
    assert got == {d: direct(old, new) for d, (old, new) in enumerate(zip(olds, news))}


def test_changed_sections(spark):
    rows = [(1, 0, "p0", "paragraph", {}, "a b"), (1, 0, "p0/t0", "table", {}, None), (1, 0, "p0/t0/c0/p0", "paragraph", {}, "c￼"), (1, 1, "p0", "paragraph", None, None), (2, 0, "p0", "paragraph", {}, "x")]
    typed = [(1, 0, "p0", "paragraph", {}, "ab\n"), (1, 0, "p1", "paragraph", {}, "c"), (1, 1, "p0", "paragraph", {}, ""), (2, 0, "p0", "paragraph", {}, "y"), (3, 0, "p0", "paragraph", {}, "")]
    got = {(x.doc_id, x.section): x.changed for x in E.changed_sections(spark.createDataFrame(rows, NODE), spark.createDataFrame(typed, NODE)).collect()}
    assert got == {(1, 0): False, (1, 1): False, (2, 0): True, (3, 0): True}


def test_empty_edits(spark):
    none = spark.createDataFrame([], NODE)
    one = spark.createDataFrame([(1, 0, "p0", "paragraph", None, "x"), (1, 0, "p0/t0", "table", None, None)], NODE)
    assert E.taken_over(none, none).count() == 0 and E.taken_over(one, none).count() == 0 and E.taken_over(none, one).count() == 2


def test_cells_meet_after_one_shuffle_of_both_sides(spark):
    at = lambda r, c: {"row": str(r), "col": str(c)}
    old = [(1, 0, "p2/t0", "table", {}, None), (1, 0, "p2/t0/c1", "cell", at(0, 0), None), (1, 0, "p2/t0/c10", "cell", at(0, 1), None), (1, 0, "p2/t0/c9", "cell", at(0, 1), None), (1, 0, "p10/t0", "table", {}, None),
           (1, 0, "p10/t0/c0", "cell", None, None), (1, 1, "p0/t0", "table", {}, None), (1, 0, "p7/t0/c0", "cell", at(0, 0), None), (None, 0, "p0/t0", "table", {}, None), (None, 0, "p0/t0/c0", "cell", at(0, 0), None)]
    new = [(1, 0, "p3/t1", "table", {}, None), (1, 0, "p3/t1/c0", "cell", at(0, 0), None), (1, 0, "p3/t1/c4", "cell", at(5, 0), None), (1, 0, "p4/t0", "table", {}, None), (1, 1, "p0/t0", "table", {}, None), (1, 1, "p0/t1", "table", {}, None), (1, 1, "p0/t0/c0", "cell", at(0, 0), None),
           (None, 0, "p0/t0", "table", {}, None), (None, 0, "p0/t0/c0", "cell", at(0, 0), None)]
    cells = E.paired_cells(spark.createDataFrame(old, NODE), spark.createDataFrame(new, NODE))
    assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((tuple(r) for r in cells.collect()), key=str) == sorted([
        (1, 0, "p3/t1", "p2/t0", 0, 0, "p3/t1/c0", "p2/t0/c1"), (1, 0, "p3/t1", "p2/t0", 0, 1, None, "p2/t0/c9"), (1, 0, "p3/t1", "p2/t0", 5, 0, "p3/t1/c4", None), (1, 0, "p4/t0", "p10/t0", 0, 0, None, "p10/t0/c0"),
    ], key=str)


def test_nodes_meet_after_one_shuffle_of_both_sides(spark):
    at, kind = {"row": "0", "col": "0"}, NODE + ", ord int, held string"
    look = {"style": "3", "para": "2", "runs": "0:1", "page_break": "1"}
    old = [(1, 0, "p5", "paragraph", look, "x"), (1, 0, "p5/t0", "table", {"border": "4"}, None), (1, 0, "p5/t0/c9", "cell", at, None), (1, 0, "p5/t0/c9/p0", "paragraph", look, "late"), (1, 0, "p5/t0/c2", "cell", at, None),
           (1, 0, "p5/t0/c2/p10", "paragraph", look, "b\nmore"), (1, 0, "p5/t0/c2/p9", "paragraph", {"style": "7"}, "a"), (None, 0, "p0/t0", "table", {"border": "4"}, None)]
    new = [(1, 0, "p1", "paragraph", {"style": "9"}, "y", 5, "k"), (1, 0, "p1/t0", "table", None, None, 6, "side"), (1, 0, "p1/t0/c0", "cell", at, None, 7, None), (1, 0, "p1/t0/c0/p0", "paragraph", {}, "new", 8, "l"), (1, 0, "p1/t0/c0/p1", "paragraph", {"runs": "5:5"}, "b", 9, "m"),
           (1, 0, "p1/t0/c0/p2", "paragraph", {}, "third", 10, "n"), (None, 0, "p0/t0", "table", {}, None, 11, "o")]
    taken = E.taken_over(spark.createDataFrame(old, NODE), spark.createDataFrame(new, kind))
    assert taken.columns == ["doc_id", "section", "path", "kind", "attrs", "text", "ord", "held"]
    assert taken._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    # The cell with the smallest number counts; "a" and "b\nmore" differ from all, so the first meet, and the second.
    assert {r.ord: (r.doc_id, r.path, r.kind, r.attrs, r.text, r.held) for r in taken.collect()} == {
        5: (1, "p1", "paragraph", {"style": "9", "para": "2", "runs": "0:1"}, "y", "k"), 6: (1, "p1/t0", "table", {"border": "4"}, None, "side"), 7: (1, "p1/t0/c0", "cell", at, None, None),
        8: (1, "p1/t0/c0/p0", "paragraph", {"style": "7"}, "new", "l"), 9: (1, "p1/t0/c0/p1", "paragraph", {"style": "3", "para": "2", "runs": "0:1", "page_break": "1"}, "b\nmore", "m"), 10: (1, "p1/t0/c0/p2", "paragraph", {}, "third", "n"), 11: (None, "p0/t0", "table", {}, None, "o"),
    }
