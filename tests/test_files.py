"""The files source and sink: pushed filters, damaged files, failed writes, names."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.sources import files as L

FILES = "file string, bytes binary"


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


@pytest.fixture
def folder(spark, tmp_path):
    L.register(spark)
    return f"file://{tmp_path}/out"


def written(spark, rows, folder, mode="append", parts=3):
    spark.createDataFrame(rows, FILES).repartition(parts).write.format("document_files").mode(mode).save(folder)


def test_parts_of_good_and_bad_files(spark, tmp_path, folder):
    good = package(mimetype="m", Contents__section0_dot_xml="<a/>", BinData__i_dot_png="x" * 5000)
    broken = bytearray(package(Contents__section0_dot_xml="<abcdefgh/>" * 50, Contents__header_dot_xml="<h/>"))
    at = broken.find(b"section0.xml") + 14
    broken[at : at + 6] = b"\xff" * 6
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in (("a.zip", good), ("sub/b.zip", bytes(broken)), ("c.zip", b"no package"), ("empty.zip", b""), (".hidden", b""), ("_x/y.zip", good)):
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    df = spark.read.format("document_parts").option("partbytes", 4000).load(f"file://{tmp_path}/in")
    got = {(r.document, r.part): (r.kind, r.bytes, r.error is not None) for r in df.collect()}
    assert got == {
        ("a.zip", "mimetype"): ("meta", b"m", False), ("a.zip", "Contents/section0.xml"): ("section", b"<a/>", False), ("a.zip", "BinData/i.png"): ("binary", None, True),
        ("sub/b.zip", "Contents/section0.xml"): ("section", None, True), ("sub/b.zip", "Contents/header.xml"): ("header", b"<h/>", False), ("c.zip", None): (None, None, True), ("empty.zip", None): (None, None, True),
    }
    for condition in ("kind = 'header'", "document = 'a.zip' AND part = 'mimetype'", "kind IN ('section', 'meta') AND document IN ('a.zip', 'c.zip')", "document = 'c.zip'", "part IS NULL", "kind <> 'meta'"):
        want = sorted(map(str, (r for r in df.collect() if spark.createDataFrame([r], df.schema).where(condition).count())))
        assert sorted(map(str, df.where(condition).collect())) == want
    assert "kind = header" not in df.where("kind = 'header'")._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_reader(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    (tmp_path / "a.zip").write_bytes(package(mimetype="m", x="y"))
    (tmp_path / "b.zip").write_bytes(package(mimetype="m"))
    reader = L._PartsReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([EqualTo(("document",), "a.zip"), GreaterThan(("size",), 1), In(("part",), ("x", "z"))]))
    assert [f.attribute for f in rest] == [("size",)]
    groups = reader.partitions()
    assert [f for g in groups for f, _ in g.files] == ["a.zip"] and [r[1] for g in groups for r in reader.read(g)] == ["x"]
    assert len(L._PartsReader({"path": str(tmp_path), "groupbytes": "1"}).partitions()) == 2
    assert [r for g in L._PartsReader({"path": str(tmp_path / "none")}).partitions() for r in reader.read(g)] == []


def test_append_and_overwrite(spark, folder):
    read = lambda: {r.file: bytes(r.bytes) for r in spark.read.format("document_files").load(folder).collect()}
    written(spark, [("a.md", b"1"), ("d/b.png", b"2"), ("é.md", None)], folder)
    assert read() == {"a.md": b"1", "d/b.png": b"2", "é.md": b""}
    written(spark, [("c.md", b"3")], folder)
    assert read() == {"a.md": b"1", "d/b.png": b"2", "é.md": b"", "c.md": b"3"}
    assert [r.file for r in spark.read.format("document_files").load(folder).where("file IN ('c.md', 'x')").collect()] == ["c.md"]
    written(spark, [("z.md", b"9")], folder, "overwrite")
    assert read() == {"z.md": b"9"}
    written(spark, [], folder)
    assert read() == {"z.md": b"9"}


def test_a_failed_write_leaves_nothing(spark, tmp_path, folder):
    written(spark, [("kept.md", b"k")], folder)
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.when(F.col("id") == 33, F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.encode(F.lit("x"), "UTF-8")).alias("bytes"))
    with pytest.raises(Exception, match="killed"):
        rows.write.format("document_files").mode("append").save(folder)
    for bad in ("../up", "/", "", None, "a/../../b", "_hidden"):
        with pytest.raises(Exception, match="not a file name"):
            written(spark, [(bad, b"x")], folder, parts=1)
    with pytest.raises(Exception, match="two rows"):
        written(spark, [("same", b"1"), ("./same", b"2")], folder, parts=1)
    assert [r.file for r in spark.read.format("document_files").load(folder).collect()] == ["kept.md"]
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("_task-")]) == 1


def test_only_committed_attempts_count(tmp_path, monkeypatch):
    import pyspark

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        partitionId = staticmethod(lambda: 0)  # noqa: N815

        def attemptNumber(self):
            return self.attempt

    writer = L._FilesWriter({"path": str(tmp_path)}, False)
    messages = []
    for attempt in (0, 1):
        monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda a=attempt: Task(a)))
        messages.append(writer.write(iter([{"file": "x", "bytes": b"%d" % attempt}])))
    assert L.listed(str(tmp_path)) == []
    writer.commit([messages[1]])
    assert [(n, open(p, "rb").read()) for n, p, _ in L.listed(str(tmp_path))] == [("x", b"1")]


def test_names_of_companions(spark):
    texts = spark.createDataFrame([("A b", "t"), ("c", None)], "document string, text string")
    assets = spark.createDataFrame([("A b", n, n.encode()) for n in ("p.png", "q/P.png", "p~2.png", "", "..", "한 글.jpg", "a.b.c", "A.b.c")] + [("A b", None, b"n"), ("c", "p.png", b"1"), ("c", "p.png", b"1")], "document string, name string, bytes binary")
    got = [r.file for r in L.companions(texts, assets).collect()]
    assert len(got) == len({x.lower() for x in got}) == 13
    assert {"A-b.md", "c.md", "A-b.assets/p.png", "A-b.assets/P~2.png", "A-b.assets/한-글.jpg", "c.assets/p.png", "c.assets/p~2.png"} <= set(got)


def test_what_was_written_is_read_by_lists_of_tasks(spark, tmp_path, folder, monkeypatch):
    rows = [(f"{'d/' * (i % 3)}f{i}.md", b"%d" % i) for i in range(50)]
    written(spark, rows, folder, parts=2)
    monkeypatch.setattr(L, "_found", lambda *a: pytest.fail("files are listed"))
    reader = L._FilesReader({"path": folder})
    groups = reader.partitions()
    assert len(groups) == 2 and not any(g.files for g in groups)
    assert sorted(r for g in groups for r in reader.read(g)) == sorted(rows)
    assert len(list((tmp_path / "out" / "_committed").glob("commit-*.json"))) == 1


def test_lists_are_bounded_and_older_manifests_count(tmp_path, monkeypatch):
    import json

    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda _: 0, "attemptNumber": lambda _: 0})()))
    monkeypatch.setattr(L, "GROUP_FILES", 4)
    writer = L._FilesWriter({"path": str(tmp_path)}, False)
    rows = [(f"a/f{i}", b"x" * i) for i in range(10)]
    writer.commit([writer.write(iter([{"file": n, "bytes": b} for n, b in rows]))])
    reader = L._FilesReader({"path": str(tmp_path)})
    groups = reader.partitions()
    assert [len(list(reader.read(g))) for g in groups] == [4, 4, 2]
    assert sorted(r for g in groups for r in reader.read(g)) == rows
    (tmp_path / "_task-old-0" / "b").mkdir(parents=True)
    (tmp_path / "_task-old-0" / "b" / "g").write_bytes(b"g")
    (tmp_path / "_committed" / "commit-0.json").write_text(json.dumps(["_task-old-0"]))
    assert sorted(r for g in reader.partitions() for r in reader.read(g)) == [*rows, ("b/g", b"g")]
    assert [(n, size) for n, _, size in L.listed(str(tmp_path))] == [*((n, len(b)) for n, b in rows), ("b/g", 1)]


def test_a_task_that_outlives_its_write_finds_no_place(tmp_path, monkeypatch):
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda _: 0, "attemptNumber": lambda _: 0})()))
    writer = L._FilesWriter({"path": str(tmp_path)}, False)

    def rows():
        yield {"file": "d/a", "bytes": b"1"}
        writer.abort([])
        yield {"file": "d/b", "bytes": b"2"}

    with pytest.raises(OSError):
        writer.write(rows())
    with pytest.raises(OSError):
        writer.write(iter([{"file": "c", "bytes": b"3"}]))
    assert list(tmp_path.iterdir()) == []
