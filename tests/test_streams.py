"""Streams and files of binary documents from rows that pass in order, across the borders of batches."""

from foliant.sources import binary as B
from foliant.sources import compound
from foliant.sources import records as R


def test_streams_and_files_hold_no_group_of_rows(spark):
    rows = [(d, f"/S{s}", i, 70 + i % 5, i % 3, bytes([d or 0, s, i])) for d in (1, 2, None) for s in range(2) for i in range(11)]
    twice = [(1, "/X", b"b"), (1, "/X", b"a"), (2, "/DocInfo", b"info"), (2, "/N", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        streams = R.streams(spark.createDataFrame(rows[::-1], "doc_id long, stream string, seq int, tag int, level int, data binary").repartition(3))
        got = {(r.doc_id, r.stream): bytes(r.bytes) for r in streams.collect()}
        assert got == {(d, f"/S{s}"): R.join([r[3:] for r in rows if r[:2] == (d, f"/S{s}")]) for d in (1, 2, None) for s in range(2)}
        files = B.files(spark.createDataFrame(twice, "doc_id long, stream string, bytes binary"))
        held = {r.doc_id: compound.read(bytes(r.content)) for r in files.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(held) == {1, 2} and held[1]["/X"] == b"a" and R.inflate(held[1]["/DocInfo"]) == b"" and R.inflate(held[2]["/DocInfo"]) == b"info" and held[2]["/N"] == b""
    assert all("FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString() for df in (streams, files))
