"""The asset footer of a document's records: binaries, section bytes and other streams as DATA lines, and the rows of such a footer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.attributes import data_uri, entry_number, mime_of
from foliant.operators.documents import attributes

STAMP = "<!-- foliant:assets v1 -->"
OCTETS = "application/octet-stream"


def _record(head: Column, mime: Column, content: Column) -> Column:
    return F.concat(head, F.lit("\nDATA: "), data_uri(mime, content), F.lit("\n\n"))


def assets_block(binaries: DataFrame, sections: DataFrame, streams: DataFrame) -> DataFrame:
    """(doc_id, assets) of binaries(doc_id, ord, id, bytes), sections(doc_id, section, bytes) and streams(doc_id, name, bytes): ASSET records
    in their order, then SECTION_BYTES by number, then UNKNOWN_STREAM by name. Empty or null content has no record, and a document
    without a record has no row. A document's records meet in one row, since they are one text."""
    number = entry_number(F.col("id"))
    label = F.coalesce(number.cast("string"), F.col("id"))
    mime = mime_of(F.col("id"), OCTETS)
    octets = F.lit(OCTETS)
    length = F.octet_length("bytes").cast("string")
    asset = F.concat(F.lit("ASSET[id=asset-"), label, F.lit(",bin_id="), label, F.lit(",mime="), mime, F.lit(",source_id="), F.col("id"), F.lit("]"))
    section = F.concat(F.lit("SECTION_BYTES[id=section-"), F.col("section").cast("string"), F.lit(",len="), length, F.lit("]"))
    stream = F.concat(F.lit("UNKNOWN_STREAM[name="), F.col("name"), F.lit(",len="), length, F.lit("]"))
    held = F.octet_length("bytes") > 0
    none = F.lit("")
    rows = binaries.where(held).select("doc_id", F.lit(0).alias("t"), F.col("ord").cast("bigint").alias("n"), F.col("id").alias("s"), _record(asset, mime, F.col("bytes")).alias("r"))
    rows = rows.unionByName(sections.where(held).select("doc_id", F.lit(1).alias("t"), F.col("section").cast("bigint").alias("n"), none.alias("s"), _record(section, octets, F.col("bytes")).alias("r")))
    rows = rows.unionByName(streams.where(held).select("doc_id", F.lit(2).alias("t"), F.lit(0).cast("bigint").alias("n"), F.col("name").alias("s"), _record(stream, octets, F.col("bytes")).alias("r")))
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("t", "n", "s", "r"))).alias("l"))
    return whole.select("doc_id", F.concat(F.lit(STAMP + "\n\n"), F.array_join(F.transform("l", lambda x: x["r"]), "")).alias("assets"))


def asset_rows(footers: DataFrame) -> DataFrame:
    """(doc_id, kind, name, mime, bytes) of footers(doc_id, assets): a row for each record whose DATA line is a data URI. name is the binary's
    source id, section-<number> or the stream's name. What isn't base64 has null bytes."""
    lines = F.filter(F.split(F.coalesce("assets", F.lit("")), "\n"), lambda x: x != "")
    pairs = F.filter(F.transform("l", lambda x, i: F.struct(x.alias("head"), F.get("l", i + 1).alias("data"))), lambda p: p["head"].rlike(r"^(?:ASSET|SECTION_BYTES|UNKNOWN_STREAM|DOC_INFO)\[") & p["data"].startswith("DATA: data:"))
    found = footers.select("doc_id", lines.alias("l")).select("doc_id", F.explode(pairs).alias("p")).select("doc_id", F.regexp_extract("p.head", r"^([A-Z_]+)", 1).alias("kind"), attributes(F.col("p.head")).alias("a"), F.col("p.data").alias("d"))
    name = F.coalesce(F.col("a")["source_id"], F.col("a")["name"], F.col("a")["id"])
    uri = r"^DATA: data:([^;,]*);base64,"
    body = F.substring_index("d", ",", -1)
    return found.select("doc_id", "kind", name.alias("name"), F.regexp_extract("d", uri, 1).alias("mime"), F.when(F.col("d").rlike(uri), F.try_to_binary(body, F.lit("base64"))).alias("bytes"))
