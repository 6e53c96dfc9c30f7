"""The pipeline's stages, one after another and at the edges."""

import corpus_pipeline as p
from foliant.llm import decontamination, neardup, toxicity
from foliant.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = p.toxicity_filter(spark, docs, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    assert clean.columns == docs.columns
    assert ids(clean) == ids(toxicity.score(docs, model).where("predicted = 0"))
    single = p.near_dedup(spark, clean, sf_dir)
    assert single.columns == docs.columns
    assert ids(single) == ids(neardup.groups(clean).where("stays"))
    held = p.decontaminate(spark, single, sf_dir)
    assert held.columns == docs.columns
    hits = {r.doc_id for r in decontamination.contaminated(single, table(spark, sf_dir, "benchmark")).collect()}
    assert ids(held) == sorted(set(ids(single)) - hits)
    last = p.tokenise(spark, held, sf_dir)
    assert ids(last) == ids(held) and last.where("NOT round_trip").count() == 0
    assert ids(p.run(spark, sf_dir)) == ids(last)


def test_null_and_empty_rows(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "plain words in a row here", None, None, None), (3, "plain words in a row here", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3]
    empty = spark.createDataFrame([], schema)
    for name, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


def test_columns_of_any_name_stay(spark, sf_dir):
    from pyspark.sql import functions as F

    names = ("_digest", "_Key", "_toxicity", "__toxicity", "score", "toxic", "quality", "label", "h", "node", "stays", "predicted", "item_id", "row")
    docs = table(spark, sf_dir, "documents")
    wide = docs.withColumns({n: F.col("doc_id").cast("int") + i for i, n in enumerate(names)})
    for name, stage in p.STAGES[:3]:
        docs, wide = stage(spark, docs, sf_dir), stage(spark, wide, sf_dir)
        assert wide.columns[5:] == list(names)
    assert wide.where(" OR ".join(f"`{n}` <> doc_id + {i}" for i, n in enumerate(names))).count() == 0
    assert sorted(r.doc_id for r in wide.collect()) == sorted(r.doc_id for r in docs.collect())
