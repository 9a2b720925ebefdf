"""The pipeline and the queries on the driver's smallest tables and on odd rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusweave.llm.queries import QUERIES
from corpusweave.llm.secrets import find_secrets

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_covers_its_table(spark, name):
    got = QUERIES[name](spark, FOLDER)
    key = "page_id" if "page_id" in got.columns else "doc_id"
    rows = spark.read.parquet(f"{FOLDER}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    if name.startswith("op8_"):
        assert set(got.columns) == {"doc_id", "item_id", "score", "word_from", "word_to"}
    elif name.startswith("op13_"):  # up to ten rows per item, not one per document
        assert {"item_id", "rank", "doc_id", "score"} <= set(got.columns)
        items = {r.item_id for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id").collect()}
        ranks = {}
        for r in got.collect():
            assert r.score > 0
            ranks.setdefault(r.item_id, []).append(r["rank"])
        assert ranks and set(ranks) <= items
        assert all(len(x) <= 10 and sorted(x) == list(range(1, len(x) + 1)) for x in ranks.values())
    else:
        assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())


def test_stages(spark):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (5000, "", "en", "src0", 0), (5001, "a " * 40, None, None, 80)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        if name != "sharding":
            assert set(out.columns) == COLUMNS
            assert out.join(docs, [out[c].eqNullSafe(docs[c]) for c in COLUMNS], "left_anti").count() == 0
        if name not in ("sharding", "mixing"):
            assert out.groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "sharding":
            assert out.count() == docs.count()
        docs = out
    assert docs.select(F.count_distinct("shard")).first()[0] == 8


def test_run(spark):
    assert {"shard", "slot"} | COLUMNS == set(corpus_pipeline.run(spark, FOLDER).columns)


def test_columns_with_clashing_names_stay(spark):
    clashing = ["_m", "_Quality", "_id", "_copies", "_copy", "_order", "_before", "_where", "_base", "_words", "_m_aside"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clashing})
    keep = dict(corpus_pipeline.STAGES)
    outs = [keep[s](spark, extra, FOLDER) for s in ("quality", "mixing", "sharding")] + [find_secrets(extra)]
    plain = [keep[s](spark, docs, FOLDER) for s in ("quality", "mixing", "sharding")] + [find_secrets(docs)]
    for out, want in zip(outs, plain):
        assert out.columns == [*docs.columns, *clashing, *want.columns[len(docs.columns) :]]
        assert out.where(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in clashing)).count() == 0
        assert sorted(out.select(*want.columns).collect()) == sorted(want.collect())
