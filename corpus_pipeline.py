"""From raw documents to shuffled training shards, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last
return the columns of ``documents`` and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm.decontaminate import contaminated
from corpusweave.llm.mixing import mix
from corpusweave.llm.neardup import near_duplicates
from corpusweave.llm.quality import judge
from corpusweave.llm.sharding import shuffle_into_shards
from corpusweave.llm.tables import set_aside, within, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs selected on the labelled ones.

    Null and empty texts have too few words and go; a null language is a stratum of its own.
    """
    docs, names = set_aside(docs, "_quality")
    return judge(docs, _table(spark, sf_dir, "labels")).where("_quality.kept").drop("_quality").withColumnsRenamed(names)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates; rows without an id stay."""
    copies = near_duplicates(docs).where("not kept").select("doc_id")
    return within(docs, written(copies), "doc_id", without=True).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id stay."""
    leaks = contaminated(docs, _table(spark, sf_dir, "benchmark")).select("doc_id")
    return within(docs, written(leaks), "doc_id", without=True).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that repeat an id, or have none, share the larger number."""
    docs, names = set_aside(docs, "_id", "_copies", "_copy")
    copies = mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    return (
        docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
        .select(*docs.columns)
        .withColumnsRenamed(names)
    )


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in random order, in eight shards of equal row counts."""
    return shuffle_into_shards(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Cutoffs with exact bounds, components and multipliers are beyond SQL; tests hold the stages' columns, rows and planted copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
