"""From a table of documents to one result row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave import params
from corpusweave.functions import blocks as B
from corpusweave.functions import text as T
from corpusweave.functions.embedding import Embedder
from corpusweave.functions.text import let
from corpusweave.operators.kmeans import kmeans_in_groups

_BLOCKS = f"array<{B.BLOCK_TYPE}>"
EMBEDDING_ERROR = "a chunk could not be embedded"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once, however often they are used afterwards.

    Catalyst merges neighbouring projections and copies a filter's condition below a projection,
    which would run the chunker again for every use; it does neither across a generator.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    row = df.select("*", F.explode(F.array(packed)).alias("_once"))
    return row.select(*df.columns, *[F.col(f"_once.{name}").alias(name) for name in columns])


def chunk_documents(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    chunking: params.ChunkSettings = params.ChunkSettings(),
) -> DataFrame:
    """One row per chunk: key, ``chunk_index`` from 0 and ``chunk``. No shuffle."""
    pieces = T.chunks(
        F.col(text),
        min_chunk_size=chunking.min_chunk_size,
        max_chunk_size=chunking.max_chunk_size,
        overlap_size=chunking.overlap_size,
    )
    # The outer form, because Spark guards the plain one with a filter that runs the chunker too.
    return docs.select(key, F.posexplode_outer(pieces).alias("chunk_index", "chunk")).filter(
        F.col("chunk").isNotNull()
    )


def _shortest_text_with(chunks: int, chunking: params.ChunkSettings) -> int:
    """A lower bound on the length of a text with that many chunks.

    A chunk is closed because it and the next block exceed ``max_chunk_size`` together, and at most
    ``overlap_size`` of its characters are repeated from the chunk before it. So two neighbouring
    chunks hold at least ``max_chunk_size - overlap_size`` characters of their own.
    """
    return (chunks // 2) * (chunking.max_chunk_size - chunking.overlap_size)


def summarize_documents(
    docs: DataFrame,
    embedder: Embedder,
    *,
    key: str = "doc_id",
    text: str = "text",
    error: str | None = None,
    chunking: params.ChunkSettings = params.ChunkSettings(),
    clustering: params.ClusterSettings = params.ClusterSettings(),
    max_text_bytes: int = params.MAX_TEXT_BYTES,
    tie_digits: int | None = None,
) -> DataFrame:
    """Status, representative blocks, summaries, keywords, language and embedding per document.

    ``error`` names a column with the message of a decoding failure, if there is one. Documents
    with few chunks never leave their partition; only the chunks of documents that are clustered
    are embedded one by one and shuffled, once, by document. A document with a chunk that the model
    fails on is ``ERROR``, with the message of the first such chunk.
    """
    decode_error = F.col(error) if error else F.lit(None).cast("string")
    failed = (decode_error.isNotNull() | F.col(text).isNull()) if error else F.col(text).isNull()
    base = docs.select(
        F.col(key).alias("file_id"),
        F.col(text).alias("text"),
        decode_error.alias("error_message"),
        T.document_status(F.col(text), failed, max_text_bytes).alias("status"),
        F.when(failed, F.lit(0)).otherwise(T.text_bytes(F.col(text))).cast("bigint").alias("text_bytes"),
    )
    pieces = T.chunks(
        F.col("text"),
        min_chunk_size=chunking.min_chunk_size,
        max_chunk_size=chunking.max_chunk_size,
        overlap_size=chunking.overlap_size,
    )
    unclustered = _sampled_documents(base, pieces, embedder, clustering)
    clustered = _clustered_documents(base, pieces, embedder, chunking, clustering, tie_digits)
    return _results(unclustered.unionByName(clustered), embedder)


def _sampled_documents(
    base: DataFrame, pieces: Column, embedder: Embedder, clustering: params.ClusterSettings
) -> DataFrame:
    """Documents that are not OK or have too few chunks to cluster."""
    ok = F.col("status") == "OK"
    cut = once(base, chunks=F.when(ok, pieces).otherwise(F.array().cast("array<string>"))).drop("text")
    few = cut.filter(F.size("chunks") < clustering.min_sentences)
    if not embedder.total:
        chunk_rows = few.select("file_id", F.posexplode_outer("chunks").alias("index", "chunk")).filter(
            F.col("chunk").isNotNull()
        )
        tried = chunk_rows.withColumn("tried", embedder.embed_or_error(F.col("chunk")))
        unembedded = (
            tried.filter(F.col("tried.vector").isNull())
            .groupBy("file_id")
            .agg(F.min_by(F.coalesce("tried.error", F.lit(EMBEDDING_ERROR)), "index").alias("_failure"))
        )
        few = (
            few.join(unembedded, "file_id", "left")
            .withColumn("error_message", F.coalesce("_failure", "error_message"))
            .withColumn("status", F.when(F.col("_failure").isNotNull(), "ERROR").otherwise(F.col("status")))
            .drop("_failure")
        )
    return few.select(
        "file_id",
        "status",
        "error_message",
        "text_bytes",
        F.size("chunks").alias("sentence_count"),
        F.when(ok, B.sampled_blocks(F.col("chunks"), clustering.max_clusters))
        .otherwise(F.array().cast(_BLOCKS))
        .cast(_BLOCKS)
        .alias("representative_blocks"),
    )


def _clustered_documents(
    base: DataFrame,
    pieces: Column,
    embedder: Embedder,
    chunking: params.ChunkSettings,
    clustering: params.ClusterSettings,
    tie_digits: int | None,
) -> DataFrame:
    many = let(pieces, lambda c: F.when(F.size(c) >= clustering.min_sentences, c))
    shortest = _shortest_text_with(clustering.min_sentences, chunking)
    rows = (
        base.filter((F.col("status") == "OK") & (F.length("text") >= shortest))
        .select("file_id", "text_bytes", F.posexplode_outer(many).alias("chunk_index", "chunk"))
        .filter(F.col("chunk").isNotNull())
    )
    if embedder.total:
        rows, carry, failure = rows.withColumn("embedding", embedder.embed(F.col("chunk"))), ["chunk"], None
    else:
        tried = rows.withColumn("_tried", embedder.embed_or_error(F.col("chunk")))
        failed = F.coalesce("_tried.error", F.when(F.col("_tried.vector").isNull(), EMBEDDING_ERROR))
        rows = tried.select(*rows.columns, F.col("_tried.vector").alias("embedding"), failed.alias("failure"))
        carry, failure = ["chunk", "failure"], F.get(F.filter("failure", lambda f: f.isNotNull()), F.lit(0))
    runs = kmeans_in_groups(
        rows,
        ["file_id", "text_bytes"],
        carry=carry,
        max_clusters=clustering.max_clusters,
        tie_digits=tie_digits,
        allow_null_vectors=not embedder.total,
    )
    embedded = F.col("cluster_id").isNotNull()
    found = B.clustered_blocks(
        F.col("chunk_index"), F.col("chunk"), F.col("cluster_id"), F.col("distance"), clustering
    )
    return runs.select(
        "file_id",
        F.when(embedded, "OK").otherwise("ERROR").alias("status"),
        F.when(~embedded, EMBEDDING_ERROR if failure is None else failure).alias("error_message"),
        "text_bytes",
        F.size("chunk").alias("sentence_count"),
        F.when(embedded, found).otherwise(F.array().cast(_BLOCKS)).cast(_BLOCKS).alias("representative_blocks"),
    )


def _results(found: DataFrame, embedder: Embedder) -> DataFrame:
    blocks = F.col("representative_blocks")
    ok = F.col("status") == "OK"
    summed = once(
        found,
        short_summary=F.when(ok, B.short_summary(blocks)),
        long_summary=F.when(ok, B.long_summary(blocks)),
    )
    short = F.col("short_summary")
    empty = F.array().cast("array<string>")
    return summed.select(
        "file_id",
        "status",
        F.lit(0).alias("retry_count"),
        "error_message",
        short,
        "long_summary",
        F.coalesce(T.keywords(short), empty).alias("tags"),
        F.lit(None).cast("string").alias("doc_type"),
        empty.alias("topics"),
        T.language(short).alias("language"),
        embedder.embed(F.nullif(short, F.lit(""))).alias("embedding"),
        F.struct(
            "sentence_count", F.size(blocks).alias("chunk_count"), "text_bytes"
        ).alias("raw_features"),
        blocks,
    )


def representative_listing(results: DataFrame) -> DataFrame:
    """One row per representative; a document without any gives one row with its status."""
    block = results.select(
        "file_id", "status", "error_message", F.explode_outer("representative_blocks").alias("_b")
    )
    return block.select(
        "file_id",
        "status",
        F.when(F.col("status") != "OK", F.coalesce("error_message", F.lit("the document failed")))
        .when(F.col("_b").isNull(), "no representatives")
        .alias("message"),
        F.col("_b.cluster_id").alias("cluster_id"),
        F.posexplode_outer("_b.representative_sentences").alias("position", "sentence"),
    )
