"""The registered queries: every operator over whole tables, with its SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracles as O
from corpusweave import params
from corpusweave.functions import text as T
from corpusweave.functions import vectors as VF
from corpusweave.functions.embedding import hashed_words, model_embedder
from corpusweave.lineage import cut, ensure_checkpoint_dir
from corpusweave.operators import density as D
from corpusweave.operators import hierarchy as H
from corpusweave.operators import kmeans as K
from corpusweave.operators import representatives as R
from corpusweave.operators import vectors as V
from corpusweave.plans import documents as P
from corpusweave.plans import files as PF
from corpusweave.sources import files as S
from corpusweave.sources import folders, sinks
from corpusweave.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

SMALL = params.ChunkSettings(200, 300, 50)
DEFAULT = params.ChunkSettings()
HASHED = hashed_words(O.DIM)
TIE_DIGITS = 9  # distances are rounded to this on both sides, before anything is compared

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def sizes(settings: params.ChunkSettings) -> tuple[int, int, int]:
    return settings.min_chunk_size, settings.max_chunk_size, settings.overlap_size


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def spaced(text: str) -> str:
    """SQL of a text with blank lines after its full stops; the tables have none of their own."""
    return f"replace({text}, '.' || chr(10), '.' || chr(10) || ' ' || chr(10))"


def spaced_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.expr(spaced("text")).alias("text"))


def listed(df: DataFrame, key: str, array: F.Column, name: str) -> DataFrame:
    return df.select(key, F.posexplode(array).alias("position", name))


def listed_sql(table: str, key: str, array: str, name: str, where: str = "true") -> str:
    return (
        f"SELECT {key}, (g.j - 1)::INT AS position, l[g.j] AS {name} FROM "
        f"(SELECT {key}, {array} AS l FROM {table} WHERE {where}), unnest(range(1, len(l) + 1)) g(j)"
    )


def elements(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(VF.rounded(F.col(vector))).alias("i", "x"))


def elements_sql(source: str, keys: str, vector: str) -> str:
    return (
        f"SELECT {keys}, (g.j - 1)::INT AS i, round(v[g.j], 6) + 0.0::DOUBLE AS x FROM "
        f"(SELECT {keys}, {vector} AS v FROM {source}), unnest(range(1, len(v) + 1)) g(j)"
    )


# --- Text ---------------------------------------------------------------------------------------


@register("corpus_table", "SELECT doc_id, text FROM documents")
def corpus_table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@register("text_bytes", "SELECT doc_id, strlen(text)::INT AS text_bytes FROM documents")
def text_bytes(spark, sf):
    return documents(spark, sf).select("doc_id", T.text_bytes(F.col("text")).alias("text_bytes"))


@register(
    "document_status",
    "SELECT doc_id, CASE WHEN strlen(text) > 3000 THEN 'TEXT_TOO_LARGE' "
    "WHEN trim(text, ' ' || chr(10)) = '' THEN 'NO_CONTENT' ELSE 'OK' END AS status FROM documents",
)
def document_status(spark, sf):
    status = T.document_status(F.col("text"), max_text_bytes=3000)
    return documents(spark, sf).select("doc_id", status.alias("status"))


@register(
    "embeddable_rows",
    "SELECT conv_id, turn, CASE WHEN u.j = 0 OR trim(text) <> '' THEN CASE WHEN u.j = 0 THEN 'rejected' "
    "ELSE 'accepted' END ELSE 'rejected' END AS route FROM conversations, (VALUES (0), (1)) u(j)",
)
def embeddable_rows(spark, sf):
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    both = turns.unionByName(turns.withColumn("text", F.lit(" 　\n")))
    accepted, rejected = V.split_embeddable(both)
    return (
        accepted.withColumn("route", F.lit("accepted"))
        .unionByName(rejected.withColumn("route", F.lit("rejected")))
        .select("conv_id", "turn", "route")
    )


@register("non_blank_documents", "SELECT doc_id FROM documents WHERE trim(text, ' ' || chr(10)) <> ''")
def non_blank_documents(spark, sf):
    return documents(spark, sf).filter(~T.is_blank(F.col("text"))).select("doc_id")


@register("paragraphs", listed_sql("documents", "doc_id", O.paragraphs(spaced("text")), "paragraph"))
def paragraphs(spark, sf):
    return listed(spaced_documents(spark, sf), "doc_id", T.paragraphs(F.col("text")), "paragraph")


@register("page_paragraphs", listed_sql("pages", "page_id", O.paragraphs("html"), "paragraph"))
def page_paragraphs(spark, sf):
    return listed(read_table(spark, sf, "pages"), "page_id", T.paragraphs(F.col("html")), "paragraph")


_ONE_LINE = "replace(text, chr(10), ' ')"


@register("sentences", listed_sql("documents", "doc_id", O.sentences(_ONE_LINE), "sentence"))
def sentences(spark, sf):
    docs = documents(spark, sf)
    return listed(docs, "doc_id", T.sentences(F.replace("text", F.lit("\n"), F.lit(" "))), "sentence")


@register("packed_paragraphs", listed_sql("documents", "doc_id", O.pack(_ONE_LINE, 300), "block"))
def packed_paragraphs(spark, sf):
    one_line = F.replace("text", F.lit("\n"), F.lit(" "))
    return listed(documents(spark, sf), "doc_id", T.pack_sentences(one_line, 300), "block")


@register("document_blocks", listed_sql("documents", "doc_id", O.blocks(spaced("text"), 300), "block"))
def document_blocks(spark, sf):
    return listed(spaced_documents(spark, sf), "doc_id", T.blocks(F.col("text"), 300), "block")


@register(
    "assembled_chunks",
    listed_sql("documents", "doc_id", O.assemble(O.sentences(_ONE_LINE), 50, 120, 20), "chunk"),
)
def assembled_chunks(spark, sf):
    parts = T.sentences(F.replace("text", F.lit("\n"), F.lit(" ")))
    built = T.assemble_chunks(parts, min_chunk_size=50, max_chunk_size=120, overlap_size=20)
    return listed(documents(spark, sf), "doc_id", built, "chunk")


def _chunks(name: str, settings: params.ChunkSettings, source, sql_text: str) -> None:
    @register(name, listed_sql("documents", "doc_id", O.chunks(sql_text, sizes(settings)), "chunk"))
    def query(spark, sf):
        rows = P.chunk_documents(source(spark, sf), chunking=settings)
        return rows.withColumnRenamed("chunk_index", "position")


_chunks("chunks", DEFAULT, documents, "text")
_chunks("small_chunks", SMALL, documents, "text")
_chunks("small_chunks_of_paragraphs", SMALL, spaced_documents, spaced("text"))


@register("language_tags", f"SELECT doc_id, {O.language('text')} AS language FROM documents")
def language_tags(spark, sf):
    return documents(spark, sf).select("doc_id", T.language(F.col("text")).alias("language"))


@register("keywords", f"SELECT doc_id, {O.keywords('text')} AS keywords FROM documents")
def keywords(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@register(
    "cluster_labels",
    "SELECT vec_id, CASE WHEN label = 0 THEN 'noise' ELSE 'cluster-' || (label - 1)::VARCHAR END AS name FROM embeddings",
)
def cluster_labels(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", T.cluster_label(F.col("label") - 1).alias("name"))


# --- Embeddings and vectors ---------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").withColumn("embedding", VF.as_doubles(F.col("embedding")))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty documents of vectors."""
    return vectors(spark, sf).select(
        (F.col("vec_id") % 20).alias("doc_id"),
        F.floor(F.col("vec_id") / 20).cast("int").alias("chunk_index"),
        "embedding",
    )


def _lengths():
    return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]


@register(
    "model_embedding",
    "SELECT doc_id, length(text)::DOUBLE AS length, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e FROM documents",
)
def model_embedding(spark, sf):
    model = model_embedder(_lengths, name="lengths")
    rows = V.embed_column(documents(spark, sf), model)
    return rows.select(
        "doc_id", F.col("embedding")[0].cast("double").alias("length"), F.col("embedding")[1].cast("double").alias("e")
    )


def _picky():
    def predict(texts):
        for t in texts:
            if len(t) % 5 == 0:
                raise ValueError(f"cannot embed {len(t)} characters")
        return [[float(len(t)), 1.0] for t in texts]

    return predict


_REFUSED = (
    f"c AS ({listed_sql('documents', 'doc_id', O.chunks('text', sizes(DEFAULT)), 't')}), "
    "f AS (SELECT doc_id, min_by('cannot embed ' || length(t) || ' characters', position) AS message FROM c "
    "WHERE length(t) % 5 = 0 GROUP BY doc_id)"
)


@register(
    "model_failures",
    f"WITH {_REFUSED} SELECT doc_id AS file_id, CASE WHEN message IS NOT NULL THEN 'ERROR' "
    "WHEN EXISTS (FROM c WHERE c.doc_id = documents.doc_id) THEN 'OK' ELSE 'NO_CONTENT' END AS status, "
    "message AS error_message FROM documents LEFT JOIN f USING (doc_id)",
)
def model_failures(spark, sf):
    """A model that raises on some chunks: their documents fail with its message, the others stay whole."""
    found = P.summarize_documents(documents(spark, sf), model_embedder(_picky, name="picky", batch_size=16))
    return found.select("file_id", "status", "error_message")


@register("whole_document_embedding", elements_sql("documents", "doc_id", O.embed("text")))
def whole_document_embedding(spark, sf):
    return elements(V.embed_column(documents(spark, sf), HASHED), ["doc_id"], "embedding")


@register(
    "chunk_embedding_mean",
    f"WITH c AS ({listed_sql('documents', 'doc_id', O.chunks('text', sizes(DEFAULT)), 't')}), "
    f"e AS (SELECT doc_id, position, {O.embed('t')} AS v FROM c) "
    "SELECT doc_id, (g.j - 1)::INT AS i, round(avg(v[g.j]), 6) + 0.0::DOUBLE AS x "
    f"FROM e, range(1, {O.DIM + 1}) g(j) GROUP BY doc_id, g.j",
)
def chunk_embedding_mean(spark, sf):
    chunked = V.embed_column(P.chunk_documents(documents(spark, sf)), HASHED, "chunk")
    return elements(V.mean_vectors(chunked, ["doc_id"]), ["doc_id"], "mean")


@register(
    "masked_mean_pool",
    "SELECT vec_id % 20 AS key, (g.j - 1)::INT AS i, round(sum(embedding[g.j]::DOUBLE * m) / greatest(sum(m), 1), 6) + 0.0::DOUBLE AS x "
    "FROM (SELECT *, CASE WHEN vec_id % 20 = 0 OR vec_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM embeddings), "
    f"range(1, {O.DIM + 1}) g(j) GROUP BY vec_id % 20, g.j",
)
def masked_mean_pool(spark, sf):
    masked = (F.col("vec_id") % 20 == 0) | (F.col("vec_id") % 3 == 0)
    tokens = vectors(spark, sf).select(
        (F.col("vec_id") % 20).alias("key"),
        F.col("embedding").alias("vec"),
        F.when(masked, 0).otherwise(1).alias("mask"),
    )
    return elements(V.masked_mean_pool(tokens, ["key"]), ["key"], "pooled")


@register(
    "l2_normalized",
    elements_sql(
        "embeddings", "vec_id", O.normalized("list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5))")
    ),
)
def l2_normalized(spark, sf):
    scaled = F.transform("embedding", lambda x: x * (F.col("vec_id") % 5))
    return elements(vectors(spark, sf).select("vec_id", VF.l2_normalize(scaled).alias("v")), ["vec_id"], "v")


@register(
    "squared_distances",
    "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 6) AS distance "
    "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def squared_distances(spark, sf):
    rows = vectors(spark, sf)
    shifted = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    distance = F.round(VF.squared_distance(F.col("embedding"), F.col("next")), 6)
    return rows.join(shifted, "vec_id").select("vec_id", distance.alias("distance"))


@register(
    "mean_vectors",
    "SELECT label, (g.j - 1)::INT AS i, round(avg(embedding[g.j]::DOUBLE), 6) + 0.0::DOUBLE AS x "
    f"FROM embeddings, range(1, {O.DIM + 1}) g(j) GROUP BY label, g.j",
)
def mean_vectors(spark, sf):
    return elements(V.mean_vectors(vectors(spark, sf), ["label"]), ["label"], "mean")


_SEGMENTS = (
    f"WITH c AS ({listed_sql('documents', 'doc_id', O.chunks('text', sizes(DEFAULT)), 't')}), "
    "n AS (SELECT doc_id, count(*)::INT AS segment_count FROM c GROUP BY doc_id) "
)


def payload(spark: SparkSession, sf: str) -> DataFrame:
    chunked = V.embed_column(P.chunk_documents(documents(spark, sf)), HASHED, "chunk")
    return V.segment_payload(chunked, "doc_id", HASHED.name)


@register(
    "segment_payload",
    _SEGMENTS + f"SELECT doc_id AS source_path, '{HASHED.name}' AS model_name, segment_count, position AS index, t AS text, "
    f"{O.DIM} AS vector_length, round(list_sum({O.embed('t')}), 6) AS vector_sum FROM c JOIN n USING (doc_id)",
)
def segment_payload(spark, sf):
    rows = payload(spark, sf).select("source_path", "model_name", "segment_count", F.inline("segments"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("vector_sum", F.round(total, 6)).drop("vector")


@register(
    "redacted_payload",
    _SEGMENTS + f"SELECT doc_id AS source_path, '{HASHED.name}' AS model_name, segment_count, position AS index, t AS text, "
    f"{O.DIM} AS vector_length FROM c JOIN n USING (doc_id)",
)
def redacted_payload(spark, sf):
    return V.redact_vectors(payload(spark, sf)).select(
        "source_path", "model_name", "segment_count", F.inline("segments")
    )


# --- K-means ------------------------------------------------------------------------------------


@register(
    "cluster_paths",
    f"SELECT doc_id, len(l)::BIGINT AS n, CASE WHEN len(l) < 8 THEN 'sample' ELSE 'cluster' END AS path FROM "
    f"(SELECT doc_id, {O.chunks('text', sizes(SMALL))} AS l FROM documents) WHERE len(l) > 0",
)
def cluster_paths(spark, sf):
    chunked = P.chunk_documents(documents(spark, sf), chunking=SMALL).drop("chunk")
    few, many = K.split_by_path(chunked, ["doc_id"])
    both = few.withColumn("path", F.lit("sample")).unionByName(many.withColumn("path", F.lit("cluster")))
    return both.select("doc_id", "n", "path").distinct()


@register(
    "cluster_counts",
    f"SELECT doc_id, n, {O.CLUSTER_COUNT} AS k FROM (SELECT doc_id, len({O.chunks('text', sizes(SMALL))})::INT AS n FROM documents)",
)
def cluster_counts(spark, sf):
    n = F.size(T.chunks(F.col("text"), min_chunk_size=200, max_chunk_size=300, overlap_size=50))
    counted = P.once(documents(spark, sf).select("doc_id", "text"), n=n)
    return counted.select("doc_id", "n", K.cluster_count(F.col("n")).alias("k"))


def _centroids_sql(ctes: str, table: str) -> str:
    return (
        f"WITH RECURSIVE {ctes} SELECT doc_id, c::INT AS cluster_id, (g.j - 1)::INT AS i, "
        f"round(m[g.j], 6) + 0.0::DOUBLE AS x FROM {table}, range(1, {O.DIM + 1}) g(j)"
    )


@register("initial_centroids", _centroids_sql(f"{O.EMBEDDED}, {O.first_centroids()}", "init"))
def initial_centroids(spark, sf):
    first = K.initial_centroids(keyed(spark, sf), ["doc_id"])
    return elements(first, ["doc_id", "cluster_id"], "centroid")


@register(
    "nearest_centroids",
    f"WITH {O.EMBEDDED}, {O.first_centroids()} SELECT doc_id, i AS chunk_index, b.c::INT AS cluster_id, "
    f"b.d AS distance FROM ({O.nearest('init')})",
)
def nearest_centroids(spark, sf):
    rows = keyed(spark, sf)
    first = K.initial_centroids(rows, ["doc_id"])
    placed = K.assign(rows, first, ["doc_id"], tie_digits=TIE_DIGITS)
    return placed.select("doc_id", "chunk_index", "cluster_id", "distance")


@register(
    "updated_centroids",
    _centroids_sql(
        f"{O.EMBEDDED}, {O.first_centroids()}, one AS (SELECT doc_id, i, b.c AS c FROM ({O.nearest('init')})), "
        f"upd AS (SELECT k.doc_id, k.c, coalesce(q.m, k.m) AS m FROM init k LEFT JOIN ({O.means('one')}) q USING (doc_id, c))",
        "upd",
    ),
)
def updated_centroids(spark, sf):
    rows = keyed(spark, sf)
    first = K.initial_centroids(rows, ["doc_id"])
    placed = K.assign(rows, first, ["doc_id"], tie_digits=TIE_DIGITS)
    return elements(K.update_centroids(placed, first, ["doc_id"]), ["doc_id", "cluster_id"], "centroid")


_KMEANS_SQL = (
    f"WITH RECURSIVE {O.EMBEDDED}, {O.kmeans()} "
    "SELECT doc_id, i AS chunk_index, c::INT AS cluster_id, d AS distance FROM placed"
)


@register("kmeans", _KMEANS_SQL)
def kmeans(spark, sf):
    return K.kmeans(keyed(spark, sf), ["doc_id"], tie_digits=TIE_DIGITS)


@register("kmeans_by_joins", _KMEANS_SQL)
def kmeans_by_joins(spark, sf):
    return K.kmeans_by_joins(keyed(spark, sf), ["doc_id"], tie_digits=TIE_DIGITS)


_CHUNK_KMEANS_SRC = (
    f"pieces AS ({listed_sql('documents', 'doc_id', O.chunks('text', sizes(SMALL)), 't')}), "
    f"src AS (SELECT doc_id, position AS i, t, {O.embed('t')} AS v FROM pieces)"
)


@register(
    "chunk_kmeans",
    f"WITH RECURSIVE {_CHUNK_KMEANS_SRC}, {O.kmeans()} "
    "SELECT doc_id, i AS chunk_index, c::INT AS cluster_id, d AS distance FROM placed",
)
def chunk_kmeans(spark, sf):
    rows = V.embed_column(P.chunk_documents(documents(spark, sf), chunking=SMALL), HASHED, "chunk")
    return K.explode_runs(K.kmeans_in_groups(rows, ["doc_id"], tie_digits=TIE_DIGITS), "chunk_index")


@register(
    "sampled_clusters",
    f"WITH c AS (SELECT doc_id, {O.chunks('text', sizes(DEFAULT))} AS l FROM documents), "
    "s AS (SELECT doc_id, (u.j - 1)::INT AS cluster_id, l, "
    "round_even((u.j - 1) * (len(l) - 1) / greatest(least(len(l), 4) - 1, 1), 0)::INT AS i "
    "FROM c, unnest(range(1, least(len(l), 4) + 1)) u(j)) "
    "SELECT doc_id, cluster_id, i AS representative_index, l[i + 1] AS representative_sentence, i::VARCHAR AS members FROM s",
)
def sampled_clusters(spark, sf):
    picked = K.sample_clusters(P.chunk_documents(documents(spark, sf)), ["doc_id"], max_clusters=4)
    members = F.array_join(F.col("member_indices").cast("array<string>"), ",")
    return picked.select(
        "doc_id", "cluster_id", "representative_index", "representative_sentence", members.alias("members")
    )


# --- Representatives ----------------------------------------------------------------------------

_PLACED = f"WITH RECURSIVE {_CHUNK_KMEANS_SRC}, {O.kmeans()}, {O.representatives()} "


def members(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.embed_column(P.chunk_documents(documents(spark, sf), chunking=SMALL), HASHED, "chunk")
    return K.kmeans(rows, ["doc_id"], carry=["chunk"], tie_digits=TIE_DIGITS)


@register(
    "large_clusters",
    f"WITH RECURSIVE {_CHUNK_KMEANS_SRC}, {O.kmeans()}, {O.representatives(least=4)} "
    "SELECT doc_id, c::INT AS cluster_id, i AS chunk_index, n::BIGINT AS cluster_size FROM ranked",
)
def large_clusters(spark, sf):
    kept = R.drop_small_clusters(members(spark, sf), ["doc_id"], 4)
    return kept.select("doc_id", "cluster_id", "chunk_index", "cluster_size")


@register(
    "ranked_members",
    f"WITH RECURSIVE {_CHUNK_KMEANS_SRC}, {O.kmeans()}, {O.representatives(least=1)} "
    "SELECT doc_id, c::INT AS cluster_id, i AS chunk_index, rank::INT AS rank FROM ranked",
)
def ranked_members(spark, sf):
    ranked = R.rank_members(members(spark, sf), ["doc_id"])
    return ranked.select("doc_id", "cluster_id", "chunk_index", "rank")


@register(
    "members_within_ratio",
    f"WITH RECURSIVE {_CHUNK_KMEANS_SRC}, {O.kmeans()}, {O.representatives(least=1, top=10**6, ratio=1.5)} "
    "SELECT doc_id, c::INT AS cluster_id, i AS chunk_index FROM topk",
)
def members_within_ratio(spark, sf):
    kept = R.within_ratio(R.rank_members(members(spark, sf), ["doc_id"]), ["doc_id"], 1.5)
    return kept.select("doc_id", "cluster_id", "chunk_index")


@register(
    "top_members",
    f"WITH RECURSIVE {_CHUNK_KMEANS_SRC}, {O.kmeans()}, {O.representatives(least=1, top=3, ratio=1e9)} "
    "SELECT doc_id, c::INT AS cluster_id, i AS chunk_index, rank::INT AS rank FROM topk",
)
def top_members(spark, sf):
    top = R.top_members(members(spark, sf), ["doc_id"], 3)
    return top.select("doc_id", "cluster_id", "chunk_index", "rank")


@register(
    "unique_representatives",
    _PLACED + "SELECT doc_id, c::INT AS cluster_id, i AS chunk_index, rank::INT AS rank FROM chosen",
)
def unique_representatives(spark, sf):
    rows = cut(members(spark, sf))
    top = R.within_ratio(R.top_members(rows, ["doc_id"]), ["doc_id"])
    large = R.drop_small_clusters(top.drop("cluster_size"), ["doc_id"], 1).drop("cluster_size")
    sized = R.cluster_sizes(rows, ["doc_id"]).filter(F.col("cluster_size") >= 2)
    kept = R.unique_texts(large.join(sized, ["doc_id", "cluster_id"]), ["doc_id"])
    return kept.select("doc_id", "cluster_id", "chunk_index", "rank")


@register(
    "representative_clusters",
    _PLACED + ", r AS (SELECT doc_id, c, list(i ORDER BY rank) AS ids, list(t ORDER BY rank) AS ts FROM chosen GROUP BY doc_id, c) "
    "SELECT doc_id, c::INT AS cluster_id, r.ids[1] AS representative_index, r.ts[1] AS representative_sentence, "
    "array_to_string(r.ts, ' | ') AS representatives, array_to_string(z.members, ',') AS members "
    "FROM r JOIN sized z USING (doc_id, c)",
)
def representative_clusters(spark, sf):
    found = R.representative_clusters(members(spark, sf), ["doc_id"])
    return found.select(
        "doc_id",
        "cluster_id",
        "representative_index",
        "representative_sentence",
        F.array_join("representative_sentences", " | ").alias("representatives"),
        F.array_join(F.col("member_indices").cast("array<string>"), ",").alias("members"),
    )


@register(
    "context_expansion",
    "SELECT r.conv_id, (r.turn // 2)::INT AS cluster_id, r.turn::INT AS representative_index, "
    "string_agg(n.turn::VARCHAR, ',' ORDER BY n.turn) AS around, string_agg(n.text, ' ' ORDER BY n.turn) AS context "
    "FROM conversations r JOIN conversations n ON n.conv_id = r.conv_id AND n.turn BETWEEN r.turn - 1 AND r.turn + 2 "
    "WHERE r.turn % 2 = 0 GROUP BY r.conv_id, r.turn",
)
def context_expansion(spark, sf):
    turns = read_table(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("int"))
    chosen = turns.filter(F.col("turn") % 2 == 0).select(
        "conv_id",
        F.floor(F.col("turn") / 2).cast("int").alias("cluster_id"),
        F.col("turn").alias("representative_index"),
    )
    wide = R.expand_context(chosen, turns, ["conv_id"], before=1, after=2, index="turn", text="text")
    return wide.select(
        "conv_id",
        "cluster_id",
        "representative_index",
        F.array_join(F.col("context_indices").cast("array<string>"), ",").alias("around"),
        "context",
    )


# --- Documents ----------------------------------------------------------------------------------

_RESULT = (
    "doc_id AS file_id, status, 0 AS retry_count, NULL::VARCHAR AS error_message, short AS short_summary, "
    f"long AS long_summary, coalesce({O.keywords('short')}, '') AS tags, NULL::VARCHAR AS doc_type, '' AS topics, "
    f"{O.language('short')} AS language, CASE WHEN short <> '' THEN round(list_sum({O.embed('short')}), 6) END AS embedding_sum, "
    "n_chunks::INT AS sentence_count, n_blocks::INT AS chunk_count, bytes::BIGINT AS text_bytes"
)


def results(spark: SparkSession, sf: str, chunking: params.ChunkSettings = DEFAULT) -> DataFrame:
    return P.summarize_documents(documents(spark, sf), HASHED, chunking=chunking, tie_digits=TIE_DIGITS)


def flat_results(found: DataFrame) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return found.select(
        "file_id", "status", "retry_count", "error_message", "short_summary", "long_summary",
        F.array_join("tags", " ").alias("tags"), "doc_type", F.array_join("topics", " ").alias("topics"),
        "language", F.round(total, 6).alias("embedding_sum"), "raw_features.*",
    )


@register("document_results", O.document_results(sizes(DEFAULT)) + f"SELECT {_RESULT} FROM result")
def document_results(spark, sf):
    return flat_results(results(spark, sf))


@register("small_chunk_document_results", O.document_results(sizes(SMALL)) + f"SELECT {_RESULT} FROM result")
def small_chunk_document_results(spark, sf):
    return flat_results(results(spark, sf, SMALL))


@register(
    "representative_blocks",
    O.document_results(sizes(SMALL)) + "SELECT doc_id AS file_id, c::INT AS cluster_id, ids[1] AS representative_index, "
    "ts[1] AS representative_sentence, array_to_string(ts, ' | ') AS representatives, "
    "array_to_string(members, ',') AS members FROM blocks",
)
def representative_blocks(spark, sf):
    rows = results(spark, sf, SMALL).select("file_id", F.inline("representative_blocks"))
    return rows.select(
        "file_id",
        "cluster_id",
        "representative_index",
        "representative_sentence",
        F.array_join("representative_sentences", " | ").alias("representatives"),
        F.array_join(F.col("member_indices").cast("array<string>"), ",").alias("members"),
    )


@register(
    "document_features",
    O.document_results(sizes(DEFAULT)) + "SELECT doc_id AS file_id, status, n_chunks::INT AS sentence_count, "
    "n_blocks::INT AS chunk_count, bytes::BIGINT AS text_bytes FROM result",
)
def document_features(spark, sf):
    return results(spark, sf).select("file_id", "status", "raw_features.*")


@register(
    "document_summaries",
    O.document_results(sizes(SMALL)) + "SELECT doc_id AS file_id, short AS short_summary, long AS long_summary FROM result",
)
def document_summaries(spark, sf):
    return results(spark, sf, SMALL).select("file_id", "short_summary", "long_summary")


@register(
    "summary_embedding",
    O.document_results(sizes(DEFAULT))
    + elements_sql("result", "doc_id", O.embed("short")).replace("SELECT doc_id, (g.j", "SELECT doc_id AS file_id, (g.j"),
)
def summary_embedding(spark, sf):
    return elements(results(spark, sf), ["file_id"], "embedding")


@register(
    "representative_listing",
    O.document_results(sizes(SMALL)) + "SELECT doc_id AS file_id, status, NULL::VARCHAR AS message, c::INT AS cluster_id, "
    "(g.j - 1)::INT AS position, ts[g.j] AS sentence FROM blocks JOIN result USING (doc_id), unnest(range(1, len(ts) + 1)) g(j) "
    "UNION ALL SELECT doc_id, status, 'no representatives', NULL, NULL, NULL FROM result WHERE n_blocks = 0",
)
def representative_listing(spark, sf):
    return P.representative_listing(results(spark, sf, SMALL))


# --- Density ------------------------------------------------------------------------------------


@register(
    "core_distances",
    f"WITH {O.pairs_ranked()} SELECT a AS vec_id, round(d, 6) AS core_distance FROM ranked WHERE rank = 5",
)
def core_distances(spark, sf):
    found = D.core_distances(vectors(spark, sf), 5)
    return found.select("vec_id", F.round("core_distance", 6).alias("core_distance"))


@register(
    "mutual_reachability",
    f"WITH {O.pairs_ranked()}, core AS (SELECT a, d AS core FROM ranked WHERE rank = 3) "
    "SELECT r.a AS id, r.b AS neighbour, r.rank::INT AS rank, round(greatest(x.core, y.core, r.d), 6) AS weight "
    "FROM ranked r JOIN core x ON x.a = r.a JOIN core y ON y.a = r.b WHERE r.rank <= 3",
)
def mutual_reachability(spark, sf):
    near = cut(D.neighbour_graph(vectors(spark, sf), 3))
    core = near.filter(F.col("rank") == 3).select("id", F.col("distance").alias("core"))
    other = core.select(F.col("id").alias("neighbour"), F.col("core").alias("_core"))
    weight = D.mutual_reachability(F.col("distance"), F.col("core"), F.col("_core"))
    return near.join(core, "id").join(other, "neighbour").select(
        "id", "neighbour", "rank", F.round(weight, 6).alias("weight")
    )


@register("spanning_tree_weights", O.mst_weights(2))
def spanning_tree_weights(spark, sf):
    from corpusweave.operators.ordinal import with_ordinal

    tree = D.spanning_tree(vectors(spark, sf), 2)
    placed = with_ordinal(tree.select("weight"), ["weight"], "place")
    return placed.select(F.col("place").cast("int").alias("place"), F.round("weight", 6).alias("weight"))


@register(
    "density_labels",
    f"WITH {O.density_labels('SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings', 5, 5, TIE_DIGITS)} "
    "SELECT id AS vec_id, label AS cluster_label FROM labels",
)
def density_labels(spark, sf):
    return D.density_labels(vectors(spark, sf), 5, tie_digits=TIE_DIGITS)


@register(
    "labelled_records",
    "SELECT d.doc_id, coalesce(e.label, -1) AS cluster_label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id",
)
def labelled_records(spark, sf):
    found = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "label")
    return D.label_records(documents(spark, sf).select("doc_id"), found, "doc_id")


_LABELLED = (
    "l AS (SELECT page_id, url AS path, coalesce(e.label - 1, -1) AS cluster_label, "
    "CASE WHEN page_id % 7 = 0 THEN 'noted' END AS note FROM pages p LEFT JOIN embeddings e ON e.vec_id = p.page_id), "
    "n AS (SELECT cluster_label, count(*) AS members FROM l GROUP BY cluster_label) "
)
_GROUP = "CASE WHEN cluster_label = -1 THEN 'noise' ELSE 'cluster-' || cluster_label::VARCHAR END AS \"group\""


def labelled_pages(spark: SparkSession, sf: str) -> DataFrame:
    found = vectors(spark, sf).select(F.col("vec_id").alias("page_id"), (F.col("label") - 1).alias("label"))
    pages = read_table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("path"), F.when(F.col("page_id") % 7 == 0, "noted").alias("note")
    )
    return D.label_records(pages, found, "page_id")


@register(
    "group_report",
    f"WITH {_LABELLED} SELECT {_GROUP}, cluster_label, members, path, note FROM l JOIN n USING (cluster_label)",
)
def group_report(spark, sf):
    return D.group_report(labelled_pages(spark, sf))


@register("group_summary", f"WITH {_LABELLED} SELECT {_GROUP}, cluster_label, members FROM n")
def group_summary(spark, sf):
    return D.group_summary(labelled_pages(spark, sf))


# --- Files --------------------------------------------------------------------------------------

_FOLDERS: dict[tuple[str, str, str], str] = {}
DOCUMENTS_PER_FOLDER = 1000


def document_files(spark: SparkSession, sf: str, text: F.Column | None = None) -> str:
    """A folder with one text file per document, written by tasks next to the checkpoints, many files to a folder.

    Each text ends with a line break of the writer's own.
    """
    text = F.col("text") if text is None else text
    known = (spark.sparkContext.applicationId, sf, str(text))
    if known not in _FOLDERS:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
        rows = documents(spark, sf).select("doc_id", text.alias("value"))
        folders.write_text_folders(rows, folder, "doc_id", keys_per_folder=DOCUMENTS_PER_FOLDER)
        _FOLDERS[known] = folder
    return _FOLDERS[known]


def doc_of(path: str) -> F.Column:
    return F.regexp_extract(path, r"doc_id=(\d+)[/.]", 1).cast("bigint").alias("doc_id")


@register("file_ordinals", "SELECT path, 'file-' || row_number() OVER (ORDER BY path)::VARCHAR AS file_id FROM (SELECT DISTINCT url AS path FROM pages)")
def file_ordinals(spark, sf):
    return S.with_file_ids(read_table(spark, sf, "pages").select(F.col("url").alias("path")))


_CP949 = "문서 "  # what the files in the second encoding start with


def mixed_files(spark: SparkSession, sf: str) -> str:
    """A folder with one file per document: hidden, below hidden folders, empty, in cp949, in no encoding, of other names."""
    known = (spark.sparkContext.applicationId, sf, "mixed")
    if known not in _FOLDERS:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/mixed-{uuid.uuid4().hex}"
        kind, text = F.col("doc_id") % 25, F.encode(F.coalesce("text", F.lit("")), "UTF-8")
        leaf = (
            F.when(kind == 0, ".hidden.txt").when(kind == 1, "_kept.txt").when(kind == 5, "other.md").when(kind == 6, "UPPER.TXT")
            .otherwise("plain.txt")
        )
        content = (
            F.when(kind == 2, F.lit(b""))
            .when(kind == 3, F.concat(F.lit(_CP949.encode("cp949")), F.encode(F.col("doc_id").cast("string"), "UTF-8")))
            .when(kind == 4, F.concat(F.lit(b"\xff"), text))
            .otherwise(text)
        )
        above = F.when(kind == 7, ".below/").otherwise("")
        rows = documents(spark, sf).select(F.concat(above, F.lit("doc_id="), "doc_id", F.lit("/"), leaf).alias("name"), content.alias("content"))
        sinks.write_files(rows, folder)
        _FOLDERS[known] = folder
    return _FOLDERS[known]


_CP949_BYTES = len(_CP949.encode("cp949"))


@register(
    "scanned_files",
    f"SELECT doc_id, CASE doc_id % 25 WHEN 2 THEN 0 WHEN 3 THEN {_CP949_BYTES} + length(doc_id::VARCHAR) WHEN 4 THEN 1 + strlen(coalesce(text, '')) "
    "ELSE strlen(coalesce(text, '')) END::BIGINT AS length FROM documents WHERE doc_id % 25 <> 5",
)
def scanned_files(spark, sf):
    found = S.list_files(spark, mixed_files(spark, sf), [" TXT", ""], hidden=True)
    return found.select(doc_of("path"), "length")


@register("decoded_texts", "SELECT doc_id, text FROM documents")
def decoded_texts(spark, sf):
    """Two thirds of the corpus as Latin-1 bytes, which are not valid UTF-8 wherever it matters."""
    latin = F.when(F.col("doc_id") % 3 != 0, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    raw = documents(spark, sf).select("doc_id", latin.alias("content"))
    decoded = raw.select("doc_id", S.decode(F.col("content"), ("utf-8", "latin-1")).alias("d"))
    return decoded.select("doc_id", "d.text")


@register(
    "admitted_files",
    f"WITH f AS (SELECT doc_id, doc_id % 25 AS kind, CASE doc_id % 25 WHEN 2 THEN '' WHEN 3 THEN '{_CP949}' || doc_id ELSE coalesce(text, '') END AS t "
    "FROM documents WHERE doc_id % 25 <> 5), n AS (SELECT doc_id, t, CASE WHEN kind = 4 THEN 'decode failed: ''cp949'' codec can''t decode byte 0xff in "
    "position 0: illegal multibyte sequence' WHEN trim(t, ' \t\n\r') = '' THEN 'empty file' END AS note FROM f) "
    "SELECT doc_id, CASE WHEN note IS NULL THEN t ELSE '' END AS text, note FROM n",
)
def admitted_files(spark, sf):
    """Every kind of file is reported: with its text, or with why it has none."""
    files = S.scan_files(spark, mixed_files(spark, sf), hidden=True)
    return S.admit_files(files, include_empty=False).select(doc_of("path"), "text", "note")


@register("json_sink", "SELECT doc_id, lang, text FROM documents")
def json_sink(spark, sf):
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/json-{uuid.uuid4().hex}"
    rows = documents(spark, sf).select("doc_id", F.struct("lang", "text").alias("body"))
    sinks.write_json(rows, folder)
    back = spark.read.schema("doc_id bigint, body struct<lang:string,text:string>").json(folder)
    return back.select("doc_id", "body.lang", "body.text")


@register(
    "summarized_files",
    O.document_results(sizes(DEFAULT)) + "SELECT doc_id, 'file-' || row_number() OVER (ORDER BY doc_id::VARCHAR || '/')::VARCHAR AS file_id, "
    "status, short AS short_summary, n_chunks::INT AS sentence_count, n_blocks::INT AS chunk_count, (bytes + 1)::BIGINT AS text_bytes FROM result",
)
def summarized_files(spark, sf):
    found = PF.summarize_files(spark, document_files(spark, sf), HASHED, tie_digits=TIE_DIGITS)
    return found.select(doc_of("path"), "file_id", "status", "short_summary", "raw_features.*")


@register(
    "embedded_file_segments",
    _SEGMENTS + f"SELECT doc_id, 'OK' AS status, segment_count, position AS index, t AS text, {O.DIM} AS vector_length FROM c JOIN n USING (doc_id)",
)
def embedded_file_segments(spark, sf):
    found = PF.embed_file_segments(spark, document_files(spark, sf), HASHED)
    return found.select(doc_of("source_path"), "status", "segment_count", F.inline("segments"))


_FILE_TEXT = "CASE WHEN doc_id % 25 = 3 THEN ' ' ELSE text END"
# The path orders the files, and so numbers their groups.
_FILE_GROUPS = O.density_labels(
    f"SELECT 'doc_id=' || doc_id AS id, {O.embed(_FILE_TEXT)} AS v FROM documents "
    f"WHERE doc_id % 25 <> 3 AND text IS NOT NULL AND strlen(text) = length(text) AND trim(text, ' \t\n\r') <> ''",
    3, 3, TIE_DIGITS,
)


@register(
    "grouped_files",
    f"WITH {_FILE_GROUPS} SELECT doc_id, coalesce(label, -1) AS cluster_label, "
    f"CASE WHEN strlen({_FILE_TEXT}) > length({_FILE_TEXT}) THEN 'undecodable' WHEN label IS NULL THEN 'empty' END AS note "
    "FROM documents LEFT JOIN labels ON id = 'doc_id=' || doc_id",
)
def grouped_files(spark, sf):
    """Files read as ASCII: those with other characters cannot be decoded, and some are blank."""
    folder = document_files(spark, sf, F.when(F.col("doc_id") % 25 == 3, " ").otherwise(F.col("text")))
    found = PF.group_files(spark, folder, HASHED, encodings=["ascii"], min_cluster_size=3, tie_digits=TIE_DIGITS)
    kind = F.when(F.col("note").startswith(S.NOTE_DECODE_FAILED), "undecodable").when(F.col("note") == S.NOTE_EMPTY, "empty")
    return found.select(doc_of("path"), "cluster_label", kind.alias("note"))
