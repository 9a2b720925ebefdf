"""Operators over tables of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions import text as T
from corpusweave.functions.embedding import Embedder


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean per key. Partial sums are formed before the shuffle, so a key that holds a
    large share of the rows costs no more there than any other."""
    elements = df.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = elements.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return _dense(means, keys, "_x", "mean")


def masked_mean_pool(
    df: DataFrame, keys: Sequence[str], vector: str = "vec", mask: str = "mask"
) -> DataFrame:
    """Token vectors of a key, summed under their mask and divided by the mask count (at least 1)."""
    elements = df.select(*keys, F.col(mask).alias("_m"), F.posexplode(vector).alias("_i", "_x"))
    pooled = elements.groupBy(*keys, "_i").agg(
        (
            F.sum(F.col("_x").cast("double") * F.col("_m"))
            / F.greatest(F.sum("_m"), F.lit(1)).cast("double")
        ).alias("_x")
    )
    return _dense(pooled, keys, "_x", "pooled")


def _dense(elements: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("_i", value)))
    return elements.groupBy(*keys).agg(F.transform(ordered, lambda e: e[value]).alias(name))


def split_embeddable(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows whose text can be embedded, and the rows that are null or blank."""
    blank = F.col(text).isNull() | T.is_blank(F.col(text))
    return df.filter(~blank), df.filter(blank)


def require_embeddable(text: Column) -> Column:
    """The text itself; a null or blank text fails the job."""
    blank = text.isNull() | T.is_blank(text)
    return F.when(~blank, text).otherwise(
        F.raise_error(F.lit("a blank text cannot be embedded")).cast("string")
    )


def embed_column(
    df: DataFrame, embedder: Embedder, text: str = "text", output: str = "embedding"
) -> DataFrame:
    return df.withColumn(output, embedder.embed(F.col(text)))


def segment_payload(
    df: DataFrame,
    key: str,
    model_name: str,
    *,
    index: str = "chunk_index",
    text: str = "chunk",
    vector: str = "embedding",
) -> DataFrame:
    """One row per source: model name, segment count and its segments in order."""
    segment = F.struct(
        F.col(index).alias("index"),
        F.col(text).alias("text"),
        F.col(vector).alias("vector"),
        F.size(vector).alias("vector_length"),
    )
    return df.groupBy(F.col(key).alias("source_path")).agg(
        F.lit(model_name).alias("model_name"),
        F.count("*").cast("int").alias("segment_count"),
        F.sort_array(F.collect_list(segment)).alias("segments"),
    )


def redact_vectors(payload: DataFrame) -> DataFrame:
    """The payload without its vectors; their lengths stay."""
    return payload.withColumn(
        "segments", F.transform("segments", lambda s: s.dropFields("vector"))
    )
