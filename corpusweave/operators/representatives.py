"""Representative rows of clusters, as windows and aggregations over a table of members.

Members have the key columns, ``cluster_id``, an index, a text and the squared ``distance`` to the
centroid of their cluster. The ``k`` best of a cluster are cut off before the shuffle (Spark plans
``WindowGroupLimit`` for a row number compared with a constant), so a hot cluster is never brought
together in one task; everything after that sees at most ``k`` rows per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave import params
from corpusweave.functions import text as T
from corpusweave.lineage import cut
from corpusweave.operators.joins import join_per_key


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b))


def cluster_sizes(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return members.groupBy(*keys, "cluster_id").agg(F.count("*").alias("cluster_size"))


def drop_small_clusters(
    members: DataFrame,
    keys: Sequence[str],
    min_size: int = params.MIN_CLUSTER_SIZE_FOR_OUTPUT,
    *,
    index: str = "chunk_index",
) -> DataFrame:
    """Members of clusters with at least ``min_size`` members, with their ``cluster_size``."""
    params.positive_int("min_size", min_size)
    members = cut(members)
    sizes = cluster_sizes(members, keys).filter(F.col("cluster_size") >= min_size)
    return join_per_key(
        members, sizes, [*keys, "cluster_id"], spread_by=index, row_bytes=F.lit(64)
    )


def _rank(keys: Sequence[str], index: str, text: str) -> Column:
    order = Window.partitionBy(*keys, "cluster_id").orderBy("distance", F.length(text), index)
    return F.row_number().over(order)


def rank_members(
    members: DataFrame, keys: Sequence[str], *, index: str = "chunk_index", text: str = "chunk"
) -> DataFrame:
    """Every member with its ``rank`` by distance, then text length, then index.

    This ranks whole clusters; to keep only the best, use :func:`top_members`.
    """
    return members.withColumn("rank", _rank(keys, index, text))


def top_members(
    members: DataFrame,
    keys: Sequence[str],
    k: int = params.MAX_REPRESENTATIVE_SENTENCES,
    *,
    index: str = "chunk_index",
    text: str = "chunk",
) -> DataFrame:
    params.positive_int("k", k)
    return rank_members(members, keys, index=index, text=text).filter(F.col("rank") <= k)


def within_ratio(
    ranked: DataFrame, keys: Sequence[str], ratio: float = params.REPRESENTATIVE_DISTANCE_RATIO
) -> DataFrame:
    """Members at most ``ratio`` times as far from the centroid as the best one.

    This keeps the first few ranks of a cluster, so it may follow :func:`top_members`.
    """
    limit = max(1.0, params.positive_number("ratio", ratio))
    best = F.min("distance").over(Window.partitionBy(*keys, "cluster_id"))
    return (
        ranked.withColumn("_best", best)
        .filter((F.col("distance") <= F.col("_best") * limit) | close_to(F.col("distance"), F.col("_best")))
        .drop("_best")
    )


def unique_texts(
    ranked: DataFrame, keys: Sequence[str], *, text: str = "chunk"
) -> DataFrame:
    """A stripped text stands for one cluster of a key only: the larger, then the lower id, then
    the better rank. Blank texts are dropped. Expects ``cluster_size`` and ``rank``."""
    order = Window.partitionBy(*keys, "_text").orderBy(F.desc("cluster_size"), "cluster_id", "rank")
    return (
        ranked.withColumn("_text", T.strip(F.col(text)))
        .filter(F.col("_text") != "")
        .withColumn("_seen", F.row_number().over(order))
        .filter(F.col("_seen") == 1)
        .drop("_text", "_seen")
    )


def cluster_members(
    members: DataFrame, keys: Sequence[str], *, index: str = "chunk_index"
) -> DataFrame:
    return members.groupBy(*keys, "cluster_id").agg(
        F.sort_array(F.collect_list(F.col(index).cast("int"))).alias("member_indices"),
        F.count("*").alias("cluster_size"),
    )


def representative_clusters(
    members: DataFrame,
    keys: Sequence[str],
    settings: params.ClusterSettings = params.ClusterSettings(),
    *,
    index: str = "chunk_index",
    text: str = "chunk",
) -> DataFrame:
    """One row per cluster that has representatives: the first of them, all of them in rank order,
    and the indices of all members."""
    group = [*keys, "cluster_id"]
    members = cut(members)
    top = within_ratio(
        top_members(members, keys, settings.max_representative_sentences, index=index, text=text),
        keys,
        settings.representative_distance_ratio,
    )
    sized = cluster_members(members, keys, index=index).filter(
        F.col("cluster_size") >= settings.min_cluster_size_for_output
    )
    kept = unique_texts(top.join(sized.select(*group, "cluster_size"), group), keys, text=text)
    ordered = F.sort_array(
        F.collect_list(F.struct("rank", F.col(index).cast("int").alias("at"), F.col(text).alias("text")))
    )
    chosen = kept.groupBy(*group).agg(ordered.alias("_r"))
    return chosen.join(sized, group).select(
        *group,
        F.element_at("_r.at", 1).alias("representative_index"),
        F.element_at("_r.text", 1).alias("representative_sentence"),
        "member_indices",
        F.col("_r.text").alias("representative_sentences"),
    )


def expand_context(
    representatives: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    *,
    before: int = params.SENTENCES_BEFORE,
    after: int = params.SENTENCES_AFTER,
    index: str = "chunk_index",
    text: str = "chunk",
    group: str = "cluster_id",
) -> DataFrame:
    """Each representative with the texts up to ``before`` and ``after`` places around it.

    The neighbourhood is listed first, which turns the range condition into an equi-join.
    """
    params.non_negative_int("before", before)
    params.non_negative_int("after", after)
    at = F.col("representative_index")
    wanted = representatives.select(
        *keys, group, at, F.explode(F.sequence(at - before, at + after)).alias(index)
    )
    return (
        wanted.join(rows.select(*keys, index, text), [*keys, index])
        .groupBy(*keys, group, "representative_index")
        .agg(F.sort_array(F.collect_list(F.struct(index, text))).alias("_around"))
        .select(
            *keys,
            group,
            "representative_index",
            F.col(f"_around.{index}").alias("context_indices"),
            F.array_join(f"_around.{text}", " ").alias("context"),
        )
    )
