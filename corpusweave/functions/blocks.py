"""Representative blocks of one document as expressions over its arrays.

A document is bounded by the size limit, so once its clusters are known as arrays in its own row
the rest needs no shuffle. :mod:`corpusweave.operators.representatives` does the same over tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave import params
from corpusweave.functions import text as T
from corpusweave.functions.text import let
from corpusweave.operators.kmeans import sampled_indices

BLOCK_TYPE = (
    "struct<cluster_id:int,representative_index:int,representative_sentence:string,"
    "representative_sentences:array<string>,member_indices:array<int>>"
)


def _block(cluster_id: Column, indices: Column, texts: Column, members: Column) -> Column:
    return F.struct(
        cluster_id.alias("cluster_id"),
        F.get(indices, 0).alias("representative_index"),
        F.get(texts, 0).alias("representative_sentence"),
        texts.alias("representative_sentences"),
        members.alias("member_indices"),
    )


def sampled_blocks(chunks: Column, max_clusters: int = params.MAX_CLUSTERS) -> Column:
    """Evenly spaced chunks, each a block of its own."""
    return F.transform(
        sampled_indices(F.size(chunks), max_clusters),
        lambda at, c: _block(c, F.array(at), F.array(F.element_at(chunks, at + 1)), F.array(at)),
    )


def clustered_blocks(
    index: Column,
    chunk: Column,
    cluster_id: Column,
    distance: Column,
    settings: params.ClusterSettings = params.ClusterSettings(),
) -> Column:
    """Blocks of a clustered document from four arrays of equal length."""
    members = F.zip_with(
        F.arrays_zip(cluster_id.alias("c"), distance.alias("d")),
        F.arrays_zip(index.alias("i"), chunk.alias("t")),
        # The order of the fields is the order of the ranking.
        lambda a, b: F.struct(
            a["c"].alias("c"), a["d"].alias("d"), F.length(b["t"]).alias("n"), b["i"].cast("int").alias("i"),
            b["t"].alias("t"),
        ),
    )
    clusters = let(
        F.array_sort(members),
        lambda ranked: F.transform(
            F.sequence(F.lit(0), F.lit(settings.max_clusters - 1)),
            lambda c: let(F.filter(ranked, lambda m: m["c"] == c), lambda own: _candidate(c, own, settings)),
        ),
    )
    large = F.filter(clusters, lambda c: F.size(c["members"]) >= settings.min_cluster_size_for_output)
    return let(large, lambda found: let(_unique(found), lambda kept: _assembled(found, kept)))


def _candidate(cluster_id: Column, own: Column, settings: params.ClusterSettings) -> Column:
    best = F.element_at(own, 1)["d"]
    limit = max(1.0, settings.representative_distance_ratio)

    def near(member: Column) -> Column:
        gap = F.abs(member["d"] - best)
        close = gap <= F.lit(1e-9) * F.greatest(F.abs(member["d"]), F.abs(best))
        return (member["d"] <= best * limit) | close

    top = F.slice(own, 1, settings.max_representative_sentences)
    return F.struct(
        cluster_id.alias("c"),
        F.sort_array(F.transform(own, lambda m: m["i"])).alias("members"),
        F.when(F.size(own) > 0, F.filter(top, near)).otherwise(top).alias("top"),
    )


def _unique(clusters: Column) -> Column:
    """The first place of every stripped text by cluster size, cluster id and rank."""
    places = F.flatten(
        F.transform(
            clusters,
            lambda c: F.transform(
                c["top"],
                lambda m, rank: F.struct(
                    (-F.size(c["members"])).alias("size"), c["c"].alias("c"), rank.alias("rank"),
                    m["i"].alias("i"), m["t"].alias("t"), T.strip(m["t"]).alias("key"),
                ),
            ),
        )
    )
    in_order = F.array_sort(F.filter(places, lambda p: p["key"] != ""))
    return let(
        in_order,
        lambda all_places: let(
            F.transform(all_places, lambda p: p["key"]),
            lambda texts: F.filter(
                all_places, lambda p, at: F.array_position(texts, p["key"]) == at + 1
            ),
        ),
    )


def _assembled(clusters: Column, kept: Column) -> Column:
    blocks = F.transform(
        clusters,
        lambda c: let(
            F.filter(kept, lambda p: p["c"] == c["c"]),
            lambda own: _block(
                c["c"],
                F.transform(own, lambda p: p["i"]),
                F.transform(own, lambda p: p["t"]),
                c["members"],
            ),
        ),
    )
    return F.filter(blocks, lambda b: F.size(b["representative_sentences"]) > 0)


def cluster_texts(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.array_join(b["representative_sentences"], " "))


def short_summary(blocks: Column) -> Column:
    return F.array_join(F.filter(cluster_texts(blocks), lambda t: t != ""), " / ")


def long_summary(blocks: Column) -> Column:
    return F.nullif(F.array_join(cluster_texts(blocks), "\n"), F.lit(""))
