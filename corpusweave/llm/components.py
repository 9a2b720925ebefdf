"""Connected components by joins: alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.tables import written


def _least_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of edges, an edge from every node to the least node that the batch's edges join it to."""
    for batch in batches:
        ends = np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
        node, place = np.unique(ends, return_inverse=True)
        u, v = np.split(place, 2)
        least = np.arange(len(node))
        while (apart := least[u] != least[v]).any():
            x, y = least[u[apart]], least[v[apart]]
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            while (further := least[least] != least).any():
                least[further] = least[least[further]]
        own = np.flatnonzero(least != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[least[own]])], names=["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al., 2014) over edges with ``a > b``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_low"))
    large = (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("_low").alias("b"))
        .distinct()
    )
    low = large.groupBy("a").agg(F.min("b").alias("_low"))
    return (
        large.join(low, "a")
        .select(F.explode(F.array(F.struct("a", "_low"), F.struct(F.col("b").alias("a"), "_low"))).alias("e"))
        .select(F.col("e.a").alias("a"), F.col("e._low").alias("b"))
        .where("a > b")
        .distinct()
    )


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser one at most, and then none from a greater one."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"))
    )
    wrong = (
        edges.select(F.inline(ends))
        .groupBy("node")
        .agg(F.sum("down").alias("down"), F.min("down").alias("least"))
        .where("down > 1 or (down = 1 and least = 0)")
    )
    return wrong.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of the edges ``a, b`` but the least of its component, which is named.

    Each task first joins what its own edges join, batch by batch, so that the steps begin with at most an
    edge per node and batch. A node of very many edges is fine: its least neighbour is found by partial
    aggregates, and the join on it can be split. Edges from a node to itself, or with a null end, are left
    out; repeated ones count once.
    """
    ends = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    now = written(written(ends).mapInArrow(_least_of_batch, "a long, b long"))
    while not _is_forest_of_stars(now):
        now = written(_stars(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
