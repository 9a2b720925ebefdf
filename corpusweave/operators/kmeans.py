"""Deterministic K-means, one run per key, for all keys at once.

``k`` follows from the number of vectors of a key, the first ``k`` vectors are the initial
centroids, ties go to the lower cluster and an empty cluster falls back to an initial vector, so a
run has one result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from corpusweave import params
from corpusweave.functions.text import let
from corpusweave.functions.vectors import as_doubles, squared_distance
from corpusweave.lineage import cut
from corpusweave.operators.joins import join_per_key

# A key with more numbers than this (64 MB of doubles) is clustered by joins, not in one task.
MAX_GROUP_VALUES = 8_000_000
# Differences between vectors and centroids held at a time within a task.
MAX_GAP_VALUES = 1_000_000
# Numbers of the vectors that a round of joins holds in one row.
PACKED_VALUES = 32_768
# Keys that Arrow tells apart as Spark does.
PLAIN_KEYS = frozenset(
    "boolean tinyint smallint int bigint string binary date timestamp timestamp_ntz".split()
)


def cluster_count(n: Column, max_clusters: int = params.MAX_CLUSTERS) -> Column:
    """``min(max_clusters, ceil(sqrt(n)), n)``, at least 1."""
    params.positive_int("max_clusters", max_clusters)
    return F.least(
        F.lit(max_clusters), F.greatest(F.lit(1), F.ceil(F.sqrt(n))), n
    ).cast("int")


def split_by_path(
    df: DataFrame, keys: Sequence[str], min_sentences: int = params.MIN_SENTENCES
) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that are sampled and rows of keys that are clustered, each with its ``n``."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    spread_by = next((c for c in df.columns if c not in keys), keys[0])
    counted = join_per_key(df, sizes, keys, spread_by=spread_by, row_bytes=F.lit(64))
    return counted.filter(F.col("n") < min_sentences), counted.filter(F.col("n") >= min_sentences)


def initial_centroids(
    df: DataFrame,
    keys: Sequence[str],
    *,
    index: str = "chunk_index",
    vector: str = "embedding",
    max_clusters: int = params.MAX_CLUSTERS,
) -> DataFrame:
    """The first ``k`` vectors of each key. ``index`` counts from 0 within a key."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    head = df.filter(F.col(index) < max_clusters).select(
        *keys, F.col(index).cast("int").alias("cluster_id"), as_doubles(F.col(vector)).alias("centroid")
    )
    return (
        head.join(sizes, list(keys))
        .filter(F.col("cluster_id") < cluster_count(F.col("n"), max_clusters))
        .drop("n")
    )


def nearest(vector: Column, centroids: Column, tie_digits: int | None = None) -> Column:
    """Struct ``(distance, cluster_id)`` of the nearest of an array of centroids."""

    def scored(centroid: Column, at: Column) -> Column:
        distance = squared_distance(vector, centroid)
        if tie_digits is not None:
            distance = F.round(distance, tie_digits)
        return F.struct(distance.alias("distance"), at.alias("cluster_id"))

    return F.array_min(F.transform(centroids, scored))


def assign(
    df: DataFrame,
    centroids: DataFrame,
    keys: Sequence[str],
    *,
    index: str = "chunk_index",
    vector: str = "embedding",
    tie_digits: int | None = None,
) -> DataFrame:
    """Add ``cluster_id`` and ``distance`` of the nearest centroid of the row's key."""
    lists = centroids.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("cluster_id", "centroid"))).alias("_c")
    )
    best = nearest(F.col(vector), F.col("_c.centroid"), tie_digits)
    row_bytes = 8 * F.size("_c") * F.size(F.element_at("_c.centroid", 1))
    return (
        join_per_key(df, lists, keys, spread_by=index, row_bytes=row_bytes)
        .withColumn("_best", best)
        .withColumn("cluster_id", F.element_at("_c.cluster_id", F.col("_best.cluster_id") + 1))
        .withColumn("distance", F.col("_best.distance"))
        .drop("_c", "_best")
    )


def update_centroids(
    assigned: DataFrame,
    initial: DataFrame,
    keys: Sequence[str],
    *,
    vector: str = "embedding",
) -> DataFrame:
    """Member means; a cluster without members takes the vector it started from.

    Cluster ``c`` starts from vector ``c`` and ``c < k <= n``, so that vector is number ``c % n``.
    """
    elements = assigned.select(*keys, "cluster_id", F.posexplode(vector).alias("_i", "_x"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_x")))
    means = (
        elements.groupBy(*keys, "cluster_id", "_i")
        .agg(F.avg(F.col("_x").cast("double")).alias("_x"))
        .groupBy(*keys, "cluster_id")
        .agg(F.transform(ordered, lambda e: e["_x"]).alias("_mean"))
    )
    return initial.join(means, [*keys, "cluster_id"], "left").select(
        *keys, "cluster_id", F.coalesce("_mean", "centroid").alias("centroid")
    )


def kmeans(
    df: DataFrame,
    keys: Sequence[str],
    *,
    index: str = "chunk_index",
    vector: str = "embedding",
    carry: Sequence[str] = (),
    max_clusters: int = params.MAX_CLUSTERS,
    rounds: int = params.KMEANS_ROUNDS,
    tie_digits: int | None = None,
    max_group_values: int = MAX_GROUP_VALUES,
) -> DataFrame:
    """Cluster the vectors of every key.

    One row per input row: keys, ``index``, the ``carry`` columns, ``cluster_id`` and the squared
    ``distance`` to the final centroid of that cluster. ``index`` counts from 0 within a key.

    A key of up to ``max_group_values`` numbers is clustered in one pass within one task, at the
    price of a single shuffle; larger keys go through :func:`kmeans_by_joins`.
    """
    keys = list(keys)
    df = cut(df.select(*keys, index, *carry, vector))  # sizes, groups and joins all read it
    sizes = df.groupBy(*keys).agg(F.sum(F.size(vector)).alias("_values"))
    large = sizes.filter(F.col("_values") > max_group_values).select(*keys)
    settings = dict(
        index=index, vector=vector, carry=carry, max_clusters=max_clusters, rounds=rounds,
        tie_digits=tie_digits,
    )
    n_large = large.count()
    if not n_large:
        return explode_runs(kmeans_in_groups(df, keys, **settings), index, carry)
    # The keys that are large are the hot ones: they must not be brought together to be told apart.
    large = cut(large.withColumn("_large", F.lit(True)))
    marked = join_per_key(df, large, keys, spread_by=index, row_bytes=F.lit(64), how="left")
    small_rows = marked.filter(F.col("_large").isNull()).drop("_large")
    large_rows = marked.filter("_large").drop("_large")
    grouped = explode_runs(kmeans_in_groups(small_rows, keys, **settings), index, carry)
    return grouped.unionByName(kmeans_by_joins(large_rows, keys, **settings))


def explode_runs(runs: DataFrame, index: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per vector from the one row per key of :func:`kmeans_in_groups`."""
    lists = [index, *carry, "cluster_id", "distance"]
    rest = [c for c in runs.columns if c not in lists]
    return runs.select(*rest, F.inline(F.arrays_zip(*lists)))


def kmeans_in_groups(
    df: DataFrame,
    keys: Sequence[str],
    *,
    index: str = "chunk_index",
    vector: str = "embedding",
    carry: Sequence[str] = (),
    max_clusters: int = params.MAX_CLUSTERS,
    rounds: int = params.KMEANS_ROUNDS,
    tie_digits: int | None = None,
    allow_null_vectors: bool = False,
) -> DataFrame:
    """One row per key, with ``index``, ``carry``, ``cluster_id`` and ``distance`` as arrays in
    index order. The caller answers for the size of a key.

    A null vector fails the job, or with ``allow_null_vectors`` gives its key null clusters.
    """
    params.positive_int("max_clusters", max_clusters)
    params.positive_int("rounds", rounds)
    keys, lists = list(keys), [index, *carry]
    types = df.select(*keys, *lists).schema
    output = St.StructType(
        [types[k] for k in keys]
        + [St.StructField(c, St.ArrayType(types[c].dataType)) for c in lists]
        + [
            St.StructField("cluster_id", St.ArrayType(St.IntegerType())),
            St.StructField("distance", St.ArrayType(St.DoubleType())),
        ]
    )
    run = _groups_runner(
        keys, vector, lists, max_clusters, rounds, tie_digits, allow_null_vectors
    )
    rows = df.select(*keys, *lists, as_doubles(F.col(vector)).alias(vector))
    if keys and all(types[k].dataType.simpleString() in PLAIN_KEYS for k in keys):
        # Many small keys share a batch: a call for each would cost more than its clusters.
        in_order = rows.repartition(*keys).sortWithinPartitions(*keys, F.col(index).asc_nulls_last())
        return in_order.mapInArrow(_over_batches(run, keys), output)

    def one_group(group: pa.Table) -> pa.Table:
        rows = group.sort_by(index).combine_chunks()
        return pa.Table.from_batches([run(rows.to_batches()[0], np.array([0, len(rows)]))])

    return rows.groupBy(*keys).applyInArrow(one_group, output)


def _key_changes(batch: pa.RecordBatch, keys: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Positions of the rows whose key is not that of the row before; ``last`` is the row before the first."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    for key in keys:
        column = batch.column(key)
        first = column.slice(0, 1) if last is None else last.column(key)
        before = pa.concat_arrays([first, column.slice(0, len(column) - 1)])
        changed |= pc.fill_null(pc.not_equal(column, before), False).to_numpy(zero_copy_only=False)
        changed |= pc.xor(column.is_null(), before.is_null()).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def _over_batches(run: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], keys: list[str]) -> Callable:
    """Hand whole keys to ``run``, from rows in the order of their keys; the last key of a batch waits for the next."""

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return run(rows, np.r_[0, _key_changes(rows, keys, None), rows.num_rows])

    def over(batches):
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            changes = _key_changes(batch, keys, open_[-1].slice(open_[-1].num_rows - 1) if open_ else None)
            if len(changes):
                yield whole([*open_, batch.slice(0, changes[-1])])
                open_ = [batch.slice(changes[-1])]
            else:
                open_.append(batch)
        if open_:
            yield whole(open_)

    return over


def _groups_runner(
    keys: list[str],
    vector: str,
    lists: list[str],
    max_clusters: int,
    rounds: int,
    tie_digits: int | None,
    allow_null_vectors: bool,
) -> Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]:
    """Clusters of the keys between the ``bounds`` of a batch, one row per key."""

    def run(rows: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        column = rows.column(vector)
        offsets, missing = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        sizes, numbers = np.diff(offsets), column.values
        clusters, distances, without = [np.zeros(0, np.int32)], [np.zeros(0)], np.zeros(len(bounds) - 1, dtype=bool)
        for at, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if missing[lo:hi].any():
                if not allow_null_vectors:
                    raise ValueError(f"{vector} is null in some rows")
                without[at] = True
                continue
            if (sizes[lo:hi] != sizes[lo]).any():
                raise ValueError("vectors differ in length")
            points = numbers.slice(offsets[lo], offsets[hi] - offsets[lo]).to_numpy().reshape(hi - lo, sizes[lo])
            found = _lloyd(points, max_clusters, rounds, tie_digits)
            clusters.append(found[0])
            distances.append(found[1])
        values = {k: rows.column(k).take(pa.array(bounds[:-1])) for k in keys}
        for name in lists:
            values[name] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows.column(name))
        ends = pa.array(np.r_[0, np.cumsum(np.where(without, 0, np.diff(bounds)))], pa.int32())
        for name, parts, kind in (("cluster_id", clusters, pa.int32()), ("distance", distances, pa.float64())):
            values[name] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind), mask=pa.array(without))
        return pa.RecordBatch.from_pydict(values)

    return run


def _distances(points: np.ndarray, centroids: np.ndarray, digits: int | None) -> np.ndarray:
    """Squared distances, summed element by element in order so that ties fall as they would in a
    plain loop; numpy's own sum along rows pairs terms up and differs in the last bits."""
    total = np.empty((len(points), len(centroids)))
    step = max(1, MAX_GAP_VALUES // max(1, centroids.size))
    for lo in range(0, len(points), step):
        gap = points[lo : lo + step].T[:, :, None] - centroids.T[:, None, :]
        gap *= gap
        # Along the first axis whole slices are added one after the other.
        np.add.reduce(gap, axis=0, out=total[lo : lo + step])
    return total if digits is None else np.round(total, digits)


def _lloyd(
    points: np.ndarray, max_clusters: int, rounds: int, digits: int | None
) -> tuple[np.ndarray, np.ndarray]:
    n, dim = points.shape
    k = min(max_clusters, max(1, int(np.ceil(np.sqrt(n)))), n)
    first = points[:k].copy()
    centroids = first
    clusters = np.zeros(n, dtype=np.int32)
    for _ in range(rounds):
        chosen = _distances(points, centroids, digits).argmin(axis=1).astype(np.int32)
        if (chosen == clusters).all():
            break
        clusters = chosen
        # Weights are added in the order of the rows: again the order of a plain loop.
        at = (clusters[:, None].astype(np.int64) * dim + np.arange(dim)).ravel()
        sums = np.bincount(at, points.ravel(), k * dim).reshape(k, dim)
        members = np.bincount(clusters, minlength=k)[:, None]
        centroids = np.where(members > 0, sums / np.maximum(members, 1), first)
    return clusters, _distances(points, centroids, digits)[np.arange(n), clusters]


def kmeans_by_joins(
    df: DataFrame,
    keys: Sequence[str],
    *,
    index: str = "chunk_index",
    vector: str = "embedding",
    carry: Sequence[str] = (),
    max_clusters: int = params.MAX_CLUSTERS,
    rounds: int = params.KMEANS_ROUNDS,
    tie_digits: int | None = None,
) -> DataFrame:
    """K-means as joins and aggregations, for keys of any size.

    The loop carries centroids only: one row per key with the centroids of this round and of the
    round before; the vectors are written once, many of a key to a row of bounded size. Assignments are recomputed from
    them, so a vector is never shuffled with its state, a round shuffles one partial sum per such row and cluster, and a
    key may be spread over all tasks.
    """
    params.positive_int("max_clusters", max_clusters)
    keys = list(keys)
    rows = cut(df.select(*keys, index, *carry, as_doubles(F.col(vector)).alias(vector)))
    first = initial_centroids(
        rows, keys, index=index, vector=vector, max_clusters=max_clusters
    )
    in_order = F.transform(
        F.sort_array(F.collect_list(F.struct("cluster_id", "centroid"))), lambda c: c["centroid"]
    )
    none = F.lit(None).cast("array<array<double>>")
    state = cut(
        first.groupBy(*keys).agg(in_order.alias("start")).select(
            *keys, "start", F.col("start").alias("now"), none.alias("before"), F.lit(False).alias("done")
        )
    )
    packed = _packed(rows, keys, index, vector)
    for _ in range(rounds):
        active = state.filter(~F.col("done"))
        if active.isEmpty():
            break
        state = cut(
            state.filter("done").unionByName(
                _next_centroids(packed, active, keys, tie_digits)
            )
        )
    # A finished key keeps the centroids its last assignment was made from. A key that ran out of
    # rounds was assigned by the centroids before the last update and is measured by those after.
    placed = _with_state(rows, state, keys, index).withColumn(
        "cluster_id",
        nearest(
            F.col(vector), F.when(F.col("done"), F.col("now")).otherwise(F.col("before")), tie_digits
        )["cluster_id"],
    )
    distance = squared_distance(F.col(vector), F.element_at("now", F.col("cluster_id") + 1))
    return placed.select(
        *keys,
        index,
        *carry,
        "cluster_id",
        (distance if tie_digits is None else F.round(distance, tie_digits)).alias("distance"),
    )


def _with_state(
    rows: DataFrame, state: DataFrame, keys: list[str], index: str
) -> DataFrame:
    """Join every vector with the state of its key: three lists of centroids."""
    numbers = 3 * F.size("now") * F.size(F.element_at("now", 1))
    return join_per_key(rows, state, keys, spread_by=index, row_bytes=8 * numbers)


def _packed(rows: DataFrame, keys: list[str], index: str, vector: str) -> DataFrame:
    """``keys, _part, _vectors``: the vectors of a key in parts of about ``PACKED_VALUES`` numbers."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.sum(F.size(vector)) / PACKED_VALUES).cast("int").alias("_parts"))
    counted = join_per_key(rows, parts, keys, spread_by=index, row_bytes=F.lit(64))
    part = F.pmod(F.xxhash64(index), F.greatest("_parts", F.lit(1))).cast("int")
    return cut(
        counted.select(*keys, part.alias("_part"), vector)
        .groupBy(*keys, "_part")
        .agg(F.collect_list(vector).alias("_vectors"))
        .filter(F.size("_vectors") > 0)
    )


def _partial_sums(keys: list[str], tie_digits: int | None) -> Callable:
    """Per row of vectors and cluster: the sum, the count, and whether a vector came from another cluster."""

    def matrix(lists: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        """Vectors, and which of their numbers are null."""
        known = lists.values.drop_null()
        sizes = set(pc.list_value_length(known).to_pylist())
        if len(sizes) > 1:
            raise ValueError("vectors differ in length")
        there, shape = lists.values.is_valid().to_numpy(zero_copy_only=False), (len(known), sizes.pop() if sizes else 0)
        values, missing = np.full((len(there), shape[1]), np.nan), np.ones((len(there), shape[1]), dtype=bool)
        values[there] = known.flatten().to_numpy(zero_copy_only=False).reshape(shape)
        missing[there] = known.flatten().is_null().to_numpy(zero_copy_only=False).reshape(shape)
        return values, missing

    def chosen(points: np.ndarray, holed: np.ndarray, lists: pa.ListScalar) -> np.ndarray:
        centroids, missing = matrix(lists)
        # As in an expression, a null distance comes before all others and NaN after them.
        null = missing.any(axis=1) | (centroids.shape[1] == 0)
        distance = np.full((len(points), len(centroids)), -np.inf)
        if not null.all():
            if centroids.shape[1] != points.shape[1]:
                raise ValueError("vectors differ in length")
            measured = _distances(points, centroids[~null], tie_digits)
            distance[:, ~null] = np.where(np.isnan(measured), np.inf, measured)
            distance[holed] = -np.inf
        return distance.argmin(axis=1)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                points, missing = matrix(batch.column("_vectors")[at])
                holed = missing.any(axis=1)
                now = chosen(points, holed, batch.column("now")[at])
                was = chosen(points, holed, batch.column("before")[at]) if batch.column("before")[at].is_valid else np.zeros_like(now)
                clusters, place = np.unique(now, return_inverse=True)
                dim = points.shape[1]
                spots = (place[:, None] * dim + np.arange(dim)).ravel()
                sums = np.bincount(spots, np.where(missing, 0.0, points).ravel(), len(clusters) * dim).reshape(-1, dim)
                counts = np.bincount(spots, ~missing.ravel(), len(clusters) * dim).astype(np.int64).reshape(-1, dim)
                values = {k: pa.array([batch.column(k)[at].as_py()] * len(clusters), batch.column(k).type) for k in keys}
                values["cluster_id"] = pa.array(clusters, pa.int32())
                values["_sum"] = pa.array(list(sums), pa.list_(pa.float64()))
                values["_n"] = pa.array(list(counts), pa.list_(pa.int64()))
                values["_moved"] = pa.array(np.bincount(place, now != was, len(clusters)) > 0).cast(pa.int32())
                yield pa.RecordBatch.from_pydict(values)

    return run


def _next_centroids(packed: DataFrame, active: DataFrame, keys: list[str], tie_digits: int | None) -> DataFrame:
    joined = _with_state(packed, active, keys, "_part").select(*keys, "_vectors", "now", "before")
    schema = St.StructType(
        [joined.schema[k] for k in keys]
        + [
            St.StructField("cluster_id", St.IntegerType()),
            St.StructField("_sum", St.ArrayType(St.DoubleType())),
            St.StructField("_n", St.ArrayType(St.LongType())),
            St.StructField("_moved", St.IntegerType()),
        ]
    )
    sums = (
        joined.mapInArrow(_partial_sums(keys, tie_digits), schema)
        .select(*keys, "cluster_id", "_moved", F.posexplode(F.arrays_zip("_sum", "_n")).alias("_i", "_x"))
        .groupBy(*keys, "cluster_id", "_i")
        .agg(F.try_divide(F.sum("_x._sum"), F.sum("_x._n")).alias("_x"), F.max("_moved").alias("_moved"))
    )
    means = sums.groupBy(*keys, "cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("_mean"),
        F.max("_moved").alias("_moved"),
    )
    found = means.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("cluster_id", "_mean"))).alias("_means"),
        (F.max("_moved") > 0).alias("_changed"),
    )
    updated = let(
        F.col("_means"),
        lambda means: F.transform(
            F.col("start"), lambda origin, c: F.coalesce(F.element_at(means, c), origin)
        ),
    )
    # Whether anything moved is asked before the update: an unchanged key keeps its centroids.
    return active.join(found, keys).select(
        *keys,
        "start",
        F.when(F.col("_changed"), updated).otherwise(F.col("now")).alias("now"),
        F.when(F.col("_changed"), F.col("now")).otherwise(F.col("before")).alias("before"),
        (~F.col("_changed")).alias("done"),
    )


def sampled_indices(n: Column, max_clusters: int = params.MAX_CLUSTERS) -> Column:
    """``min(n, max_clusters)`` evenly spaced indices from 0 to ``n - 1``, halves rounded to even."""
    params.positive_int("max_clusters", max_clusters)
    target = F.least(n, F.lit(max_clusters))
    step = (n - 1) / F.greatest(target - 1, F.lit(1))
    spaced = F.transform(
        F.sequence(F.lit(0), F.greatest(target, F.lit(1)) - 1), lambda i: F.rint(i * step).cast("int")
    )
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(spaced)


def sample_clusters(
    df: DataFrame,
    keys: Sequence[str],
    *,
    index: str = "chunk_index",
    text: str = "chunk",
    max_clusters: int = params.MAX_CLUSTERS,
) -> DataFrame:
    """Evenly spaced rows of each key, every one a cluster of its own."""
    sizes = df.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    picks = sizes.select(
        *keys, F.posexplode(sampled_indices(F.col("n"), max_clusters)).alias("cluster_id", index)
    )
    kept = df.select(*keys, F.col(index).cast("int").alias(index), text)
    return kept.join(picks, [*keys, index]).select(
        *keys,
        "cluster_id",
        F.col(index).alias("representative_index"),
        F.col(text).alias("representative_sentence"),
        F.array(index).alias("member_indices"),
        F.array(text).alias("representative_sentences"),
    )
