import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusweave.operators import kmeans as K
from tests.naive import lloyd

SCHEMA = "doc_id long, chunk_index int, embedding array<double>"


def table(spark, docs):
    rows = [(d, i, [float(x) for x in v]) for d, vs in docs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


def runs(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["chunk_index"]):
        where, gaps = out.setdefault(r["doc_id"], ([], []))
        where.append(r["cluster_id"])
        gaps.append(r["distance"])
    return out


@pytest.mark.parametrize("limit", [10**6, 1, 6])
def test_known_cases_by_either_path(spark, limit):
    docs = {
        1: [[0], [1], [2], [3]],  # two clusters of neighbours
        2: [[0], [0], [1]],  # round one moves nothing: the first centroid stays at 0
        3: [[0], [2], [1], [0]],  # the middle point is a tie and goes to the lower cluster
        4: [[7]],
        5: [[1], [1], [1], [1], [5]],  # k = 3, two clusters never get a member
    }
    found = runs(K.kmeans(table(spark, docs), ["doc_id"], max_group_values=limit))
    assert found[1] == ([0, 0, 1, 1], [0.25] * 4)
    assert found[2] == ([0, 0, 0], [0.0, 0.0, 1.0])
    for doc, vectors in docs.items():
        assert found[doc] == lloyd(vectors, 12), doc


def test_round_limit_measures_by_the_last_update(spark):
    rng = random.Random(3)
    docs = {1: [[rng.random(), rng.random()] for _ in range(40)]}
    for rounds in (1, 2):
        where, gaps = lloyd(docs[1], 12, rounds)
        for path in (K.kmeans_by_joins(table(spark, docs), ["doc_id"], rounds=rounds),
                     K.kmeans(table(spark, docs), ["doc_id"], rounds=rounds)):
            got = runs(path)[1]
            assert got[0] == where and got[1] == pytest.approx(gaps, abs=1e-12)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6))
def test_groups_match_a_plain_loop_to_the_last_bit(spark, seed):
    rng = random.Random(seed)
    docs = {
        d: [[rng.choice([rng.random(), rng.randint(0, 3) / 2]) for _ in range(3)] for _ in range(rng.randint(1, 60))]
        for d in range(12)
    }
    found = runs(K.kmeans(table(spark, docs), ["doc_id"]))
    assert found == {d: lloyd(v, 12) for d, v in docs.items()}


def test_update_resets_empty_clusters(spark):
    df = table(spark, {1: [[0], [9], [1], [1]]})
    first = K.initial_centroids(df, ["doc_id"])
    assigned = df.withColumn("cluster_id", F.lit(0))
    found = {r["cluster_id"]: r["centroid"] for r in K.update_centroids(assigned, first, ["doc_id"]).collect()}
    assert found == {0: [2.75], 1: [9.0]}


def test_vectors_of_unequal_length_fail(spark):
    with pytest.raises(Exception, match="differ in length"):
        K.kmeans(table(spark, {1: [[0], [1, 2]]}), ["doc_id"]).collect()


def test_sampling(spark):
    rows = spark.createDataFrame([(0, 4), (1, 4), (3, 4), (7, 4), (6, 3), (9, 1)], "n int, m int")
    found = [rows.filter(f"n = {n}").select(K.sampled_indices(F.col("n"), m)).first()[0] for n, m in
             [(0, 4), (1, 4), (3, 4), (7, 4), (6, 3), (9, 1)]]
    assert found == [[], [0], [0, 1, 2], [0, 2, 4, 6], [0, 2, 5], [0]]


def test_paths_and_counts(spark):
    df = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 0)], "doc_id string, chunk_index int")
    few, many = K.split_by_path(df, ["doc_id"])
    assert {r["doc_id"] for r in few.collect()} == {"b"} and many.count() == 8
    n = spark.createDataFrame([(1,), (2,), (4,), (5,), (400,)], "n int")
    assert [r[0] for r in n.select(K.cluster_count(F.col("n"))).collect()] == [1, 2, 2, 3, 12]


@pytest.mark.parametrize("bad", [0, -1, True, 2.5, "3"])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        K.cluster_count(F.col("n"), bad)


def test_joins_read_many_vectors_to_a_row(spark, monkeypatch):
    rng = random.Random(8)
    docs = {d: [[rng.randint(0, 9) / 8, rng.randint(0, 9) / 8] for _ in range(n)] for d, n in ((1, 50), (2, 7))}
    monkeypatch.setattr(K, "PACKED_VALUES", 30)
    packed = K._packed(table(spark, docs), ["doc_id"], "chunk_index", "embedding")
    counts = {(r["doc_id"], r["_part"]): len(r["_vectors"]) for r in packed.collect()}
    assert sum(counts.values()) == 57 and 1 < sum(d == 1 for d, _ in counts) <= 4 and counts[2, 0] == 7
    found = runs(K.kmeans_by_joins(table(spark, docs), ["doc_id"]))
    for doc, vectors in docs.items():
        where, gaps = lloyd(vectors, 12)
        assert found[doc][0] == where and found[doc][1] == pytest.approx(gaps, abs=1e-12)
    # A vector without a value moves no centroid.
    with_null = table(spark, {1: docs[1]}).unionByName(spark.createDataFrame([(1, 50, None)], SCHEMA))
    assert runs(K.kmeans_by_joins(with_null, ["doc_id"]))[1][0][:50] == lloyd(docs[1], 12)[0]


def test_joins_take_null_centroids_and_numbers_as_expressions_do(spark):
    """A null distance comes first, so the first null centroid draws every vector; a null number counts in no mean."""
    rows = [(1, 0, [0.0, 0.0]), (1, 1, None), (1, 2, [4.0, 2.0]), (1, 3, [8.0, None]), (1, 4, [6.0, 4.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    # After one round cluster 1 lies at the mean (10 / 3, 2) of the whole vectors that it drew.
    where, gaps = runs(K.kmeans_by_joins(df, ["doc_id"], rounds=1))[1]
    assert where == [1, 0, 1, 0, 1] and gaps == [pytest.approx(136 / 9), None, pytest.approx(4 / 9), None, pytest.approx(100 / 9)]
    where, gaps = runs(K.kmeans_by_joins(df, ["doc_id"]))[1]
    assert where == [0] * 5 and gaps == [24.25, None, 0.25, None, 6.25]


def test_small_keys_share_a_batch_and_large_ones_span_several(spark, monkeypatch):
    rng = random.Random(9)
    sizes = {None: 4, "a": 1, "b": 33, "": 2, "ä": 7}
    docs = {d: [[rng.randint(0, 9) / 8, rng.randint(0, 9) / 8] for _ in range(n)] for d, n in sizes.items()}
    rows = [(d, i if i or d else None, v) for d, vs in docs.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, embedding array<double>").repartition(3)
    found = K.kmeans_in_groups(df, ["doc_id"])
    # One call of Python for a key was dear where there are many keys.
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        split = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, split)) == sorted(map(str, found.collect())) and len(split) == 5
    for row in split:
        vectors = docs[row["doc_id"]]
        if not row["doc_id"]:
            vectors = vectors[1:] + vectors[:1]  # a row without an index comes last
        where, gaps = lloyd(vectors, 12)
        assert row["cluster_id"] == where and row["distance"] == pytest.approx(gaps, abs=1e-12)
    calls = []
    runner = K._groups_runner(["doc_id"], "embedding", ["chunk_index"], 12, 50, None, False)
    batch = pa.RecordBatch.from_pylist(
        [{"doc_id": d, "chunk_index": 0, "embedding": [1.0]} for d in range(40)],
        schema=pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("embedding", pa.list_(pa.float64()))]),
    )
    out = list(K._over_batches(lambda *a: calls.append(a) or runner(*a), ["doc_id"])([batch]))
    assert len(calls) == 2 and sum(b.num_rows for b in out) == 40


def test_keys_of_other_types_keep_their_own_calls(spark):
    nan = float("nan")
    rows = [(nan, i, [float(i)]) for i in range(5)] + [(0.0, 0, [1.0]), (-0.0, 1, [2.0])]
    df = spark.createDataFrame(rows, "doc_id double, chunk_index int, embedding array<double>")
    assert sorted(len(r["cluster_id"]) for r in K.kmeans_in_groups(df, ["doc_id"]).collect()) == [2, 5]
    nulls = spark.createDataFrame([(1, 0, [1.0]), (1, 1, None), (2, 0, [3.0])], SCHEMA)
    found = {r["doc_id"]: r for r in K.kmeans_in_groups(nulls, ["doc_id"], allow_null_vectors=True).collect()}
    assert found[1]["cluster_id"] is None and found[1]["distance"] is None and found[1]["chunk_index"] == [0, 1]
    assert found[2]["cluster_id"] == [0] and found[2]["distance"] == [0.0]
