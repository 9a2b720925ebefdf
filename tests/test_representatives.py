import random

from pyspark.sql import functions as F

from corpusweave import params
from corpusweave.functions import blocks as B
from corpusweave.operators import joins as J
from corpusweave.operators import representatives as R
from tests.naive import unique_by_greed

SCHEMA = "doc_id int, cluster_id int, chunk_index int, chunk string, distance double"


def test_weak_clusters_are_dropped(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a", 0.0), (1, 1, 1, "b", 0.0)], SCHEMA)
    assert R.representative_clusters(rows, ["doc_id"]).count() == 0
    assert R.drop_small_clusters(rows, ["doc_id"], 1).count() == 2


def _rows_out(df):
    """Rows that the operators of a plan gave out, by operator."""
    df.collect()
    found, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            found.setdefault(node.nodeName(), []).append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_sizes_too_large_to_broadcast_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(J, "MAX_BROADCAST_BYTES", 0)
    rows = spark.range(3000).selectExpr("id % 500 AS doc_id", "int(id % 2) AS cluster_id", "int(id) AS chunk_index")
    kept = R.drop_small_clusters(rows, ["doc_id"], 2)
    assert max(max(counts) for counts in _rows_out(kept).values()) == 3000
    assert kept.count() == 3000 and kept.filter("cluster_size <> 6").isEmpty()


def test_only_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(J, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(J, "HOT_ROWS", 100)
    rows = spark.range(1000).selectExpr("if(id < 600, 7, if(id < 900, null, id)) AS k", "id").cache()
    per_key = spark.createDataFrame([(7, "a"), (950, "b"), (2000, "c"), (None, "d")], "k long, v string")
    joined = {how: J.join_per_key(rows, per_key, ["k"], spread_by="id", row_bytes=F.lit(8), how=how) for how in ("inner", "left")}
    for how, found in joined.items():
        assert found.columns == ["k", "id", "v"]
        assert sorted(map(str, found.collect())) == sorted(map(str, rows.join(per_key, "k", how).collect()))
        assert max(_rows_out(found)["Generate"]) == J.SALTS + 2


def test_ratio_works_on_squared_distances(spark):
    rows = spark.createDataFrame([(1, 0, 0, "p", 0.16), (1, 0, 1, "q", 0.09), (1, 0, 2, "r", 0.1)], SCHEMA)
    kept = R.within_ratio(R.top_members(rows, ["doc_id"]), ["doc_id"], 1.2)
    assert sorted(r["chunk_index"] for r in kept.collect()) == [1, 2]


def test_zero_distance_keeps_exact_matches_only(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a", 0.0), (1, 0, 1, "b", 0.0), (1, 0, 2, "c", 1e-12)], SCHEMA)
    kept = R.within_ratio(R.top_members(rows, ["doc_id"]), ["doc_id"])
    assert sorted(r["chunk_index"] for r in kept.collect()) == [0, 1]


def test_the_larger_cluster_keeps_a_shared_text(spark):
    rows = [(1, 0, 2, 1, 0, "Hafen"), (1, 0, 2, 2, 2, "Mole"), (1, 1, 1, 1, 1, " Hafen "), (1, 2, 1, 1, 3, " 　")]
    ranked = spark.createDataFrame(
        rows, "doc_id int, cluster_id int, cluster_size int, rank int, chunk_index int, chunk string"
    )
    kept = {(r["cluster_id"], r["chunk_index"]) for r in R.unique_texts(ranked, ["doc_id"]).collect()}
    assert kept == {(0, 0), (0, 2)}


def test_top_k_comes_before_uniqueness(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, "x", 0.1), (1, 0, 1, "x", 0.1), (1, 0, 2, "yy", 0.1), (1, 0, 3, "zzz", 0.1)], SCHEMA
    )
    row = R.representative_clusters(rows, ["doc_id"]).first()
    assert row["representative_sentences"] == ["x", "yy"] and row["member_indices"] == [0, 1, 2, 3]


def test_tables_and_arrays_agree_with_greed(spark):
    rng = random.Random(5)
    rows = [
        (d, rng.randrange(5), i, rng.choice(["a", " a", "bb", "ccc", "dd ", "e", ""]) , rng.choice([0.0, 0.5, 0.55, 1.0]))
        for d in range(40)
        for i in range(rng.randint(1, 30))
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    settings = params.ClusterSettings(max_clusters=5, max_representative_sentences=2)
    found = R.representative_clusters(table, ["doc_id"], settings)
    lists = table.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk", "cluster_id", "distance"))).alias("m"))
    block = B.clustered_blocks(F.col("m.chunk_index"), F.col("m.chunk"), F.col("m.cluster_id"), F.col("m.distance"), settings)
    in_rows = lists.select("doc_id", F.inline(block))
    columns = sorted(found.columns)
    as_set = lambda df: sorted(map(str, df.select(columns).collect()))
    assert as_set(found) == as_set(in_rows)

    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], {})[r["cluster_id"]] = (r["representative_index"], len(r["representative_sentences"]))
    for d in range(40):
        mine = [r for r in rows if r[0] == d]
        clusters = []
        for c in range(5):
            own = sorted((r for r in mine if r[1] == c), key=lambda r: (r[4], len(r[3]), r[2]))
            if len(own) >= 2:
                near = [r[2] for r in own if r[4] <= own[0][4] * 1.2]
                clusters.append((c, len(own), near[:2]))
        kept = unique_by_greed(clusters, {r[2]: r[3] for r in mine})
        assert got.get(d, {}) == {c: (idx[0], len(idx)) for c, idx in kept.items()}


def test_top_members_are_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a", 0.0)], SCHEMA)
    plan = R.top_members(rows, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_context_stays_within_the_document(spark):
    chunks = spark.createDataFrame([(1, i, f"c{i}") for i in range(4)] + [(2, 0, "z")], "doc_id int, chunk_index int, chunk string")
    chosen = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (2, 0, 0)], "doc_id int, cluster_id int, representative_index int")
    found = {(r["doc_id"], r["cluster_id"]): r["context"] for r in R.expand_context(chosen, chunks, ["doc_id"]).collect()}
    assert found == {(1, 0): "c0 c1", (1, 1): "c1 c2 c3", (2, 0): "z"}
