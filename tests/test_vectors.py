import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusweave.functions import embedding
from corpusweave.functions import text as T
from corpusweave.functions import vectors as VF
from corpusweave.functions.embedding import WrongCount, _tried, hashed_words, model_embedder
from corpusweave.operators import vectors as V


def test_squared_distance_needs_equal_lengths(spark):
    good = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    assert good.select(VF.squared_distance(F.col("a"), F.col("b"))).first()[0] == 25.0
    bad = spark.createDataFrame([([0.0], [4.0, 0.0])], "a array<double>, b array<double>")
    with pytest.raises(PySparkException):
        bad.select(VF.squared_distance(F.col("a"), F.col("b"))).collect()


def test_pooling_with_no_mask_gives_zero_and_stays_finite(spark):
    rows = [(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 4.0], 1), (1, 2, [9.0, 9.0], 0), (2, 0, [5.0, 5.0], 0)]
    tokens = spark.createDataFrame(rows, "key int, pos int, vec array<double>, mask int")
    pooled = {r["key"]: r["pooled"] for r in V.masked_mean_pool(tokens, ["key"]).collect()}
    assert pooled == {1: [2.0, 3.0], 2: [0.0, 0.0]}
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(VF.l2_normalize(F.col("v")))
    assert [r[0] for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_model_sees_small_batches_of_texts_only(spark):
    def make():
        def predict(texts):
            assert 0 < len(texts) <= 3 and all(t.strip() for t in texts)
            return [None if t == "bad" else [float(len(t))] for t in texts]

        return predict

    texts = ["a", " ", None, "bad", "ccc", "dddd", "", "eeeee"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    found = V.embed_column(rows, model_embedder(make, name="m", batch_size=3)).orderBy("i").collect()
    assert [r["embedding"] for r in found] == [[1.0], None, None, None, [3.0], [4.0], None, [5.0]]


def test_hashed_words_are_deterministic_and_null_for_blanks(spark):
    rows = spark.createDataFrame([("b a B",), ("a b b",), (" ",), (None,), ("!",)], "text string")
    one, two, blank, null, nothing = [r["embedding"] for r in V.embed_column(rows, hashed_words(8)).collect()]
    assert one == two and abs(sum(x * x for x in one) - 1) < 1e-12
    assert blank is None and null is None and nothing == [0.0] * 8


def test_hashed_words_are_the_unit_counts_of_the_words(spark):
    texts = ["  --Ärger, am  Kai!", "a_b c3 c3 \U00010400x\n", "Σας ΣΑΣ 港口。港口", "İ x\u00a0y", "one", ", x", "x ,"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    words = F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), 0)
    found = V.embed_column(rows, hashed_words(16)).withColumn("words", words).orderBy("i").collect()
    for row in found:
        counts = [0.0] * 16
        for word in row["words"]:
            counts[int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % 16] += 1.0
        unit = spark.createDataFrame([(counts,)], "v array<double>").select(VF.l2_normalize(F.col("v"))).first()[0]
        assert row["words"] and row["embedding"] == unit


def test_payload(spark):
    rows = [
        ("report", 2, "behind the reeds", [0.25, 0.5, -2.0]),
        ("report", 0, "A boat", [3.0, 0.0, 1.5]),
        ("report", 1, "lies hidden", [-1.0, 8.0, 0.125]),
    ]
    chunks = spark.createDataFrame(rows, "doc string, chunk_index int, chunk string, embedding array<double>")
    payload = V.segment_payload(chunks, "doc", "m")
    row = payload.first().asDict(recursive=True)
    assert row == {
        "source_path": "report",
        "model_name": "m",
        "segment_count": 3,
        "segments": [
            {"index": 0, "text": "A boat", "vector": [3.0, 0.0, 1.5], "vector_length": 3},
            {"index": 1, "text": "lies hidden", "vector": [-1.0, 8.0, 0.125], "vector_length": 3},
            {"index": 2, "text": "behind the reeds", "vector": [0.25, 0.5, -2.0], "vector_length": 3},
        ],
    }
    assert set(V.redact_vectors(payload).first()["segments"][0].asDict()) == {"index", "text", "vector_length"}


def test_blank_texts_are_refused_or_routed(spark):
    rows = spark.createDataFrame([(1, "x"), (2, " 　"), (3, None)], "i int, text string")
    good, bad = V.split_embeddable(rows)
    assert [r["i"] for r in good.collect()] == [1] and sorted(r["i"] for r in bad.collect()) == [2, 3]
    with pytest.raises(PySparkException):
        rows.select(V.require_embeddable(F.col("text"))).collect()


def test_a_text_that_the_model_fails_on_takes_no_other_with_it(spark):
    def make():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no vector")
            return [[float(len(t))] for t in texts]

        return predict

    rows = spark.createDataFrame([(1, "one"), (2, "bad one"), (3, "three"), (4, None)], "i int, text string").coalesce(1)
    found = {r["i"]: r["embedding"] for r in V.embed_column(rows, model_embedder(make, name="m")).collect()}
    assert found == {1: [3.0], 2: None, 3: [5.0], 4: None}


def test_a_failing_text_costs_few_calls():
    calls = []

    def predict(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError("bad text")
        return [[1.0]] * len(texts)

    found = _tried(predict, ["a"] * 37 + ["bad"] + ["b"] * 26)
    assert found == [([1.0], None)] * 37 + [(None, "bad text")] + [([1.0], None)] * 26
    assert len(calls) == 1 + 2 * 6
    with pytest.raises(WrongCount):
        _tried(lambda texts: [[1.0]], ["a", "b"])


def test_hashed_words_count_each_distinct_word_once_a_batch(spark, monkeypatch):
    texts = [None, "b a_1 B! ÉCOLE école", " ", "!", "a_1 " * 500, "b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    found = V.embed_column(rows, hashed_words(8)).orderBy("i").collect()
    for text, row in zip(texts, found):
        words = re.findall(r"\w+", (text or "").lower())
        counts = [0.0] * 8
        for word in words:
            counts[int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % 8] += 1
        norm = sum(c * c for c in counts) ** 0.5
        expected = None if not (text or "").strip() else [c / norm if norm else 0.0 for c in counts]
        assert row["embedding"] == (expected if expected is None else pytest.approx(expected, abs=1e-12))
    hashed = []
    real = embedding.hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda data: hashed.append(data) or real(data))
    counts = embedding._bucket_counts(4).func(pa.array([["x"] * 9, None, ["y", "x"], []]))
    assert counts.null_count == 1 and sum(counts[0].as_py()) == 9 and sum(counts[2].as_py()) == 2 and sum(counts[3].as_py()) == 0
    assert sorted(hashed) == [b"x", b"y"]
