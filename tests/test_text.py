import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusweave.functions import text as T
from tests.naive import chunk

SENTENCE = "Ab cd ef."


def evaluate(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["v"] for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


def chunks_of(spark, low, high, overlap, *texts):
    column = T.chunks(F.col("text"), min_chunk_size=low, max_chunk_size=high, overlap_size=overlap)
    return evaluate(spark, column, *texts)


def test_two_paragraphs_become_one_chunk(spark):
    text = "Ein Satz. Noch einer!\n\nletzte Zeile"
    assert chunks_of(spark, 10, 60, 5, text) == [["Ein Satz. Noch einer! letzte Zeile"]]


def test_overlap(spark):
    # Four sentences of 9 characters make 39; the last chunk has two; 3 characters and a space overlap.
    (found,) = chunks_of(spark, 10, 45, 3, " ".join([SENTENCE] * 10))
    assert [len(c) for c in found] == [39, 43, 23]
    assert all(c.startswith("ef. Ab") for c in found[1:])


def test_long_sentence_stays_whole_and_short_chunk_has_no_overlap(spark):
    assert chunks_of(spark, 1000, 1500, 250, "x" * 2000) == [["x" * 2000]]
    text = "a" * 30 + "\n\n" + "b" * 70
    assert chunks_of(spark, 50, 80, 10, text) == [["a" * 30, "b" * 70]]


def test_blank_and_null(spark):
    assert chunks_of(spark, 50, 80, 10, "", " \n\t　\x1c\n") == [[], []]
    assert evaluate(spark, T.is_blank(F.col("text")), "", "   ", "a ") == [True, True, False]


def test_unicode_white_space_and_line_breaks(spark):
    text = "　a \x85 b\r\n\x1c\nc d\x1f\rz"
    assert evaluate(spark, T.paragraphs(F.col("text")), text) == [["a b", "c d z"]]
    assert evaluate(spark, T.strip(F.col("text")), "　 \x1cx y \n") == ["x y"]
    newline = T.text_bytes(T.normalize_newlines(F.col("text")))
    assert evaluate(spark, newline, "a\r\nb\rc") == [5]


def test_keywords_and_language(spark):
    assert evaluate(spark, T.keywords(F.col("text")), "AI 인공지능 is AI, élan a_b 12") == [
        ["ai", "인공지능", "is", "élan", "a_b"]
    ]
    assert evaluate(spark, T.language(F.col("text")), "한글 and Latin", "Latin", "123", " ") == ["ko", "en", None, None]
    with pytest.raises(ValueError):
        T.keywords(F.col("text"), 0)


def test_chunk_settings_are_checked():
    with pytest.raises(ValueError):
        T.chunks(F.col("text"), min_chunk_size=10, max_chunk_size=5)


def test_status_is_strict_about_size(spark):
    status = T.document_status(F.col("text"), max_text_bytes=4)
    assert evaluate(spark, status, "éa a", "éa", " \n", None) == ["TEXT_TOO_LARGE", "OK", "NO_CONTENT", "ERROR"]
    assert evaluate(spark, status, "abcd", "abcde") == ["OK", "TEXT_TOO_LARGE"]


def test_labels(spark):
    rows = spark.createDataFrame([(-1,), (0,), (12,)], "l int")
    assert [r[0] for r in rows.select(T.cluster_label(F.col("l"))).collect()] == ["noise", "cluster-0", "cluster-12"]


def test_large_document_in_one_row(spark):
    text = " ".join(f"Sentence number {i} says little." for i in range(40_000))
    (found,) = chunks_of(spark, 1000, 1500, 250, text)
    assert found == chunk(text, 1000, 1500, 250)


ALPHABET = ["a", "bc", "é", "한글", "😀", ".", "!", "。", "？", " ", "  ", "\n", "\n\n", "\r\n", "\t", "　", "\x1c", " ", "\x85"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), low=st.integers(1, 20), extra=st.integers(0, 20), overlap=st.integers(-2, 25))
def test_chunks_follow_the_rules(spark, seed, low, extra, overlap):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 150))) for _ in range(60)]
    high = low + extra
    assert chunks_of(spark, low, high, overlap, *texts) == [chunk(t, low, high, overlap) for t in texts]
