from corpusweave import params
from corpusweave.functions.embedding import hashed_words, model_embedder
from corpusweave.plans.documents import EMBEDDING_ERROR, representative_listing, summarize_documents
from corpusweave.plans.files import embed_segments

LENGTHS = model_embedder(lambda: lambda texts: [None if "BAD" in t else [float(len(t))] for t in texts], name="lengths")
SMALL = params.ClusterSettings(max_clusters=4, min_sentences=2)


def summarize(spark, docs, embedder=LENGTHS, **settings):
    df = spark.createDataFrame(docs, "doc_id string, text string")
    found = summarize_documents(df, embedder, **settings)
    return {r["file_id"]: r.asDict(recursive=True) for r in found.collect()}


def test_one_short_document(spark):
    text = "바람이 산을 넘는다. 바람이 산을 흔든다. 바람이 멈춘다."
    row = summarize(spark, [("file-1", text)], clustering=SMALL, max_text_bytes=10_000)["file-1"]
    assert row == {
        "file_id": "file-1", "status": "OK", "retry_count": 0, "error_message": None,
        "short_summary": text, "long_summary": text, "tags": ["바람이", "산을", "넘는다", "흔든다", "멈춘다"],
        "doc_type": None, "topics": [], "language": "ko", "embedding": [float(len(text))],
        "raw_features": {"sentence_count": 1, "chunk_count": 1, "text_bytes": len(text.encode())},
        "representative_blocks": [
            {"cluster_id": 0, "representative_index": 0, "representative_sentence": text,
             "representative_sentences": [text], "member_indices": [0]}
        ],
    }


def test_clustered_document(spark):
    text = "\n\n".join(c * 8 for c in "aabbbc") + "\n\n" + "d" * 10
    row = summarize(
        spark, [("x", text)], chunking=params.ChunkSettings(5, 10, 0), clustering=SMALL
    )["x"]
    assert row["status"] == "OK" and row["raw_features"]["sentence_count"] == 7
    # All lengths are 8 but the last: k = 3, ties go to cluster 0, the text of length 10 as well.
    (block,) = row["representative_blocks"]
    assert block["cluster_id"] == 0 and block["member_indices"] == [0, 1, 2, 3, 4, 5, 6]
    assert block["representative_sentences"] == ["a" * 8, "b" * 8]
    assert row["short_summary"] == row["long_summary"] == "a" * 8 + " " + "b" * 8


def test_documents_that_are_not_ok(spark):
    rows = summarize(
        spark,
        [("large", "x" * 21), ("fits", "x" * 20), ("blank", " \n "), ("null", None)],
        max_text_bytes=20,
    )
    assert {k: r["status"] for k, r in rows.items()} == {
        "large": "TEXT_TOO_LARGE", "fits": "OK", "blank": "NO_CONTENT", "null": "ERROR",
    }
    assert rows["large"]["raw_features"] == {"sentence_count": 0, "chunk_count": 0, "text_bytes": 21}
    assert rows["null"]["raw_features"]["text_bytes"] == 0
    for name in ("large", "blank", "null"):
        assert rows[name]["short_summary"] is None and rows[name]["embedding"] is None
        assert rows[name]["tags"] == [] and rows[name]["representative_blocks"] == []


def test_a_chunk_that_cannot_be_embedded_fails_its_document_only(spark):
    many = "\n\n".join(["fine text"] * 9 + ["BAD chunk"])
    rows = summarize(
        spark, [("few", "BAD"), ("many", many), ("good", "good")], chunking=params.ChunkSettings(5, 10, 0)
    )
    assert {k: (r["status"], r["error_message"]) for k, r in rows.items()} == {
        "few": ("ERROR", EMBEDDING_ERROR), "many": ("ERROR", EMBEDDING_ERROR), "good": ("OK", None),
    }
    assert rows["many"]["raw_features"]["sentence_count"] == 10 and rows["few"]["raw_features"]["sentence_count"] == 1


def test_the_message_of_the_model_is_kept(spark):
    def make():
        def predict(texts):
            for t in texts:
                if "BAD" in t:
                    raise RuntimeError(f"refused: {t}")
            return [[1.0, float(len(t))] for t in texts]

        return predict

    texts = [("few", "BAD"), ("many", "\n\n".join(["fine text"] * 9 + ["BAD one", "BAD two"])), ("good", "good")]
    df = spark.createDataFrame(texts, "doc_id string, text string").coalesce(1)
    model, chunking = model_embedder(make, name="m"), params.ChunkSettings(5, 10, 0)
    rows = {r["file_id"]: r for r in summarize_documents(df, model, chunking=chunking).collect()}
    assert {k: (r["status"], r["error_message"]) for k, r in rows.items()} == {
        "few": ("ERROR", "refused: BAD"), "many": ("ERROR", "refused: BAD one"), "good": ("OK", None),
    }
    segments = embed_segments(df, model, key="doc_id", error=None, chunking=chunking)
    assert {r["source_path"]: (r["status"], r["error_message"], r["segment_count"]) for r in segments.collect()} == {
        "few": ("ERROR", "refused: BAD", 1), "many": ("ERROR", "refused: BAD one", 11), "good": ("OK", None, 1),
    }


def test_weak_clusters_leave_an_empty_summary(spark):
    text = "\n\n".join(["a" * 3, "b" * 10])
    row = summarize(spark, [("x", text)], chunking=params.ChunkSettings(5, 10, 0), clustering=SMALL)["x"]
    assert row["status"] == "OK" and row["short_summary"] == "" and row["long_summary"] is None
    assert row["embedding"] is None and row["language"] is None


def test_listing(spark):
    df = spark.createDataFrame([("ok", "Some text."), ("blank", " ")], "doc_id string, text string")
    rows = {r["file_id"]: r for r in representative_listing(summarize_documents(df, hashed_words(4))).collect()}
    assert rows["ok"]["sentence"] == "Some text." and rows["ok"]["message"] is None
    assert rows["blank"]["status"] == "NO_CONTENT" and rows["blank"]["message"] == "the document failed"
