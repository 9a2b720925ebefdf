"""The registered queries of the subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import bpe, language, secrets, warc
from corpusweave.llm.decontaminate import contaminated
from corpusweave.llm.html import extracted
from corpusweave.llm.mixing import mix
from corpusweave.llm.neardup import near_duplicates
from corpusweave.llm.oracles import ORACLES  # noqa: F401
from corpusweave.llm.periodic import collapse_runs
from corpusweave.llm.quality import judge
from corpusweave.llm.search import ranked
from corpusweave.llm.sharding import shuffle_into_shards
from corpusweave.llm.substring import remove_repeats
from corpusweave.llm.tables import shared_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of each page."""
    pages = _table(spark, folder, "pages").withColumn("text", extracted(F.col("html")))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each document, and whether the base rules and the selected cutoffs keep it."""
    docs = judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return docs.select("doc_id", *(F.col(f"_quality.{c}").alias(c) for c in counts))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words that stay when passages of 13 words and more of earlier documents are taken out."""
    return remove_repeats(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of each document."""
    docs = secrets.find_secrets(_table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_secrets", lambda s: s["kind"] == kind)).cast("long")
    return docs.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS)),
        F.sha2(secrets.shown(F.filter("_secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        secrets.shown(F.col("_secrets")).alias("spans"),
    )


def op5_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC records, indexed and read back."""
    store = shared_path(spark)
    warc.write_archives(_table(spark, folder, "pages"), f"{store}/archives")
    warc.write_index(spark, f"{store}/archives", f"{store}/index")
    return warc.read_records(spark, f"{store}/archives", f"{store}/index", payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document, learned from those that are not held out."""
    docs = _table(spark, folder, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = language.fit(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), language.predicted(model, F.col("text")).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def op7_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return near_duplicates(_table(spark, folder, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, the score and the passage."""
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of equal row counts, in random order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sharded = shuffle_into_shards(
        _table(spark, folder, "documents").select(
            "doc_id",
            "text",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_entropy_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mix(_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate"
    )


def _with_periods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give a period to the end of each tenth text, as the hash of its id says."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, id_ in enumerate(batch.column("doc_id").to_pylist()):
            hashed = crc32(str(id_).encode())
            if hashed % 10 or id_ is None or texts[i] is None:
                continue
            words = texts[i].encode().split()
            n, g = len(words), hashed // 10
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                again = words[a : a + p] * ((n - a) // p + 1)
                texts[i] = b" ".join(words[:a] + again[: n - a]).decode()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of each document, the one of greatest exponent, and the document without its repeats."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    texts = docs.mapInArrow(_with_periods, docs.schema)
    exponent = lambda r: r["length"] / r["period"]  # noqa: E731  exact order up to 2 ** 26 words
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(exponent(r).alias("e"), -r["start"], -r["period"], r["length"]))
    )
    shown = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        collapse_runs(texts)
        .withColumn("_best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("_best.col2")).alias("start"),
            F.col("_best.length").alias("length"),
            (-F.col("_best.col3")).alias("period"),
            F.expr("1000 * _best.length div -_best.col3").alias("exponent_milli"),
            F.sha2(F.array_join(shown, ""), 256).alias("runs_sha256"),
            F.sha2("kept_text", 256).alias("collapsed_sha256"),
        )
    )


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document and the bytes they decode to."""
    tokenizer = bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(_table(spark, folder, "documents"), tokenizer).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "ids",
    )
    return bpe.decode(coded, tokenizer).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc_index": op5_warc_index,
    "op6_language_id": op6_language_id,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_external_shuffle": op9_external_shuffle,
    "op10_entropy_mixing": op10_entropy_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_lexical_search": op13_lexical_search,
}
