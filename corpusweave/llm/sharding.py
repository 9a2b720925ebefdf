"""Two-pass external shuffle into shards, with DataFrame functions only.

First pass: rows are scattered into buckets by a seeded hash, as many as it takes for a bucket to fit
in memory. Second pass: each bucket is put in the order of a Fisher-Yates permutation, and
the shuffled buckets, one after another, are dealt to the shards in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.tables import set_aside, written

SHARDS = 8
SEED = 20240607
BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 100_000
MIN_BUCKETS = 64


def shuffle_into_shards(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Add ``shard`` and ``slot`` to every row; shards differ by one row at most, slots count from 0.

    The place of a row depends on its key, its text's checksum and the seed, so a rerun gives the same
    shards (rows that repeat key and text change places among themselves only). Null keys and texts are
    hashed as such. ``docs`` may have any other columns but ``shard`` and ``slot``, which are replaced.
    """
    docs, names = set_aside(docs.drop("shard", "slot"), "_where", "_bucket", "_at", "_place", "_before", "_order")
    payload = docs
    volume = payload.agg(
        F.sum(F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1).alias("bytes"), F.count("*").alias("rows")
    ).first()
    buckets = max(MIN_BUCKETS, (volume["bytes"] or 0) // bucket_bytes + 1, volume["rows"] // BUCKET_ROWS + 1)
    where = F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    bucket = F.pmod(where, F.lit(buckets))
    counts = docs.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_rows"))
    orders = written(_orders(counts, buckets, seed))
    within = Window.partitionBy("_bucket").orderBy("_where", F.col(key))
    numbered = payload.withColumns({"_where": where, "_bucket": bucket}).withColumn("_at", F.row_number().over(within))
    place = F.col("_before") + F.element_at("_order", F.col("_at")) - 1
    return (
        numbered.join(orders, "_bucket")
        .withColumn("_place", place)
        .withColumns(
            {
                "shard": F.pmod("_place", F.lit(shards)).cast("int"),
                "slot": F.floor(F.col("_place") / shards).cast("long"),
            }
        )
        .drop("_where", "_bucket", "_at", "_place", "_before", "_order")
        .withColumnsRenamed(names)
    )


def _orders(counts: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``_bucket, _before, _order``: rows in the buckets before, and a permutation of ``1 … rows``.

    ``shuffle`` is Spark's Fisher-Yates shuffle; its seed holds for a partition, so the buckets come from
    a range of fixed partitions. One row per bucket is brought together.
    """
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sized = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    fixed = counts.sparkSession.range(0, buckets, 1, min(buckets, 1024)).withColumnRenamed("id", "_bucket")
    return fixed.join(F.broadcast(sized), "_bucket").select(
        "_bucket", "_before", F.shuffle(F.sequence(F.lit(1), F.col("_rows").cast("int")), seed).alias("_order")
    )
