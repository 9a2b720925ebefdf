"""Joining many rows with one small row per key without piling a hot key onto one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.lineage import cut

MAX_BROADCAST_BYTES = 64 << 20
# Rows of a key from which on it is spread over many tasks.
HOT_ROWS = 10_000
SALTS = 64


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    *,
    spread_by: str,
    row_bytes: Column,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` with ``per_key``, which holds at most one row per key; ``inner`` or ``left``.

    The small side is measured: ``row_bytes`` and the bytes of keys of varying length. Up to ``MAX_BROADCAST_BYTES`` it is broadcast and the rows stay
    where they are; beyond, both sides are shuffled by key. Only keys of more than ``HOT_ROWS`` rows are also salted, so that
    the rows of one key go to many tasks and the copies of ``per_key`` stay few beside the rows. ``spread_by`` is a column
    that varies within a key.
    """
    keys = list(keys)
    for key in keys:
        if per_key.schema[key].dataType.typeName() in ("string", "binary"):
            row_bytes = row_bytes + F.coalesce(F.octet_length(F.col(key)), F.lit(0)).cast("long")
    size = per_key.agg(F.sum(row_bytes)).first()[0] or 0
    if size <= MAX_BROADCAST_BYTES:
        return rows.join(F.broadcast(per_key), keys, how)
    hot = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS).select(*keys))
    if hot.isEmpty():
        return rows.join(per_key, keys, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    # A row with a null key has no match, so it need not meet one, but an outer join keeps it.
    no_match = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])
    spread = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    salted_rows = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot") | no_match, spread).otherwise(0))
    copies = F.sequence(F.lit(0), F.when(F.col("_hot"), SALTS - 1).otherwise(0))
    salted = per_key.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted_rows.drop("_hot").join(salted, [*keys, "_salt"], how).drop("_salt")
