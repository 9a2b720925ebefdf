"""Mixing sources to target weights by entropy balancing.

A document's rate is the exponential tilt ``min(2, exp(lambda * size / mean size))`` of its source that is
closest to taking every document once (least relative entropy) and makes the source's words meet its target. The
multipliers solve the convex dual by Newton steps, each a distributed sum over documents of equal source
and size. Rates are then rounded into copies, in order of size, so that errors cancel.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusweave.llm.tables import MAX_SENT_IDS, written
from corpusweave.llm.words import find_words, slices
from corpusweave.operators.ordinal import with_ordinal

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Documents of equal source and size that are ranked together, about.
CELL_ROWS = 128
_STEPS = 40
#: Sums are taken over whole numbers, so that their order changes nothing.
_UNIT = 1 << 20


def _count(text: pa.Array) -> pa.Array:
    parts = [np.diff(find_words(data, offsets).first) for _, data, offsets in slices(text)]
    return pa.array(np.concatenate(parts) if parts else [], pa.int64())


def word_count(text: Column) -> Column:
    return arrow_udf(_count, "long").asNondeterministic()(text.cast("string"))


def _sent(small: DataFrame) -> DataFrame:
    """Send a table to every task if its rows, counted, allow it."""
    return F.broadcast(small) if small.count() <= MAX_SENT_IDS // 4 else small


def source_targets(sizes: DataFrame) -> DataFrame:
    """``_source, source_size, target`` from ``_source, _size`` per document.

    Weights repeat in the order of sources. Whatever exceeds twice a source's size is shared among the others
    by weight until none is above: the targets are ``least(level * weight, 2 * size)``.
    """
    sums = written(sizes.groupBy("_source").agg(F.sum("_size").cast("long").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_n") % len(WEIGHTS) + 1).cast("int"))
    sources = written(with_ordinal(sums, ["_source"], "_n", 0).withColumn("_weight", weight))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.col("_weight") * F.lit(level) >= F.col("source_size") * MOST
        fixed, free = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size") * MOST)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0)),
        ).first()
        if not free or (new := (SHARE * total - fixed) / free) <= level:
            break
        level = new
    target = F.least(F.col("_weight") * F.lit(level), (F.col("source_size") * MOST).cast("double"))
    return sources.select("_source", "source_size", target.alias("target"))


def _rate(multiplier: Column) -> Column:
    return F.exp(F.least(multiplier * F.col("_size") / F.col("_mean"), F.lit(math.log(MOST))))


def _multipliers(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``_source, _mean, _by``: the multiplier of each source, with infinities for all and nothing.

    Newton steps on the dual, kept in a bracket that each step narrows.
    """
    means = cells.groupBy("_source").agg((F.sum(F.col("_size") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    inf = F.lit(float("inf"))
    state = written(
        targets.join(means, "_source").select(
            "_source",
            "target",
            "_mean",
            F.when(F.col("target") >= F.col("source_size") * MOST, inf)
            .when(F.col("target") <= 0, -inf)
            .otherwise(F.lit(0.0))
            .alias("_by"),
            F.lit(-1e4).alias("_low"),
            F.lit(1e4).alias("_high"),
        )
    )
    for _ in range(_STEPS):
        words = F.col("_size") * F.col("_n") * _rate(F.col("_by"))
        slope = F.when(F.col("_by") * F.col("_size") / F.col("_mean") < math.log(MOST), words * F.col("_size") / F.col("_mean"))
        whole = lambda x: F.sum(F.round(x * _UNIT).cast("decimal(38,0)")).cast("double") / _UNIT
        sums = (
            cells.join(_sent(state.where("abs(_by) < 1e300")), "_source")
            .groupBy("_source")
            .agg(whole(words).alias("_words"), F.coalesce(whole(slope), F.lit(0.0)).alias("_slope"))
        )
        gap = F.coalesce(F.col("_words") - F.col("target"), F.lit(0.0))
        low = F.when(gap < 0, F.col("_by")).otherwise(F.col("_low"))
        high = F.when(gap > 0, F.col("_by")).otherwise(F.col("_high"))
        step = F.col("_by") - gap / F.greatest("_slope", F.lit(1e-9))
        moved = state.join(sums, "_source", "left").select(
            "_source", "target", "_mean", "_by", gap.alias("_gap"), low.alias("_low"), high.alias("_high"), step.alias("_step")
        )
        inside = (F.col("_step") > F.col("_low")) & (F.col("_step") < F.col("_high"))
        state = written(
            moved.select(
                "_source",
                "target",
                "_mean",
                F.when(F.abs("_gap") <= F.col("target") * 1e-9, F.col("_by"))
                .when(inside, F.col("_step"))
                .otherwise((F.col("_low") + F.col("_high")) / 2)
                .alias("_by"),
                "_low",
                "_high",
                "_gap",
            )
        )
        if not state.where("abs(_gap) > target * 1e-6").limit(1).count():
            break
        state = state.drop("_gap")
    return state.select("_source", "_mean", "_by")


def _rounded(cells: DataFrame) -> DataFrame:
    """Add ``_copies``, the whole copies of a cell, from ``_due`` in units: sums stay within half a copy.

    Cells go by source and size over range partitions; a source's sum before a partition comes from one
    row per partition and source.
    """
    placed = written(
        cells.repartitionByRange("_source", "_size", "_part")
        .sortWithinPartitions("_source", "_size", "_part")
        .withColumn("_p", F.spark_partition_id())
    )
    sums = placed.groupBy("_p", "_source").agg(F.sum("_due").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", "_source", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    run = Window.partitionBy("_p", "_source").orderBy("_size", "_part").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.col("_run")
    whole = lambda x: F.floor((x + _UNIT // 2) / _UNIT)
    return (
        placed.withColumn("_run", F.sum("_due").over(run))
        .join(before, ["_p", "_source"])
        .withColumn("_copies", (whole(upto) - whole(upto - F.col("_due"))).cast("long"))
        .withColumn("_copies", F.greatest(F.lit(0), F.least("_copies", F.col("_n") * MOST)).cast("long"))
        .drop("_p", "_run", "_before")
    )


_CHANGE = pa.schema([("_source", pa.string()), ("_size", pa.int64()), ("_part", pa.int64()), ("_change", pa.int64())])


def _settle(table: pa.Table) -> pa.Table:
    """Take or leave copies of a few cells of a source, large ones first, to come closer to the target."""
    rows = table.to_pylist()
    gap = rows[0]["gap"]
    out = []
    for size, part, n, copies in sorted(
        {(r["_size"], r["_part"], r["_n"], r["_copies"]) for r in rows}, key=lambda c: (-c[0], c[1])
    ):
        change = max(-copies, min(round(gap / size), n * MOST - copies))
        if change:
            gap -= change * size
            out.append({"_source": rows[0]["_source"], "_size": size, "_part": part, "_change": change})
    return pa.Table.from_pylist(out, schema=_CHANGE)


def _near_target(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Correct the rounded copies: per source, the least and largest cell of each power of two may change."""
    taken = cells.groupBy("_source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("_taken"))
    gap = taken.join(targets, "_source").select("_source", (F.col("target") - F.col("_taken")).alias("gap"))
    row = F.struct("_size", "_part", "_n", "_copies")
    octave = F.floor(F.log2("_size"))
    few = (
        cells.where("_size > 0")
        .groupBy("_source", octave.alias("_octave"))
        .agg(
            F.array_distinct(
                F.array(
                    F.min_by(row, F.when(F.col("_copies") < F.col("_n") * MOST, F.struct("_size", "_part"))),
                    F.max_by(row, F.when(F.col("_copies") < F.col("_n") * MOST, F.struct("_size", "_part"))),
                    F.min_by(row, F.when(F.col("_copies") > 0, F.struct("_size", "_part"))),
                    F.max_by(row, F.when(F.col("_copies") > 0, F.struct("_size", "_part"))),
                )
            ).alias("few")
        )
        .select("_source", F.explode("few").alias("c"))
        .where("c is not null")
        .select("_source", "c.*")
    )
    change = (
        few.join(gap, "_source")
        .groupBy("_source")
        .applyInArrow(_settle, "_source string, _size long, _part long, _change long")
    )
    key = ["_source", "_size", "_part"]
    return cells.join(change, key, "left").select(
        *key, "_n", (F.col("_copies") + F.coalesce("_change", F.lit(0))).alias("_copies")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``key, size, source_size, target, rate, copies``.

    ``size``: words of the text (null: none). Sources go by code point, null last. ``copies`` is 0, 1 or
    2; a document without words gets its rounded rate, too. A rerun gives the same copies; which of
    equal documents are taken depends on a hash of the key, and rows that repeat a key fall as one
    by one in any order. Other columns are left out, whatever their names.
    """
    name = F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))
    sized = written(
        docs.select(F.col(key).alias("_key"), name.alias("_source"), word_count(F.col(text)).alias("_size")).withColumn(
            "_hash", F.xxhash64("_key")
        )
    )
    targets = written(source_targets(sized))
    counts = written(sized.groupBy("_source", "_size").agg(F.count("*").alias("_n")))
    multipliers = _multipliers(counts, targets)
    crowded = counts.where(F.col("_n") > CELL_ROWS).select("_source", "_size", F.ceil(F.col("_n") / CELL_ROWS).alias("_k"))
    parted = sized.join(_sent(written(crowded)), ["_source", "_size"], "left").withColumn(
        "_part", F.pmod(F.col("_hash"), F.coalesce("_k", F.lit(1))).cast("long")
    )
    cell = ["_source", "_size", "_part"]
    cells = (
        parted.groupBy(*cell)
        .agg(F.count("*").alias("_n"))
        .join(_sent(multipliers), "_source")
        .withColumn("_rate", F.when(F.col("_by") == float("inf"), F.lit(float(MOST))).when(F.col("_by") == -float("inf"), F.lit(0.0)).otherwise(_rate(F.col("_by"))))
        .withColumn("_due", F.round(F.col("_rate") * F.col("_n") * _UNIT).cast("long"))
        .select(*cell, "_n", "_rate", "_due")
    )
    rounded = written(_rounded(cells))
    copies = written(_near_target(rounded, targets))
    rates = rounded.select(*cell, "_rate")
    rank = Window.partitionBy(*cell).orderBy("_hash", "_key")
    own = F.floor(F.col("_copies") / F.col("_n")) + (F.col("_at") <= F.col("_copies") % F.col("_n")).cast("long")
    return (
        parted.withColumn("_at", F.row_number().over(rank))
        .join(copies.join(rates, cell), cell)
        .join(_sent(targets), "_source")
        .select(
            F.col("_key").alias(key),
            F.col("_size").alias("size"),
            "source_size",
            "target",
            F.col("_rate").alias("rate"),
            own.cast("int").alias("copies"),
        )
    )
