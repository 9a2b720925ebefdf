"""Near-duplicates of word shingles by MinHash with tensored banding.

Each set of shingles gets ``collections`` small hashes, each of ``rows`` minhashes. A table key is a
pair of two of them, so that 24 collections give 276 tables from 72 minhashes instead of 1,656. Two
sets are candidates if any two collections agree; at a similarity of 0.75 the odds of missing a
pair are 3e-5. Candidates are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.components import components
from corpusweave.llm.tables import within, written
from corpusweave.llm.words import find_words, mix, slices, windows

WIDTH = 5
PERCENT = 75
ROWS = 3
COLLECTIONS = 24
SEED = 20240607
#: Bits of a set's parity map: twice its size as a power of two, within these.
_MIN_BITS, _MAX_BITS = 1024, 4096
#: Shared items before its own that an item's row holds.
_BEFORE = 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts, sorted within each, and where each text's begin."""
    words = find_words(data, offsets)
    hashes = words.hashes(lower=True)
    first, value = windows(words, hashes, width)
    text = np.searchsorted(words.first, first, side="right") - 1
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):  # the whole sequence is one shingle
        whole = count[short].astype(np.uint64)
        for at in range(width - 1):
            there = np.flatnonzero(count[short] > at)
            whole[there] = mix(whole[there] ^ hashes[words.first[:-1][short[there]] + at])
        text, value = np.concatenate([text, short]), np.concatenate([value, whole])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(offsets)))


def _per_text(of: np.ufunc, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, dtype=value.dtype)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        out[some] = of.reduceat(value, bounds[:-1][some])
    return out


def _lists(value: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value).cast(kind))


def _signatures(width: int, rows: int, collections: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(seed)
        factor = odd.integers(0, 2**63, rows * collections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        start = odd.integers(0, 2**63, rows * collections, dtype=np.uint64)
        for batch in batches:
            for part, data, offsets in slices(batch.column("text")):
                value, bounds = shingle_sets(data, offsets, width)
                marks = np.zeros((len(bounds) - 1, collections), dtype=np.uint64)
                for c in range(collections):
                    for k in range(c * rows, c * rows + rows):
                        hashed = (value ^ start[k]) * factor[k]
                        hashed ^= hashed >> np.uint64(32)
                        marks[:, c] = marks[:, c] * factor[0] + _per_text(np.minimum, hashed, bounds)
                    marks[:, c] = mix(marks[:, c] + np.uint64(c))
                ids_ = batch.column("_id").slice(part.start, part.stop - part.start)
                every = np.arange(len(bounds)) * collections
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_,
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(_per_text(np.bitwise_xor, value, bounds).view(np.int64)),
                        pa.array(_per_text(np.add, mix(value.copy()), bounds).view(np.int64)),
                        _lists(marks.reshape(-1).view(np.int64), every, pa.int64()),
                    ],
                    names=["_id", "n_shingles", "f1", "f2", "marks"],
                )

    return run


def _parities(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps of 64-bit words, one after another, and where each begins: a bit tells whether an odd number of a set's
    hashes falls on it. The place is a hash's last bits, so the two halves of a map xor to the map of half the size."""
    n = np.diff(bounds)
    size = 2 ** np.ceil(np.log2(np.clip(2 * n, _MIN_BITS, _MAX_BITS))).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(starts[:-1], n) + (value & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=starts[-1]) & 1).astype(bool)
    return np.packbits(odd).view(np.int64), starts // 64


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch.column("text")):
                value, bounds = shingle_sets(data, offsets, width)
                bits, starts = _parities(value, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(part.start, part.stop - part.start),
                        pa.array(_per_text(np.bitwise_xor, value, bounds).view(np.int64)),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        _lists(value.view(np.int64), bounds, pa.int64()),
                        _lists(bits, starts, pa.int64()),
                    ],
                    names=["rep", "f1", "n", "items", "bits"],
                )

    return run


def _reaches(common: Column, left: Column, right: Column, percent: int) -> Column:
    return common * (100 + percent) >= (left + right) * percent


def _near_in_size(left: Column, right: Column, percent: int) -> Column:
    return F.least(left, right) * 100 >= F.greatest(left, right) * percent


def _may_reach(bits_a: str, bits_b: str, n: Column, percent: int) -> Column:
    """Bits in which two parity maps differ are a lower bound of the items in which the sets do.

    What both sets hold cancels out, so the bound is as good for long sets. The larger map is folded to the
    smaller's size. ``get`` raises nothing, so that Catalyst may evaluate the bound within a join.
    """
    a_is_longer = F.size(bits_a) > F.size(bits_b)
    long, short = (F.when(a_is_longer, x).otherwise(F.col(y)) for x, y in ((F.col(bits_a), bits_b), (F.col(bits_b), bits_a)))
    words = F.least(F.size(bits_a), F.size(bits_b))

    def differing(x: Column, at: Column) -> Column:
        for piece in range(_MAX_BITS // _MIN_BITS):
            x = x.bitwiseXOR(F.coalesce(F.get(long, at + words * piece), F.lit(0).cast("long")))
        return F.bit_count(x)

    same_size = F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    per_word = F.when(F.size(bits_a) == F.size(bits_b), same_size).otherwise(F.transform(short, differing))
    apart = F.aggregate(per_word, F.lit(0), lambda total, x: total + x)
    return apart * (100 + percent) <= n * (100 - percent)


def _side(table: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return table.select(F.col("rep").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that may reach the similarity by their maps."""
    small = ["n", "bits"]
    return (
        pairs.join(_side(sets, "a", small), "a")
        .join(_side(sets, "b", small), "b")
        .where(_may_reach("bits_a", "bits_b", F.col("n_a") + F.col("n_b"), percent))
        .select("a", "b")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    common = F.size(F.array_intersect("items_a", "items_b"))
    return (
        pairs.join(_side(sets, "b", ["items"]), "b")
        .join(_side(sets, "a", ["items"]), "a")
        .where(_reaches(common, F.size("items_a"), F.size("items_b"), percent))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    width: int = WIDTH,
    percent: int = PERCENT,
    rows: int = ROWS,
    collections: int = COLLECTIONS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``key, n_shingles, component_id, kept``.

    A-Z count as a-z. A text of fewer than ``width`` words is one shingle; one without words (or
    null) has none, is linked with nothing and is its own component. Texts of equal sets are merged
    before anything else, so copies cost one row each. Documents are linked if ``100 * common >=
    percent * union``; a component's id is its least key. Rows that repeat a key are one document
    with several texts: a link of any of them counts, and each row gets the key's result. A row
    without a key is linked with nothing and kept, with a null component. Other columns of
    ``docs`` are left out, whatever their names.

    A bucket is first compared with its least member. Members that are then still apart are
    compared exactly, by rare shingles; so no candidate is dropped, and a large group of copies
    costs its size.
    """
    rows_ = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("text"))
    marked = written(
        rows_.mapInArrow(
            _signatures(width, rows, collections, seed),
            "_id long, n_shingles long, f1 long, f2 long, marks array<long>",
        )
    )
    same = ["n_shingles", "f1", "f2"]
    distinct = written(
        marked.where("n_shingles > 0 and _id is not null")
        .groupBy(*same)
        .agg(F.min("_id").alias("rep"), F.first("marks").alias("marks"))
    )
    live = written(_buckets(distinct))
    in_reach = _near_in_size(F.col("n"), F.col("n_a"), percent)
    first_pairs = written(
        live.where((F.col("rep") != F.col("a")) & in_reach).select("a", F.col("rep").alias("b")).distinct()
    )
    sets = written(
        within(rows_, live.select(F.col("rep").alias("_id")), "_id").mapInArrow(
            _sets(width), "rep long, f1 long, n long, items array<long>, bits array<long>"
        )
    )
    placed = components(_confirmed(_likely(first_pairs, sets, percent), sets, percent))
    more = written(_still_apart(live, sets, placed, percent))
    links = placed.select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = links.unionByName(_confirmed(more, sets, percent))
    nodes = marked.drop("marks").join(distinct.drop("marks"), same, "left")
    nodes = written(nodes.select("_id", "n_shingles", F.expr("if(_id is null, null, coalesce(rep, _id))").alias("rep")))
    low = nodes.groupBy("_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_high")).where("a < _high")
    repeated = nodes.join(low, "_id").select("a", F.col("rep").alias("b"))
    groups = components(links.unionByName(repeated))
    return (
        nodes.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component_id", F.coalesce("component", "rep"))
        .select(
            F.col("_id").alias(key),
            "n_shingles",
            "component_id",
            F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def _buckets(distinct: DataFrame) -> DataFrame:
    """``bucket, rep, n`` of tables where sets meet, with the bucket's least set ``a`` of size ``n_a``.

    A small hash that no other set has can be in no shared table, so only shared ones are paired.
    """
    marks = distinct.select("rep", F.col("n_shingles").alias("n"), F.posexplode("marks").alias("c", "mark"))
    shared = marks.groupBy("mark").agg(F.count("*").alias("_n")).where("_n > 1").select("mark")
    alive = (
        marks.join(shared, "mark")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("c", "mark"))).alias("m"))
        .where("size(m) > 1")
    )
    tables = written(
        alive.select("rep", "n", F.posexplode("m").alias("at", "one"), "m")
        .select("rep", "n", "one", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("two"))
        .select("rep", "n", F.xxhash64("one.c", "one.mark", "two.c", "two.mark").alias("bucket"))
    )
    least = (
        tables.groupBy("bucket")
        .agg(F.count("*").alias("_n"), F.min(F.struct("rep", "n")).alias("low"))
        .where("_n > 1")
        .select("bucket", F.col("low.rep").alias("a"), F.col("low.n").alias("n_a"))
    )
    return tables.join(least, "bucket")


def _still_apart(live: DataFrame, sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be similar among sets that met in a bucket but are in different components.

    A crowded bucket may hold very many sets just below the similarity, so its pairs are not listed.
    The sets of such buckets are brought together exactly, by their rarest shingles: two sets that
    are similar share one of the rarest ``n - least overlap + 1`` of each, in one order of all
    shingles. A set with too many shingles of its own shares none. A pair that shares an item just
    before another has been listed there, so it is not listed again; parity maps refute most pairs
    below the similarity inside the join.
    """
    member = written(
        live.select("bucket", "rep")
        .join(placed.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    crowded = (
        member.groupBy("bucket")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .where("_low < _high")
        .select("bucket")
    )
    suspects = member.join(crowded, "bucket").select("rep", "component").distinct()
    own = sets.join(suspects, "rep")
    items = written(own.select("rep", "f1", "n", "component", F.explode("items").alias("item")))
    common = items.groupBy("item").agg(F.count("*").alias("_df")).where("_df > 1")
    shared = (
        items.join(common, "item")
        .groupBy("rep", "f1", "n", "component")
        .agg(F.sort_array(F.collect_list(F.struct("_df", "item"))).alias("shared"))
    )
    n = F.col("n")
    lone = n - F.size("shared")

    def rare(share: int, of: int) -> Column:
        """How many of the rarest may be needed to meet ``n * share / of`` common items, less the lone ones."""
        least = F.floor((n * share + (of - 1)) / of)
        return F.greatest(n - least + 1 - lone, F.lit(0)).cast("int")

    to_probe, to_index = rare(percent, 100), rare(2 * percent, 100 + percent)
    whole = ["rep", "n", "component", "bits"]
    rarest = written(
        shared.where(to_probe > 0)
        .join(sets.select("rep", "f1", "bits"), ["rep", "f1"])
        .select(*whole, to_index.alias("_index"), F.slice("shared.item", F.lit(1), to_probe).alias("r"))
        .select(*whole, "_index", "r", F.posexplode("r").alias("at", "item"))
        .select(*whole, "item", (F.col("at") < F.col("_index")).alias("_first"), _before("r", F.col("at")).alias("before"))
    )
    shorter = rarest.where("_first").select("item", *(F.col(c).alias(f"{c}_a") for c in [*whole, "before"]))
    return (
        rarest.join(shorter, "item")
        .where(F.struct("n_a", "rep_a") < F.struct("n", "rep"))
        .where((F.col("component") != F.col("component_a")) & _near_in_size(n, F.col("n_a"), percent))
        .where(~F.arrays_overlap("before", "before_a"))
        .where(_may_reach("bits_a", "bits", F.col("n_a") + n, percent))
        .select(F.col("rep_a").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )


def _before(items: str, at: Column) -> Column:
    """The last few items before the one at place ``at``."""
    few = F.least(at, F.lit(_BEFORE))
    return F.slice(items, at - few + 1, few)
