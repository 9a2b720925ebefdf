"""Ranked search of many items at once, which share the work on what their terms have in common.

The items' terms are mined for sets that several items share: terms that the same items hold, equally often, are one
set, and neighbouring sets that stay together in two items or more are paired, and the pairs again. The sets are the
nodes of a graph whose leaves are terms and whose ends are items. A node's accumulator holds a partial score of each
document; it is worked out once from those of its parts and goes into all nodes and items above it.

Documents stay where they are: a first pass keeps the counts of the items' terms in each, the corpus statistics follow
from these, and a second pass works out the accumulators of some documents at a time and keeps the best of each item.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.tables import LAST_ID, written
from corpusweave.llm.words import Words, find_words, ramps, slices, word_column

TOP = 10
#: Terms of items that are sent to every task at once; more items are looked for in further passes.
BLOCK_TERMS = 1 << 20
#: Accumulators that are held at a time: documents times nodes.
_HELD = 1 << 21
# Share of the score's length norm, in hundredths, and its other fixed values.
_NORM, _UNIT = 75, 1_000_000_000

_BETWEEN_TERMS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of ASCII letters and digits and of anything beyond ASCII; only A-Z become lower case."""
    return find_words(_LOWER[data], offsets, _BETWEEN_TERMS)


@dataclass
class Sharing:
    """Nodes: first the terms, then what is shared, then the items. ``steps``: child, parent and factor, by level."""

    terms: int
    items: int  # the first node that is an item
    nodes: int
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def share(items: list[dict[int, int]], terms: int) -> Sharing:
    """Mine the sets of terms that items share; each item maps its terms to how often it repeats them."""
    parts: dict[int, list[tuple[int, int]]] = {}
    holders: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at, item in enumerate(items):
        for term, times in item.items():
            holders[term].append((at, times))
    alike: dict[tuple, list[int]] = defaultdict(list)
    for term, where in holders.items():
        alike[tuple(where)].append(term)
    lists: list[list[tuple[int, int]]] = [[] for _ in items]
    alone: list[list[tuple[int, int]]] = [[] for _ in items]
    # The sets of most items first, so that they become neighbours.
    for where, some in sorted(alike.items(), key=lambda pair: (-len(pair[0]), pair[1])):
        if len(where) == 1:
            alone[where[0][0]].extend((term, where[0][1]) for term in some)
            continue
        node = some[0]
        if len(some) > 1:
            node = terms + len(parts)
            parts[node] = [(term, 1) for term in some]
        for at, times in where:
            lists[at].append((node, times))
    while True:
        counts = Counter(pair for one in lists for pair in zip(one, one[1:]))
        made: dict[tuple, int] = {}
        for at, one in enumerate(lists):
            out, i = [], 0
            while i < len(one):
                pair, after = tuple(one[i : i + 2]), tuple(one[i + 1 : i + 3])
                if counts[pair] > 1 and counts[pair] >= counts[after]:
                    if pair not in made:
                        made[pair] = terms + len(parts)
                        parts[made[pair]] = list(pair)
                    out.append((made[pair], 1))
                    i += 2
                else:
                    out.append(one[i])
                    i += 1
            lists[at] = out
        if not made:
            break
    first = terms + len(parts)
    for at in range(len(items)):
        parts[first + at] = lists[at] + alone[at]
    level = [0] * (first + len(items))
    by_level: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for node, below in parts.items():  # parts come before what holds them
        level[node] = 1 + max((level[child] for child, _ in below), default=0)
        by_level[level[node]].extend((child, node, times) for child, times in below)
    steps = [tuple(np.array(c, dtype=np.int64) for c in zip(*by_level[at])) for at in sorted(by_level) if by_level[at]]
    return Sharing(terms, first, len(level), steps)


def combine(sharing: Sharing, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int):
    """``(item, doc, score)`` of the items' accumulators from those of the terms; ``doc`` is below ``docs``."""
    order = np.argsort(term, kind="stable")
    node, doc, value = term[order], doc[order], value[order]
    begin, held = np.zeros(sharing.nodes, dtype=np.int64), np.zeros(sharing.nodes, dtype=np.int64)

    def place(made: np.ndarray, shift: int) -> None:
        head = np.flatnonzero(np.diff(made, prepend=-1))
        begin[made[head]] = head + shift
        held[made[head]] = np.diff(np.append(head, len(made)))

    place(node, 0)
    for child, parent, times in sharing.steps:
        count = held[child]
        at = ramps(begin[child], count)
        where = np.repeat(parent, count) * docs + doc[at]
        what = value[at] * np.repeat(times, count)
        order = np.argsort(where, kind="stable")
        where, what = where[order], what[order]
        head = np.flatnonzero(np.diff(where, prepend=-1))
        if not len(head):
            continue
        made = where[head] // docs
        place(made, len(node))
        node = np.concatenate([node, made])
        doc = np.concatenate([doc, where[head] % docs])
        value = np.concatenate([value, np.add.reduceat(what, head)])
    end = node >= sharing.items
    return node[end] - sharing.items, doc[end], value[end]


def _best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, top: int):
    """The ``top`` rows of each item: highest score, then lowest document."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    head = np.flatnonzero(np.diff(item, prepend=-1))
    rank = np.arange(len(item)) - np.repeat(head, np.diff(np.append(head, len(item))))
    keep = rank < top
    return item[keep], doc[keep], score[keep]


def _count_terms(vocabulary: pa.Array):
    kinds = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch.column("text")):
                words = _terms(data, offsets)
                count = np.diff(words.first)
                found = pc.index_in(word_column(words), value_set=vocabulary).fill_null(-1).to_numpy()[::2]
                text = np.repeat(np.arange(len(count)), count)
                hit = found >= 0
                pair, times = np.unique(text[hit] * kinds + found[hit], return_counts=True)
                bounds = pa.array(np.searchsorted(pair, np.arange(len(count) + 1) * kinds), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(part.start, part.stop - part.start),
                        pa.array(count, pa.int64()),
                        pa.ListArray.from_arrays(bounds, pa.array(pair % kinds, pa.int32())),
                        pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
                    ],
                    names=["_id", "n", "terms", "times"],
                )
                yield out.filter(pa.array(count > 0))

    return run


def _score(sharing: Sharing, weight: np.ndarray, all_docs: int, all_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, dtype=np.int64)
        best = (nothing, nothing, nothing)
        least = np.zeros(sharing.nodes - sharing.items, dtype=np.int64)  # that a row has to reach for its item
        width = max(1, _HELD // sharing.nodes)
        for whole in batches:
            for at in range(0, whole.num_rows, width):
                batch = whole.slice(at, width)
                id_ = batch.column("_id").to_numpy(zero_copy_only=False)
                norm = 100 - _NORM + _NORM * batch.column("n").to_numpy() * all_docs // all_terms
                count = batch.column("terms").value_lengths().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), count)
                term = batch.column("terms").flatten().to_numpy()
                times = batch.column("times").flatten().to_numpy().astype(np.int64)
                value = weight[term] * (_UNIT * times // (1000 * times + 8 * norm[doc]))
                item, doc, score = combine(sharing, term.astype(np.int64), doc, value, batch.num_rows)
                use = (score > 0) & (score >= least[item])
                best = _best(*(np.concatenate(c) for c in zip(best, (item[use], id_[doc[use]], score[use]))), top)
                full = np.flatnonzero(np.diff(best[0], prepend=-1)) + top - 1
                full = full[full < len(best[0])]
                full = full[best[0][full] == best[0][full - top + 1]]
                least[best[0][full]] = best[2][full]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best], names=["_item", "_id", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[dict[int, int]], pa.Array]]:
    """Ids, terms and vocabulary of items in blocks of bounded size; rows of one partition at a time reach the driver."""
    ids: list = []
    counted: list[dict[int, int]] = []
    codes: dict[bytes, int] = {}
    held = 0
    for id_, text in items.toLocalIterator():
        raw = text.encode()
        words = _terms(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        terms = Counter(word_column(words).to_pylist()[::2])
        if not terms:
            continue
        ids.append(id_)
        counted.append({codes.setdefault(term, len(codes)): times for term, times in terms.items()})
        held += len(terms)
        if held >= BLOCK_TERMS:
            yield ids, counted, pa.array(list(codes), pa.large_binary())
            ids, counted, codes, held = [], [], {}, 0
    if ids:
        yield ids, counted, pa.array(list(codes), pa.large_binary())


def ranked(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
) -> DataFrame:
    """``item, rank, key, score``: the ``top`` documents of each item with a score above 0, ranks from 1.

    Scores are sums over the terms of the item, repeats included, of a weight for rarity times a share of occurrences
    that grows less than in proportion and is set against the document's length; all in whole numbers, so that equal
    texts have equal scores in any order of work. Equal scores rank by ascending key, null keys last. Null and
    termless texts are no documents, null and termless items find nothing. Rows that repeat a key are documents of
    their own; rows that repeat an item id are items of their own, each with its ranks. Keys are integers, item ids of
    any type. Other columns are left out, whatever their names.

    The items go to every task in blocks of ``BLOCK_TERMS`` terms, documents are read once for each block.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("_id"), F.col(text).cast("string").alias("text")
    )
    asked = items.select(F.col(item).alias("_item"), F.col(item_text).cast("string").alias("text"))
    item_type, key_type = asked.schema["_item"].dataType, docs.schema[key].dataType
    out = None
    for ids, counted, vocabulary in _blocks(asked.where(F.col("text").isNotNull())):
        counts = written(texts.mapInArrow(_count_terms(vocabulary), "_id long, n long, terms array<int>, times array<int>"))
        all_docs, all_terms = counts.agg(F.count("*"), F.sum("n")).first()
        holding = np.zeros(len(vocabulary), dtype=np.int64)
        # One row per term of the block.
        for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holding[row["term"]] = row["count"]
        weight = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * n + 1))) for n in holding.tolist()])
        scored = counts.mapInArrow(
            _score(share(counted, len(vocabulary)), weight, all_docs, all_terms or 1, top), "_item long, _id long, score long"
        )
        order = Window.partitionBy("_item").orderBy(F.desc("score"), "_id")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(
            list(enumerate(ids)), f"_item long, _name {item_type.simpleString()}"
        )
        found = best.join(F.broadcast(names), "_item").select(
            F.col("_name").alias(item),
            "rank",
            F.when(F.col("_id") != F.lit(LAST_ID), F.col("_id")).cast(key_type).alias(key),
            "score",
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = F.lit(None)
        out = texts.limit(0).select(
            none.cast(item_type).alias(item), none.cast("int").alias("rank"), none.cast(key_type).alias(key), none.cast("long").alias("score")
        )
    return out
