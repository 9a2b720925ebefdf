"""Training documents that hold a benchmark item, also edited: rare n-gram seeds, then Smith-Waterman.

Words are runs of letters and digits in lower case. A seed is three successive words of an item whose words are rare
together: their shares of all words of the corpus, multiplied, are small. Rarity is judged by
single words, since the n-grams of an item that leaked often are frequent themselves. Wherever seeds of an
item meet a document on nearby diagonals, the passage is aligned with the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.words import Words, find_words, slices, windows

SEED_WORDS = 3
#: A seed may be expected once in so many words of unrelated text.
SEED_RARITY = 1e7
#: Score of the alignment, of that of the item with itself.
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items that are sent to every task at once; more items are looked for in further passes.
BLOCK_WORDS = 1 << 20
_TABLE_BITS = 22

_GAP_BYTES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _word_hashes(data: np.ndarray, offsets: np.ndarray):
    words = find_words(data, offsets, _GAP_BYTES)
    return words, words.hashes(lower=True)


@dataclass
class Items:
    """A block of items: hashes of their words, and their seeds sorted by hash."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray
    seeds: np.ndarray | None = None
    item: np.ndarray | None = None
    place: np.ndarray | None = None


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    """Items in blocks of bounded size, one after another; rows of one partition at a time reach the driver."""
    ids, words, held = [], [], 0

    def block() -> Items:
        return Items(ids, words, np.unique(np.concatenate(words)))

    rows = benchmark.select(F.col(item), F.lower(F.col(text).cast("string"))).where(F.col(text).isNotNull())
    for id_, value in rows.toLocalIterator():
        raw = value.encode()
        _, hashes = _word_hashes(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        if not len(hashes):
            continue
        ids.append(id_)
        words.append(hashes)
        held += len(hashes)
        if held >= BLOCK_WORDS:
            yield block()
            ids, words, held = [], [], 0
    if ids:
        yield block()


def _find(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``values`` that are in ``sorted_``, and where there."""
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    hit = np.flatnonzero(sorted_[at] == values)
    return hit, at[hit]


def _table(values: np.ndarray) -> np.ndarray:
    """Which hashes may be among ``values``, by some of their bits."""
    out = np.zeros(1 << _TABLE_BITS, dtype=bool)
    out[(values & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
    return out


def _may(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(table[(values & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])


def _count_words(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(vocabulary)
        counts, total = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                _, hashes = _word_hashes(data, offsets)
                total += len(hashes)
                _, at = _find(vocabulary, hashes[_may(table, hashes)])
                counts += np.bincount(at, minlength=len(vocabulary))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(counts[some], total), pa.int64())],
            names=["at", "n"],
        )

    return run


def _choose_seeds(items: Items, frequency: dict[int, int]) -> None:
    """Seeds of each item: its n-grams that are rare, and the rarest quarter in any case."""
    total = max(1, frequency.pop(-1, 1))
    share = np.full(len(items.vocabulary), 1.0 / (total + 1))
    for at, n in frequency.items():
        share[at] = (n + 1) / (total + 1)
    seeds, owners, places = [], [], []
    for number, words in enumerate(items.words):
        width = min(SEED_WORDS, len(words))
        first, value = windows(_one_text(words), words, width)
        chance = np.ones(len(first))
        for k in range(width):
            chance *= share[np.searchsorted(items.vocabulary, words[first + k])]
        use = (chance * SEED_RARITY <= 1) | (np.argsort(np.argsort(chance)) < max(2, len(first) // 4))
        # Short items have seeds of fewer words, which are told apart by their width.
        seeds.append(value[use] + np.uint64(width - SEED_WORDS & 3))
        owners.append(np.full(int(use.sum()), number))
        places.append(first[use])
    seed = np.concatenate(seeds)
    order = np.argsort(seed, kind="stable")
    items.seeds, items.item, items.place = seed[order], np.concatenate(owners)[order], np.concatenate(places)[order]


def _one_text(words: np.ndarray) -> Words:
    """Words of one text, as ``windows`` wants them."""
    n = len(words)
    return Words(np.zeros(0, np.uint8), np.array([0, 0]), np.arange(n), np.arange(n), np.array([0, n]))


def _local_scores(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman scores of pairs of word sequences, and where in ``right`` each ends.

    All pairs advance together, a word of ``left`` at a time; gaps in a row are closed by a running maximum.
    """
    rows, columns = max(map(len, left)), max(map(len, right))
    a = np.zeros((len(left), rows), dtype=np.uint64)
    b = np.zeros((len(right), columns), dtype=np.uint64)
    a_in, b_in = np.zeros(a.shape, dtype=bool), np.zeros(b.shape, dtype=bool)
    for i, (x, y) in enumerate(zip(left, right)):
        a[i, : len(x)], a_in[i, : len(x)] = x, True
        b[i, : len(y)], b_in[i, : len(y)] = y, True
    above = np.zeros((len(left), columns + 1), dtype=np.int32)
    slope = (np.arange(columns + 1) * -GAP).astype(np.int32)
    best, end = np.zeros(len(left), dtype=np.int32), np.zeros(len(left), dtype=np.int64)
    for i in range(rows):
        same = (b == a[:, i : i + 1]) & b_in & a_in[:, i : i + 1]
        now = np.zeros_like(above)
        now[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP)
        now = np.maximum(np.maximum.accumulate(now + slope, axis=1) - slope, 0).astype(np.int32)
        now[~a_in[:, i]] = 0
        at = now.argmax(axis=1)
        top = now[np.arange(len(left)), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above = now
    return best, end


_FOUND = pa.schema(
    [("_id", pa.int64()), ("_item", pa.int64()), ("score", pa.float64()), ("word_from", pa.int64()), ("word_to", pa.int64())]
)


def _passages(items: Items, table: np.ndarray, hashes: np.ndarray, words, width: int, tag: int) -> tuple[np.ndarray, ...]:
    """Text, item and diagonal of each seed that is met."""
    first, value = windows(words, hashes, width)
    value = value + np.uint64(tag)
    may = _may(table, value)
    first, value = first[may], value[may]
    low, high = np.searchsorted(items.seeds, value), np.searchsorted(items.seeds, value, side="right")
    times = high - low
    first = np.repeat(first, times)
    seed = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    text = np.searchsorted(words.first, first, side="right") - 1
    return text, items.item[seed], first - words.first[text] - items.place[seed], items.place[seed]


def _align(items: Items, min_score: float):
    lengths = np.array([len(w) for w in items.words])
    widths = sorted({min(SEED_WORDS, n) for n in lengths.tolist()})

    def found(table: np.ndarray, hashes: np.ndarray, words) -> Iterator[tuple[int, int, float, int, int]]:
        hits = [_passages(items, table, hashes, words, width, width - SEED_WORDS & 3) for width in widths]
        text, item, diagonal, place = (np.concatenate(c) for c in zip(*hits))
        if not len(text):
            return
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal, place = text[order], item[order], diagonal[order], place[order]
        slack = lengths[item] // 4 + 2
        cut = np.ones(len(text), dtype=bool)
        cut[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
        begin = np.flatnonzero(cut)
        stop = np.r_[begin[1:], len(text)]
        # Words that seeds can tell of; a single seed is too little for a long item.
        enough = (stop - begin >= 2) | (lengths[item[begin]] < 3 * SEED_WORDS)
        jobs = []
        for a, b in zip(begin[enough], stop[enough]):
            base, m = words.first[text[a]], int(lengths[item[a]])
            low = max(base, base + int(diagonal[a]) - int(slack[a]))
            high = min(words.first[text[a] + 1], base + int(diagonal[b - 1]) + m + int(slack[a]))
            jobs.append((int(text[a]), int(item[a]), int(low), int(high), int(base)))
        jobs.sort(key=lambda j: (j[3] - j[2], j))
        for at in range(0, len(jobs), 256):
            some = jobs[at : at + 256]
            left = [items.words[j[1]] for j in some]
            right = [hashes[j[2] : j[3]] for j in some]
            score, end = _local_scores(left, right)
            share = score / (MATCH * lengths[[j[1] for j in some]])
            good = np.flatnonzero(share >= min_score)
            if not len(good):
                continue
            # From the end backwards, the same alignment tells where it begins.
            _, back = _local_scores([left[g][::-1] for g in good], [right[g][: end[g]][::-1] for g in good])
            for g, length in zip(good.tolist(), back.tolist()):
                text_, item_, low, _, base = some[g]
                last = low - base + int(end[g])
                yield text_, item_, float(share[g]), last - length, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(items.seeds)
        for batch in batches:
            id_ = batch.column("_id").to_pylist()
            for part, data, offsets in slices(batch.column("text")):
                words, hashes = _word_hashes(data, offsets)
                best: dict[tuple[int, int], tuple] = {}
                for text, item, score, begin, end in found(table, hashes, words):
                    key, value = (text, item), (score, -begin, end)
                    best[key] = max(best.get(key, value), value)
                rows = [(id_[part.start + t], items.ids[i], s, -b, e) for (t, i), (s, b, e) in best.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND
                    )

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """``key, item, score, word_from, word_to``: a row for each document and item that it holds.

    ``score``: the best local alignment of the item in the document, 1 for a whole copy; the words
    of the passage count from 0, the end exclusive. Case and punctuation don't matter. Null or wordless texts
    and items match nothing; an item of fewer words than a seed is its own seed. Keys are integers; a null key is given
    back as null, and rows that repeat a key each give their own rows. Other columns are left out.

    The items, in blocks of ``BLOCK_WORDS`` words, go to every task; documents stay where they are.
    """
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.lower(F.col(text).cast("string")).alias("text"))
    out = None
    for items in _blocks(benchmark.select(F.col(item).cast("long").alias(item), item_text), item, item_text):
        counts = texts.select("text").mapInArrow(_count_words(items.vocabulary), "at long, n long")
        _choose_seeds(items, {r["at"]: r["n"] for r in counts.groupBy("at").agg(F.sum("n").alias("n")).collect()})
        found = texts.mapInArrow(
            _align(items, min_score), "_id long, _item long, score double, word_from long, word_to long"
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.select("_id", F.col("_id").alias("_item"), F.lit(0.0).alias("score"), F.col("_id").alias("word_from"), F.col("_id").alias("word_to")).limit(0)
    return out.select(F.col("_id").alias(key), F.col("_item").alias(item), "score", "word_from", "word_to")
