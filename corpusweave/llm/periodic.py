"""Runs: stretches of words that repeat with a period, found by online dyadic square catching.

Whenever an aligned block of ``2 ** k`` words is complete, a catcher is set up for it. Each word appended after that
completes a suffix of the same length, which is compared with the catcher's block: if they are equal at a distance
``q`` of ``2 ** k`` to ``2 ** (k + 1) - 1`` words, the catcher reports the start of a square of period ``q``. The
reports of neighbouring catchers at one distance are one stretch; stretches are compared word by word over their
margins and merge into runs. Blocks and suffixes are compared by hashes that are doubled from level to level, and all
the catchers of a level take their appended words at once, as numpy arrays over the texts of an Arrow batch: ``n log
n`` comparisons for ``n`` words. A report inside a run that is known from a lower level belongs to a multiple of its
period and goes at once, so that a text of one repeated word costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.words import find_words, mix, ramps, slices, word_column

#: A run holds so many words and so many periods, or more.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of margins that are compared at a time.
_COMPARED = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_DDL = "_key {key}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string"


def _caught(label: np.ndarray, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and distances at which the block's catcher meets its equal, outside the known runs."""
    blocks = max(len(label) // size, 1)
    suffixes = np.zeros(blocks * size, dtype=np.uint64)
    suffixes[: len(label) - size] = label[size:]
    block, step = np.nonzero(suffixes.reshape(blocks, size) == label[::size][:blocks, None])
    distance = step + size
    keep = (block * size + distance < len(label)) & (known[block * size] < distance + size)
    return block[keep], distance[keep]


def _stretches(word: np.ndarray, block: np.ndarray, distance: np.ndarray, size: int, periods: int):
    """Stretches ``[from, to)`` within which every word equals the one ``distance`` further on."""
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    new = np.ones(len(block), dtype=bool)
    new[1:] = (np.diff(block) != 1) | (np.diff(distance) != 0)
    head = np.flatnonzero(new)
    blocks = np.diff(np.append(head, len(block)))
    # A run holds this many whole blocks, of which the catchers report each.
    head, blocks = head[blocks >= periods - 2], blocks[blocks >= periods - 2]
    q = distance[head]
    low = np.maximum((block[head] - 1) * size, 0)
    high = np.minimum((block[head] + blocks + 1) * size, len(word) - q)
    part = np.cumsum(high - low) // _COMPARED
    for at in range(int(part[-1]) + 1 if len(part) else 0):
        some = np.flatnonzero(part == at)
        if not len(some):
            continue
        # One more place after each range, which is equal to nothing, ends its stretch.
        length = high[some] - low[some] + 1
        place = ramps(low[some], length)
        period = np.repeat(q[some], length)
        equal = np.zeros(len(place) + 1, dtype=bool)
        inside = np.ones(len(place), dtype=bool)
        inside[np.cumsum(length) - 1] = False
        equal[1:][inside] = word[place[inside]] == word[place[inside] + period[inside]]
        edge = np.flatnonzero(np.diff(equal)).reshape(-1, 2)
        yield place[edge[:, 0]], place[edge[:, 1] - 1] + 1, period[edge[:, 0]]


def runs_of(
    code: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, in the order of their starts and periods.

    ``code`` numbers the words of some texts, ``first[i]:first[i + 1]`` are those of text ``i``. A run is a stretch
    with ``least`` words and ``periods`` periods, or more, that no neighbouring word extends.
    """
    counts = np.diff(first)
    # Words of different texts are never equal.
    word = (code.astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    place = np.arange(len(word))
    own = np.repeat(counts, counts)
    label = mix(word.copy())
    known = np.zeros(len(word), dtype=np.int64)  # words from here to the end of the known run that reaches farthest
    found = []
    size, longest = 1, int(counts.max(initial=0))
    while periods * size <= longest:
        block, distance = _caught(label, size, known)
        new = []
        for start, stop, q in _stretches(word, block, distance, size, periods):
            use = (stop - start >= (periods - 1) * q) & (stop - start + q >= least)
            new.append((start[use], (stop - start + q)[use], q[use]))
        if new:
            start, length, q = (np.concatenate(c) for c in zip(*new))
            found.append((place[start], length, q))
            reach = np.zeros(len(word), dtype=np.int64)
            np.maximum.at(reach, start, start + length)
            np.maximum(known, np.maximum.accumulate(reach) - np.arange(len(word)), out=known)
        longer = np.zeros(len(label), dtype=np.uint64)
        longer[:-size] = label[size:]
        label = mix(label * _STEP + longer)
        size *= 2
        some = own >= periods * size
        if np.count_nonzero(some) < len(some) // 2:  # go on with the texts that are long enough
            word, place, own, label, known = word[some], place[some], own[some], label[some], known[some]
    if not found:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing, nothing
    start, length, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _collapse(least: int, periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch.column("text")):
                words = find_words(data, offsets)
                code = word_column(words).dictionary_encode().indices.to_numpy(zero_copy_only=False)[::2]
                start, length, q = runs_of(code, words.first, least, periods)
                cover = np.zeros(len(code) + 1, dtype=np.int32)
                np.add.at(cover, start + q, 1)
                np.add.at(cover, start + length, -1)
                stay = np.cumsum(cover[:-1]) == 0
                raw, kept = data.tobytes(), []
                for i in range(len(offsets) - 1):
                    some = stay[words.first[i] : words.first[i + 1]]
                    own = raw[offsets[i] : offsets[i + 1]].split()
                    kept.append(b" ".join(own if some.all() else compress(own, some)).decode())
                text = np.searchsorted(words.first, start, side="right") - 1
                listed = np.searchsorted(text, np.arange(len(offsets)))
                runs = pa.StructArray.from_arrays(
                    [pa.array(start - words.first[text]), pa.array(length), pa.array(q)], fields=list(_RUN)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_key").slice(part.start, part.stop - part.start),
                        pa.array(np.diff(words.first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(listed, pa.int32()), runs),
                        pa.array(kept, pa.string()),
                    ],
                    names=["_key", "n_words", "runs", "kept_text"],
                )

    return run


def collapse_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
) -> DataFrame:
    """One row per row of ``docs``: ``key, n_words, runs, kept_text``.

    ``runs``: start, length and smallest period of each run in words, counted from 0, in the order of start and period.
    ``kept_text``: the words that no run contains after its first period, joined by one space. Whole texts are worked
    on, each in the task that reads it; nothing is shuffled. Null, empty and wordless texts have no runs and keep the
    empty text. Keys of any type, null and repeated ones too, are passed on row by row. Other columns are left out,
    whatever their names.
    """
    if periods < 3 or least < 1:
        raise ValueError("a run has three periods and one word at least")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["_key"].dataType.simpleString()
    return texts.mapInArrow(_collapse(least, periods), _DDL.format(key=kind)).withColumnRenamed("_key", key)
