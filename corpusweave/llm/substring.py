"""Removal of word passages that an earlier document has, found by difference-cover anchors.

A window of 13 words is looked for by anchors of 7 words that start at places 1, 2 and 4 modulo 7.
These three places cover every difference modulo 7, so wherever two documents hold the same window,
one anchor inside it starts at a covered place of both. So only three words in seven are hashed
and sent out. Windows around an anchor that two documents share are then extended to the full 13
words and compared by a hash of all of them.

Both exchanges send packed arrays to buckets of hashes. The number of buckets follows the number
of words, so a bucket has a bounded share; a passage counts once for each run of texts that one
task reads together, however many of them have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.tables import LAST_ID, ids, within, written
from corpusweave.llm.words import find_words, mix, slices, windows

WIDTH = 13
#: A perfect difference set: every number is a difference of two of these, modulo the period.
PERIOD, COVER = 7, (1, 2, 4)
#: Hashes that a bucket takes, about.
BUCKET_HASHES = 2 << 20
#: Bytes of text whose hashes are merged in a task before they are sent.
MERGE_BYTES = 16 << 20

_SENT_DDL = "bucket int, docs array<long>, hashes array<{kind}>, marks array<long>"


def _schema(kind: pa.DataType) -> pa.Schema:
    """Hashes for a bucket with their documents, or marks that the documents have been told of already."""
    long = pa.list_(pa.int64())
    return pa.schema([("bucket", pa.int32()), ("docs", long), ("hashes", pa.list_(kind)), ("marks", long)])


_REPLY = pa.schema([("to", pa.int32()), ("docs", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in the text and hash of each anchor of texts that have a whole window."""
    words = find_words(data, offsets)
    first, value = windows(words, words.hashes(), WIDTH - PERIOD + 1)
    text = np.searchsorted(words.first, first, side="right") - 1
    place = first - words.first[text]
    use = np.isin(place % PERIOD, COVER) & (np.diff(words.first)[text] >= WIDTH)
    return text[use], place[use], value[use]


def _own(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hashes that also tell the texts of one slice apart."""
    return value ^ mix(text.astype(np.uint64) + np.uint64(1))


def _groups(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash and owner, where each hash begins, and the group of each place."""
    order = np.lexsort((owner, value))
    sorted_ = value[order]
    begin = np.ones(len(order), dtype=bool)
    begin[1:] = sorted_[1:] != sorted_[:-1]
    return order, np.flatnonzero(begin), np.cumsum(begin) - 1


def _packed(part: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Columns cut by a number of each place: the number, then a piece of each column."""
    order = np.argsort(part, kind="stable")
    columns = [c[order] for c in columns]
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for number in np.flatnonzero(np.diff(cut)):
        yield int(number), *(c[cut[number] : cut[number + 1]] for c in columns)


def _home(docs: np.ndarray, parts: int) -> np.ndarray:
    """Where the replies of a document are gathered."""
    return (mix(docs.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _sendable(value: np.ndarray, owner: np.ndarray, buckets: int, earliest: bool) -> Iterator[tuple]:
    """Rows for hashes with the documents that have them; repeats within are settled in place.

    A hash goes out once, with its least document. ``earliest``: the other documents are told at
    once that an earlier one has it; else all of them are told that another one has it. Without
    ``earliest`` the hashes are codes of ``_codes``, of which only the lower half has to be sent.
    """
    if not len(value):
        return
    order, begin, group = _groups(value, owner)
    value, owner = value[order], owner[order]
    told = owner != owner[begin][group]
    if not earliest:
        shared = np.zeros(len(begin), dtype=bool)
        shared[group[told]] = True
        told = shared[group]
    for home, docs, marks in _packed(_home(owner[told], buckets), buckets, owner[told], value[told].view(np.int64)):
        yield home, docs, None, marks
    value, owner = value[begin], owner[begin]
    order = np.argsort(owner, kind="stable")  # documents together, so that their column packs well
    value, owner = value[order], owner[order]
    if earliest:
        bucket = ((value >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
        sent = value.view(np.int64)
    else:
        bucket = (value >> np.uint64(32)).astype(np.int64)
        sent = value.astype(np.uint32).view(np.int32)
    for number, docs, hashes in _packed(bucket, buckets, owner, sent):
        yield number, docs, hashes, None


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(column), field.type) for column, field in zip(zip(*held), schema)], schema=schema
        )

    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch()
            held = []
    if held:
        yield batch()


def _codes(value: np.ndarray, buckets: int) -> np.ndarray:
    """Shorten hashes to 32 bits within a bucket; a clash only leads to a second look."""
    return ((value & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)) << np.uint64(32) | value >> np.uint64(32)


def _sent_in_runs(parts: Iterator[tuple[int, np.ndarray, np.ndarray]], buckets: int, earliest: bool) -> Iterator[tuple]:
    """Merge hashes of some texts (bytes of the texts, hashes, documents) before they are sent."""
    values, owners, held = [], [], 0
    for size, value, owner in parts:
        values.append(value)
        owners.append(owner)
        held += size
        if held > MERGE_BYTES:
            yield from _sendable(np.concatenate(values), np.concatenate(owners), buckets, earliest)
            values, owners, held = [], [], 0
    if values:
        yield from _sendable(np.concatenate(values), np.concatenate(owners), buckets, earliest)


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                id_ = batch.column("_id").to_numpy(zero_copy_only=False)
                for part, data, offsets in slices(batch.column("text")):
                    text, _, value = _anchors(data, offsets)
                    yield len(data), _codes(value, buckets), id_[part][text]

        return _batches(_sent_in_runs(parts(), buckets, False), _schema(pa.int32()))

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _settle(earliest: bool, buckets: int):
    """For the hashes of one bucket, tell the documents whose hash another (earlier) one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, owners, marks, docs = [], [], [], []
        for batch in batches:
            fresh = batch.column("hashes").is_valid()
            told, sent = batch.filter(pc.invert(fresh)), batch.filter(fresh)
            docs.append(_flat(told.column("docs")))
            marks.append(_flat(told.column("marks")))
            if sent.num_rows:
                value = _flat(sent.column("hashes"))
                if not earliest:
                    high = np.uint64(sent.column("bucket")[0].as_py()) << np.uint64(32)
                    value = value.view(np.uint32).astype(np.uint64) | high
                values.append(value.view(np.uint64))
                owners.append(_flat(sent.column("docs")))
        if values:
            value, owner = np.concatenate(values), np.concatenate(owners)
            values, owners = [], []
            order, begin, group = _groups(value, owner)
            value, owner = value[order], owner[order]
            told = owner != owner[begin][group]
            if not earliest:
                shared = np.zeros(len(begin), dtype=bool)
                shared[group[told]] = True
                told = shared[group]
            docs.append(owner[told])
            marks.append(value[told].view(np.int64))
        doc, mark = np.concatenate(docs), np.concatenate(marks)
        yield from _batches(_packed(_home(doc, buckets), buckets, doc, mark), _REPLY)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, marks = [], []
    for batch in batches:
        docs.append(_flat(batch.column("docs")))
        marks.append(_flat(batch.column("marks")))
    doc, mark = np.concatenate(docs), np.concatenate(marks)
    order = np.argsort(doc, kind="stable")
    doc, mark = doc[order], mark[order]
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    bounds = pa.array(np.r_[begin, len(doc)], pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[begin]), pa.ListArray.from_arrays(bounds, pa.array(mark))], names=["_id", "marks"]
    )


def _told(sent: DataFrame, earliest: bool, buckets: int) -> DataFrame:
    """``_id, marks``: for each document the hashes it has been told of."""
    settled = sent.groupBy("bucket").applyInArrow(
        _settle(earliest, buckets), "to int, docs array<long>, marks array<long>"
    )
    return written(settled.groupBy("to").applyInArrow(_by_document, "_id long, marks array<long>"))


def _marks(column: pa.Array, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Text within the slice and hash of each mark."""
    column = column.slice(part.start, part.stop - part.start)
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths), _flat(column).view(np.uint64)


def _send_windows(buckets: int):
    """Extend shared anchors to windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                id_ = batch.column("_id").to_numpy(zero_copy_only=False)
                for part, data, offsets in slices(batch.column("text")):
                    words = find_words(data, offsets)
                    text, place, anchor = _anchors(data, offsets)
                    mark_text, mark = _marks(batch.column("marks"), part)
                    hit = np.isin(_own(text, _codes(anchor, buckets)), _own(mark_text, mark))
                    first, value = windows(words, words.hashes(), WIDTH)
                    near = np.zeros(len(words.start) + 1, dtype=np.int64)
                    near[words.first[text[hit]] + place[hit]] = 1
                    near = np.concatenate([[0], np.cumsum(near)])
                    # The anchor starts in one of the first places of the window.
                    use = near[first + PERIOD] > near[first]
                    owner = np.searchsorted(words.first, first[use], side="right") - 1
                    yield len(data), value[use], id_[part][owner]

        return _batches(_sent_in_runs(parts(), buckets, True), _schema(pa.int64()))

    return run


_DONE = pa.schema(
    [
        ("_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_text", pa.string()),
        ("removed", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
    ]
)
_DONE_DDL = "_id long, n_words long, n_removed long, kept_text string, removed array<struct<from: long, to: long>>"


def _done(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), field.type) for column, field in zip(zip(*rows), _DONE)], schema=_DONE
    )


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        id_ = batch.column("_id").to_pylist()
        for part, data, offsets in slices(batch.column("text")):
            raw, out = data.tobytes(), []
            for i in range(len(offsets) - 1):
                kept = raw[offsets[i] : offsets[i + 1]].split()
                out.append((id_[part.start + i], len(kept), 0, b" ".join(kept).decode(), []))
            yield _done(out)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        id_ = batch.column("_id").to_pylist()
        for part, data, offsets in slices(batch.column("text")):
            words = find_words(data, offsets)
            first, value = windows(words, words.hashes(), WIDTH)
            text = np.searchsorted(words.first, first, side="right") - 1
            mark_text, mark = _marks(batch.column("marks"), part)
            hit = first[np.isin(_own(text, value), _own(mark_text, mark))]
            cover = np.zeros(len(words.start) + 1, dtype=np.int64)
            cover[hit] += 1
            cover[hit + WIDTH] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            raw, out = data.tobytes(), []
            for i in range(len(offsets) - 1):
                own = gone[words.first[i] : words.first[i + 1]]
                kept = compress(raw[offsets[i] : offsets[i + 1]].split(), ~own)
                edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                spans = [{"from": int(a), "to": int(b)} for a, b in edge.reshape(-1, 2)]
                out.append((id_[part.start + i], len(own), int(own.sum()), b" ".join(kept).decode(), spans))
            yield _done(out)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key, n_words, n_removed, kept_text, removed``.

    A word goes if a window of 13 words over it also starts in a document with a smaller key;
    windows are judged on the input. ``kept_text`` has the other words, joined by one space;
    ``removed`` has the runs of words that went, as word numbers, the end exclusive. Null and empty
    texts have no words and keep the empty text; shorter texts than a window stay whole. Rows that
    repeat a key don't remove each other's words; null keys come after all others and don't remove
    each other's words either. Other columns are left out, whatever their names.
    """
    texts = ids(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")), "_key").select(
        "_id", "text"
    )
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About six bytes to a word, three words in seven.
    buckets = volume // 14 // BUCKET_HASHES + 1
    anchors = _told(texts.mapInArrow(_send_anchors(buckets), _SENT_DDL.format(kind="int")), False, buckets)
    marked = within(texts, anchors, "_id").join(anchors, "_id")
    repeats = _told(marked.mapInArrow(_send_windows(buckets), _SENT_DDL.format(kind="long")), True, buckets)
    whole = within(texts, repeats, "_id", without=True).mapInArrow(_keep, _DONE_DDL)
    partly = within(texts, repeats, "_id").join(repeats, "_id").mapInArrow(_remove, _DONE_DDL)
    return whole.unionByName(partly).select(
        F.when(F.col("_id") != F.lit(LAST_ID), F.col("_id")).alias(key),
        "n_words",
        "n_removed",
        "kept_text",
        "removed",
    )
