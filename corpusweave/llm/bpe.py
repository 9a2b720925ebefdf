"""Byte-level BPE over a corpus: every distinct word is encoded once, wherever it stands.

A task cuts its texts into segments of some megabytes and numbers the distinct words that the pattern finds in each. The
words go to buckets by a hash of theirs, those of a segment and bucket packed in one row; a bucket encodes each distinct
word once, as its rows stream by, and sends the ids back to the segments. There they meet the documents, which travel as
the numbers of their words in the order of their positions, and take the words' places. A word that stands everywhere
comes once from each segment, and its bucket holds it once, so frequent words weigh on no task.

Decoding joins the table of token bytes, which is as small as the vocabulary and goes to every task, to the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm.tables import task_count
from corpusweave.llm.words import Words, ramps, slices

#: Bytes of text in a segment; a longer text is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: Bytes of text to a bucket of words: what all its distinct words can take at most, on average.
BUCKET_BYTES = 16 << 20
_PART_BITS = 33
_BETWEEN = 0xFF  # no byte of UTF-8

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
# Bytes that white space beyond ASCII ends with; text is not cut after these.
_MAY_BE_WHITE = np.zeros(256, dtype=bool)
_MAY_BE_WHITE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


@dataclass(frozen=True)
class Tokenizer:
    """The path of a file of ranks, a line ``base64 rank`` for each token, and the pattern that cuts texts into words.

    The driver reads the file and sends it to the tasks; its size is that of the vocabulary, whatever the corpus.
    """

    ranks: str
    pattern: str

    def sent(self, spark: SparkSession) -> Broadcast:
        with open(self.ranks, "rb") as file:
            return spark.sparkContext.broadcast(file.read())


@lru_cache(maxsize=2)
def _ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


# --- Packed numbers ------------------------------------------------------------------------------


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Whole numbers in base 128, low digits first, the last without the high bit; ``first`` parts them into rows."""
    digits = 1 + sum((values >> shift > 0).astype(np.int64) for shift in range(7, 42, 7))
    ends = np.cumsum(digits)
    nth = ramps(np.zeros(len(values), dtype=np.int64), digits)
    out = (np.repeat(values, digits) >> (7 * nth)) & 127
    out |= (nth < np.repeat(digits, digits) - 1) << 7
    bounds = np.concatenate([[0], ends])[first].astype(np.int64)
    parts = [None, pa.py_buffer(bounds), pa.py_buffer(out.astype(np.uint8))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, parts).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column, and where each row begins and ends among them."""
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())]).astype(np.int64)
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, dtype=np.int64), np.zeros(len(bounds), dtype=np.int64)
    head = np.concatenate([[0], last[:-1] + 1])
    nth = np.arange(len(data)) - np.repeat(head, last - head + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * nth), head), np.searchsorted(head, bounds)


def _ids_packed(ids: list[int]) -> bytes:
    """The ids of a word, each doubled, plus one at the last."""
    out = bytearray()
    for at, id_ in enumerate(ids):
        left = 2 * id_ + (at == len(ids) - 1)
        while left > 127:
            out.append(left & 127 | 128)
            left >>= 7
        out.append(left)
    return bytes(out)


# --- Encoding ------------------------------------------------------------------------------------


def _pieces(data: np.ndarray, offsets: np.ndarray, find) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, the numbers of the words in order, and the distinct words, frequent ones first.

    White space after something else begins a new word whatever follows, and so does what is no letter after a letter;
    the text is cut there, and the pattern runs once on each distinct cut.
    """
    if not len(data):
        return np.zeros(len(offsets) - 1, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.array([], pa.large_string())
    white = _WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = white[1:] & ~white[:-1] & ~_MAY_BE_WHITE[data[:-1]]
    edge[1:-1] |= _LETTER[data[:-1]] & (data[1:] < 128) & ~_LETTER[data[1:]]
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    parts = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    cuts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, parts).dictionary_encode()
    kinds, begin, letters = cuts.dictionary, *_letters(cuts.dictionary)
    # ASCII letters after one space or none are a word.
    whole = (letters == np.diff(begin)) & (letters > 0)
    found = [find(cut.decode()) for cut in kinds.filter(pa.array(~whole)).to_pylist()]
    one = kinds.filter(pa.array(whole)).cast(pa.large_string())
    words = pa.concat_arrays(
        [one, pa.array([word for some in found for word in some], pa.large_string())]
    ).dictionary_encode()
    count = np.ones(len(kinds), dtype=np.int64)
    count[~whole] = [len(some) for some in found]
    first = np.empty(len(kinds), dtype=np.int64)
    first[whole] = np.arange(len(one))
    first[~whole] = len(one) + np.cumsum(count[~whole]) - count[~whole]
    cut = cuts.indices.to_numpy(zero_copy_only=False)
    code = words.indices.to_numpy(zero_copy_only=False)[ramps(first[cut], count[cut])]
    upto = np.concatenate([[0], np.cumsum(count[cut])])
    order = np.argsort(-np.bincount(code, minlength=len(words.dictionary)), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return np.diff(upto[np.searchsorted(bounds, offsets)]), rank[code], words.dictionary.take(pa.array(order))


def _letters(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins, and how many ASCII letters it has, a space before them included."""
    data, begin = _bytes(values)
    counted = np.concatenate([[0], np.cumsum(_LETTER[data])])
    start = begin[:-1]
    return begin, counted[begin[1:]] - counted[start] + (data[np.minimum(start, len(data) - 1)] == 0x20)


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large column without nulls and where each value begins, then the end."""
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _segments(batches: Iterator[pa.RecordBatch], pattern: str):
    """``segment, rows, counts, codes, words`` of the segments of a task."""
    find = regex.compile(pattern).findall
    segment = TaskContext.get().partitionId() << _PART_BITS
    for batch in batches:
        for part, data, offsets in slices(batch.column("text"), SEGMENT_BYTES):
            yield segment, batch.slice(part.start, part.stop - part.start), *_pieces(data, offsets, find)
            segment += 1


def _send_words(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, _, _, _, words in _segments(batches, pattern):
            if not len(words):
                continue
            data, begin = _bytes(words)
            hashed = Words(data, begin, begin[:-1], begin[1:], begin[:1]).hashes()
            to = (hashed % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            some, first = np.unique(to[order], return_index=True)
            edge = np.append(first, len(order))
            step = np.diff(order, prepend=0)
            step[first] = order[first]
            data, begin = _bytes(words.take(pa.array(order)))
            joined = np.full(len(data) + len(order), _BETWEEN, dtype=np.uint8)  # a byte after each word
            joined[np.arange(len(data)) + np.repeat(np.arange(len(order)), np.diff(begin))] = data
            parts = [None, pa.py_buffer(begin[edge] + edge), pa.py_buffer(joined)]
            sent = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()),
                    pa.array(np.full(len(some), segment), pa.int64()),
                    _packed(step, edge),
                    sent.cast(pa.binary()),
                ],
                names=["bucket", "segment", "codes", "words"],
            )

    return run


def _encode_words(lines: Broadcast):
    """Rows of a bucket follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        known: dict[bytes, bytes] = {}
        bucket = None
        for batch in batches:
            if encoding is None:
                encoding = tiktoken.Encoding(
                    "ranks", pat_str="(?s:.+)", mergeable_ranks=_ranks(lines.value), special_tokens={}
                )
            replies = []
            for of, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if of != bucket:
                    known, bucket = {}, of
                reply = []
                for word in words.split(bytes([_BETWEEN]))[:-1]:
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = _ids_packed(encoding.encode_ordinary(word.decode()))
                    reply.append(ids)
                replies.append(b"".join(reply))
            yield pa.RecordBatch.from_arrays(
                [batch.column("segment"), batch.column("codes"), pa.array(replies, pa.binary())],
                names=["segment", "codes", "ids"],
            )

    return run


def _send_rows(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, rows, counts, code, words in _segments(batches, pattern):
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, segment), pa.int64()),
                    pa.array(np.arange(n), pa.int64()),
                    pa.array(np.full(n, len(words)), pa.int64()),
                    rows.column("row"),
                    _packed(code, np.concatenate([[0], np.cumsum(counts)])),
                ],
                names=["segment", "place", "kinds", "row", "codes"],
            )

    return run


def _put_in_place(rows: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of the words at the positions of the words, for the documents of a segment."""
    rows = rows.sort_by("place")
    code, upto = _unpacked(rows["codes"])
    step, first = _unpacked(words["codes"])
    total = np.concatenate([[0], np.cumsum(step)])
    number = total[1:] - np.repeat(total[first[:-1]], np.diff(first))
    doubled, _ = _unpacked(words["ids"])
    last = np.flatnonzero(doubled & 1)
    kinds = rows["kinds"][0].as_py() if rows.num_rows else 0
    if len(number) != kinds or len(last) != kinds or len(code) and int(code.max()) >= kinds:
        raise RuntimeError("the texts changed between two reads")
    begin, length = np.zeros(kinds, dtype=np.int64), np.zeros(kinds, dtype=np.int64)
    begin[number] = np.concatenate([[0], last[:-1] + 1]) if kinds else last
    length[number] = np.diff(last, prepend=-1)
    ids = (doubled >> 1).astype(np.int32)[ramps(begin[code], length[code])]
    edge = np.concatenate([[0], np.cumsum(length[code])])[upto]
    return pa.table({"row": rows["row"], "ids": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids))})


def encode(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key, ids``, the tokens of the whole text without special ones.

    Null and empty texts have no tokens. Keys of any type, null and repeated ones too, are passed on row by row. Other
    columns are left out, whatever their names.

    ``docs`` is read twice, for the words and for their positions, and has to give the same rows in the same order, as
    files and written tables do; if it does not, the job fails. A text lies within one task.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("row"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["row"].dataType.simpleString()
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = task_count(spark)
    buckets = max(volume // BUCKET_BYTES + 1, tasks)
    words = (
        texts.select("text")
        .mapInArrow(_send_words(tokenizer.pattern, buckets), "bucket long, segment long, codes binary, words binary")
        .repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode_words(tokenizer.sent(spark)), "segment long, codes binary, ids binary")
    )
    rows = texts.mapInArrow(
        _send_rows(tokenizer.pattern), f"segment long, place long, kinds long, row {kind}, codes binary"
    )
    done = rows.groupBy("segment").cogroup(words.groupBy("segment")).applyInArrow(_put_in_place, f"row {kind}, ids array<int>")
    return done.withColumnRenamed("row", key)


# --- Decoding ------------------------------------------------------------------------------------


def decode(coded: DataFrame, tokenizer: Tokenizer, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The columns of ``coded`` but ``ids``, and ``name``: the bytes of its tokens, one row per row.

    Null and empty lists decode to no bytes. A token that the table doesn't hold, or a null one, raises an error. A
    column of ``coded`` that is called ``name`` is replaced.

    The table of token bytes is a constant of the plan, so it meets the tokens where they are, in the JVM.
    """
    with open(tokenizer.ranks, "rb") as file:
        ranks = _ranks(file.read())
    table = [""] * (max(ranks.values()) + 1)
    for value, rank in ranks.items():
        table[rank] = value.hex()
    # Splitting a constant is done once, when the plan is made.
    known = F.split(F.lit(",".join(table)), ",")
    unknown = F.raise_error(F.lit("the table does not hold all tokens"))
    found = F.transform(F.col(ids), lambda token: F.coalesce(F.nullif(F.get(known, token), F.lit("")), unknown))
    others = [c for c in coded.columns if c not in (ids, name)]
    decoded = F.coalesce(F.unhex(F.array_join(found, "")), F.lit(b""))
    return coded.select(*[F.col(f"`{c}`") for c in others], decoded.alias(name))
