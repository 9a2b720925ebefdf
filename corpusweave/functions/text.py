"""Column expressions over text. Everything here stays in the JVM and needs no shuffle.

White space follows Python's notion of it: the Unicode ``White_Space`` property plus the
four separators U+001C to U+001F. Lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave import params

# Character classes and patterns.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = SPACE.replace("[", "[^")
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WIDE_STOPS = "。？！"
SENTENCE_GAP = "(?<=[.!?])" + SPACE + "+"
WIDE_SENTENCE_GAP = "(?<=[.!?。？！])" + SPACE + "+"
HANGUL = "[가-힣]"
LATIN = "[a-zA-Z]"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Catalyst inlines a projected expression into a lambda that reads it, and would then evaluate
    it once per element; a lambda variable is evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    """True when there is nothing but white space."""
    return ~text.rlike(NOT_SPACE)


def _contains_any(text: Column, characters: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(c) for c in characters])


def text_bytes(text: Column) -> Column:
    """Length of the text in UTF-8."""
    return F.octet_length(text)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def paragraphs(text: Column) -> Column:
    """Lines are stripped; blank lines end a paragraph; its lines are joined with one space."""
    # Regular expressions cost several times as much as the native string functions, so the rare
    # line breaks are only looked for where one of them occurs.
    broken = F.when(
        _contains_any(text, RARE_BREAKS), F.regexp_replace(text, LINE_BREAK, "\n")
    ).otherwise(text)
    lines = F.transform(F.split(broken, "\n"), strip)
    joined = F.btrim(F.array_join(lines, "\n"), F.lit("\n"))
    parts = let(
        joined,
        lambda body: F.when(body == "", F.array().cast("array<string>"))
        .when(body.contains("\n\n"), F.split(body, "\n\n+"))
        .otherwise(F.array(body)),
    )
    return F.transform(parts, lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))


def _split_at_gaps(paragraph: Column) -> Column:
    return F.when(
        _contains_any(paragraph, WIDE_STOPS), F.split(paragraph, WIDE_SENTENCE_GAP)
    ).otherwise(F.split(paragraph, SENTENCE_GAP))


def sentences(paragraph: Column) -> Column:
    """Split after ``. ! ? 。 ？ ！`` where white space follows; parts are stripped, empties dropped."""
    return F.filter(_split_at_gaps(strip(paragraph)), lambda part: part != "")


def pack_sentences(paragraph: Column, max_chunk_size: int) -> Column:
    """Blocks of a paragraph: whole sentences packed greedily up to ``max_chunk_size`` characters.

    A paragraph that fits is kept as it is, and so is a single sentence that is too long. The greedy
    packing is one regular expression over the sentences, one per line (a paragraph holds no line
    break): the longest run of at most ``max_chunk_size`` characters that ends at a line end, or
    else one whole sentence.
    """
    size = params.positive_int("max_chunk_size", max_chunk_size)
    marked = F.array_join(_split_at_gaps(paragraph), "\n")
    pattern = rf"\n?((?s:.{{1,{size}}})(?=\n|\z)|[^\n]+)"
    packed = F.regexp_extract_all(marked, F.lit(pattern), 1)
    return F.when(F.length(paragraph) <= size, F.array(paragraph)).otherwise(
        F.transform(packed, lambda block: F.replace(block, F.lit("\n"), F.lit(" ")))
    )


def blocks(text: Column, max_chunk_size: int = params.MAX_CHUNK_SIZE) -> Column:
    """Blocks of a document, paragraph by paragraph."""
    return F.flatten(F.transform(paragraphs(text), lambda p: pack_sentences(p, max_chunk_size)))


def assemble_chunks(
    block_list: Column,
    *,
    min_chunk_size: int = params.MIN_CHUNK_SIZE,
    max_chunk_size: int = params.MAX_CHUNK_SIZE,
    overlap_size: int = params.OVERLAP_SIZE,
) -> Column:
    """Join neighbouring blocks into chunks, carrying a tail of each chunk into the next."""
    stripped = F.transform(block_list, strip)
    return _assemble(
        F.filter(stripped, lambda b: b != ""),
        params.ChunkSettings(min_chunk_size, max_chunk_size, overlap_size),
    )


def _assemble(block_list: Column, settings: params.ChunkSettings) -> Column:
    """Fold over stripped blocks.

    Every chunk is a contiguous piece of the blocks joined with spaces, so the fold only keeps the
    byte span of each finished chunk and the text of the open one; the text of all chunks is cut
    from the joined bytes at the end, in time linear in the document.
    """
    lo, hi, overlap = settings.min_chunk_size, settings.max_chunk_size, settings.overlap_size

    def span(end: Column, buffer: Column) -> Column:
        size = F.octet_length(buffer)
        return F.struct((end - size).alias("start"), size.alias("size"))

    def with_tail(buffer: Column, block: Column, n: Column | int) -> Column:
        return F.btrim(
            F.concat(F.right(buffer, F.lit(n) if isinstance(n, int) else n), F.lit(" "), block),
            F.lit(WHITE),
        )

    def reopened(buffer: Column, block: Column) -> Column:
        room = F.lit(hi) - F.length(block) - 1
        shrunk = F.when(room > 0, with_tail(buffer, block, room)).otherwise(block)
        if not overlap:
            return F.when(F.length(block) > hi, shrunk).otherwise(block)
        return let(
            with_tail(buffer, block, overlap),
            lambda candidate: F.when(F.length(candidate) > hi, shrunk).otherwise(candidate),
        )

    def state(done: Column, buffer: Column, end: Column) -> Column:
        return F.struct(done.alias("done"), buffer.alias("buffer"), end.alias("end"))

    def step(acc: Column, block: Column) -> Column:
        done, buffer, end = acc["done"], acc["buffer"], acc["end"]
        block_end = end + 1 + F.octet_length(block)
        finished = F.concat(done, F.array(span(end, buffer)))
        return (
            F.when(buffer == "", state(done, block, F.octet_length(block)))
            .when(
                F.length(buffer) + 1 + F.length(block) <= hi,
                state(done, F.concat(buffer, F.lit(" "), block), block_end),
            )
            .when(F.length(buffer) < lo, state(finished, block, block_end))
            .otherwise(state(finished, reopened(buffer, block), block_end))
        )

    start = F.struct(
        F.array().cast("array<struct<start:int,size:int>>").alias("done"),
        F.lit("").alias("buffer"),
        F.lit(0).alias("end"),
    )

    def cut(parts: Column) -> Column:
        spans = F.aggregate(
            parts,
            start,
            step,
            lambda acc: F.concat(acc["done"], F.array(span(acc["end"], acc["buffer"]))),
        )
        joined = F.array_join(parts, " ").cast("binary")
        return let(
            joined,
            lambda body: F.transform(
                spans, lambda s: F.substring(body, s["start"] + 1, s["size"]).cast("string")
            ),
        )

    return let(
        block_list,
        # One block is one chunk: most short documents end here and skip the fold.
        lambda parts: F.when(F.size(parts) <= 1, parts).otherwise(cut(parts)),
    )


def chunks(
    text: Column,
    *,
    min_chunk_size: int = params.MIN_CHUNK_SIZE,
    max_chunk_size: int = params.MAX_CHUNK_SIZE,
    overlap_size: int = params.OVERLAP_SIZE,
) -> Column:
    """Cut a text into overlapping chunks: paragraphs, then sentences, then assembly."""
    settings = params.ChunkSettings(min_chunk_size, max_chunk_size, overlap_size)
    return _assemble(blocks(text, settings.max_chunk_size), settings)


def language(text: Column) -> Column:
    """``ko`` when there is a Hangul syllable, else ``en`` when there is an ASCII letter, else null."""
    return F.when(text.rlike(HANGUL), "ko").when(text.rlike(LATIN), "en")


def keywords(text: Column, limit: int = params.KEYWORD_LIMIT) -> Column:
    """The first ``limit`` distinct lower-case words of two or more characters."""
    params.positive_int("limit", limit)
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), 1, limit)


def cluster_label(label: Column) -> Column:
    return F.when(label == -1, "noise").otherwise(F.concat(F.lit("cluster-"), label.cast("string")))


def document_status(
    text: Column, decode_failed: Column | None = None, max_text_bytes: int = params.MAX_TEXT_BYTES
) -> Column:
    """``ERROR``, ``TEXT_TOO_LARGE``, ``NO_CONTENT`` or ``OK``, tested in this order.

    A text has no chunks exactly when it is blank, so the chunker need not run to know it.
    """
    params.positive_int("max_text_bytes", max_text_bytes)
    failed = text.isNull() if decode_failed is None else decode_failed
    return (
        F.when(failed, "ERROR")
        .when(text_bytes(text) > max_text_bytes, "TEXT_TOO_LARGE")
        .when(is_blank(text), "NO_CONTENT")
        .otherwise("OK")
    )
