"""Secrets in texts, with SQL functions only: patterns, and entropy of sliding windows.

Strings of 20 and more characters of one alphabet are candidates. A window slides over each; the counts of its
characters and the sum that its Shannon entropy needs are brought up to date for the one character that
comes and the one that goes. Candidates of an allow-list, and such as overlap a pattern's span, are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.tables import set_aside

#: Kinds of spans, in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Runs are maximal, so asking for the length in the pattern finds the same as dropping shorter ones.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
MIN_VALUE = 6
#: Text without any of these holds no assignment.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits per character that a window has to reach, by alphabet: hex digits, and letters and digits at large.
HEX_BITS, MIXED_BITS = 3.0, 3.8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that look random but are no secrets: UUIDs, dates and times, alphabets, placeholders, paths of words.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    r"|\d{4}-\d{2}-\d{2}|abcdefghij|0123456789|1234567890|qwerty"
    r"|example|sample|placeholder|changeme|dummy|xxxx|(.)\2{5}"
    r"|^/?([a-z]+[/_-])+[a-z]*\d{0,4}$"
)

_SPAN = "array<struct<start: int, kind: int, end: int>>"


def _no_spans() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of matches in code points, the end exclusive; ``least`` characters of a group are wanted.

    The pieces between the matches tell where each begins.
    """
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda whole, part: F.struct(F.length(whole).alias("length"), (F.length(part) >= least).alias("good")),
    )
    steps = F.zip_with(
        F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m"))
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["m"]["length"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(F.coalesce(x["m"]["good"], F.lit(False)), F.concat(state["out"], F.array(span)))
            .otherwise(state["out"])
            .alias("out"),
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), _no_spans().alias("out")), step, lambda s: s["out"])


def _hot_part(word: Column) -> Column:
    """``first, last``: starts of the first and the last window of a string that reach its entropy; first -1: none."""
    table = F.array(*(F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 1)))
    # Entropy of a window is log2(W) - sum(c * log2 c) / W.
    most = lambda bits: F.lit((math.log2(WINDOW) - bits) * WINDOW + 1e-9)
    limit = F.when(word.rlike("^[0-9a-fA-F]+$"), most(HEX_BITS)).otherwise(most(MIXED_BITS))
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(
        codes,
        F.concat(F.array_repeat(F.lit(-1), WINDOW), codes),
        lambda comes, goes: F.struct(comes.alias("comes"), goes.alias("goes")),
    )
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("at"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
        limit.alias("limit"),
    )

    def step(s: Column, x: Column) -> Column:
        comes, goes = x["comes"], x["goes"]
        had = F.get(s["counts"], comes)
        lost = F.when(goes >= 0, F.get(s["counts"], goes))
        # The count of the character that goes, after the other has come.
        lost = F.when(goes == comes, lost + 1).otherwise(lost)
        change = F.get(table, had + 1) - F.get(table, had)
        change = change + F.when(goes >= 0, F.get(table, lost - 1) - F.get(table, lost)).otherwise(F.lit(0.0))
        total, at = s["sum"] + change, s["at"] + 1
        hot = (at >= WINDOW) & (total <= s["limit"])
        return F.when(
            comes.isNotNull(),
            F.struct(
                F.transform(
                    s["counts"], lambda c, i: c + (i == comes).cast("int") - (i == goes).cast("int")
                ).alias("counts"),
                total.alias("sum"),
                at.alias("at"),
                F.when(hot & (s["first"] < 0), at - WINDOW).otherwise(s["first"]).alias("first"),
                F.when(hot, at - WINDOW).otherwise(s["last"]).alias("last"),
                s["limit"].alias("limit"),
            ),
        ).otherwise(s)

    return F.aggregate(pairs, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_secrets``: all spans ``start, kind, end`` of a text, in order of start and kind; kind is a place in ``KINDS``.

    Places are code points, the end exclusive. Null and empty texts have no spans. All rows and columns stay; no
    row moves, and texts of any length are searched whole.
    """
    docs, names = set_aside(docs, "_base", "_words", "_more")
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.lower(raw)
    may_assign = F.lit(False)
    for word in ASSIGN_WORDS:
        may_assign = may_assign | low.contains(word)
    # Each step stands behind an array of one row, so that no step is computed again inside a later one.
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))
    df = once(
        docs,
        "_base",
        F.concat(
            F.when(may_assign, _spans(raw, ASSIGN, 0, 2, MIN_VALUE)).otherwise(_no_spans()),
            F.when(raw.contains("AKIA"), _spans(raw, ACCESS, 1)).otherwise(_no_spans()),
            _spans(raw, HEX, 2),
        ),
    )
    words = F.filter(
        _words(raw),
        lambda w: w["word"].rlike("[0-9]") & w["word"].rlike("[A-Za-z]") & ~w["word"].rlike(ALLOWED),
    )
    df = once(df, "_words", F.when(raw.rlike(CANDIDATE), words).otherwise(words_none()))
    hot = F.filter(
        F.transform(F.col("_words"), lambda w: F.struct(w["start"].alias("start"), _hot_part(w["word"]).alias("hot"))),
        lambda w: w["hot"]["first"] >= 0,
    )
    spans = F.transform(
        hot,
        lambda w: F.struct(
            (w["start"] + w["hot"]["first"]).alias("start"),
            F.lit(3).alias("kind"),
            (w["start"] + w["hot"]["last"] + WINDOW).alias("end"),
        ),
    )
    df = once(df, "_more", F.when(F.size("_words") > 0, spans).otherwise(_no_spans()))
    fresh = F.filter(
        "_more",
        lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )
    return df.withColumn("_secrets", F.array_sort(F.concat("_base", fresh))).drop("_base", "_words", "_more").withColumnsRenamed(names)


def words_none() -> Column:
    return F.array().cast("array<struct<start: int, word: string>>")


def _words(text: Column) -> Column:
    """Candidate strings and where they start."""
    steps = F.zip_with(
        F.split(text, CANDIDATE, -1),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
        lambda gap, word: F.struct(F.length(gap).alias("gap"), word.alias("word")),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        return F.struct(
            (start + F.coalesce(F.length(x["word"]), F.lit(0))).alias("at"),
            F.when(
                x["word"].isNotNull(),
                F.concat(state["out"], F.array(F.struct(start.alias("start"), x["word"].alias("word")))),
            )
            .otherwise(state["out"])
            .alias("out"),
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), words_none().alias("out")), step, lambda s: s["out"])


def shown(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
