"""Quality rules whose cutoffs are selected under risk control.

Each rule rejects a document whose ratio is beyond a cutoff of a grid fixed beforehand. On the
labelled documents of a stratum, an exact binomial test shows that a cutoff rejects at most the
rule's share of good documents. The cutoffs of a rule are tested in fixed sequence, from mild to
strict, and the first that fails ends the sequence; so only the number of strata and rules needs
correcting for (Bonferroni), and all guarantees together fail with a chance of at most ``DELTA``.
Of the cutoffs before that end the one that parts bad from good best is taken, and the mildest of
equals; without one, the rule rejects nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusweave.llm.tables import set_aside, within, written
from corpusweave.llm.words import find_words, mix, slices, windows

REPEAT_WIDTH = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Chance that any guarantee of any stratum fails.
DELTA = 0.05
#: Strata with most labels that get cutoffs of their own; all others form one stratum together.
MAX_STRATA = 64
OTHERS = "\x00others"
#: Rule: share of good documents that it may reject in a stratum, cutoffs from mild to strict. The shares add up to 5 %.
RULES: dict[str, tuple[float, tuple[float, ...]]] = {
    "symbols": (0.02, (0.3, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02, 0.01)),
    "repeats": (0.015, (0.28, 0.24, 0.2, 0.15, 0.1, 0.05)),
    "dup_lines": (0.005, (0.6, 0.45, 0.3, 0.2, 0.1)),
    "long_words": (0.005, (20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
    "short_words": (0.005, (-1.5, -2.0, -2.5, -3.0)),
}

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


def _between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(value: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    _, place, count = np.unique(value, return_inverse=True, return_counts=True)
    return count[place] > 1


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words = find_words(data, offsets)
    heads = (data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(heads)])
    chars = _between(total[words.end] - total[words.start], words.first)

    lines = find_words(data, offsets, _NEWLINE)
    at = np.searchsorted(words.start, lines.start)
    filled = np.searchsorted(words.start, lines.end) > at
    line_of = lines.text_of_word()[filled]
    mark = lines.hashes()[filled] ^ mix(line_of.astype(np.uint64) + np.uint64(1))
    n = len(offsets) - 1
    n_lines = np.bincount(line_of, minlength=n)
    _, first = np.unique(mark, return_index=True)
    n_distinct = np.bincount(line_of[first], minlength=n)

    start, value = windows(words, words.hashes(), REPEAT_WIDTH)
    text = np.searchsorted(words.first, start, side="right") - 1
    hit = start[_again(value ^ mix(text.astype(np.uint64) + np.uint64(1)))]
    cover = np.zeros(len(words.start) + 1, dtype=np.int64)
    cover[hit] += 1
    cover[hit + REPEAT_WIDTH] -= 1
    repeated = np.cumsum(cover[:-1]) > 0
    return [
        np.diff(words.first),
        chars,
        _between(_SYMBOL[data], offsets),
        n_lines,
        n_lines - n_distinct,
        _between(repeated, words.first),
    ]


def _measure(text: pa.Array) -> pa.Array:
    parts = [_counts(data, offsets) for _, data, offsets in slices(text)]
    columns = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [] for c in range(len(_COUNTS))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_COUNTS)


def measured(text: Column) -> Column:
    """Struct of counts of a text: words, code points in words, symbols, filled lines, lines equal to an
    earlier one, words in repeated windows of 8. Null counts as empty."""
    return arrow_udf(_measure, ", ".join(f"{c} long" for c in _COUNTS)).asNondeterministic()(text.cast("string"))


def _ratios(m: str = "") -> dict[str, Column]:
    """What each rule compares with its cutoffs; larger is worse."""
    c = {name: F.col(f"{m}{name}") for name in _COUNTS}
    some = lambda name: F.greatest(c[name], F.lit(1))
    return {
        "symbols": c["n_symbols"] / some("word_chars"),
        "repeats": c["n_repeat_words"] / some("n_words"),
        "dup_lines": c["n_dup_lines"] / some("n_lines"),
        "long_words": c["word_chars"] / some("n_words"),
        "short_words": -c["word_chars"] / some("n_words"),
    }


def _base_failed(m: str = "") -> Column:
    words, repeated = F.col(f"{m}n_words"), F.col(f"{m}n_repeat_words")
    return (words < MIN_WORDS) | (repeated * 100 > words * MAX_REPEAT_PERCENT)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of the binomial distribution of n trials, exact up to rounding."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def _pick(levels: dict[tuple[int, int], int], rule: str, tests: int, delta: float) -> float | None:
    """The cutoff of one stratum and rule out of ``tests`` such sequences; ``levels``: documents by cutoffs exceeded and quality."""
    share, grid = RULES[rule]
    good = sum(n for (_, quality), n in levels.items() if quality)
    bad = sum(n for (_, quality), n in levels.items() if not quality)
    best, choice = 0.0, None
    for at, cutoff in enumerate(grid):
        # Whoever exceeds a mild cutoff exceeds all stricter ones, which come after it.
        beyond = len(grid) - at
        lost = sum(n for (level, quality), n in levels.items() if quality and level >= beyond)
        caught = sum(n for (level, quality), n in levels.items() if not quality and level >= beyond)
        if not good or lost > share * good or binomial_tail(lost, good, share) > delta / tests:
            break
        if not caught:
            continue
        gain = caught / bad - lost / good
        if gain > best:
            best, choice = gain, cutoff
    return choice


def select_cutoffs(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    quality: str = "quality",
    delta: float = DELTA,
) -> dict[str, dict[str, float | None]]:
    """Cutoffs by stratum and rule, learned from all labelled documents that pass the base rules.

    A null stratum is one of its own. Of several labels of a document the best counts; null labels
    and labels of no document count for nothing. Only counts reach the driver: at most
    ``MAX_STRATA + 1`` strata, each with a number per rule, level and quality. Without labels all
    cutoffs are None.
    """
    marked = (
        labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.col(quality).cast("int")).alias("_quality"))
    )
    known = (
        within(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), _stratum(stratum).alias("_stratum")), marked, "_key")
        .select("_key", "_stratum", measured(F.col("_text")).alias("m"))
        .select("_key", "_stratum", "m.*")
        .where(~_base_failed())
        .join(marked, "_key")
    )
    level = lambda ratio, grid: sum(((ratio > c).cast("int") for c in grid), F.lit(0))
    rules = F.array(
        *(F.struct(F.lit(rule).alias("rule"), level(ratio, RULES[rule][1]).alias("level")) for rule, ratio in _ratios().items())
    )
    counts = written(
        known.select("_stratum", "_quality", F.explode(rules).alias("r"))
        .groupBy("_stratum", "r.rule", "r.level", "_quality")
        .agg(F.count("*").alias("n"))
    )
    largest = counts.groupBy("_stratum").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "_stratum").limit(MAX_STRATA)
    own = [r["_stratum"] for r in largest.collect()]
    pooled = F.when(F.col("_stratum").isin(own), F.col("_stratum")).otherwise(OTHERS)
    rows = counts.groupBy(pooled.alias("stratum"), "rule", "level", "_quality").agg(F.sum("n").alias("n")).collect()
    tests = max(1, len({r["stratum"] for r in rows})) * len(RULES)
    levels: dict[tuple[str, str], dict[tuple[int, int], int]] = {}
    for r in rows:
        levels.setdefault((r["stratum"], r["rule"]), {})[r["level"], int(r["_quality"] > 0)] = r["n"]
    return {
        name: {rule: _pick(levels.get((name, rule), {}), rule, tests, delta) for rule in RULES}
        for name in [*own, OTHERS]
    }


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00null"))


def _rejected(cutoffs: dict[str, dict[str, float | None]], stratum: str, m: str) -> Column:
    """Whether a rule of the stratum rejects; the table of cutoffs is a constant of bounded size."""
    of = F.create_map(
        *(
            part
            for name, by_rule in cutoffs.items()
            for part in (F.lit(name), F.array(*(F.lit(by_rule[rule]).cast("double") for rule in RULES)))
        )
    )
    mine = F.coalesce(F.element_at(of, _stratum(stratum)), F.element_at(of, F.lit(OTHERS)))
    verdict = F.lit(False)
    for at, (rule, ratio) in enumerate(_ratios(m).items()):
        verdict = verdict | F.coalesce(ratio > mine[at], F.lit(False))
    return verdict


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    quality: str = "quality",
) -> DataFrame:
    """Add ``_quality``: a struct of the counts of ``measured``, ``base_failed``, ``rejected``, ``kept``.

    All rows and columns of ``docs`` stay as they are, but for a ``_quality`` that was there; no row moves. ``base_failed``: under 20 words, or more
    than 30 % of them in repeated windows. ``rejected``: a cutoff of the stratum is exceeded.
    """
    cutoffs = select_cutoffs(docs, labels, key, text, stratum, quality)
    docs, names = set_aside(docs, "_m")
    with_counts = docs.withColumn("_m", measured(F.col(text)))
    failed, rejected = _base_failed("_m."), _rejected(cutoffs, stratum, "_m.")
    return with_counts.withColumn(
        "_quality",
        F.struct("_m.*", failed.alias("base_failed"), rejected.alias("rejected"), (~failed & ~rejected).alias("kept")),
    ).drop("_m").withColumnsRenamed(names)
