"""Language of a text by sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained with follow-the-regularised-leader (proximal, per coordinate) and elastic-net penalties, then
calibrated by one temperature on documents that the training left aside. Document frequencies
come from all training documents; the model is fitted on a bounded sample of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusweave.llm.words import slices

ORDERS = (1, 2, 3)
FEATURE_BITS = 15
#: Documents that the model is fitted on, and languages that it learns, the most frequent first.
SAMPLE_ROWS = 4000
MAX_LANGUAGES = 64
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter below U+20000; 0 for all else."""
    table = np.zeros(0x20000, dtype=np.uint32)
    for code in range(0x20000):
        if (char := chr(code)).isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Features and their counts of each text; None for a text without letters."""
    table = _letter_table()
    shift = np.uint64(64 - FEATURE_BITS)
    for _, data, offsets in slices(column):
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        letters = table[np.minimum(codes, len(table) - 1)].astype(np.uint64)
        grams, value = [], np.zeros(len(letters), dtype=np.uint64)
        for order in ORDERS:
            value = (value[: len(letters) - order + 1] + letters[order - 1 :] + np.uint64(order)) * _FACTOR
            grams.append((value >> shift).astype(np.int64))
        for begin, end in zip(heads[:-1], heads[1:]):
            if not letters[begin:end].any():
                yield None
                continue
            own = np.concatenate([g[begin : max(begin, end - o + 1)] for o, g in zip(ORDERS, grams)])
            counts = np.bincount(own, minlength=1 << FEATURE_BITS)
            some = np.flatnonzero(counts)
            yield some, counts[some]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # feature by language
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, some: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[some]
        return x / max(np.sqrt(x @ x), 1e-12)

    def scores(self, some: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(some, counts) @ self.weights[some] + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray) -> Model:
    """FTRL over the rows in their order. The last column of the state is the bias, without penalties."""
    size = len(idf) + 1
    z, n = np.zeros((size, len(languages))), np.zeros((size, len(languages)))
    model = Model(languages, idf, np.zeros((len(idf), len(languages))), np.zeros(len(languages)))

    def weights(z_: np.ndarray, n_: np.ndarray, free: bool = False) -> np.ndarray:
        shrunk = np.sign(z_) * np.maximum(np.abs(z_) - (0 if free else L1), 0)
        return -shrunk / ((BETA + np.sqrt(n_)) / ALPHA + (0 if free else L2))

    for _ in range(EPOCHS):
        for some, counts, language in rows:
            at = np.append(some, size - 1)
            x = np.append(model.vector(some, counts), 1.0)
            z_, n_ = z[at], n[at]
            w = weights(z_, n_)
            w[-1] = weights(z_[-1], n_[-1], True)
            error = _softmax(x @ w)
            error[language] -= 1
            gradient = np.outer(x, error)
            root = np.sqrt(n_ + gradient**2)
            z[at] += gradient - (root - np.sqrt(n_)) / ALPHA * w
            n[at] = root**2
    model.weights = weights(z[:-1], n[:-1])
    model.bias = weights(z[-1], n[-1], True)
    return model


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not rows:
        return 1.0
    scores = np.array([model.scores(some, counts) for some, counts, _ in rows])
    truth = np.array([language for _, _, language in rows])

    def loss(log_t: float) -> float:
        s = scores / math.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]))

    low, high, ratio = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(1 << FEATURE_BITS, dtype=np.int64), 0
    for batch in batches:
        for found in features(batch.column(0)):
            if found is not None:
                total[found[0]] += 1
                n += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[some], n), pa.int64())], names=["at", "n"]
    )


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int32())
    for batch in batches:
        found = list(features(batch.column("text")))
        keep = [i for i, f in enumerate(found) if f is not None]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang").take(pa.array(keep, pa.int64())),
                batch.column("h").take(pa.array(keep, pa.int64())),
                pa.array([found[i][0] for i in keep], kind),
                pa.array([found[i][1] for i in keep], kind),
            ],
            names=["lang", "h", "some", "counts"],
        )


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_ROWS) -> Model | None:
    """Learn from ``labelled``; rows without language or text are left out. None if nothing is left.

    The sample takes the documents of least hash of each language, as many of each, ``sample`` in all at most (but 20
    of a language at least); only their features come to the driver, whatever their length. Every fifth calibrates.
    """
    rows = labelled.select(F.xxhash64(F.col(key)).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where(
        "lang is not null and text is not null"
    )
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None
    frequency = {r["at"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    idf = np.full(1 << FEATURE_BITS, 0.0)
    n = frequency.pop(-1, 0)
    for at, count in frequency.items():
        idf[at] = math.log((1 + n) / (1 + count)) + 1
    each = max(20, sample // len(sizes))
    # Twice as many as wanted by their hash, then exactly as many; nothing large is ranked.
    span = F.create_map(*(part for r in sizes for part in (F.lit(r["lang"]), F.lit(min(1.0, 2 * each / r["n"])))))
    spread = (F.shiftrightunsigned(F.col("h"), 11)).cast("double") / float(1 << 53)
    thin = rows.where(spread < F.element_at(span, F.col("lang")))
    ranked = thin.select("lang", "h").withColumn("_at", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = ranked.where(F.col("_at") <= each).select("lang", "h").distinct()
    languages = sorted(r["lang"] for r in sizes)
    found = thin.join(F.broadcast(chosen), ["lang", "h"], "left_semi").mapInArrow(
        _sparse, "lang string, h long, some array<int>, counts array<int>"
    )
    data = sorted(
        ((r["h"], r["lang"], np.array(r["some"]), np.array(r["counts"])) for r in found.collect()),
        key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), r[1]),
    )
    points = [(some, counts, languages.index(name)) for _, name, some, counts in data]
    model = train([p for i, p in enumerate(points) if i % 5 or len(points) < 10], languages, idf)
    model.temperature = calibrate(model, [p for i, p in enumerate(points) if i % 5 == 0])
    return model


def predicted(model: Model | None, text: Column) -> Column:
    """Struct ``lang, score``: the most likely language and its calibrated probability; ``und`` and 0 for a
    text that is null or has no letter, or without a model."""

    def run(column: pa.Array) -> pa.Array:
        names, scores = [], []
        for found in features(column):
            if found is None or model is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            odds = _softmax(model.scores(*found) / model.temperature)
            best = int(odds.argmax())
            names.append(model.languages[best])
            scores.append(float(min(1.0, odds[best])))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return arrow_udf(run, "lang string, score double").asNondeterministic()(text.cast("string"))
