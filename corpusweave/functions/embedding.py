"""The embedding hook: a text column becomes a vector column.

An embedder knows three things: its name, how to turn a text column into a vector column, and
whether it is total, that is, gives a vector for every text that is not blank. Pipelines use the
last to leave out embeddings that cannot change any result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as St

from corpusweave import params
from corpusweave.functions import text as T
from corpusweave.functions.vectors import NORM_FLOOR

_ATTEMPT = St.StructType(
    [St.StructField("vector", St.ArrayType(St.FloatType())), St.StructField("error", St.StringType())]
)

PredictFn = Callable[[list[str]], Sequence[Sequence[float] | None]]


@dataclass(frozen=True)
class Embedder:
    name: str
    embed: Callable[[Column], Column]
    total: bool = False
    #: A struct ``(vector, error)`` of a text column, for embedders that can fail.
    attempt: Callable[[Column], Column] | None = None

    def embed_or_error(self, text: Column) -> Column:
        """Struct ``(vector, error)``: the message of the failure where there is no vector because of one."""
        if self.attempt is not None:
            return self.attempt(text)
        return F.struct(self.embed(text).alias("vector"), F.lit(None).cast("string").alias("error"))


def _tried(predict: PredictFn, texts: list[str]) -> list[tuple[Sequence[float] | None, str | None]]:
    """Vector or message of each text; a batch that fails is halved until the texts that fail are alone."""
    try:
        found = predict(texts)
    except Exception as failure:
        if len(texts) == 1:
            return [(None, str(failure) or type(failure).__name__)]
        half = len(texts) // 2
        return _tried(predict, texts[:half]) + _tried(predict, texts[half:])
    if len(found) != len(texts):
        raise WrongCount("the model returned a different number of vectors than texts")
    return [(vector, None) for vector in found]


class WrongCount(ValueError):
    """A model that does not give one vector per text cannot be used at all."""


def model_embedder(
    make_predict_fn: Callable[[], PredictFn],
    *,
    name: str,
    batch_size: int = params.EMBEDDING_BATCH_SIZE,
) -> Embedder:
    """Embed with a user's model.

    ``make_predict_fn`` runs once per Python task and returns a function from a list of texts to a
    vector per text, or ``None`` for a text it cannot embed. The model sees batches of at most
    ``batch_size`` texts and never sees a null or blank text: these get a null vector. If it raises on
    a batch, the batch is halved and asked again, so that one failing text costs about twice the logarithm of
    the batch size in calls; a text that it raises on alone gets a null vector and the message.
    """
    params.positive_int("batch_size", batch_size)

    def attempt_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = make_predict_fn()
        for texts in batches:
            found: list[tuple] = [(None, None)] * len(texts)
            wanted = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for at in range(0, len(wanted), batch_size):
                rows = wanted[at : at + batch_size]
                for i, result in zip(rows, _tried(predict, [texts.iloc[i] for i in rows])):
                    found[i] = result
            vectors, errors = zip(*found) if found else ((), ())
            yield pd.DataFrame(
                {"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)}
            )

    attempt = F.pandas_udf(attempt_batches, _ATTEMPT)
    return Embedder(name, lambda text: attempt(text)["vector"], attempt=attempt)


def hashed_words(dim: int = 64) -> Embedder:
    """A fixed, model-free embedder for tests and timing: hashed word counts at unit length.

    Word ``w`` is counted in bucket ``h % dim``, where ``h`` is the number spelled by the first
    seven hexadecimal digits of ``md5(w)``. It says nothing about meaning.
    """
    params.positive_int("dim", dim)

    def embed(column: Column) -> Column:
        words = F.regexp_extract_all(F.lower(column), F.lit(T.WORD), 0)
        return F.when(column.isNotNull() & ~T.is_blank(column), _bucket_counts(dim, unit=True)(words))

    return Embedder(f"hashed-words-{dim}", embed, total=True)


def _bucket_counts(dim: int, unit: bool = False):
    """Counts of the words of a row by bucket, or with ``unit`` at unit length; a batch hashes each of its distinct words once."""

    def bucket(word: str) -> int:
        return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16) % dim

    def counts(words: pa.Array) -> pa.Array:
        rows = len(words)
        coded = words.flatten().dictionary_encode()
        buckets = np.array([bucket(w) for w in coded.dictionary.to_pylist()], dtype=np.int64)
        per_row = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(rows) * dim, per_row)
        if len(at):
            at += buckets[coded.indices.to_numpy(zero_copy_only=False)]
        found = np.bincount(at, minlength=rows * dim).astype(float)
        if unit:
            # Sums of squares of whole numbers are exact, so these are the vectors that l2_normalize gives.
            by_row = found.reshape(rows, dim)
            by_row /= np.maximum(np.sqrt((by_row * by_row).sum(axis=1)), NORM_FLOOR)[:, None]
        offsets = pa.array(np.arange(rows + 1) * dim, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(found), mask=words.is_null() if words.null_count else None)

    return F.arrow_udf(counts, "array<double>")
