"""Results as nested JSON, with non-ASCII characters kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.sources.folders import write_files

_KEEP_NULLS = {"ignoreNullFields": "false"}


def to_json_lines(df: DataFrame, key: str) -> DataFrame:
    """One JSON document per row next to its key."""
    return df.select(key, F.to_json(F.struct(*df.columns), _KEEP_NULLS).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**_KEEP_NULLS).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_json_files(df: DataFrame, folder: str, name: str) -> int:
    """One JSON file per row, ``<name>.json`` below ``folder``; returns their number. See ``write_files``."""
    shown = to_json_lines(df, name)
    return write_files(shown.select(F.concat(name, F.lit(".json")).alias("name"), F.col("json").alias("content")), folder)
