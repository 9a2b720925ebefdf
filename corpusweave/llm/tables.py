"""Tables that are written once and read again, and schemas of Arrow stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.lineage import ensure_checkpoint_dir

#: Stands for a null id wherever ids are compared; it comes after every other.
LAST_ID = (1 << 63) - 1


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the copy, which outlives executors.

    Parquet holds packed columns in a third of the room of a checkpoint's rows and reads only the
    columns asked for.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids(df: DataFrame, key: str) -> DataFrame:
    """Add ``_id``: the key, with nulls after all others."""
    return df.withColumn("_id", F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)))


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these names, in any case, called otherwise, and what gives them their names back."""
    taken = {c.lower() for c in df.columns}
    back = {}
    for column in df.columns:
        if column.lower() in names:
            other = f"{column}_aside"
            while other.lower() in taken:
                other += "_"
            taken.add(other.lower())
            back[other] = column
    return df.withColumnsRenamed({old: new for new, old in back.items()}), back


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that are sent to every task at most; each takes about 100 bytes in memory.
MAX_SENT_IDS = 512 << 10


def within(rows: DataFrame, some: DataFrame, key: str, without: bool = False) -> DataFrame:
    """The rows whose key is (not) in ``some``.

    The keys are counted: up to ``MAX_SENT_IDS`` they go to every task and the rows stay where they
    are; beyond, both sides are shuffled by key.
    """
    keys = some.select(key).distinct()
    if keys.count() <= MAX_SENT_IDS:
        keys = F.broadcast(keys)
    return rows.join(keys, key, "left_anti" if without else "left_semi")
