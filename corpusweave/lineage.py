"""Cutting the lineage of iterative jobs, and giving back the disk that passing copies take."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

# Spark removes the shuffle files of a query as soon as it has ended, and not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The copies that were written inside each open passing() of a thread, the innermost last. Plain values, since the
# package is pickled by value.
_OPEN: dict[int, list[list[str]]] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only a local master gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    Unlike cached blocks, the copy outlives the executors that wrote it. A checkpoint keeps the size that the
    optimizer guessed for its origin, and a join's guess is the product of its sides, so that in a loop of joins the
    number of its digits doubles with each round until multiplying them takes longer than the work. The copy
    therefore starts again without a guess. The shuffle files of ``df`` go once the copy is there.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # A frame keeps the setting that it was made under.
        plan = df.select("*").checkpoint(eager=True)._jdf
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    copy = DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.queryExecution().toRdd(), plan.schema(), False), spark)
    copy._copy_at = plan.queryExecution().logical().rdd().getCheckpointFile().get()
    for innermost in _OPEN.get(get_ident(), [])[-1:]:
        innermost.append(copy._copy_at)
    return copy


def _copy_at(frame: DataFrame) -> str | None:
    return vars(frame).get("_copy_at")


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the copies that :func:`cut` writes inside, but for those of the frames handed to the function it gives.

    That function writes its frame, unless ``cut`` has just done so, and leaves the copy to the caller's own ``passing``.
    Nothing else that was made inside may be read afterwards.
    """
    scopes, inner = _OPEN.setdefault(get_ident(), []), []
    outer = scopes[-1] if scopes else []
    scopes.append(inner)

    def keep(df: DataFrame) -> DataFrame:
        copy = df if _copy_at(df) in inner else cut(df)
        inner.remove(_copy_at(copy))
        outer.append(_copy_at(copy))
        return copy

    try:
        yield keep
    finally:
        scopes.pop()
        if not scopes:
            del _OPEN[get_ident()]
        _delete(spark, inner)


def give_back(*frames: DataFrame) -> None:
    """Delete the copies behind frames of :func:`cut` that nothing reads any more; other frames have none."""
    for frame in frames:
        path = _copy_at(frame)
        for scope in _OPEN.get(get_ident(), []):
            if path in scope:
                scope.remove(path)
        if path is not None:
            _delete(frame.sparkSession, [path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
