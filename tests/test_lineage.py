import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusweave.lineage import cut, give_back, passing

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture()
def copies(spark):
    cut(spark.range(1))

    def there():
        return {p.name for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("rdd-*")}

    before = there()
    return lambda: len(there() - before)


def test_passing_copies_are_deleted_and_kept_ones_are_not(spark, copies):
    with passing(spark) as keep_outer:
        with passing(spark) as keep:
            first = cut(spark.range(10))
            second = cut(first.filter("id < 5"))
            third = keep(second.withColumn("n", F.col("id") + 1))
            second = keep(second)  # written just before, so not written again
            assert copies() == 3
        assert copies() == 2 and third.count() == second.count() == 5
        last = keep_outer(third.filter("n > 1"))
    assert copies() == 1 and last.count() == 4
    give_back(last, spark.range(1))
    assert copies() == 0


def test_copies_of_failed_work_are_deleted(spark, copies):
    with pytest.raises(ZeroDivisionError):
        with passing(spark):
            cut(spark.range(10))
            1 / 0
    assert copies() == 0
    cut(spark.range(2))  # nothing is open any more
    assert copies() == 1


def test_shuffle_files_go_once_the_copy_is_there(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP)
    made = cut(spark.range(1000).repartition(7).groupBy((F.col("id") % 5).alias("k")).count())
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert made.count() == 5 and spark.conf.get(CLEANUP) == setting
