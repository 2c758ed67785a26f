"""What is left on disk of the queries that make intermediate tables."""

import time

from pyspark.sql import functions as F

from folioscope.llm.common import SHUFFLES_GO, stored


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in files.split("\n") if "/shuffle_" in name}


def test_shuffles_of_a_stored_table_go_once_it_is_written(spark):
    before = shuffle_files(spark)
    table = stored(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    for _ in range(20):  # executors delete in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.5)
    assert not shuffle_files(spark) - before
    assert table.count() == 7 and spark.conf.get(SHUFFLES_GO, "false") == "false"
