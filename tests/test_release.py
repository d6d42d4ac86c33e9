"""Files of finished shuffles go when they are released."""

import time

from pyspark.sql import functions as F

from tidemark.session import cut, release


def test_release_drops_the_last_shuffle(spark):
    def held():
        return set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split())

    release(spark)
    time.sleep(2)
    before = held()
    rows = cut(spark.range(1000).select((F.col("id") % 7).alias("k")).groupBy("k").count())
    assert {f for f in held() - before if "shuffle_" in f}
    release(spark)
    until = time.time() + 0.8  # well before py4j's thread wakes and another collection happens to run
    while time.time() < until and {f for f in held() - before if "shuffle_" in f}:
        time.sleep(0.05)
    assert not {f for f in held() - before if "shuffle_" in f}
    assert rows.count() == 7
