import time

from pyspark.sql import functions as F

from hazeframe.llm import store


def test_pin_removes_the_shuffle_of_its_write(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        blocks = tracker.getAllBlocks()
        return {n for n in (blocks.apply(i).name() for i in range(blocks.size())) if n.startswith("shuffle_")}

    before, conf = shuffles(), spark.conf.get(store.SHUFFLE_CLEANUP, None)
    d = store.pin(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")).repartition(5, "n"), "test")
    assert sorted(r["n"] for r in d.collect()) == [142, 143, 143, 143, 143, 143, 143]
    end = time.time() + 10
    while (left := shuffles() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(store.SHUFFLE_CLEANUP, None) == conf
