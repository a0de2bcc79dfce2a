"""What a step leaves behind on disks, and what it asks of the driver."""

import time

from pyspark.sql import functions as F

from tests.llm.helpers import corpus, documents

from lexmesh.llm import minhash
from lexmesh.llm.common import CLEAN, broadcast_if_small, cut, semi_join
from lexmesh.llm.linededup import dedup_report
from lexmesh.llm.neardedup import keep_first


def shuffled(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in blocks.split() if b.startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    was, before = shuffled(spark), spark.conf.get(CLEAN, None)
    sums = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(3, "id").groupBy("k").agg(F.sum("id").alias("n"))
    back, until = cut(sums), time.time() + 10
    while shuffled(spark) - was and time.time() < until:
        time.sleep(0.1)
    assert not shuffled(spark) - was
    assert sorted(r.n for r in back.collect()) == sorted(sum(range(k, 1000, 7)) for k in range(7))
    assert spark.conf.get(CLEAN, None) == before


def test_keys_for_the_driver_are_few(spark):
    """What a table of 6 GB asks for (over 300,000 keys) isn't broadcast through the driver."""
    hinted = lambda n: "Hint" in broadcast_if_small(spark.range(n), minhash.MAX_KEYS)._jdf.queryExecution().logical().toString()
    assert hinted(1000) and not hinted(300_000)


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    rows = documents(spark, [r for r in corpus() if r[0] is not None and r[0] != 3])
    ids = sorted(r.doc_id for r in keep_first(rows).collect())
    monkeypatch.setattr(minhash, "MAX_KEYS", 0)
    assert sorted(r.doc_id for r in keep_first(rows).collect()) == ids


def shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_joins_with_many_keys_shuffle_few_other_rows(spark):
    """Beyond the broadcast's limit what has no key mostly stays where it is, and none that has one is lost."""
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("k"), F.unhex(F.md5(F.col("id").cast("string"))).alias("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for col in "kb":
            keys = cut(rows.filter("id % 40 = 3").select(F.col(col).alias("w")))
            before = shuffled_rows(spark)
            got = sorted(r.id for r in semi_join(rows, col, keys, 10).collect())
            assert got == list(range(3, 40_000, 40))
            assert shuffled_rows(spark) - before < 10_000
            assert semi_join(rows, col, keys, 1000).count() == 1000 and semi_join(rows, col, keys.limit(0), 0).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_without_broadcasts(spark, monkeypatch):
    rows = documents(spark, corpus())
    tidy = lambda: sorted(map(repr, dedup_report(rows).collect()))
    want = tidy()
    monkeypatch.setattr(minhash, "MAX_KEYS", 0)
    assert tidy() == want
