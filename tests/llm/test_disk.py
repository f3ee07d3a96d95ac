"""What the operators leave on the disks of executors, and what they shuffle."""

import glob
import time

from pyspark.sql import functions as F

from skyfix.llm import suffixes
from skyfix.llm.common import CLEANUP, written
from skyfix.llm.texts import held_by_several


def _shuffled(spark) -> set[str]:
    return {f for d in (spark.sparkContext.getConf().get("spark.local.dir", "/tmp")).split(",") for f in glob.glob(f"{d}/blockmgr-*/*/shuffle_*.data")}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_leave_no_shuffle_files(spark):
    held, before = _shuffled(spark), spark.conf.get(CLEANUP)
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "seven")
    deadline = time.time() + 10
    while _shuffled(spark) - held and time.time() < deadline:
        time.sleep(0.1)
    assert not _shuffled(spark) - held
    assert table.count() == 7 and spark.conf.get(CLEANUP) == before


def test_entries_are_dealt_once_where_a_join_by_row_follows(spark):
    entries = written(spark.range(400).select((F.col("id") % 40).alias("row"), (F.col("id") * 7 % 90).alias("key")).distinct(), "entries")
    rows = written(spark.range(40).select(F.col("id").alias("row"), (F.col("id") * 2).alias("n")), "rows")
    found = held_by_several(entries).groupBy("row").agg(F.collect_list(F.struct("holders", "key")).alias("held")).join(rows, "row")
    assert found.count() == 40
    found.collect()
    assert "ReusedExchange" in _plan(found)


def test_texts_stay_where_they_are_when_passages_are_cut(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage + " one"), (2, "two " + passage + " zwei"), (3, "three")], "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = suffixes.without_repeats(docs)
        assert sorted(map(tuple, cut.collect())) == [(1, passage + " one"), (2, "two zwei"), (3, "three")]
        assert "Exchange hashpartitioning" not in _plan(cut)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
