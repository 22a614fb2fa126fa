"""Activity-log stream (S15): file source -> foreachBatch append with keys."""

import pytest
from pyspark.sql import functions as F

from crmlake.streaming import activity as A

SF = "/root/testdata/sf0.001"


def _run(spark, land):
    src = A.entries_from_events(A.event_stream(spark, f"{land}/in", "*.parquet"))
    A.start_activity_stream(spark, src, f"{land}/log", f"{land}/ck").awaitTermination()


def test_stream_appends_and_restart_continues_keys(spark, tmp_path):
    land = str(tmp_path)
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.filter("event_id < 50").write.mode("append").parquet(f"{land}/in")
    _run(spark, land)
    ev.filter("event_id >= 50 AND event_id < 80").write.mode("append").parquet(f"{land}/in")
    _run(spark, land)  # same checkpoint: only the new files, next batch id
    log = A.read_log(spark, f"{land}/log")
    r = log.agg(F.count("*").alias("n"), F.min("LogID").alias("lo"), F.max("LogID").alias("hi"),
                F.countDistinct("LogID").alias("d")).first()
    assert (r.n, r.lo, r.hi, r.d) == (80, 1, 80, 80)
    # keys follow entry time within a batch
    first = log.filter("LogID <= 50").orderBy("LogID").select("CreatedAt").collect()
    assert [x[0] for x in first] == sorted(x[0] for x in first)
    _run(spark, land)  # nothing new: no batch, nothing duplicated
    assert A.read_log(spark, f"{land}/log").count() == 80


def test_stream_continues_an_existing_log_and_stamps_undated_entries(spark, tmp_path):
    land = str(tmp_path)
    ev = spark.read.parquet(f"{SF}/events.parquet").filter("event_id < 6")
    ev.withColumn("ts", F.when(F.col("event_id") > 2, F.col("ts"))).write.parquet(f"{land}/in")
    src = A.entries_from_events(A.event_stream(spark, f"{land}/in", "*.parquet"))
    existing = spark.createDataFrame([(41,), (7,)], "LogID long")
    before = spark.range(1).select(F.localtimestamp()).first()[0]
    A.start_activity_stream(spark, src, f"{land}/log", f"{land}/ck", existing=existing).awaitTermination()
    log = A.read_log(spark, f"{land}/log")
    assert sorted(r[0] for r in log.select("LogID").collect()) == list(range(42, 48))
    assert log.filter(F.col("CreatedAt") >= F.lit(before)).count() == 3


def test_stream_fails_on_unreadable_keys(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = A.entries_from_events(spark.read.parquet(f"{SF}/events.parquet").limit(3))
    write = A._append_batch(log, A.ENTRY_ORDER + ["seq"], None, 1)
    write(batch, 0)
    for part in (tmp_path / "log" / "_keys" / "batch_id=0").glob("*.parquet"):
        part.write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017 - any reader error, never a restart at key 1
        write(batch, 1)
