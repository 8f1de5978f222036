"""Decisions on a stream of requests against the table's, and an audit trail whose batches are replayed."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siltstone.operators.stage import shared_path
from siltstone.streaming import audit, limits

SCHEMA = "who string, ts timestamp, id long"
BEGIN = datetime(2024, 5, 1, tzinfo=timezone.utc)


def requests(seed, n=300):
    rng = random.Random(seed)
    out = [(rng.choice(["a", "b", None, "hot", "hot"]), BEGIN + timedelta(seconds=rng.randrange(0, 600)), k) for k in range(n)]
    return out + out[:20]  # some come twice


def test_stream_decides_as_the_table(spark):
    rows = spark.createDataFrame(requests(1), SCHEMA)
    far = spark.createDataFrame([("end", BEGIN + timedelta(days=400), -1)], SCHEMA)
    stream = limits.decided(limits.replayed(rows, far, 5), "who", "ts", "id", 4, 60, "1 hour")
    got = sorted(((r["who"], r["ts"], r["id"], r["allowed"]) for r in limits.finished(stream, "limits").collect()), key=str)
    want = audit.limited(rows, "who", "ts", 4, 60, "id").select("who", "ts", "id", "allowed")
    assert got == sorted(map(tuple, want.collect()), key=str)
    assert sum(x[3] for x in got) > 50 and not all(x[3] for x in got)


def test_windows_of_the_nearest_second(spark):
    at = [BEGIN + timedelta(seconds=59, milliseconds=k) for k in (0, 400, 600, 900)] + [BEGIN + timedelta(seconds=61)]
    rows = spark.createDataFrame([("a", t, k) for k, t in enumerate(at)], SCHEMA)
    far = spark.createDataFrame([("end", BEGIN + timedelta(days=400), -1)], SCHEMA)
    want = {0: True, 1: False, 2: True, 3: False, 4: False}  # 59.6 and 59.9 stand at the full minute
    assert {r["id"]: r["allowed"] for r in audit.limited(rows, "who", "ts", 1, 60, "id", nearest=True).collect()} == want
    stream = limits.decided(limits.replayed(rows, far, 2), "who", "ts", "id", 1, 60, "1 hour", nearest=True)
    assert {r["id"]: r["allowed"] for r in limits.finished(stream, "limits").collect() if r["id"] >= 0} == want
    counted = audit.requests(rows, "who", "ts", 1, nearest=True).orderBy("window").select("n", "rejected").collect()
    assert [tuple(r) for r in counted] == [(2, 1), (3, 2)]


def test_clients_share_the_state_rows_of_a_window(spark):
    """Many clients of one window are a few calls, not one each."""
    rows = spark.range(3000).select((F.col("id") % 1000).cast("string").alias("who"), F.timestamp_seconds(F.lit(int(BEGIN.timestamp())) + F.col("id") % 7).alias("ts"), "id")
    at, checkpoint, out = (shared_path(spark, x) for x in ("requests", "checkpoint", "decided"))
    rows.coalesce(1).write.parquet(at)
    query = limits.decided(spark.readStream.schema(SCHEMA).parquet(at), "who", "ts", "id", 2, 60, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 1 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= limits.SHARDS
    assert spark.read.parquet(out).filter("NOT allowed").count() == 1000  # the third of each is turned away at once


def test_missing_and_large_ids(spark):
    big = 2**60
    rows = [(None if k % 3 == 0 else big + k % 3, BEGIN + timedelta(seconds=k % 4), None if k % 5 == 0 else big + k) for k in range(60)]
    rows = spark.createDataFrame(rows, "who long, ts timestamp, id long")
    far = spark.createDataFrame([(None, BEGIN + timedelta(days=400), None)], rows.schema)
    stream = limits.decided(limits.replayed(rows, far, 3), "who", "ts", "id", 7, 60, "1 hour")
    got = sorted(((r["who"], r["ts"], r["id"], r["allowed"]) for r in limits.finished(stream, "limits").filter("ts < '2024-06-01'").collect()), key=str)
    assert got == sorted(map(tuple, audit.limited(rows, "who", "ts", 7, 60, "id").select("who", "ts", "id", "allowed").collect()), key=str)
    assert sum(x[3] for x in got) == 21


def test_a_client_of_many_requests(spark):
    """A shard's requests come in several parts, and its state is merged with them a few times."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = spark.createDataFrame(requests(4, 900), SCHEMA)
        far = spark.createDataFrame([("end", BEGIN + timedelta(days=400), -1)], SCHEMA)
        stream = limits.decided(limits.replayed(rows, far, 3), "who", "ts", "id", 60, 600, "1 hour", shards=1)
        got = sorted(((r["who"], r["ts"], r["id"], r["allowed"]) for r in limits.finished(stream, "limits").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(tuple, audit.limited(rows, "who", "ts", 60, 600, "id").select("who", "ts", "id", "allowed").collect()), key=str)


def test_late_requests_and_state_go_at_the_watermark(spark):
    """In order of time, with the watermark close behind: rows that come too late get no decision, and no state is left."""
    at, checkpoint, out = (shared_path(spark, x) for x in ("requests", "checkpoint", "decided"))
    t = lambda s: BEGIN + timedelta(seconds=s)
    for k, part in enumerate([[("a", t(1), 1), ("a", t(2), 2)], [("a", t(500), 3)], [("a", t(3), 4), ("b", t(501), 5)], [("z", t(5000), 6)], [("z", t(9000), 7)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(at)
        stream = limits.decided(spark.readStream.schema(SCHEMA).parquet(at), "who", "ts", "id", 1, 60, "1 minute")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["id"]: r["allowed"] for r in spark.read.parquet(out).collect()}
    assert got == {1: True, 2: False, 3: True, 5: True, 6: True}  # 4 came after the watermark had passed it, 7's window is open
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_no_requests(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert limits.finished(limits.decided(limits.replayed(none, none), "who", "ts", "id", 1), "limits").count() == 0


@pytest.mark.parametrize("replay", [False, True])
def test_audit_rows_are_written_once(spark, replay):
    at, trail, checkpoint = (shared_path(spark, x) for x in ("audit-in", "trail", "audit-checkpoint"))
    for k in range(3):
        spark.createDataFrame([(str(k), BEGIN, k), (str(k), BEGIN, k + 10)], SCHEMA).coalesce(1).write.mode("append").parquet(at)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
        limits.append_once(stream, trail, checkpoint, "main").trigger(availableNow=True).start().awaitTermination()

    run()
    if replay:  # the last batch's commit is lost, as when the driver dies after its write
        fs = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/2").getFileSystem(spark._jsc.hadoopConfiguration())
        assert fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/2"), False)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/.2.crc"), False)
        run()
    rows = spark.read.json(trail)
    assert sorted(r["id"] for r in rows.collect()) == [0, 1, 2, 10, 11, 12]
    assert rows.select(F.countDistinct("batch")).first()[0] == 3
