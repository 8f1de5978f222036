"""Fixed-window limits on a stream of requests: every request gets its decision, the same as over the table as a whole.

Requests come in any order, so a window's first `limit` are known for sure only when the watermark has
passed its end. Until then its state holds the `limit` earliest requests seen; what falls out of those can't
come back and is turned away at once. A timer at the window's end lets the rest in and drops the state, so
that state is bounded by open windows x limit, however many requests a client sends. Clients are dealt to
shards: a state row is a window's shard, so that a call works on the requests of many clients at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stage import shared_path
from .audit import nearest_second

#: Shards of a window's clients: few, since each costs a call for a micro-batch. A stream keeps their number as long as its checkpoint.
SHARDS = 32


def decided(events: DataFrame, key: str, time: str, tie: str, limit: int, seconds: int = 60, late: str = "10 minutes", nearest: bool = False, shards: int = SHARDS) -> DataFrame:
    """(key, time, tie, allowed) of each request of a stream: whether it is among the first `limit` of its key in its fixed window, by time, then tie.

    Requests later than the watermark (`late` behind the latest) get no decision; Spark counts them as
    dropped. A request that comes again counts again, as in a table. Null keys are one client, null ties
    come first; requests without a time are in no window and get no decision. No request is let in before
    its window has ended. nearest: the nearest whole second tells the window, which then ends half a second
    before its timer.
    """
    seen = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).filter(F.col(time).isNotNull())
    window = F.floor((nearest_second(time) if nearest else F.unix_timestamp(time)) / seconds)
    # Null keys have a shard of their own. Where one is missing, pandas would make the others' whole numbers floats, so that nulls are marked and filled.
    shard = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.hash(key), F.lit(shards)))
    filled = lambda c: F.coalesce(c, F.lit(0).cast(events.schema[c].dataType)) if isinstance(events.schema[c].dataType, T.IntegralType) else F.col(c)
    seen = seen.select(window.alias("window"), shard.alias("shard"), filled(key).alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("micros"), F.col(tie).isNotNull().alias("tied"), filled(tie).alias("tie"))
    kinds = {f.name: f.dataType for f in seen.schema.fields}
    names = ["key", "micros", "tied", "tie"]
    out = T.StructType([T.StructField("shard", T.IntegerType()), *[T.StructField(n, kinds[n]) for n in names], T.StructField("allowed", T.BooleanType())])
    held = T.StructType([T.StructField(n, T.ArrayType(kinds[n])) for n in names])

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, shard = group
        first = pd.DataFrame(dict(zip(names, state.get))) if state.hasTimedOut or state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield first.assign(shard=shard, allowed=True)
            return

        def merged(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, pd.DataFrame]:
            both = pd.concat(parts, ignore_index=True).sort_values(["micros", "tied", "tie"])
            among = both.groupby("key", dropna=False, sort=False).cumcount() < limit
            return both[among], both[~among].assign(shard=shard, allowed=False)

        parts, new = [] if first is None else [first], 0
        for pdf in batches:
            parts.append(pdf[names])
            new += len(pdf)
            if first is None or new >= len(first):  # as many new rows as are held at least, so that the work stays in proportion
                first, gone = merged(parts)
                parts, new = [first], 0
                if len(gone):
                    yield gone
        if new:
            first, gone = merged(parts)
            if len(gone):
                yield gone
        state.update(tuple(first[n].tolist() for n in names))
        state.setTimeoutTimestamp((int(window) + 1) * seconds * 1000)

    found = seen.groupBy("window", "shard").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.when(F.col("shard") >= 0, F.col("key")).alias(key), F.timestamp_micros("micros").alias(time), F.when(F.col("tied"), F.col("tie")).alias(tie), "allowed")


def replayed(rows: DataFrame, closing: DataFrame, files: int = 2) -> DataFrame:
    """The rows of a table as a stream of `files` micro-batches, then those of `closing`, whose times close all windows."""
    spark, at = rows.sparkSession, shared_path(rows.sparkSession, "replayed")
    rows.repartition(files).write.parquet(at)
    closing.select([F.col(f.name).cast(f.dataType) for f in rows.schema.fields]).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)  # oldest files first


def append_once(stream: DataFrame, path: str, checkpoint: str, name: str):
    """A writer that appends a stream to JSON lines under `path`, each micro-batch exactly once; start() it.

    A batch has a folder of its own, named by the stream and the batch's number, and is written whole or
    not at all: one that is there is left as it is, so that a batch replayed after a failure adds nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        at = f"{path}/stream={name}/batch={number}"
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return
        batch.write.mode("overwrite").json(at)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def finished(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream of rows gives until its sources are used up, as a table in the shared folder."""
    spark = stream.sparkSession
    at = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)
