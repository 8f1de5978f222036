"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch: texts are long, and each task holds a batch on either side of the pipe.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may lack one; it gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends there and no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def mapped(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_ROWS rows, unless the session names another number than Spark's own.

    At a task's end its Python process, which waits for the next task, gives back the memory that it no longer needs.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, BATCH_ROWS)

    def tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo folds; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def texts(batch, name: str = "text") -> list[bytes]:
    """An Arrow batch's text column as UTF-8 bytes; null is the empty text."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def values(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


_POW = np.empty(0, np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each ASCII-white-space word of the text, in order."""
    global _POW
    b = np.frombuffer(text, np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    longest = int((stop - start).max())
    if len(_POW) < longest:
        power = np.empty(max(64, 2 * longest), np.uint64)
        power[0] = 1
        power[1:] = 0x9E3779B97F4A7C15
        _POW = np.multiply.accumulate(power)
    offset = np.arange(len(b)) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(b)]))))
    term = np.where(inside, (b.astype(np.uint64) + np.uint64(1)) * _POW[np.minimum(offset, len(_POW) - 1)], np.uint64(0))
    return mixed(np.add.reduceat(term, start))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """df with its columns named c0, c1 and so on, the new name of each, and the columns that bring the old names back.

    An operator that adds columns of its own to such rows can't clash with what the table holds.
    """
    new = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), new, [F.col(n).alias(c) for c, n in new.items()]


def widened(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The schema of df's columns `names`, with the columns of the DDL text `more` after them."""
    return T.StructType([df.schema[n] for n in names] + T.StructType.fromDDL(more).fields)
