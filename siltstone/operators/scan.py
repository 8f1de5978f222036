"""Running numbers and carried values in groups of any size: a prefix scan over ranges in place of a window over a group.

A window puts a group into one task. Here rows are dealt by ranges of (group, order), so that a group lies
in neighbouring partitions; each partition numbers its own rows in order, and what stands before it, a count
and the last value for each group, is added up over one line for each partition and group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .stage import written


class _Line:
    """One group's state as a partition's rows go by: how many there were, and the last value of each carried column."""

    def __init__(self, carried: int):
        self.group, self.n, self.last = None, 0, [None] * carried

    def run(self, group: str, size: int, values: list[pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
        """Numbers of `size` rows of a group, and for each carried column the last value before each row."""
        if group != self.group:
            self.group, self.n, self.last = group, 0, [None] * len(values)
        numbers = np.arange(self.n + 1, self.n + size + 1)
        before = []
        for k, v in enumerate(values):
            held = pa.concat_arrays([pa.array([self.last[k]], v.type), v])
            at = np.maximum.accumulate(np.where(pc.is_valid(held).to_numpy(zero_copy_only=False), np.arange(size + 1), 0))
            before.append(held.take(pa.array(at[:-1])))
            self.last[k] = held[int(at[-1])].as_py()
        self.n += size
        return numbers, before


def _scanned(carry: list[str]):
    def run(batches):
        line = _Line(len(carry))
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(batch.schema.get_field_index("_group"))
            turn = pc.not_equal(groups.slice(1), groups.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
            values = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            parts = [line.run(groups[a].as_py(), b - a, [v.slice(a, b - a) for v in values]) for a, b in zip(starts, starts[1:])]
            new = [pa.array(np.concatenate([p[0] for p in parts]), pa.int64()), *[pa.concat_arrays([p[1][k] for p in parts]) for k in range(len(carry))]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_n", *[f"_before_{c}" for c in carry]])

    return run


def running(df: DataFrame, group: list[Column], order: list[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """df with _n, each row's number in its group (from 1, in order), and for each column of `carry` the group's last value before the row that isn't null.

    Rows alike in group and order may come in either order. Names that begin with _ are taken by this scan.
    """
    carry = carry or {}
    keyed = df.withColumns({"_group": F.to_json(F.struct(*[g.cast("string").alias(str(k)) for k, g in enumerate(group)]))})
    by = ["_group", *order]
    # What is carried is computed after the shuffle, whose ranges come from a first pass over the rows.
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({**carry, "_part": F.spark_partition_id()})
    fields = [*dealt.schema.fields, T.StructField("_n", T.LongType()), *[T.StructField(f"_before_{c}", dealt.schema[c].dataType) for c in carry]]
    rows = written(dealt.mapInArrow(_scanned(list(carry)), T.StructType(fields)), "scan")
    ends = rows.groupBy("_group", "_part").agg(F.max("_n").alias("_count"), *[F.max_by(F.coalesce(c, f"_before_{c}"), "_n").alias(f"_end_{c}") for c in carry])
    line = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select("_group", "_part", F.sum("_count").over(line).alias("_ahead"), *[F.last(f"_end_{c}", ignorenulls=True).over(line).alias(f"_ahead_{c}") for c in carry])
    # Only a partition's first group can have begun before it: a row for each partition at most.
    ahead = F.broadcast(written(ahead.filter(F.col("_ahead").isNotNull()), "scan-ahead"))
    out = rows.join(ahead, ["_group", "_part"], "left")
    out = out.withColumns({"_n": F.col("_n") + F.coalesce("_ahead", F.lit(0)), **{c: F.coalesce(f"_before_{c}", f"_ahead_{c}") for c in carry}})
    return out.select(*df.columns, "_n", *carry)
