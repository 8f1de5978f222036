"""Where rows meet a model: calls in batches on the executors, in which one row's failure stays that row's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stripped

#: Rows of one call.
CALL = 64


@dataclass(frozen=True)
class Model:
    """A model as a function of a row's texts, or with `batched` of a list of such rows, that gives a text for each.

    A call that raises is repeated up to `tries` times in all, for a batch then row by row. It must be
    picklable, and open what it needs in the task.
    """

    call: Callable
    batched: bool = False
    tries: int = 2

    def replies(self, rows: list[tuple]) -> list[tuple[str | None, str | None]]:
        """(reply, error) of each row; one of the two is null, unless the model gives null itself."""
        if self.batched and len(rows) > 1:
            try:
                found = list(self.call(rows))
                if len(found) == len(rows):
                    return [(x, None) for x in found]
            except Exception:  # noqa: BLE001  which row it was comes out below
                pass
        return [self._one(r) for r in rows]

    def _one(self, row: tuple) -> tuple[str | None, str | None]:
        error = None
        for _ in range(max(1, self.tries)):
            try:
                return (list(self.call([row]))[0] if self.batched else self.call(*row)), None
            except Exception as e:  # noqa: BLE001  whatever a model raises is its row's error
                error = f"{type(e).__name__}: {e}"
        return None, error


def asked(df: DataFrame, model: Model, inputs: list[str], to: str = "reply") -> DataFrame:
    """df with the model's reply to each row's input columns (strings, null as such), and `to`_error: why there is none."""
    names = [to, f"{to}_error"]
    kept = [c for c in df.columns if c not in names]

    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), CALL):
                part = batch.slice(at, CALL)
                found = model.replies(list(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs))))
                held = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*held, *[pa.array([x[k] for x in found], pa.string()) for k in (0, 1)]], names=[*kept, *names])

    fields = [*[df.schema[c] for c in kept], *[T.StructField(n, T.StringType()) for n in names]]
    return df.mapInArrow(run, T.StructType(fields))


def rewritten(questions: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """questions with query as the model writes it anew, and rewrite_error. Where it fails or writes nothing, the question itself is searched for; with `keep`, the question stands before what was written."""
    found = asked(questions, model, ["query"], "rewrite")
    new = stripped(F.coalesce("rewrite", F.lit("")))
    text = F.concat("query", F.lit("\n\n"), new) if keep else new
    return found.withColumn("query", F.when((new == "") | (new == F.col("query")), F.col("query")).otherwise(text)).drop("rewrite")
