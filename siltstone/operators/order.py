"""Exact order statistics of groups of any size: selection by ranges and rank offsets, without holding a group's values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stage import written

#: Values of a group that one task sorts.
FEW = 100_000
#: Ranges into which a round cuts what is left of a group.
CUTS = 64


def selected(df: DataFrame, group: str, value: str, place: Callable[[Column], Column], few: int = FEW) -> DataFrame:
    """(group, n, least, selected, most): of each group's known values the number, the ends, and the one at a place from 0 in rising order.

    place gives the place from n. A group of more than `few` values is cut at approximate quantiles; exact
    counts tell which range holds the place and what lies before it, and only that range is looked at again.
    """
    known = written(df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v")), "known")
    ends = written(known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")), "ends")
    state = ends.select("g", "n", F.col("least").alias("lo"), F.col("most").alias("hi"), place(F.col("n")).cast("long").alias("at"))
    settled = None
    while True:
        done = written(state.filter(~((F.col("lo") < F.col("hi")) & (F.col("n") > few))), "settled")
        settled = done if settled is None else settled.unionByName(done)
        open_ = written(state.filter((F.col("lo") < F.col("hi")) & (F.col("n") > few)), "open")
        if open_.isEmpty():
            break
        inside = _inside(known, open_)
        marks = inside.groupBy("g").agg(F.percentile_approx("v", [k / CUTS for k in range(1, CUTS)], 10 * CUTS).alias("marks"))
        # A value's range: how many marks lie below it. A mark belongs to the range that it ends.
        cut = inside.join(written(marks, "marks").alias("m"), F.col("i.g").eqNullSafe(F.col("m.g"))).select("i.g", "i.v", "i.at", F.size(F.filter("marks", lambda m: m < F.col("v"))).alias("part"))
        parts = cut.groupBy("g", "at", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # CUTS rows
        held = parts.withColumn("before", before).filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n")))
        state = written(held.select("g", "n", "lo", "hi", (F.col("at") - F.col("before")).alias("at")), "ranges")
    last = Window.partitionBy("g").orderBy("v")  # up to `few` values
    flat = settled.filter("lo = hi OR (lo IS NULL AND hi IS NULL)").select("g", F.col("lo").alias("selected"))
    short = _inside(known, settled.filter("lo < hi")).select("i.g", "i.v", "i.at").withColumn("k", F.row_number().over(last) - 1)
    found = flat.unionByName(short.filter("k = at").select("g", F.col("v").alias("selected")))
    out = ends.alias("e").join(found.alias("f"), F.col("e.g").eqNullSafe(F.col("f.g")))
    return out.select(F.col("e.g").alias(group), "n", "least", "selected", "most")


def _inside(known: DataFrame, state: DataFrame) -> DataFrame:
    """Alias i: (g, v, at) of values within their group's range."""
    s = state.select(F.col("g").alias("sg"), "lo", "hi", "at")
    rows = known.join(s, F.col("g").eqNullSafe(F.col("sg")) & F.col("v").between(F.col("lo"), F.col("hi")))
    return rows.select("g", "v", "at").alias("i")
