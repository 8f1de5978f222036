"""Mixing sources to target weights, with DataFrame operations only.

Sizes are summed per source, targets are shared out by weight under a cap on repetition, and every
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the
rate's fraction.

Defined results: a null text has size 0; null is a source of its own and comes last; a source of
size 0 has rate 0, and its documents are taken 0 times; rows with the same key and source draw
alike; an empty table gives an empty mix; columns other than the named ones pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, staged

#: How many seeds are tried for each source; the one whose mix comes nearest to the target is used.
SEEDS = 8


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with target and rate.

    Water filling: at the level where all targets add up to the budget, each is level x weight or
    its cap, whichever is less. One row per source: the windows hold the table of sources alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1)
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    out = out.withColumn("full_at", F.col("cap") / F.col("weight"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("level", (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    out = out.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"])
    out = out.withColumn("target", F.least("cap", F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("source", "source_size", "target", rate.alias("rate"))


def _draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 8 hexadecimal digits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * seed + 1, 8), 16, 10).cast("double") / float(2**32)


def _copies(seed: int) -> Column:
    return (F.floor("rate") + F.when(F.col(f"u{seed}") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def mix_plan(df: DataFrame, weights=(3, 1, 2), share=1.5, most=2.0, key="doc_id", text="text", source="source") -> DataFrame:
    """key, source, size, source_size, target, rate and copies of each row.

    Sizes are counted once and staged; sums per source are combined before the shuffle, so a source
    with a third of all rows costs one row per task.
    """
    sized = staged(df.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size")), "mix-sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    name = F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("null")), F.coalesce(F.col("d.source"), F.lit("null")))
    drawn = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.source_size", "p.target", "p.rate", *[_draw(name, k).alias(f"u{k}") for k in range(SEEDS)])
    taken = drawn.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(F.col("size") * _copies(k)).alias(f"t{k}") for k in range(SEEDS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))["seed"]
    chosen = taken.select(F.col("source").alias("of"), best.alias("seed"))
    copies = F.element_at(F.array(*[_copies(k) for k in range(SEEDS)]), F.col("seed") + 1)
    out = drawn.join(chosen, F.col("source").eqNullSafe(F.col("of")))
    return out.select("key", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(df: DataFrame, weights=(3, 1, 2), share=1.5, most=2.0, key="doc_id", text="text", source="source") -> DataFrame:
    """df's rows, each as often as the mix takes it. Rows with the same key and source are taken alike."""
    plan = mix_plan(df, weights, share, most, key, text, source).groupBy("key", "source").agg(F.first("copies").alias("copies"))
    plan = plan.select(F.col("key").alias("_mix_key"), F.col("source").alias("_mix_source"), F.col("copies").alias("_mix_copies"))
    out = df.join(plan, df[key].eqNullSafe(F.col("_mix_key")) & df[source].eqNullSafe(F.col("_mix_source")))
    times = F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))
    return out.filter("_mix_copies > 0").withColumn("_mix_copy", F.explode(times)).select(*[F.col(f"`{c}`") for c in df.columns])
