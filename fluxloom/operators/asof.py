"""As-of join: every row of one side with the last row of the other at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: Column, right_at: Column, right_tie: Column, width: int) -> DataFrame:
    """``left`` with ``matched``, the latest row (a struct) of ``right`` of the same ``by`` at or before ``left_at``; null if there is none.

    Times are whole numbers.  Of rows of ``right`` tied in time the one with the greatest ``right_tie`` counts.  Null keys
    match nothing, null times neither match nor are matched.  Work is linear: both sides are cut into slices of ``width``
    per key, each slice is sorted on its own, and the last row of every slice is carried over the slices after it, so a
    key with a third of all rows is as many tasks' work as it has slices.
    """
    by = list(by)
    order = F.struct(F.col("_at"), F.col("_tie"))
    l_ = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], left_at.cast("bigint").alias("_at"))
    r_ = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], right_at.cast("bigint").alias("_at"), right_tie.alias("_tie"))
    keys = [f"_k{i}" for i in range(len(by))]
    r_ = r_.where(" and ".join(f"{k} is not null" for k in [*keys, "_at"]))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    slice_ = F.floor(F.col("_at") / F.lit(width)).cast("bigint")
    both = l_.withColumn("_r", none(r_, "_r")).withColumn("_tie", none(r_, "_tie")).withColumn("_left", F.lit(1)).unionByName(r_.withColumn("_l", none(l_, "_l")).withColumn("_left", F.lit(0))).withColumn("_slice", slice_)
    # rows of the right side come before those of the left at the same time
    inside = Window.partitionBy(*keys, "_slice").orderBy("_at", "_left", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_in", F.last("_r", ignorenulls=True).over(inside)).where("_left = 1")
    ends = both.groupBy(*keys, "_slice").agg(F.max_by("_r", F.when(F.col("_left") == 0, order)).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("_slice").alias("_c_slice"), F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    on = F.col("_slice") == F.col("_c_slice")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_c{k}"))
    out = seen.join(carried, on, "left")
    usable = F.col("_at").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    return out.select("_l.*", F.when(usable, F.coalesce("_in", "_carry")).alias("matched"))
