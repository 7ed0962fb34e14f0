"""Running totals over a whole table without gathering any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


def running_total(df: DataFrame, order: list[str], value: str, out: str, group: list[str] | None = None) -> DataFrame:
    """df plus `out`: the sum of `value` over the rows before this one, in `order` within `group`.

    Rows are dealt out by ranges of (group, order), so a group that holds a third of the rows is spread
    over many tasks; each range is summed by itself and then gets the total of the ranges before it. That
    total is made from one row per range and group. `order` must be unique within `group`.
    """
    group = group or []
    parted = df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id())
    parted = common.staged(parted, "ranges")
    keys = ["__part", *group]
    sums = parted.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parted = parted.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    parted = common.join_sized(parted, common.staged(sums, "sums"), keys, "inner")
    return parted.withColumn(out, F.col("__within") + F.col("__before")).drop("__part", "__within", "__before")
