"""Row numbers over lanes that may be larger than one task can sort."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.joins import computed_once, null_safe_lookup, stored

ONE_TASK_ROWS = 2_000_000


def row_numbers(df: DataFrame, lanes: list, order: list, out: str,
                one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Number the rows of each lane from 1 in `order` (make it total for a fixed result).

    Without lanes, rows are numbered range by range. A window sorts each lane in one task, which
    is right while the largest lane is small: lanes are counted first, and numbered range by range
    if one has more than `one_task_rows`. The numbers are the same either way.
    """
    if lanes:
        sizes = df.groupBy(*lanes).agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= one_task_rows:
            window = Window.partitionBy(*lanes).orderBy(*order)
            return df.withColumn(out, F.row_number().over(window).cast("bigint"))
    return _number_by_range(df, lanes, order, out)


def running_totals(df: DataFrame, order: list, measure: str, out: str) -> DataFrame:
    """Add the sum of `measure` over all rows up to each one in `order`, itself included, range by range.

    Only the rows of one range are accumulated together; the sums of the ranges before are added.
    """
    placed = _placed(df, order)
    ranges = placed.groupBy("_part").agg(F.sum(measure).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = computed_once(ranges.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(out, F.sum(measure).over(within)).join(F.broadcast(bases), "_part").withColumn(
        out, F.col(out) + F.col("_base")).drop("_at", "_part", "_base")


def _placed(df, keys):
    """The rows sorted by sampled ranges and stored once, with their place `_at` and their range `_part`."""
    keys = [*keys, "_place"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(
        df.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_place")
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))


def _number_by_range(df, lanes, order, out):
    """Sort by sampled ranges, store, and add to each row the rows of its lane before its range.

    The ranges come from a sample, so they may differ when computed again (a lost executor
    is enough). The sorted rows are therefore stored once, and both uses read that table.
    Rows that are equal in all keys are kept apart by their place, so no range is larger.
    """
    placed = _placed(df, [*lanes, *order])
    runs = placed.groupBy(*lanes, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per lane and range, so this window is small whatever the lane holds.
    before = Window.partitionBy(*(lanes or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        null_safe_lookup(placed, computed_once(bases), [*lanes, "_part"])
        .withColumn(out, F.col("_base") + F.col("_at") - F.col("_first") + 1)
        .drop("_at", "_part", "_first", "_base")
    )
