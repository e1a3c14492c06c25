"""Comparison of two keyed snapshots, such as two listings of a configuration folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """added, changed (the version grew), removed or unchanged, per key."""
    no_version = F.lit(None).cast(current.schema[version].dataType)
    sides = previous.select(
        F.col(key).alias("key"), F.col(version).alias("old"), no_version.alias("new"),
        F.lit(True).alias("was"), F.lit(False).alias("is")
    ).unionByName(current.select(
        F.col(key).alias("key"), no_version.alias("old"), F.col(version).alias("new"),
        F.lit(False).alias("was"), F.lit(True).alias("is")))
    change = (
        F.when(~F.col("was"), "added").when(~F.col("is"), "removed")
        .when(F.col("new") > F.col("old"), "changed").otherwise("unchanged")
    )
    return sides.groupBy("key").agg(
        F.max("old").alias("old"), F.max("new").alias("new"),
        F.bool_or("was").alias("was"), F.bool_or("is").alias("is"),
    ).select("key", change.alias("change"))
