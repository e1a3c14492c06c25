"""Joins that fit both a small and a large lookup side."""

import operator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from sluice.session import scratch_dir

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
LOCAL_ROWS = 10_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPE: ContextVar = ContextVar("scratch_tables", default=None)


def fits_broadcast(df: DataFrame, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> bool:
    """Measure a table by one aggregate, whatever the statistics of its files say."""
    seen = df.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("size")).first()
    return seen["n"] <= max_rows and seen["size"] <= max_bytes


def _row_bytes(df):
    """The bytes of a row: texts by their length, nested values by their JSON, others as a word."""
    def width(field):
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            length = F.octet_length(field.name)
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            length = F.octet_length(F.to_json(field.name))
        else:
            return F.lit(8)
        return F.coalesce(length, F.lit(0)) + 8
    return reduce(operator.add, map(width, df.schema.fields)).cast("bigint")


def lookup_join(big: DataFrame, small: DataFrame, on, how="left", **limits) -> DataFrame:
    """Join with a lookup table of unknown size.

    A lookup side that was measured to be small is broadcast, so that `big` is not shuffled.
    Beyond that it is a shuffled join, where AQE splits a hot key of the `big` side. AQE does so
    only for sides that are shuffled for this join, not for a reused aggregation, so the lookup
    side is stored first.
    """
    if fits_broadcast(small, **limits):
        return big.join(F.broadcast(small), on, how)
    return big.join(stored(small), on, how)


@contextmanager
def scratch_tables(spark):
    """Tables that `stored` writes in here are removed at the end.

    One stored with `keep` belongs to the scope around this one, or stays where there is none. A table that is
    not computed yet must not read a removed one: store what leaves the scope.
    """
    own = []
    token = _SCOPE.set((own, _SCOPE.get()))
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for folder in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """The table, written to the shared folder and read from there; see `scratch_tables` for how long.

    Shuffle files of the write are of no use once it has ended, and go at once; Spark would
    keep them on the executors' disks until the driver's memory is collected.
    """
    spark = df.sparkSession
    folder = scratch_dir(spark, "table")
    scope = _SCOPE.get()
    if scope and keep:
        scope = scope[1]
    if scope:
        scope[0].append(folder)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def computed_once(df: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """The rows of a costly table, so that using it twice does not compute it twice.

    It is stored in the shared folder; up to `local_rows` rows are then kept in the plan.
    """
    table = stored(df)
    rows = table.limit(local_rows + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= local_rows else table


def null_safe_lookup(big: DataFrame, small: DataFrame, on: list, how="left", **limits) -> DataFrame:
    """`lookup_join` where null equals null, keeping one copy of the keys.

    Structs compare their null fields as equal, and a struct is a plain hash-partitioning key.
    """
    rest = [c for c in small.columns if c not in on]
    keyed = small.select(F.struct(*on).alias("_key"), *rest)
    return lookup_join(
        big.withColumn("_key", F.struct(*on)), keyed, "_key", how, **limits).drop("_key")
