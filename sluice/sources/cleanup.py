"""Deleting files that are read or expired: the only operators that destroy input."""

import posixpath
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.joins import scratch_tables, stored
from sluice.functions.times import epoch_micros
from sluice.session import scratch_dir
from sluice.sources.ranges import readable, store_of

CHUNK = 1000
TASK_FILES = 10_000
# What need not be tried again.
SETTLED = ("deleted", "absent", "not a file")


def expire_older_than_days(listing: DataFrame, now, days: int = 6) -> DataFrame:
    """Files whose age in whole days is more than `days`; list with `recursive=True`."""
    # A whole-day age of more than `days` is an age of `days` + 1 days or more.
    now = now if isinstance(now, Column) else F.lit(now)
    age = epoch_micros(listing, "modified", now) - epoch_micros(listing, "modified")
    return listing.where(age >= F.lit((days + 1) * 86_400_000_000))


def _resolved(uri):
    """(scheme, host, path) with `.`, `..` and repeated slashes resolved."""
    plain = urlsplit(uri.replace("?", "%3F").replace("#", "%23"))
    return plain.scheme or "file", plain.netloc, posixpath.normpath("/" + plain.path.lstrip("/")) if (
        plain.path.startswith("/")) else posixpath.normpath(plain.path)


def inside(path: str, root: str) -> bool:
    """True if `path` lies below `root` once `..` is resolved."""
    (scheme, host, name), (root_scheme, root_host, root_name) = _resolved(path), _resolved(root)
    return (scheme, host) == (root_scheme, root_host) and name.startswith(
        root_name.rstrip("/") + "/")


def _checked_root(root):
    if not root.strip() or _resolved(root)[2] in ("/", ".") or _resolved(root)[2].startswith(".."):
        raise ValueError("refusing to delete below the root of the file system")


def _outside(paths: DataFrame, root: str) -> DataFrame:
    """The paths that are not below `root`, found in tasks."""
    def outside(batches):
        for batch in batches:
            yield batch.filter(pa.array([not inside(path, root) for path in batch["path"].to_pylist()], pa.bool_()))
    return paths.mapInArrow(outside, "path string")


def dealt(paths: DataFrame) -> DataFrame:
    """The rows dealt by `path`, at most about `TASK_FILES` to a task, so that no task grows with the table."""
    tasks = max(4 * paths.sparkSession.sparkContext.defaultParallelism, -(-paths.count() // TASK_FILES))
    return paths.repartition(tasks, "path")


def delete_in_tasks(listing: DataFrame, root: str, outcomes: str) -> DataFrame:
    """Delete the listed files below `root` in tasks; returns (path, state), which is kept in the folder `outcomes`.

    Nothing is deleted if any path lies outside. States are `deleted`, `absent`, `not a file`, or the reason of a
    failure. A further call with the same folder skips the paths that have been deleted, were absent or are no files.
    Tasks must be able to open the store, see `ranges.readable`.
    """
    _checked_root(root)
    spark = listing.sparkSession
    paths = stored(listing.select("path").distinct())
    wrong = _outside(paths, root).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['path']} is not below {root}")

    def delete(batches):
        for batch in batches:
            names = batch["path"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["path"], pa.array([_deleted(name) for name in names], pa.string())], ["path", "state"])

    schema = "path string, state string"
    before = _outcomes(spark, outcomes, schema)
    left = paths if before is None else paths.join(
        before.where(F.col("state").isin(*SETTLED)).select("path"), "path", "left_anti")
    dealt(stored(left)).mapInArrow(delete, schema).write.mode("append").parquet(outcomes)
    # A path that was tried again has several states; that of the last try comes last in this order.
    rank = F.when(F.col("state") == "deleted", 3).when(F.col("state").isin(*SETTLED), 2).otherwise(1)
    return _outcomes(spark, outcomes, schema).groupBy("path").agg(F.max_by("state", rank).alias("state"))


def _deleted(path):
    """Delete one file; returns its state."""
    store, name = store_of(path)
    try:
        info = store.get_file_info(name)
        if info.type == pyarrow.fs.FileType.NotFound:
            return "absent"
        if info.type != pyarrow.fs.FileType.File:
            return "not a file"
        store.delete_file(name)
        return "deleted"
    except FileNotFoundError:
        return "absent"
    except OSError as failure:
        return f"failed: {failure}"


def _outcomes(spark, folder, schema):
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def delete_files(listing: DataFrame, root: str, dry_run: bool = True) -> int:
    """Delete the listed files below `root`; returns how many (or how many it would delete).

    All paths are checked in tasks before the first file goes, and tasks delete them. Where tasks cannot open the
    store, the driver makes the calls, one by one.
    """
    _checked_root(root)
    spark = listing.sparkSession
    with scratch_tables(spark):
        paths = stored(listing.select("path").distinct())
        wrong = _outside(paths, root).limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0]['path']} is not below {root}")
        if dry_run:
            return paths.count()
        first = paths.first()
        if first is None:
            return 0
        if readable(first["path"]):
            return delete_in_tasks(paths, root, scratch_dir(spark, "deleted")).where("state = 'deleted'").count()
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        rows, deleted = paths.toLocalIterator(), 0
        while chunk := list(islice(rows, CHUNK)):
            for row in chunk:
                path = jvm.org.apache.hadoop.fs.Path(row["path"])
                fs = path.getFileSystem(conf)
                if fs.exists(path) and fs.getFileStatus(path).isFile():
                    deleted += bool(fs.delete(path, False))
        return deleted
