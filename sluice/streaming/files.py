"""The watched folder as a stream: each finished file is read once per checkpoint."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import piece_text
from sluice.functions.times import older_than
from sluice.operators.lines import split_lines, tag_category
from sluice.sources.files import (
    DEFAULT_PATTERN, DEFAULT_RETENTION_SECONDS, delimited, escape_glob, folder_uri, full_match,
    record_pieces, uri_decoded)
from sluice.sources.ranges import ranges_of, read_ranges, readable

# Spark's age limit counts back from the newest file and skips in silence; a file with a wrong
# date must not hide others, so the limit is set beyond any age.
NO_AGE_LIMIT = "36500d"


def exact_glob(pattern: str) -> str | None:
    """The glob that matches the same names, for patterns of the form `^.*literal$`."""
    found = re.fullmatch(r"\^?\.\*((?:[\w\-]|\\\.)*)\$?", pattern)
    return "*" + found[1].replace("\\.", ".") if found else None


def _partition_folders(spark, directory):
    """True if the folder holds folders that the file source would take for partitions."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return any(status.isDirectory() and "=" in status.getPath().getName() for status in found)


def _watched(spark, directory, include_pattern, order, max_files, delete_after_read):
    """(streaming reader, folder) of a watched folder; see `stream_records`."""
    if order not in ("asc", "desc"):
        raise ValueError(f"order should be desc or asc, not {order!r}")
    folder = folder_uri(spark, directory, encoded=True)
    glob = exact_glob(include_pattern)
    if delete_after_read and glob is None:
        raise ValueError(f"delete after read needs a pattern like ^.*\\.log$, not {include_pattern}")
    if delete_after_read and _partition_folders(spark, directory):
        raise ValueError(f"delete after read: {directory} holds key=value folders")
    reader = spark.readStream.option("latestFirst", str(order == "desc").lower()).option(
        "maxFileAge", NO_AGE_LIMIT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if delete_after_read:
        reader = reader.option("cleanSource", "delete")
    else:  # folders named like key=value are folders, and their files are filtered out below
        reader = reader.option("recursiveFileLookup", "true")
    return reader, folder


def _selected(found, include_pattern, retention_seconds):
    found = found.where(full_match(F.col("file_name"), include_pattern))
    if retention_seconds is None:
        return found
    return found.where(~older_than(found, "modified", F.current_timestamp(), retention_seconds))


def stream_records(spark: SparkSession, directory: str, include_pattern: str = DEFAULT_PATTERN,
                   retention_seconds: int | None = DEFAULT_RETENTION_SECONDS, order: str = "asc",
                   max_files: int | None = None, delete_after_read: bool = False,
                   whole_files: bool = False) -> DataFrame:
    """New records of matching live files: RECORD columns without `rec`, which streams lack.

    Only the retention decides which files are too old. `delete_after_read` leaves the deletion to the file source, which
    deletes all files that it lists; it is refused unless it lists the matching files only.
    """
    reader, folder = _watched(spark, directory, include_pattern, order, max_files, delete_after_read)
    records = delimited(reader, escape_glob(directory), folder, whole_files)
    return _selected(records, include_pattern, retention_seconds).select("value", "file_path", "file_size", "block")


def stream_files_found(spark: SparkSession, directory: str, include_pattern: str = DEFAULT_PATTERN,
                       retention_seconds: int | None = DEFAULT_RETENTION_SECONDS, order: str = "asc",
                       max_files: int | None = None, delete_after_read: bool = False) -> DataFrame:
    """New matching live files themselves: path, file_name, modified, length. Contents are not read."""
    reader, folder = _watched(spark, directory, include_pattern, order, max_files, delete_after_read)
    meta = F.col("_metadata")
    listed = reader.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary").load(escape_glob(directory)).where(
        meta["file_path"] == F.concat(F.lit(folder + "/"), meta["file_name"]))
    return _selected(listed.select(
        uri_decoded(meta["file_path"]).alias("path"), uri_decoded(meta["file_name"]).alias("file_name"),
        meta["file_modification_time"].alias("modified"), meta["file_size"].alias("length")),
        include_pattern, retention_seconds)


def stream_lines(spark: SparkSession, directory: str, category: str, whole_files: bool = False,
                 **selection) -> DataFrame:
    """Streaming messages of a watched folder, one per line, with `file_path` as lineage.

    The stream is one of files, whose byte ranges tasks open and cut; lines are exact. Only in stores that tasks cannot
    open, records are scanned: row by row, a scan does not show whether a file ends with a line feed, so there a file
    whose last byte is a carriage return gives one empty line too many, and a byte order mark is lost.
    `whole_files` reads each file as one row, which must fit in memory.
    """
    if not whole_files and readable(folder_uri(spark, directory)):
        found = stream_files_found(spark, directory, **selection)
        lines = read_ranges(ranges_of(found.withColumn("offset", F.lit(0))))
        return tag_category(lines.select("file_path", "line"), category).select("topic", "data", "file_path")
    records = stream_records(spark, directory, whole_files=whole_files, **selection)
    if whole_files:
        lines = split_lines(records, "value", ["file_path"])
    else:
        lines = records.select(
            "file_path", F.is_valid_utf8("value").alias("_valid"),
            F.explode_outer(record_pieces(F.col("value"))).alias("line")
        ).select("file_path", piece_text(F.col("line"), F.col("_valid")).alias("line"))
    return tag_category(lines, category).select("topic", "data", "file_path")
