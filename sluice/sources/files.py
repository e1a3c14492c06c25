"""Watched folders of finished text files: listing, selection, reading.

Paths are kept as the listing gives them (`file:/logs/a b.log`). `_metadata` columns are
URI-encoded (`a%20b.log`) and are decoded to the same form, so the two always join.
Spark does not list empty files and names that start with `_` or `.`.
"""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.joins import computed_once, lookup_join, stored
from sluice.functions.ranking import running_totals
from sluice.functions.text import (
    byte_length, cuttable, piece_bytes, piece_text, with_running_total)
from sluice.functions.times import older_than
from sluice.operators.lines import resume_lines, tag_category
from sluice.schema import RECORD
from sluice.sources.ranges import probe_ends, ranges_of, read_ranges, readable

DEFAULT_PATTERN = r"^.*\.log$"
DEFAULT_RETENTION_SECONDS = 86_400
_WIDE = "decimal(38,0)"
MARK = "\ufeff"


def escape_glob(path: str) -> str:
    """Spark takes paths for glob patterns; a folder or file name is to be taken literally."""
    return re.sub(r"([\[\]{}?*\\])", r"\\\1", path)


def uri_decoded(col: Column) -> Column:
    """A `_metadata` path or name as plain text (`url_decode` alone turns + into a space)."""
    plain = F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(col, F.lit("%")), plain).otherwise(col)


def full_match(col: Column, pattern: str) -> Column:
    """True if the whole text matches a Java regex (`rlike` alone finds it anywhere)."""
    return col.rlike(rf"^(?:{pattern})\z")


def folder_uri(spark: SparkSession, directory: str, encoded: bool = False) -> str:
    """The folder as its file system names it, which is how listings start their paths."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    path = hadoop_path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"{directory} does not exist or is not a directory")
    plain = fs.makeQualified(path).toString()
    return hadoop_path(plain).toUri().toString() if encoded else plain


def list_files(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """path, file_name, modified and length of the regular files in a folder.

    Only the listing is read: the file contents are pruned from the scan, and filters on these
    columns prune files from the listing. Files that go meanwhile are left out.
    """
    folder = folder_uri(spark, directory, encoded=True)
    meta = F.col("_metadata")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "ignoreMissingFiles", "true").load(escape_glob(directory))
    # Without recursive lookup, folders named like key=value would be read as partitions.
    if not recursive:
        files = files.where(meta["file_path"] == F.concat(F.lit(folder + "/"), meta["file_name"]))
    return files.select(
        uri_decoded(meta["file_path"]).alias("path"), uri_decoded(meta["file_name"]).alias("file_name"),
        meta["file_modification_time"].alias("modified"), meta["file_size"].alias("length"))


def match_files(listing: DataFrame, include_pattern: str = DEFAULT_PATTERN) -> DataFrame:
    """Files whose name (not path) fully matches: the pattern defines the data set."""
    return listing.where(full_match(F.col("file_name"), include_pattern))


def split_expired(listing: DataFrame, now,
                  retention_seconds: int = DEFAULT_RETENTION_SECONDS):
    """(live, expired) by age. Expired files are due for deletion, read or not.

    A file exactly at the limit is still live.
    """
    expired = older_than(listing, "modified", now, retention_seconds)
    return listing.where(~expired), listing.where(expired)


def unread_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger does not know."""
    return listing.join(ledger.select("path"), "path", "left_anti")


def unfinished_files(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """Ledger entries that are not completed and whose file still exists, to be read first."""
    return ledger.where(~F.col("completed")).join(listing, "path")


def order_files(listing: DataFrame, order: str = "asc") -> DataFrame:
    """Oldest (`asc`) or newest (`desc`) first; equal times are ordered by path."""
    if order not in ("asc", "desc"):
        raise ValueError(f"order should be desc or asc, not {order!r}")
    modified = F.col("modified")
    return listing.orderBy(modified.asc() if order == "asc" else modified.desc(), "path")


def plan_groups(waiting: DataFrame, order: str = "asc", max_files: int | None = None,
                max_bytes: int | None = None) -> DataFrame:
    """The files with `group`, from 0, in the given order; stored, so that all groups come from one listing.

    A group has `max_files` files at most. It ends with the file that brings it to `max_bytes`, where both limits
    count in part: a file takes up the larger of its shares of the two. Running sums go range by range.
    """
    if order not in ("asc", "desc"):
        raise ValueError(f"order should be desc or asc, not {order!r}")
    if max_files and max_bytes:
        share, whole = F.greatest(F.col("length").cast(_WIDE) * max_files, F.lit(max_bytes)), max_files * max_bytes
    elif max_bytes:
        share, whole = F.col("length"), max_bytes
    else:
        share, whole = F.lit(1), max_files
    if not whole:
        return stored(waiting.withColumn("group", F.lit(0).cast("bigint")))
    modified = F.col("modified")
    placed = running_totals(
        waiting.withColumn("_share", share.cast(_WIDE)),
        [modified.asc() if order == "asc" else modified.desc(), F.col("path")], "_share", "_total")
    return stored(placed.withColumn("group", F.expr(f"(_total - _share) div {whole}").cast("bigint")).drop(
        "_share", "_total"))


def delimited(reader, paths, folder: str | None = None, whole_file: bool = False) -> DataFrame:
    """A text scan with the place of each record; `reader` is spark.read or spark.readStream.

    Records end at line feeds, so large files are split over tasks. With `whole_file` a file
    is one record and must fit in memory. `folder` (encoded) leaves out files of subfolders.
    Files that go between listing and reading are skipped.
    """
    meta = F.col("_metadata")
    records = reader.option("ignoreMissingFiles", "true").text(
        paths, wholetext=whole_file, lineSep="\n")
    if folder is not None:
        records = records.where(
            meta["file_path"] == F.concat(F.lit(folder + "/"), meta["file_name"]))
    return records.select(
        "value", uri_decoded(meta["file_path"]).alias("file_path"),
        uri_decoded(meta["file_name"]).alias("file_name"),
        meta["file_size"].alias("file_size"), meta["file_modification_time"].alias("modified"),
        meta["file_block_start"].alias("block"))


def scan_files(spark: SparkSession, files) -> DataFrame:
    """The records of a list of files, or of the `path` column of a listing.

    The paths (and nothing else) pass through the driver, where Spark's own file index needs
    them in any case; `Pipeline.run_batch` gives it bounded groups. Files that have gone are skipped.
    """
    if isinstance(files, DataFrame):
        files = [row["path"] for row in files.select("path").toLocalIterator()]
    reader = spark.read.option("recursiveFileLookup", "true")
    for still in (lambda: files, lambda: [f for f in files if _exists(spark, f)]):
        there = still()
        if not there:
            return spark.createDataFrame([], RECORD)
        try:
            return with_record_number(delimited(reader, [escape_glob(f) for f in there]))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            failure = missing
    raise failure


def _exists(spark, path):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def scan_directory(spark: SparkSession, directory: str, include_pattern: str = DEFAULT_PATTERN,
                   now=None, retention_seconds: int | None = None) -> DataFrame:
    """The records of all matching live files, in one lazy scan.

    Spark evaluates filters on `_metadata` while listing, so other files are not opened.
    """
    folder = folder_uri(spark, directory, encoded=True)
    reader = spark.read.option("recursiveFileLookup", "true")
    records = delimited(reader, escape_glob(directory), folder).where(
        full_match(F.col("file_name"), include_pattern))
    if retention_seconds is not None:
        now = F.current_timestamp() if now is None else now
        records = records.where(~older_than(records, "modified", now, retention_seconds))
    return with_record_number(records)


def with_record_number(records: DataFrame) -> DataFrame:
    return records.withColumn("rec", F.monotonically_increasing_id()).select(*RECORD.names)


def lines_of(records: DataFrame, offsets: bool = False, exact: bool = True) -> DataFrame:
    """Lines of scanned records: file_path, block, rec, piece, line and optionally end_offset.

    (file_path, block, rec, piece) orders the lines. Records still hold carriage returns, each
    of which ends a line. A record does not show two things, which the total of its file does:
    whether the last one had a line feed (if not, a carriage return at its end is not followed
    by an empty line), and whether the scan has dropped a byte order mark. `exact` takes these
    totals, which reads the files a second time; pass False for files that are known to end
    with a line feed and to start without a mark. `offsets` needs the totals in any case.
    """
    if offsets:
        located = _with_record_ends(records)
    elif exact:
        located = _with_file_ends(records)
    else:
        located = records.withColumn("_bare", F.lit(False)).withColumn("_marked", F.lit(False))
    valid = F.col("_valid")
    pieces = (
        located
        .withColumn("value", F.when(
            F.col("_marked"), F.concat(F.lit(MARK), "value")).otherwise(F.col("value")))
        .withColumn("_valid", F.is_valid_utf8("value"))
        .withColumn("_pieces", record_pieces(F.col("value")))
    )
    place = ["file_path", "block", "rec"]
    keep = [*place, "_valid", (F.col("_bare") & (F.size("_pieces") > 1)).alias("_open_end"),
            (F.size("_pieces") - 1).alias("_last")]
    is_line = ~F.col("_open_end") | (F.col("piece") < F.col("_last")) | (F.col("line") != "")
    if not offsets:
        lines = pieces.select(*keep, F.posexplode_outer("_pieces").alias("piece", "line"))
        return lines.where(is_line).select(
            *place, "piece", piece_text(F.col("line"), valid).alias("line"))
    measured = with_running_total(
        pieces.withColumn("_start", F.col("_end") - byte_length("value") - 1).withColumn(
            "_lengths", F.transform("_pieces", lambda p: piece_bytes(p, valid) + 1)),
        "_lengths", "_ends")
    zipped = F.arrays_zip(F.col("_pieces").alias("line"), F.col("_ends").alias("end"))
    lines = measured.select(
        *keep, "_start", "file_size", F.posexplode_outer(zipped).alias("piece", "_at")
    ).withColumn("line", F.col("_at.line"))
    return lines.where(is_line).select(
        *place, "piece", piece_text(F.col("line"), valid).alias("line"),
        F.least(F.col("_start") + F.col("_at.end"), "file_size").alias("end_offset"))


def record_pieces(value: Column) -> Column:
    """The pieces of a record between carriage returns: one, unless it has any."""
    return F.when(
        F.contains(value, F.lit("\r")), F.split(cuttable(value), "\r", -1)
    ).otherwise(F.array(cuttable(value)))


def _shape(total: Column, size: Column):
    """(ends without a line feed, began with a mark), from the bytes of records and of the file."""
    return ((total == size + 1) | (total == size - 2),
            (total == size - 3) | (total == size - 2))


def _with_file_ends(records):
    """Flag the records that need care: `_bare` (no line feed at the end) and `_marked`.

    The totals show which files are odd, however a scan is split. The place of a record does
    depend on the split, so odd files, nearly always none, are stored with their places and
    flagged there. The records of all other files stay in the scan.
    """
    place = F.struct("block", "rec")
    unterminated, marked = _shape(F.col("_total"), F.col("_size"))
    odd = computed_once(records.groupBy("file_path").agg(
        F.sum(byte_length("value") + 1).alias("_total"), F.max("file_size").alias("_size"),
        F.max_by(F.endswith("value", F.lit("\r")), place).alias("_return"),
    ).select("file_path", (unterminated & F.col("_return")).alias("_open"), marked.alias("_mark")
    ).where("_open OR _mark"))

    def plain(part):
        return part.withColumn("_bare", F.lit(False)).withColumn("_marked", F.lit(False))

    if odd.isEmpty():
        return plain(records)
    kept = stored(lookup_join(records, odd, "file_path", "inner"))
    ends = kept.groupBy("file_path").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    flagged = lookup_join(kept, ends, "file_path", "inner").withColumn(
        "_bare", F.col("_open") & (place == F.col("_last"))).withColumn(
        "_marked", F.col("_mark") & (place == F.col("_first")))
    others = plain(lookup_join(records, odd.select("file_path"), "file_path", "left_anti"))
    return others.unionByName(flagged.select(*others.columns))


def _with_record_ends(records):
    """Add `_end`, the byte position after each record's line feed, as if each had one.

    A file may hold a third of all records: they are totalled per (file, block), where a block
    is an input split, and only the records of one block are accumulated together. Blocks must
    be the same in both uses, so the records are stored first.
    """
    sized = stored(records).withColumn("_key", F.struct("file_path", "block")).withColumn(
        "_bytes", byte_length("value") + 1)
    file = Window.partitionBy("_key.file_path")
    earlier = file.orderBy("_key.block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy("_key").agg(
        F.sum("_bytes").alias("_sum"), F.min("rec").alias("_first"),
        F.max("file_size").alias("_size"))
    unterminated, marked = _shape(F.col("_total"), F.col("_size"))
    bases = blocks.withColumn("_total", F.sum("_sum").over(file)).select(
        "_key", "_first", unterminated.alias("_open"), marked.alias("_mark"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    so_far = Window.partitionBy("_key").orderBy("rec").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_base") + F.sum("_bytes").over(so_far) + F.when(
        F.col("_mark"), byte_length(F.lit(MARK))).otherwise(0)
    return (
        sized.join(bases, "_key").withColumn("_end", end)
        .withColumn("_bare", F.col("_open") & (F.col("_end") > F.col("file_size")))
        .withColumn("_marked", F.col("_mark") & (F.col("block") == 0)
                    & (F.col("rec") == F.col("_first")))
        .drop("_key", "_bytes", "_base", "_first", "_open", "_mark")
    )


def read_lines(spark: SparkSession, files, category: str, offsets: bool = False,
               exact: bool = True) -> DataFrame:
    """Messages of finished files, one per line, with their place as extra columns.

    `files` are paths, or a table with `path`. Exact reading looks at a few bytes of each file. Files that Spark's
    scan would not show exactly (a byte order mark, or a carriage return at the very end) are read by byte ranges, all
    others by the scan; contents are read once. So are all files if `offsets` are asked for, where tasks can open the files.
    """
    if not isinstance(files, DataFrame):
        files = spark.createDataFrame([(path,) for path in files], "path string")
    first = files.select("path").first()
    if not (exact or offsets) or first is None or not readable(first["path"]):
        return tag_category(lines_of(scan_files(spark, files), offsets, exact), category)
    probed = computed_once(probe_ends(_spread(files)))
    if offsets:
        return tag_category(_by_ranges(probed), category)
    plain = lines_of(scan_files(spark, probed.where("NOT (marked OR open)")), exact=False)
    odd = probed.where("marked OR open")
    if odd.isEmpty():
        return tag_category(plain, category)
    return tag_category(plain.unionByName(_by_ranges(odd).drop("end_offset")), category)


def _spread(files):
    """A table of paths over as many tasks as there are cores, however small it is."""
    return files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism, "path")


def _by_ranges(files):
    """The lines of files (path, length and perhaps offset), in the columns of `lines_of`."""
    if "offset" not in files.columns:
        files = files.withColumn("offset", F.lit(0).cast("bigint"))
    return read_ranges(ranges_of(files))


def read_pending(spark: SparkSession, listing: DataFrame, ledger: DataFrame,
                 category: str, exact: bool = True) -> DataFrame:
    """Messages that the ledger has not seen: new files whole, unfinished files from their offset.

    Unfinished files are opened at their offset: what was read before is not read again. An offset
    inside a line gives the whole line. Where tasks cannot open the files, they are scanned
    from their start, and lines up to the offset are dropped.
    """
    saved = ledger.groupBy("path").agg(
        F.max("offset").alias("offset"), F.bool_or("completed").alias("completed"))
    pending = computed_once(listing.select("path", "length").join(saved, "path", "left").where(
        ~F.coalesce("completed", F.lit(False))).select("path", "length", F.coalesce("offset", F.lit(0)).alias("offset")))
    begun = pending.where("offset > 0")
    new = read_lines(spark, pending.where("offset <= 0"), category, exact=exact)
    first = begun.select("path").first()
    if first is None:
        return new
    if readable(first["path"]):
        rest = tag_category(_by_ranges(begun), category)
    else:
        rest = resume_lines(read_lines(spark, begun, category, offsets=True), saved)
    return new.unionByName(rest.drop("end_offset"))
