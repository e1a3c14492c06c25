"""The file ledger: how far each file has been read."""

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.lines import split_lines
from sluice.schema import LEDGER
from sluice.sources.statelog import StateLog

LOG = logging.getLogger(__name__)

# Fixed format of a text ledger line: path, offset and completed, separated by one space.
# The path is all that comes before the last two fields, so it may hold spaces itself.
LEDGER_LINE = r"^(.+) ([+-]?\d+) (\S+)$"


def advance_ledger(ledger: DataFrame, progress: DataFrame, listing: DataFrame) -> DataFrame:
    """The next ledger: raised offsets, new files, and only files that are still listed.

    Stacking the three tables and grouping by path takes one shuffle, where a full outer join
    with the progress and a semi join with the listing would take two.
    """
    columns = ("path", "offset", "completed")
    known = ledger.select(*columns).unionByName(progress.select(*columns)).withColumn(
        "live", F.lit(False))
    listed = listing.select("path", F.lit(0).cast("bigint").alias("offset"),
                            F.lit(False).alias("completed"), F.lit(True).alias("live"))
    return known.unionByName(listed).groupBy("path").agg(
        F.max("offset").alias("offset"), F.bool_or("completed").alias("completed"),
        F.bool_or("live").alias("live")).where("live").drop("live")


def completed(listing: DataFrame) -> DataFrame:
    """The progress that a finished batch read of these files has made."""
    return listing.select("path", F.col("length").alias("offset"), F.lit(True).alias("completed"))


def backlog(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files and bytes that wait to be read."""
    saved = ledger.groupBy("path").agg(
        F.max("offset").alias("offset"), F.bool_or("completed").alias("completed"))
    waiting = listing.join(saved, "path", "left").where(~F.coalesce("completed", F.lit(False)))
    left = F.col("length") - F.coalesce("offset", F.lit(0))
    return waiting.agg(F.count(F.lit(1)).alias("files"),
                       F.coalesce(F.sum(left), F.lit(0)).alias("bytes"))


def ledger_log(spark: SparkSession, path: str) -> StateLog:
    """The ledger as a log: saving the progress of a batch writes that progress only."""
    return StateLog(spark, path, LEDGER, ["path"])


def save_ledger(ledger: DataFrame, path: str) -> str:
    """Replace the whole ledger. A crash before the commit leaves the old one in force."""
    log = ledger_log(ledger.sparkSession, path)
    return f"{log.replace(ledger.select(*LEDGER.names), log.number()):012d}"


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in force, or an empty one where none was ever saved."""
    return ledger_log(spark, path).load()[1]


def parse_ledger_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """path, offset and completed of text ledger lines; other lines are left out."""
    def field(i):
        return F.regexp_extract(line_col, LEDGER_LINE, i)

    rest = [c for c in lines.columns if c != line_col]
    return lines.where(F.col(line_col).rlike(LEDGER_LINE)).select(
        field(1).alias("path"), field(2).try_cast("bigint").alias("offset"),
        (F.lower(field(3)) == "true").alias("completed"), *rest
    ).where(F.col("offset").isNotNull())


def import_text_ledger(spark: SparkSession, path: str, path_prefix: str = "") -> DataFrame:
    """Read a ledger kept as text. A path named twice keeps its last line.

    `path_prefix` (such as `file:`) turns bare paths into the form of `list_files`.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value")
    lines = split_lines(text, "value", ["file"], keep_empty=False)
    entries = parse_ledger_lines(lines)
    skipped = lines.where(~F.col("line").rlike(LEDGER_LINE)).count()
    if skipped:
        LOG.warning("%d ledger lines of %s have another format and are skipped", skipped, path)
    return entries.groupBy(F.concat(F.lit(path_prefix), "path").alias("path")).agg(
        F.max_by(F.struct("offset", "completed"), F.struct("file", "pos")).alias("e")
    ).select("path", "e.offset", "e.completed")
