"""Sources of a pipeline: the same messages as a batch or as micro-batches.

A source has a `name` and the methods `batch(spark)`, `stream(spark)`, `messages(micro_batch)`,
which turns rows of the stream into messages, and `finish(spark)`, called after a delivered batch.
"""

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.joins import stored
from sluice.operators.lines import tag_category
from sluice.schema import LEDGER, POSITION
from sluice.sources.cleanup import delete_files
from sluice.sources.files import (
    DEFAULT_PATTERN, DEFAULT_RETENTION_SECONDS, lines_of, list_files, match_files, plan_groups,
    read_pending, split_expired, unread_files, with_record_number)
from sluice.sources.kafka import (
    SOURCE_PREFIX, broker_ends, next_span, position_log, read_kafka, stream_kafka)
from sluice.sources.ledger import completed, ledger_log, load_ledger
from sluice.streaming.files import stream_records


MAX_FILES = 1000


class FileSource:
    """A watched folder. A batch reads what the ledger at `ledger_path` has not seen yet.

    `max_files` bounds a micro-batch, and with `max_bytes` a group of a batch with a ledger; groups follow `order`.
    The folder is listed once for all groups of a run, and each group adds its own progress to the ledger. With
    `delete_expired`, matching files beyond the retention are deleted, read or not, when a batch lists.
    """

    name = "FileSource"

    def __init__(self, directory: str, category: str, include_pattern: str = DEFAULT_PATTERN,
                 retention_seconds: int = DEFAULT_RETENTION_SECONDS, order: str = "asc",
                 delete_after_read: bool = False, ledger_path: str | None = None,
                 max_files: int | None = MAX_FILES, scan_seconds: int = 30, exact: bool = True,
                 max_bytes: int | None = None, delete_expired: bool = False):
        self.directory, self.category = directory, category
        self.include_pattern, self.retention_seconds = include_pattern, retention_seconds
        self.order, self.delete_after_read = order, delete_after_read
        self.ledger_path, self.max_files, self.max_bytes = ledger_path, max_files, max_bytes
        self.scan_seconds, self.exact = scan_seconds, exact
        self.remove_expired = delete_expired
        self.run_id, self.more = None, False

    def listing(self, spark: SparkSession):
        """(live, expired) files that match now."""
        matching = match_files(list_files(spark, self.directory), self.include_pattern)
        return split_expired(matching, datetime.now(timezone.utc), self.retention_seconds)

    def batch(self, spark: SparkSession) -> DataFrame:
        if not self.ledger_path:
            self._live = self._listed(spark)
            return read_pending(spark, self._live, spark.createDataFrame([], LEDGER), self.category, self.exact)
        if not self.more:
            self._plan_run(spark)
        self.more = False  # until this group is finished; a run that failed is planned again
        self.run_id = f"{self._number:012d}"
        self._live = self._plan.where(F.col("group") == self._group).drop("group")
        return read_pending(spark, self._live, self._ledger, self.category, self.exact)

    def _listed(self, spark):
        """The live files of one listing; expired ones go, if so configured."""
        live, expired = self.listing(spark)
        if self.remove_expired:
            delete_files(expired, self.directory, dry_run=False)
        return stored(live)

    def _plan_run(self, spark):
        """List once, note what has gone from the folder, and cut what waits into groups."""
        log = ledger_log(spark, self.ledger_path)
        self._number, loaded = log.load()
        self._ledger = stored(loaded)
        listed = self._listed(spark)
        done = self._ledger.where("completed").select("path")
        self._gone = self._ledger.join(listed.select("path"), "path", "left_anti").withColumn("removed", F.lit(True))
        self._plan = plan_groups(listed.join(done, "path", "left_anti"), self.order, self.max_files, self.max_bytes)
        self._group = self._next_group(-1) or 0

    def _next_group(self, after):
        return self._plan.where(F.col("group") > after).agg(F.min("group")).first()[0]

    def finish(self, spark: SparkSession) -> None:
        """Record that the files of the last batch are read, then delete them if so configured."""
        if self.ledger_path:
            changes = completed(self._live).withColumn("removed", F.lit(False))
            if self._gone is not None:
                changes, self._gone = changes.unionByName(self._gone), None
            self._number = ledger_log(spark, self.ledger_path).save(changes, self._number)
            self._group = self._next_group(self._group)
            self.more = self._group is not None
        if self.delete_after_read:
            delete_files(self._live, self.directory, dry_run=False)

    def delete_expired(self, spark: SparkSession, dry_run: bool = True) -> int:
        """Delete matching files beyond the retention, read or not."""
        return delete_files(self.listing(spark)[1], self.directory, dry_run)

    def pending(self, spark: SparkSession) -> DataFrame:
        """Files that a batch would read and that are new to the ledger."""
        return unread_files(self.listing(spark)[0], load_ledger(spark, self.ledger_path))

    def stream(self, spark: SparkSession) -> DataFrame:
        return stream_records(
            spark, self.directory, self.include_pattern, self.retention_seconds, self.order,
            self.max_files, self.delete_after_read)

    def messages(self, records: DataFrame) -> DataFrame:
        lines = lines_of(with_record_number(records), exact=self.exact)
        return tag_category(lines, self.category)


class KafkaSource:
    """Kafka topics, configured by `source.kafka.*` keys.

    With `positions`, a shared folder, a batch reads from where the last delivered one ended up to the ends at its start,
    and is named by the positions it started from. Without, each batch reads all that the topics hold.
    `ends(spark, conf)` tells the ends; `fmt` is the reader's format.
    """

    name = "KafkaSource"
    scan_seconds = 0

    def __init__(self, conf: dict, max_offsets: int | None = None, positions: str | None = None,
                 ends: Callable = broker_ends, fmt: str = "kafka"):
        self.conf, self.max_offsets, self.positions, self.ends, self.fmt = conf, max_offsets, positions, ends, fmt
        self.run_id = None

    def batch(self, spark: SparkSession) -> DataFrame:
        if not self.positions:
            return read_kafka(spark, self.conf, fmt=self.fmt)
        self._number, saved = position_log(spark, self.positions).load()
        start = {(r["topic"], r["partition"]): r["offset"] for r in saved.collect()}
        span, self._next = next_span(
            start, self.ends(spark, self.conf), self.conf.get(f"{SOURCE_PREFIX}auto.offset.reset", "earliest"))
        self._changed = {at: offset for at, offset in self._next.items() if start.get(at) != offset}
        self.run_id = f"{self._number:012d}"
        return read_kafka(spark, self.conf, span=span, fmt=self.fmt)

    def finish(self, spark: SparkSession) -> None:
        """Save where the next batch starts; a stream's checkpoint keeps its positions itself."""
        if self.positions and self._changed:
            rows = [(*at, offset) for at, offset in self._changed.items()]
            position_log(spark, self.positions).save(spark.createDataFrame(rows, POSITION), self._number)

    def stream(self, spark: SparkSession) -> DataFrame:
        return stream_kafka(spark, self.conf, self.max_offsets)

    def messages(self, micro_batch: DataFrame) -> DataFrame:
        return micro_batch
