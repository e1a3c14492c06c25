"""A pipeline: one source, one converter, one sink, a store for failures, and counts."""

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.joins import scratch_tables
from sluice.operators.convert import apply_converter, identity, parse_mappings, rename_topics
from sluice.operators.counters import count_messages, write_counters
from sluice.operators.deadletter import batch_folder, discard, store_failures
from sluice.plans.sources import FileSource, KafkaSource
from sluice.plans.spec import get, validate_spec
from sluice.sinks.delivery import EndpointSink, KafkaSink
from sluice.sinks.endpoint import EndpointOptions

LOG = logging.getLogger(__name__)


@dataclass
class Pipeline:
    """`store(failed, path, pipeline, run, batch_id)` keeps failures; `discard` drops them.

    `counters` is the folder of the counts. Each batch replaces its own folder there, so a
    retried batch does not count twice. `exporter` is called with the counts of each batch.
    """
    name: str
    source: object
    sink: object
    state: str
    converter: Callable[[DataFrame], DataFrame] = identity
    store: Callable = store_failures
    exporter: Callable[[DataFrame], None] | None = None

    @property
    def letters(self) -> str:
        return f"{self.state}/letters"

    @property
    def counters(self) -> str:
        return f"{self.state}/counters"

    def run_batch(self, spark: SparkSession, persist: bool = False) -> dict:
        """Deliver all that waits now. Counting scans the source again, unless `persist` is set.

        A file source gives its backlog in groups of files, and its ledger is saved after each.
        A group is named by the ledger state it started from, so one that is tried again after a
        failure replaces the files, failures and counts of its first try. Kafka batches are named
        in the same way by the positions they started from.
        """
        with scratch_tables(spark):
            return self._run_groups(spark, persist)

    def _run_groups(self, spark, persist):
        totals = {}
        while True:
            msgs = self.source.batch(spark)
            run = getattr(self.source, "run_id", None) or uuid.uuid4().hex
            if persist:
                msgs.persist(StorageLevel.DISK_ONLY)
            try:
                part = self._deliver(msgs, run, 0)
            finally:
                msgs.unpersist()
            self.source.finish(spark)
            totals = {event: totals.get(event, 0) + n for event, n in part.items()}
            if not getattr(self.source, "more", False):
                return totals

    def start(self, spark: SparkSession, checkpoint: str | None = None, **trigger):
        """Start the stream. Progress is saved only after the batch is delivered and counted."""
        if not trigger and self.source.scan_seconds:
            trigger = {"processingTime": f"{self.source.scan_seconds} seconds"}

        def run(micro_batch, batch_id):
            session = micro_batch.sparkSession
            run_id = session.sparkContext.getLocalProperty("sql.streaming.queryId")
            with scratch_tables(session):
                msgs = self.source.messages(micro_batch).persist(StorageLevel.MEMORY_AND_DISK)
                try:
                    self._deliver(msgs, run_id, batch_id)
                finally:
                    msgs.unpersist()

        writer = self.source.stream(spark).writeStream.foreachBatch(run).queryName(self.name).option(
            "checkpointLocation", checkpoint or f"{self.state}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def _deliver(self, msgs, run, batch_id):
        read = count_messages(msgs, f"{self.name}-{self.source.name}")
        converted = apply_converter(msgs, self.converter).select("topic", "data")
        done = self.sink.deliver(converted, self.name, run, batch_id)
        folder = batch_folder(self.counters, self.name, run, batch_id)
        spark = msgs.sparkSession
        counts = read.withColumn("event", F.lit("read")).unionByName(
            done.counts.withColumn("event", F.lit("written")))
        if done.failed is not None:
            self.store(done.failed, self.letters, self.name, run, batch_id)
            counts = counts.unionByName(
                count_messages(done.failed, f"{self.name}-{self.sink.name}")
                .withColumn("event", F.lit("failed")))
        if done.skipped is not None:
            counts = counts.unionByName(done.skipped.withColumn("event", F.lit("skipped")))
        write_counters(counts.withColumn("counted_at", F.current_timestamp()), folder,
                       mode="overwrite")
        written = spark.read.parquet(folder)
        if self.exporter:
            self.exporter(written)
        totals = {row["event"]: row["n"] for row in
                  written.groupBy("event").agg(F.sum("delta").alias("n")).collect()}
        totals = {event: totals.get(event, 0) for event in ("read", "written", "failed", "skipped")}
        totals["dropped"] = totals["read"] - sum(
            totals[event] for event in ("written", "failed", "skipped"))
        LOG.info("%s batch %s: %s", self.name, batch_id, totals)
        return totals

    def counts(self, spark: SparkSession, event: str) -> DataFrame:
        """All counts of one kind: read, written, failed or skipped."""
        return spark.read.parquet(self.counters).where(F.col("event") == event)


def from_conf(conf: dict, state: str, client_factory: Callable | None = None,
              parts: dict | None = None, lanes: int | None = None,
              exporter: Callable[[DataFrame], None] | None = None, **file_options) -> Pipeline:
    """Build a pipeline from a configuration.

    Batches of files keep a ledger, and batches of Kafka topics their positions, under `state`, unless `ledger_path` or
    `parts` say otherwise. `delete_expired=True` lets a file source delete matching files beyond the retention whenever it
    lists for a batch. `exporter` is given the counts of each batch.

    Thread numbers are not taken over: tasks read and send. `lanes` limits the senders to a
    number, at the price of a shuffle.

    `parts` maps further part names to functions of the configuration, which return a source,
    a converter, a store or a sink. Failures are kept even where the configuration names the
    store that drops them, unless `parts` says otherwise.
    """
    named = validate_spec(conf)
    own = parts or {}
    name = conf["pipeline.name"]

    def file_source(c):
        return FileSource(
            c["source.file.directory"], c["source.file.category"],
            get(c, "source.file.include.pattern"), get(c, "source.file.retention.second"),
            get(c, "source.file.read.order"), get(c, "source.file.delete.after.read"),
            scan_seconds=get(c, "source.file.scan.interval.second"),
            **{"ledger_path": f"{state}/ledger", **file_options})

    def endpoint_sink(c):
        if client_factory is None:
            raise ValueError(f"{name}: the sink needs a client_factory")
        hosts = c["sink.scribe.server.hosts"].split(",")
        port = get(c, "sink.scribe.server.port")
        options = EndpointOptions(
            tuple(f"{host}:{port}" for host in hosts), get(c, "sink.scribe.batch.size"),
            get(c, "sink.scribe.max.send.interval"), get(c, "sink.scribe.retry.time"),
            get(c, "sink.scribe.worker.sleep"))
        return EndpointSink(client_factory, options, f"{state}/outcomes", lanes=lanes)

    def rename(c):
        mappings = parse_mappings(c.get("topic.mappings"))
        return lambda msgs: rename_topics(msgs, mappings)

    known = {
        "FileSource": file_source, "KafkaSource": lambda c: KafkaSource(c, positions=f"{state}/positions"),
        "DefaultConverter": lambda c: identity, "TopicNameConverter": rename,
        "DefaultStore": lambda c: store_failures, "DiscardStore": lambda c: discard,
        "KafkaSink": KafkaSink, "ScribeSink": endpoint_sink,
    } | own
    for key, part in named.items():
        if part not in known:
            raise ValueError(f"{name}: pipeline.{key} names an unknown part {part}")
    built = {key: known[part](conf) for key, part in named.items()}
    return Pipeline(
        name, built["source"], built["sink"], state, built["converter"], built["store"], exporter)


def start_all(spark: SparkSession, pipelines: dict[str, Callable[[], Pipeline]], **trigger):
    """Build and start independent pipelines, each given as a function that builds it.

    One that fails does not stop the others. Returns the queries and the errors, by name.
    """
    queries, errors = {}, {}
    for name, build in pipelines.items():
        try:
            queries[name] = build().start(spark, **trigger)
        except Exception as failure:
            LOG.exception("%s does not start", name)
            errors[name] = failure
    return queries, errors


def live_rates(query) -> dict:
    """Rows of the last micro-batch and rows per second, as the running query reports them."""
    last = query.lastProgress
    if last is None:
        return {"rows": 0, "arriving": 0.0, "processed": 0.0}
    return {"rows": last["numInputRows"], "arriving": last["inputRowsPerSecond"],
            "processed": last["processedRowsPerSecond"]}
