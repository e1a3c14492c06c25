"""The sink contract: try to deliver, tell what was delivered, skipped and failed."""

import socket
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.joins import stored
from sluice.operators.counters import count_messages
from sluice.operators.deadletter import batch_folder
from sluice.sinks.endpoint import EndpointOptions, deliver_to_endpoint
from sluice.sinks.files import read_messages, write_files
from sluice.sinks.kafka import write_kafka


@dataclass
class Delivery:
    """Counts per topic of delivered messages, failed messages, and the number of skipped ones."""
    counts: DataFrame
    failed: DataFrame | None = None
    skipped: DataFrame | None = None


def deliver(msgs: DataFrame, send: Callable[[DataFrame], DataFrame], folder: str):
    """(delivered, failed): `send` returns the messages with `error`, null for delivered ones.

    The outcome is written to `folder` and read back, so that every message is sent once
    however often the two results are used.
    """
    send(msgs).write.mode("overwrite").parquet(folder)
    outcome = msgs.sparkSession.read.parquet(folder)
    ok = F.col("error").isNull()
    return outcome.where(ok).drop("error"), outcome.where(~ok)


class FileSink:
    """Files per pipeline, run and batch; a retried batch replaces what it wrote before."""

    def __init__(self, path: str, fmt: str = "parquet", rebalance: bool = False):
        self.path, self.fmt, self.rebalance = path, fmt, rebalance
        self.name = "FileSink"

    def deliver(self, msgs: DataFrame, pipeline: str, run: str, batch_id: int) -> Delivery:
        folder = batch_folder(self.path, pipeline, run, batch_id)
        write_files(msgs, folder, self.fmt, "overwrite", self.rebalance)
        written = read_messages(msgs.sparkSession, folder, self.fmt)
        return Delivery(count_messages(written, f"{pipeline}-{self.name}"))


class KafkaSink:
    """One record per message. A failed write fails the batch, which is then tried again.

    A source may grow and a converter need not repeat itself, so the messages are stored first:
    what is counted is what was sent.
    """

    def __init__(self, conf: dict):
        self.conf, self.name = conf, "KafkaSink"

    def deliver(self, msgs: DataFrame, pipeline: str, run: str, batch_id: int) -> Delivery:
        msgs = stored(msgs)
        write_kafka(msgs, self.conf)
        return Delivery(count_messages(msgs, f"{pipeline}-{self.name}"))


class EndpointSink:
    """Remote hosts. What cannot be sent after the retries is failed; empty data is skipped.

    `outcomes` is a shared folder for the result of each batch: a status per message, and the
    text of failed ones only.
    """

    def __init__(self, client_factory: Callable, options: EndpointOptions, outcomes: str,
                 host: str | None = None, lanes: int | None = None):
        self.factory, self.options, self.outcomes = client_factory, options, outcomes
        self.host = socket.gethostname() if host is None else host
        self.lanes, self.name = lanes, "EndpointSink"

    def deliver(self, msgs: DataFrame, pipeline: str, run: str, batch_id: int) -> Delivery:
        spark = msgs.sparkSession
        prefix = f"{self.host}|"
        entries = msgs.select(
            F.col("topic").alias("category"),
            F.when(F.col("data") != "", F.concat(F.lit(prefix), "data")).alias("message"))
        tried = deliver_to_endpoint(entries, self.factory, self.options, self.lanes)
        failed = F.col("error").isNotNull()
        status = F.when(F.col("message").isNull(), "skipped").when(failed, "failed").otherwise(
            "delivered")
        folder = batch_folder(self.outcomes, pipeline, run, batch_id)
        tried.select(
            F.col("category").alias("topic"), status.alias("status"),
            F.when(failed, F.substr("message", F.lit(len(prefix) + 1))).alias("data"), "error",
        ).write.mode("overwrite").parquet(folder)
        outcome = spark.read.schema(
            "topic string, status string, data string, error string").parquet(folder)
        return Delivery(
            count_messages(outcome.where("status = 'delivered'"), f"{pipeline}-{self.name}"),
            outcome.where("status = 'failed'").select("topic", "data", "error"),
            count_messages(outcome.where("status = 'skipped'"), f"{pipeline}-{self.name}"))
