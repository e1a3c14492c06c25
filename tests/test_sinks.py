"""The endpoint sender with a client that writes files, the file sink, dead letters."""

import json
import os
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sluice.operators.deadletter import (
    discard, load_letters, pending_letters, quarantined_letters, release, replay, replay_due,
    store_failures)
from sluice.schema import ENTRY, MESSAGE
from sluice.sinks.delivery import EndpointSink, FileSink, deliver
from sluice.sinks.endpoint import (
    EndpointOptions, Sender, batches, deliver_to_endpoint, endpoint_data_source, write_endpoint)
from sluice.sinks.files import read_messages, stream_files, write_files
from tests.conftest import rows


class FileClient:
    """Keeps each batch as a file of the host's folder. A file named `down` refuses connections."""

    def __init__(self, root, host, refuse=None):
        self.folder, self.refuse = os.path.join(root, host), refuse
        if os.path.exists(os.path.join(self.folder, "down")):
            raise ConnectionError("down")
        os.makedirs(self.folder, exist_ok=True)

    def send(self, batch):
        if self.refuse and any(self.refuse in message for _, message in batch):
            return False
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as out:
            json.dump(batch, out)

    def close(self):
        pass


def client_of(root, refuse=None):
    root = str(root)
    return lambda host: FileClient(root, host, refuse)


def take_down(root, host):
    os.makedirs(os.path.join(root, host), exist_ok=True)
    open(os.path.join(root, host, "down"), "w").close()


def sent(root, host="*"):
    hosts = os.listdir(root) if host == "*" else [host]
    got = []
    for h in hosts:
        for name in sorted(os.listdir(os.path.join(root, h))):
            if name != "down":
                with open(os.path.join(root, h, name)) as f:
                    got.append([tuple(e) for e in json.load(f)])
    return got


def entries(spark, n, parts=1):
    return spark.range(0, n, 1, parts).select(
        F.lit("c").alias("category"), F.concat(F.lit("h|"), "id").alias("message"))


QUICK = {"max_interval_ms": 60_000, "all_down_wait_ms": 10}


def test_batches_by_size_and_age():
    assert [len(b) for b in batches(range(250), 100, 10 ** 9)] == [100, 100, 50]
    assert list(batches([], 100, 10 ** 9)) == []
    clock = iter([0.0, 0.4, 1.1, 1.2, 1.3]).__next__
    assert list(batches("abc", 100, 1000, clock)) == [["a", "b"], ["c"]]


def test_all_hosts_up(spark, tmp_path):
    options = EndpointOptions(("h1", "h2"), **QUICK)
    outcome = deliver_to_endpoint(entries(spark, 250), client_of(tmp_path), options).collect()
    assert sorted(len(b) for b in sent(tmp_path)) == [50, 100, 100]
    assert len(outcome) == 250 and all(r.error is None for r in outcome)
    assert {e for b in sent(tmp_path) for e in b} == {(r.category, r.message) for r in outcome}


def test_one_host_down(spark, tmp_path):
    take_down(tmp_path, "h1")
    options = EndpointOptions(("h1", "h2"), **QUICK)
    outcome = deliver_to_endpoint(entries(spark, 300, 3), client_of(tmp_path), options).collect()
    assert all(r.error is None for r in outcome)
    assert sent(tmp_path, "h1") == [] and sum(map(len, sent(tmp_path, "h2"))) == 300


def test_all_hosts_down(spark, tmp_path):
    for host in ("h1", "h2"):
        take_down(tmp_path, host)
    options = EndpointOptions(("h1", "h2"), **QUICK)
    outcome = deliver_to_endpoint(entries(spark, 5), client_of(tmp_path), options).collect()
    assert len(outcome) == 5 and all("no host" in r.error for r in outcome)


class Flaky:
    """Hosts that fail on a script of events; keeps what was sent."""

    def __init__(self, script):
        self.script, self.log = list(script), []

    def __call__(self, host):
        self.event(f"connect {host}")
        return self

    def event(self, what):
        self.log.append(what)
        answer = self.script.pop(0) if self.script else None
        if answer == "fail":
            raise OSError("broken")
        return answer

    def send(self, batch):
        return self.event(f"send {len(batch)}")

    def close(self):
        pass


def test_failed_send_is_tried_on_another_host():
    flaky = Flaky([None, "fail"])
    sender = Sender(flaky, EndpointOptions(("h1", "h2"), **QUICK))
    assert sender.send([("c", "m")]) is None
    assert [e.split()[0] for e in flaky.log] == ["connect", "send", "connect", "send"]
    assert flaky.log[0] != flaky.log[2]
    assert sender.hosts == ["h1", "h2"]  # a success makes every host eligible again


def test_hosts_that_come_back_are_used():
    flaky = Flaky(["fail", "fail", None])
    sender = Sender(flaky, EndpointOptions(("h1", "h2"), **QUICK))
    assert sender.send([("c", "m")]) is None
    assert len(flaky.log) == 4


def test_retries_are_bounded_and_later_batches_go_on():
    flaky = Flaky([None, False, False, False])
    sender = Sender(flaky, EndpointOptions(("h1",), **QUICK))
    assert "try later" in sender.send([("c", "m")])
    assert sender.send([("c", "m")]) is None


def test_failure_of_the_last_batch_is_reported(spark, tmp_path):
    options = EndpointOptions(("h1",), **QUICK)
    outcome = deliver_to_endpoint(
        entries(spark, 250), client_of(tmp_path, refuse="h|249"), options)
    outcome = outcome.collect()
    assert sum(r.error is None for r in outcome) == 200
    assert all(r.error for r in outcome if int(r.message[2:]) >= 200)


def test_empty_messages_are_passed_unsent_and_extra_columns_kept(spark, tmp_path):
    df = spark.createDataFrame(
        [("c", "m", 1), ("c", None, None), ("c", "n", 3)], "category string, message string, k bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = deliver_to_endpoint(df.coalesce(1), client_of(tmp_path), EndpointOptions(("h",), 2))
        assert rows(got) == sorted(
            [("c", "m", 1, None), ("c", None, None, None), ("c", "n", 3, None)], key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(e for b in sent(tmp_path) for e in b) == [("c", "m"), ("c", "n")]


def test_lanes_set_the_number_of_senders(spark, tmp_path):
    options = EndpointOptions(("h",), **QUICK)
    got = deliver_to_endpoint(entries(spark, 100), client_of(tmp_path), options, lanes=3)
    assert got.rdd.getNumPartitions() == 3


def test_data_source_batch_and_stream(spark, tmp_path):
    out = tmp_path / "out"
    spark.dataSource.register(endpoint_data_source(client_of(out), "test_endpoint"))
    entries(spark, 120, 2).write.format("test_endpoint").mode("append").options(
        hosts="h1,h2", batch_size="50").save()
    assert sum(map(len, sent(out))) == 120
    entries(spark, 10).write.parquet(str(tmp_path / "in"))
    query = spark.readStream.schema(ENTRY).parquet(str(tmp_path / "in")).writeStream.format(
        "test_endpoint").options(hosts="h1", checkpointLocation=str(tmp_path / "cp")).trigger(
        availableNow=True).start()
    query.awaitTermination()
    assert sum(map(len, sent(out))) == 130


def test_data_source_fails_rather_than_loses(spark, tmp_path):
    take_down(tmp_path, "h1")
    spark.dataSource.register(endpoint_data_source(client_of(tmp_path), "failing_endpoint"))
    with pytest.raises(Exception, match="no host"):
        entries(spark, 1).write.format("failing_endpoint").mode("append").options(
            hosts="h1", all_down_wait_ms="1").save()


@pytest.fixture
def msgs(spark):
    return spark.createDataFrame(
        [("a", "1"), ("a/b=c", "2"), ("7", "3"), ("", "4"), (None, "5"), ("a", None)], MESSAGE)


@pytest.mark.parametrize("how", [{}, {"rebalance": True}, {"fmt": "orc"}])
def test_write_files_keeps_all_topics(spark, msgs, tmp_path, how):
    path = str(tmp_path / "out")
    write_files(msgs, path, **how)
    back = {k: v for k, v in how.items() if k == "fmt"}
    assert rows(read_messages(spark, path, **back)) == rows(msgs)
    assert rows(read_messages(spark, path, topic="a", **back)) == sorted(
        [("a", "1"), ("a", None)], key=repr)
    assert rows(read_messages(spark, path, topic="", **back)) == [("", "4")]


def test_stream_files(spark, msgs, tmp_path):
    msgs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart on the same checkpoint writes nothing twice
        stream_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"),
                     availableNow=True).awaitTermination()
    assert rows(read_messages(spark, str(tmp_path / "out"))) == rows(msgs)


def test_file_sink_replaces_a_retried_batch(spark, msgs, tmp_path):
    sink = FileSink(str(tmp_path))
    for _ in range(2):
        done = sink.deliver(msgs, "p/1", "r", 0)
    assert sum(r.delta for r in done.counts.collect()) == 6
    sink.deliver(msgs, "p/1", "r", 1)
    assert read_messages(spark, str(tmp_path)).count() == 12


def test_endpoint_sink(spark, msgs, tmp_path):
    more = msgs.unionByName(spark.createDataFrame([("e", "")], MESSAGE)).coalesce(1)
    options = EndpointOptions(("h1",), batch_size=1, **QUICK)
    sink = EndpointSink(client_of(tmp_path / "out", refuse="host|2"), options,
                        str(tmp_path / "outcomes"), host="host")
    done = sink.deliver(more, "p", "r", 0)
    assert rows(done.counts.select("topic", "delta")) == sorted(
        [("a", 1), ("7", 1), ("", 1), (None, 1)], key=repr)
    assert rows(done.failed.select("topic", "data")) == [("a/b=c", "2")]
    assert sum(r["delta"] for r in done.skipped.collect()) == 2
    assert ("7", "host|3") in [e for b in sent(tmp_path / "out") for e in b]


def test_deliver_sends_once(spark, msgs, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def send(df):
        options = EndpointOptions(("h",), batch_size=1, **QUICK)
        tried = deliver_to_endpoint(
            df.withColumn("category", F.col("topic")).withColumn("message", F.col("data")),
            client_of(calls, refuse="2"), options)
        return tried.select("topic", "data", "error")
    ok, failed = deliver(msgs, send, str(tmp_path / "outcome"))
    assert ok.count() == 5 and rows(failed.select("data")) == [("2",)]
    assert len(sent(calls)) == 4


def test_dead_letters_and_replay(spark, tmp_path):
    path, replayed = str(tmp_path / "letters"), str(tmp_path / "replayed")
    assert load_letters(spark, path).count() == 0
    failed = spark.createDataFrame(
        [("a", str(i), "why") for i in range(4)], "topic string, data string, error string")
    for _ in range(2):  # a retry replaces the letters of its batch
        store_failures(failed, path, "p/1", "run", 3)
    store_failures(failed.where("data = '0'"), path, "123", "run", 3)
    discard(failed, path, "p/1", "run", 4)
    assert rows(load_letters(spark, path).groupBy("pipeline", "batch_id").count()) == [
        ("123", 3, 1), ("p/1", 3, 4)]

    def odd_fail(letters):
        return letters.withColumn("error", F.when(F.col("data").cast("int") % 2 == 1, "again"))
    assert replay(spark, path, replayed, odd_fail) == 3
    assert rows(pending_letters(spark, path, replayed).select("data")) == [("1",), ("3",)]
    assert replay(spark, path, replayed, odd_fail) == 0
    assert replay(spark, path, replayed, lambda df: df.withColumn("error", F.lit(None))) == 2
    assert pending_letters(spark, path, replayed).count() == 0
    # A retry without failures leaves no letters of its batch behind.
    store_failures(failed.limit(0), path, "p/1", "run", 3)
    assert load_letters(spark, path).count() == 1


def test_replay_pauses_and_quarantine(spark, tmp_path):
    path, attempts = str(tmp_path / "letters"), str(tmp_path / "attempts")
    start, calls = datetime(2024, 5, 1, tzinfo=timezone.utc), []

    def at(seconds, fail=("a", "b")):
        def send(letters):
            calls.append(sorted((r["data"], r["tries"]) for r in letters.collect()))
            return letters.withColumn("error", F.when(F.col("data").isin(*fail), "why"))
        return replay_due(spark, path, attempts, send, start + timedelta(seconds=seconds), max_tries=3, pause_seconds=60)
    assert at(0) == {"delivered": 0, "waiting": 0, "quarantined": 0}
    failed = spark.createDataFrame([("t", d, "why") for d in "abc"], "topic string, data string, error string")
    store_failures(failed, path, "p", "run", 1)
    assert at(0) == {"delivered": 1, "waiting": 2, "quarantined": 0}
    assert at(59) == {"delivered": 0, "waiting": 0, "quarantined": 0}
    store_failures(failed.where("data = 'c'"), path, "p", "run", 2)  # a new letter is due at once
    assert at(60, ("a",)) == {"delivered": 2, "waiting": 1, "quarantined": 0}
    assert at(179) == {"delivered": 0, "waiting": 0, "quarantined": 0}
    assert at(180) == {"delivered": 0, "waiting": 0, "quarantined": 1}
    assert at(10 ** 6) == {"delivered": 0, "waiting": 0, "quarantined": 0}
    assert calls == [[], [("a", 0), ("b", 0), ("c", 0)], [], [("a", 1), ("b", 1), ("c", 0)], [], [("a", 2)], []]
    lost = quarantined_letters(spark, path, attempts)
    assert rows(lost.select("data", "tries", "error")) == [("a", 3, "why")]
    release(spark, attempts, lost)
    assert quarantined_letters(spark, path, attempts).count() == 0
    assert at(10 ** 6, ()) == {"delivered": 1, "waiting": 0, "quarantined": 0}


def test_write_endpoint(spark, tmp_path):
    write_endpoint(entries(spark, 30), client_of(tmp_path), EndpointOptions(("h1",), 10, **QUICK))
    assert sorted(len(b) for b in sent(tmp_path)) == [10, 10, 10]
