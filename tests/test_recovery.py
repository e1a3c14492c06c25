"""Files that go, roots that are no roots, hosts that stay down, and batches in groups."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sluice.operators.counters import throughput
from sluice.plans.flow import Pipeline
from sluice.plans.sources import FileSource
from sluice.sinks import delivery, endpoint
from sluice.sinks.delivery import FileSink
from sluice.sinks.endpoint import EndpointOptions, Sender
from sluice.sinks.files import read_messages
from sluice.sources.cleanup import delete_files
from sluice.sources.files import list_files, read_lines


@pytest.mark.parametrize("root", ["", " ", "/", "//", "/.", "/./", "file:/", "file:///", "/tmp/..", "hdfs://n/", "/a/../..", ".", ".."])
def test_no_root_of_a_file_system(spark, root):
    with pytest.raises(ValueError):
        delete_files(spark.createDataFrame([("file:/x",)], "path string"), root)


def test_files_that_go_are_skipped(spark, folder):
    root = folder({"a.log": b"1\n", "b.log": b"2\n", "c.log": b"3\n"})
    listing = list_files(spark, root)
    os.remove(f"{root}/a.log")
    assert listing.count() == 2
    paths = [f"file:{root}/{n}.log" for n in "abc"]
    lines = read_lines(spark, paths, "x", exact=False)
    os.remove(f"{root}/b.log")
    assert [r["data"] for r in lines.collect()] == ["3"]


def test_all_hosts_down_ends_soon(monkeypatch):
    waits = []
    monkeypatch.setattr(time, "sleep", waits.append)

    def refuse(host):
        raise ConnectionError(host)
    sender = Sender(refuse, EndpointOptions(("a", "b"), retries=3, all_down_wait_ms=5000))
    errors = [sender.send([("t", "m")]) for _ in range(1000)]
    assert waits == pytest.approx([5.0, 5.0], abs=0.01) and all("no host" in e for e in errors)


def test_try_later_pauses(monkeypatch):
    waits = []
    monkeypatch.setattr(time, "sleep", waits.append)

    class Busy:
        def __init__(self, host):
            pass

        def send(self, batch):
            return False

        def close(self):
            pass
    sender = Sender(Busy, EndpointOptions(("a",), retries=3))
    assert "try later" in sender.send([("t", "m")])
    assert waits == pytest.approx([0.1, 0.2], abs=0.01)


class Clock:
    """Time that passes only while one sleeps, and a little at each look."""

    def __init__(self, monkeypatch):
        self.time, self.slept = 0.0, 0.0
        monkeypatch.setattr(endpoint, "time", self)  # other threads sleep, too

    def monotonic(self):
        self.time += 1e-7
        return self.time

    def sleep(self, seconds):
        self.time += seconds
        self.slept += seconds


class Hosts:
    """Hosts whose answer is decided by `accepts(host, batch)`; keeps what they took and were asked."""

    def __init__(self, accepts):
        self.accepts, self.took, self.asked = accepts, [], []

    def __call__(self, host):
        outer = self

        class Client:
            def send(self, batch):
                outer.asked.append((host, *batch))
                if not outer.accepts(host, batch):
                    return False
                outer.took.extend(batch)

            def close(self):
                pass
        return Client()


def send_all(sender, batches):
    outcome = {}
    for i, batch in enumerate(batches):
        sender.offer(batch, lambda error, i=i: outcome.__setitem__(i, error))
    sender.flush()
    assert len(outcome) == len(batches) and sender.queued == 0
    return outcome


def test_pauses_of_refused_batches_stay_within_the_budget(monkeypatch):
    clock, hosts = Clock(monkeypatch), Hosts(lambda host, batch: False)
    options = EndpointOptions(("a", "b"), wait_budget_ms=7_000, queue_entries=50)
    outcome = send_all(Sender(hosts, options), [[("t", str(i))] for i in range(10_000)])
    assert all("try later" in error for error in outcome.values())
    assert 0 < clock.slept <= 7.0 and len(hosts.asked) <= 3 * 10_000


def test_a_host_that_recovers_gets_all(monkeypatch):
    clock = Clock(monkeypatch)
    hosts = Hosts(lambda host, batch: clock.time > 30)
    sender = Sender(hosts, EndpointOptions(("a",), queue_entries=50))
    outcome = send_all(sender, [[("t", str(i))] for i in range(10_000)])
    assert set(outcome.values()) == {None} and len(hosts.took) == 10_000
    assert len({e for e in hosts.took}) == 10_000 and 30 < clock.slept < 120


def test_refused_entries_among_others_cost_no_pause(monkeypatch):
    clock, hosts = Clock(monkeypatch), Hosts(lambda host, batch: batch[0][1] != "bad")
    batches = [[("t", "bad" if i % 4 == 0 else str(i))] for i in range(4_000)]
    outcome = send_all(Sender(hosts, EndpointOptions(("a", "b"))), batches)
    assert sorted(i for i, error in outcome.items() if error) == list(range(0, 4_000, 4))
    assert clock.slept < 1 and sum(entry == ("t", "bad") for _, entry in hosts.asked) == 3_000


def test_a_busy_host_is_left_alone_while_another_works(monkeypatch):
    clock, hosts = Clock(monkeypatch), Hosts(lambda host, batch: host == "good")
    sender = Sender(hosts, EndpointOptions(("good", "busy"), breaker_refusals=4), seed=1)
    sender.hosts = ["busy", "good"]
    outcome = send_all(sender, [[("t", str(i))] for i in range(500)])
    assert set(outcome.values()) == {None} and clock.slept < 2
    assert sum(host == "busy" for host, _ in hosts.asked) <= 20


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_progress_after_a_crash_in_the_third_group(spark, folder, tmp_path, order):
    names = [f"{c}.log" for c in "abcdefg"]
    root = folder({n: n.encode() + b"\n" for n in names}, ages={n: 100 * (i + 1) for i, n in enumerate(names)})
    seen = []

    class Source(FileSource):
        fail = True

        def finish(self, spark):
            seen.append(sorted(r["path"][-5:] for r in self._live.collect()))
            if self.fail and len(seen) == 3:
                raise InterruptedError("third group")
            super().finish(spark)

    def flow():
        source = Source(root, "x", order=order, ledger_path=str(tmp_path / "ledger"), max_files=2)
        return Pipeline("p", source, FileSink(str(tmp_path / "out")), str(tmp_path / "state"))
    with pytest.raises(InterruptedError):
        flow().run_batch(spark)
    again = flow()
    again.source.fail = False
    assert again.run_batch(spark)["read"] == 3
    want = [["f.log", "g.log"], ["d.log", "e.log"], ["b.log", "c.log"]] if order == "asc" else [
        ["a.log", "b.log"], ["c.log", "d.log"], ["e.log", "f.log"]]
    assert seen[:4] == [*want, want[2]]
    assert sorted(r["data"] for r in read_messages(spark, str(tmp_path / "out")).collect()) == names
    assert sum(r["delta"] for r in again.counts(spark, "read").collect()) == 7


def test_buckets_divide_a_minute(spark):
    msgs = spark.createDataFrame([("t", 0)], "topic string, ts long").selectExpr("topic", "timestamp_seconds(ts) AS ts")
    for seconds in (0, 7, 120):
        with pytest.raises(ValueError):
            throughput(msgs, "ts", seconds)


def test_kafka_counts_what_was_sent(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(delivery, "write_kafka", lambda msgs, conf: sent.extend(msgs.collect()))
    changing = F.udf(lambda i: str(time.time_ns())).asNondeterministic()
    msgs = spark.range(20).select(changing("id").alias("topic"), F.lit("x").alias("data"))
    done = delivery.KafkaSink({}).deliver(msgs, "p", "r", 0)
    assert {r.topic for r in sent} == {r.topic for r in done.counts.collect()}
    assert len(sent) == done.counts.agg(F.sum("delta")).first()[0] == 20
