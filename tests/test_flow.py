"""Pipelines: batch and stream, restarts, configuration, accounting."""

import os

import pytest
from pyspark.sql import functions as F

from sluice import checks
from sluice.operators.counters import reconcile
from sluice.operators.deadletter import discard, load_letters
from sluice.plans.flow import Pipeline, from_conf, live_rates, start_all
from sluice.plans.sources import FileSource
from sluice.plans.spec import get, part_name, validate_spec
from sluice.sinks.delivery import EndpointSink, FileSink
from sluice.sinks.endpoint import EndpointOptions
from sluice.sinks.files import read_messages
from sluice.streaming.files import exact_glob, stream_lines
from tests.conftest import rows
from tests.test_sinks import QUICK, client_of, sent

CONTENT = {
    "1.log": b"one\r\ntwo\n\nthree", "2.log": b"x\ry\r", "3.log": b"c1\n", "4.log": b"\n",
    "b d.log": b"\xef\xbb\xbfm\n\xff\n", "skip.txt": b"no\n", "old.log": b"expired\n"}
AGES = {"old.log": 5000, "1.log": 400, "2.log": 300, "3.log": 200, "4.log": 100}
LINES = ["one", "", "two", "", "three", "x", "y", "c1", "", "﻿m", "�"]


def file_flow(root, tmp_path, name="p", converter=None, **options):
    source = FileSource(root, "cat", retention_seconds=3600,
                        ledger_path=str(tmp_path / "ledger"), **options)
    extra = {"converter": converter} if converter else {}
    return Pipeline(name, source, FileSink(str(tmp_path / "out")), str(tmp_path / "state"), **extra)


def delivered(spark, tmp_path):
    return sorted(r.data for r in read_messages(spark, str(tmp_path / "out")).collect())


@pytest.mark.parametrize("persist", [False, True])
def test_batch_reads_each_file_once(spark, folder, tmp_path, persist):
    root = folder(CONTENT, AGES)
    flow = file_flow(root, tmp_path)
    assert flow.run_batch(spark, persist) == {
        "read": 11, "written": 11, "failed": 0, "skipped": 0, "dropped": 0}
    assert flow.run_batch(spark)["read"] == 0
    folder({"5.log": b"late\n"})
    assert flow.run_batch(spark)["read"] == 1
    assert delivered(spark, tmp_path) == sorted(LINES + ["late"])


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_stream_equals_batch(spark, folder, tmp_path, order):
    flow = file_flow(folder(CONTENT, AGES), tmp_path, order=order, max_files=1)
    query = flow.start(spark, availableNow=True)
    query.awaitTermination()
    assert delivered(spark, tmp_path) == sorted(LINES)
    assert len([p for p in query.recentProgress if p.numInputRows]) >= 3
    folder({"5.log": b"late\n"})
    flow.start(spark, availableNow=True).awaitTermination()
    assert delivered(spark, tmp_path) == sorted(LINES + ["late"])
    got = rows(flow.counts(spark, "written").groupBy("name", "topic").agg(F.sum("delta")))
    assert got == [("p-FileSink", "cat", 12)]


def test_restart_after_a_failed_batch_loses_and_repeats_nothing(spark, folder, tmp_path):
    root = folder(CONTENT, AGES)
    failures = []

    def fails_once(msgs):
        if len(failures) < 1 and msgs.where("data = 'x'").count():
            failures.append(1)
            raise RuntimeError("converter broke")
        return msgs
    flow = file_flow(root, tmp_path, converter=fails_once, max_files=1)
    with pytest.raises(Exception, match="converter broke"):
        flow.start(spark, availableNow=True).awaitTermination()
    assert len(delivered(spark, tmp_path)) < len(LINES)
    flow.start(spark, availableNow=True).awaitTermination()
    assert delivered(spark, tmp_path) == sorted(LINES)
    assert flow.counts(spark, "read").agg(F.sum("delta")).first()[0] == len(LINES)


def test_accounting_over_all_ends(spark, folder, tmp_path):
    root = folder({"1.log": b"keep\ndrop\nfail\n\nkeep2\n"})
    options = EndpointOptions(("h1",), batch_size=1, **QUICK)
    sink = EndpointSink(client_of(tmp_path / "host", refuse="fail"), options,
                        str(tmp_path / "outcomes"), host="me")
    exported = []
    flow = Pipeline("p:1", FileSource(root, "a"), sink, str(tmp_path / "state"),
                    lambda df: df.where("data != 'drop'").withColumn("topic", F.lit("b:c")),
                    exporter=lambda df: exported.extend(df.collect()))
    assert flow.run_batch(spark) == {
        "read": 5, "written": 2, "failed": 1, "skipped": 1, "dropped": 1}
    letters = load_letters(spark, flow.letters)
    assert rows(letters.select("pipeline", "topic", "data")) == [("p:1", "b:c", "fail")]
    assert {(r.name, r.topic, r.event, r.delta) for r in exported} == {
        ("p:1-FileSource", "a", "read", 5), ("p:1-EndpointSink", "b:c", "written", 2),
        ("p:1-EndpointSink", "b:c", "failed", 1), ("p:1-EndpointSink", "b:c", "skipped", 1)}
    compared = reconcile(flow.counts(spark, "read"), flow.counts(spark, "written"), {"a": "b:c"})
    assert rows(compared) == [("b:c", 5, 2, 3)]


def test_discarded_failures_are_counted(spark, folder, tmp_path):
    root = folder({"1.log": b"fail\n"})
    options = EndpointOptions(("h1",), batch_size=1, **QUICK)
    sink = EndpointSink(client_of(tmp_path / "host", refuse="fail"), options,
                        str(tmp_path / "outcomes"))
    flow = Pipeline("p", FileSource(root, "a"), sink, str(tmp_path / "state"), store=discard)
    assert flow.run_batch(spark)["failed"] == 1
    assert load_letters(spark, flow.letters).count() == 0


def test_delete_after_read(spark, folder, tmp_path):
    root = folder(CONTENT, AGES)
    flow = file_flow(root, tmp_path, delete_after_read=True)
    flow.run_batch(spark)
    assert sorted(os.listdir(root)) == ["old.log", "skip.txt"]
    assert flow.source.delete_expired(spark) == 1
    assert flow.source.delete_expired(spark, dry_run=False) == 1
    assert os.listdir(root) == ["skip.txt"]


def test_stream_delete_after_read_spares_other_files(spark, folder, tmp_path):
    root = folder(CONTENT, AGES)
    flow = file_flow(root, tmp_path, delete_after_read=True, max_files=1)
    flow.start(spark, availableNow=True).awaitTermination()
    left = os.listdir(root)
    assert "skip.txt" in left and len(left) < len(CONTENT)
    assert delivered(spark, tmp_path) == sorted(LINES)
    for pattern, extra in ((r"^\d+\.log$", {}), (r"^.*\.log$", {"k=1/a.log": b"x"})):
        folder(extra)
        broken = file_flow(root, tmp_path, delete_after_read=True, include_pattern=pattern)
        with pytest.raises(ValueError, match="delete after read"):
            broken.start(spark)


@pytest.mark.parametrize("whole", [False, True])
def test_stream_lines(spark, folder, tmp_path, whole):
    root = folder({n: c for n, c in CONTENT.items() if n not in ("2.log", "b d.log")}
                  | {"k=1/in.log": b"no\n", "sub/in.log": b"no\n"}, AGES)
    lines = stream_lines(spark, root, "cat", whole_files=whole, retention_seconds=3600)
    query = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("topic", "data")) == sorted(
        [("cat", x) for x in ["one", "", "two", "", "three", "c1", ""]], key=repr)


@pytest.mark.parametrize("pattern, glob", [
    (r"^.*\.log$", "*.log"), (r".*\.test\.log", "*.test.log"), (r"^.*$", "*"),
    (r"^a.*\.log$", None), (r"\d+", None), (r"^.*.log$", None), (r"^.*\.(log|txt)$", None),
])
def test_exact_glob(pattern, glob):
    assert exact_glob(pattern) == glob


CONF = {
    "pipeline.name": "file-to-scribe-test", "pipeline.source": "some.package.FileSource",
    "pipeline.converter": "some.package.TopicNameConverter",
    "pipeline.store": "some.package.DefaultStore", "pipeline.sink": "some.package.ScribeSink",
    "source.file.directory": "/none", "source.file.include.pattern": r"^.*\.test\.log$",
    "source.file.category": "test", "source.file.retention.second": " 7200 ",
    "topic.mappings": "test:renamed", "sink.scribe.server.hosts": "h1,h2",
    "sink.scribe.thread.number": "2"}


def test_pipeline_from_configuration(spark, folder, tmp_path):
    root = folder({"a.test.log": b"1\n2\n\n", "b.log": b"3\n"})
    flow = from_conf(CONF | {"source.file.directory": root}, str(tmp_path / "state"),
                     client_of(tmp_path / "hosts"))
    assert flow.run_batch(spark) == {
        "read": 3, "written": 2, "failed": 0, "skipped": 1, "dropped": 0}
    assert set(os.listdir(tmp_path / "hosts")) <= {"h1:1466", "h2:1466"}
    messages = [e for b in sent(tmp_path / "hosts") for e in b]
    assert sorted((c, m.split("|")[1]) for c, m in messages) == [("renamed", "1"), ("renamed", "2")]


def test_own_parts(spark, folder, tmp_path):
    root = folder({"a.test.log": b"1\n2\n"})
    conf = CONF | {"source.file.directory": root, "pipeline.sink": "Files",
                   "pipeline.converter": "OnlyTwo"}
    flow = from_conf(conf, str(tmp_path / "state"), parts={
        "Files": lambda c: FileSink(str(tmp_path / "out")),
        "OnlyTwo": lambda c: lambda msgs: msgs.where("data = '2'")})
    assert flow.run_batch(spark)["dropped"] == 1
    with pytest.raises(ValueError, match="unknown part"):
        from_conf(conf, "s")


@pytest.mark.parametrize("change, named", [
    ({"pipeline.name": ""}, "pipeline.name"),
    ({"pipeline.source": None}, "file-to-scribe-test: pipeline.source"),
    ({"pipeline.converter": ""}, "pipeline.converter"),
    ({"pipeline.store": ""}, "pipeline.store"),
    ({"pipeline.sink": ""}, "pipeline.sink"),
    ({"source.file.directory": ""}, "source.file.directory"),
    ({"source.file.category": None}, "source.file.category"),
    ({"source.file.read.order": "newest"}, "source.file.read.order"),
    ({"sink.scribe.server.hosts": ""}, "sink.scribe.server.hosts"),
    ({"sink.scribe.batch.size": "many"}, "sink.scribe.batch.size"),
    ({"pipeline.source": "KafkaSourceV010"}, "source.kafka.topic.and.threads"),
    ({"pipeline.source": "KafkaSource", "source.kafka.topic.and.threads": "t"}, "'t'"),
])
def test_validate_spec_names_the_key(change, named):
    conf = {k: v for k, v in (CONF | change).items() if v is not None}
    with pytest.raises(ValueError, match=named):
        validate_spec(conf)


def test_typed_values():
    assert validate_spec(CONF)["sink"] == "ScribeSink"
    assert part_name("a.b.KafkaSinkV010") == "KafkaSink"
    assert get(CONF, "source.file.retention.second") == 7200
    assert get({}, "source.file.retention.second") == 86_400
    assert get({"source.file.delete.after.read": " TRUE "}, "source.file.delete.after.read") is True
    assert get({}, "source.file.delete.after.read") is False


def test_pipelines_are_independent(spark, folder, tmp_path):
    root = folder({"a.log": b"1\n"})

    def flow(name, directory):
        return lambda: Pipeline(name, FileSource(directory, "c"), FileSink(str(tmp_path / "out")),
                                str(tmp_path / name))
    queries, errors = start_all(
        spark, {"good": flow("good", root), "bad": flow("bad", root + "/none"),
                "other": flow("other", root), "wrong": lambda: from_conf({}, "s")},
        availableNow=True)
    for query in queries.values():
        query.awaitTermination()
    assert set(queries) == {"good", "other"} and set(errors) == {"bad", "wrong"}
    assert delivered(spark, tmp_path) == ["1", "1"]


def test_live_rates(spark, folder, tmp_path):
    flow = file_flow(folder(CONTENT, AGES), tmp_path)
    query = flow.start(spark, processingTime="1 second")
    try:
        query.processAllAvailable()
        assert set(live_rates(query)) == {"rows", "arriving", "processed"}
    finally:
        query.stop()


def test_kafka_pipeline_from_configuration():
    flow = from_conf({
        "pipeline.name": "k", "pipeline.source": "some.package.KafkaSourceV010",
        "pipeline.converter": "some.package.DefaultConverter",
        "pipeline.store": "some.package.DefaultStore",
        "pipeline.sink": "some.package.KafkaSinkV010",
        "source.kafka.topic.and.threads": "t1:2", "source.kafka.bootstrap.servers": "h:9092",
        "sink.kafka.bootstrap.servers": "h:9092"}, "state")
    assert (flow.source.name, flow.sink.name) == ("KafkaSource", "KafkaSink")
    assert flow.converter("msgs") == "msgs"


def test_configured_batches_keep_state_and_expire(spark, folder, tmp_path):
    root, seen = folder(CONTENT, AGES), []
    conf = {"pipeline.name": "p", "pipeline.source": "FileSource", "pipeline.converter": "DefaultConverter",
            "pipeline.store": "DefaultStore", "pipeline.sink": "own", "source.file.directory": root,
            "source.file.category": "cat", "source.file.retention.second": "3600"}
    sink = {"own": lambda c: FileSink(str(tmp_path / "out"))}

    def flow(**options):
        return from_conf(conf, str(tmp_path / "state"), parts=sink, exporter=lambda counts: seen.append(counts.count()), **options)
    assert flow().run_batch(spark)["read"] == 11 and os.path.exists(f"{root}/old.log")
    assert flow(delete_expired=True).run_batch(spark)["read"] == 0 and not os.path.exists(f"{root}/old.log")
    assert len(seen) == 2 and seen[0] >= 2
    assert sorted(os.listdir(root)) == sorted(set(CONTENT) - {"old.log"})


def test_one_listing_serves_all_groups(spark, folder, tmp_path, monkeypatch):
    root = folder({f"{i:02d}.log": b"x\n" for i in range(12)})
    flow = file_flow(root, tmp_path, max_files=3)
    listed, listing = [], flow.source.listing
    monkeypatch.setattr(flow.source, "listing", lambda spark: listed.append(1) or listing(spark))
    assert flow.run_batch(spark)["read"] == 12 and len(listed) == 1
    assert flow.run_batch(spark)["read"] == 0 and len(listed) == 2


def test_hosts_keep_one_file_a_connection(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checks, "scratch_dir", lambda spark, label: str(tmp_path / label))
    counts = {r["event"]: r["n"] for r in checks.folder_to_hosts(spark, "/root/testdata/sf0.01").collect()}
    assert counts["received"] == counts["written"] > 4000
    kept = os.listdir(tmp_path / "flow" / "received")
    assert len(kept) < 20  # of more than 40 batches
