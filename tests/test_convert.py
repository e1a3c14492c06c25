"""Converters, Kafka projections and options."""

import pytest
from pyspark.sql import functions as F

from sluice.operators.convert import (
    add_host_prefix, apply_converter, convert_batches, drop_empty, filter_messages, identity,
    parse_mappings, rename_topics)
from sluice.schema import MESSAGE
from sluice.sinks.kafka import kafka_sink_options, to_kafka, write_kafka
from sluice.sources.kafka import (
    from_kafka, kafka_source_options, parse_topic_threads, read_kafka, stream_kafka)
from tests.conftest import rows


@pytest.fixture
def msgs(spark):
    return spark.createDataFrame(
        [("a", "1"), ("b", "2"), ("x", ""), (None, "3"), ("", " "), ("a", None)], MESSAGE)


@pytest.mark.parametrize("text, want", [
    ("test1:test2,topic1:topic2", {"test1": "test2", "topic1": "topic2"}),
    ("a:b,b:c", {"a": "b", "b": "c"}),
    ("a:b,a:c", {"a": "c"}),
    ("a:b:", {"a": "b"}),
    ("a:", {}), ("a", {}), ("a:b:c", {}), ("", {}), (None, {}), (",", {}), (":", {}),
    (":b", {"": "b"}), ("a:b, c:d", {"a": "b", " c": "d"}), ("a::b,,c:d,", {"c": "d"}),
])
def test_parse_mappings(text, want):
    assert parse_mappings(text) == want


def test_rename_forms_agree(spark, msgs):
    want = sorted([("b", "1"), ("c", "2"), ("x", ""), (None, "3"), ("e", " "), ("b", None)], key=repr)
    mapping = {"a": "b", "b": "c", "": "e", "unused": "z"}
    table = spark.createDataFrame(list(mapping.items()), "from_topic string, to_topic string")
    assert rows(rename_topics(msgs, "a:b,b:c,:e,unused:z")) == want
    assert rows(rename_topics(msgs, mapping)) == want
    assert rows(rename_topics(msgs, table)) == want
    assert rows(rename_topics(msgs, table, max_rows=1)) == want
    many = mapping | {f"t{i}": "z" for i in range(100)}
    assert rows(rename_topics(msgs, many)) == want
    assert rows(rename_topics(msgs, {})) == rows(msgs) == rows(rename_topics(msgs, None))


def test_rename_by_table_takes_the_last_of_repeated_topics(spark, msgs):
    table = spark.createDataFrame(
        [("a", "z", 1), ("a", "c", 2)], "from_topic string, to_topic string, seq int")
    assert rows(rename_topics(msgs, table, "seq").where("data = '1'")) == [("c", "1")]


def test_lookup_size_decides_the_join(spark, msgs):
    table = spark.range(50).selectExpr("'t' || id AS from_topic", "'z' AS to_topic")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = (rename_topics(msgs, table, max_rows=n) for n in (100, 10))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (small, large)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_filters(msgs):
    assert rows(identity(msgs)) == rows(msgs)
    assert rows(filter_messages(msgs, "data = '1'")) == [("a", "1")]
    assert rows(filter_messages(msgs, F.col("topic") == "b")) == [("b", "2")]
    assert rows(drop_empty(msgs)) == sorted([("a", "1"), ("b", "2"), (None, "3"), ("", " ")], key=repr)


def test_converters(msgs):
    out = apply_converter(msgs, lambda df: df.where("data = '1'").withColumn("data", F.lit("new")))
    assert rows(out) == [("a", "new")]
    with pytest.raises(ValueError, match="data"):
        apply_converter(msgs, lambda df: df.drop("data"))

    def shout(frame):
        frame = frame[frame["topic"] == "b"]
        return frame.assign(data=frame["data"] + "!")
    assert rows(convert_batches(msgs, shout)) == [("b", "2!")]


def test_host_prefix(msgs):
    got = rows(add_host_prefix(drop_empty(msgs), "h"))
    assert got == sorted([("a", "h|1"), ("b", "h|2"), (None, "h|3"), ("", "h| ")], key=repr)
    assert rows(add_host_prefix(msgs.where("data = '1'"), None)) == [("a", "null|1")]


@pytest.mark.parametrize("text, want", [
    ("t1:2,t2:1", {"t1": 2, "t2": 1}), ("t1:1,t1:3", {"t1": 3}), ("t1:0", {"t1": 0}),
])
def test_parse_topic_threads(text, want):
    assert parse_topic_threads(text) == want


@pytest.mark.parametrize("text", ["t1", "t1:x", "", None, "t1:1:2", "t1: 1", "t1:1,,t2:1"])
def test_parse_topic_threads_errors(text):
    with pytest.raises(ValueError):
        parse_topic_threads(text)


def test_kafka_source_options():
    conf = {
        "source.kafka.bootstrap.servers": "h1:9092,h2:9092", "source.kafka.group.id": "g",
        "source.kafka.key.deserializer": "K", "source.kafka.value.deserializer": "V",
        "source.kafka.topic.and.threads": "t1:2,t2:1,t3:0", "source.kafka.enable.auto.commit": "true",
        "source.kafka.session.timeout.ms": "30000", "source.kafka.auto.offset.reset": "earliest",
        "sink.kafka.acks": "all"}
    assert kafka_source_options(conf) == {
        "subscribe": "t1,t2", "minPartitions": "3", "startingOffsets": "earliest",
        "kafka.bootstrap.servers": "h1:9092,h2:9092", "kafka.group.id": "g",
        "kafka.session.timeout.ms": "30000"}
    with pytest.raises(ValueError):
        kafka_source_options({"source.kafka.topic.and.threads": "t:0"})
    with pytest.raises(ValueError):
        kafka_source_options({"source.kafka.topic.and.threads": "t:1",
                              "source.kafka.auto.offset.reset": "none"})


def test_kafka_sink_options():
    conf = {"sink.kafka.bootstrap.servers": "h:9092", "sink.kafka.key.serializer": "K",
            "sink.kafka.value.serializer": "V", "sink.kafka.compression.type": "gzip",
            "source.kafka.group.id": "g"}
    assert kafka_sink_options(conf) == {
        "kafka.bootstrap.servers": "h:9092", "kafka.compression.type": "gzip"}


def test_kafka_projections(spark):
    records = spark.createDataFrame(
        [(b"k", b"v", "t", 1, 7), (None, None, "t", 0, 8), (None, b"\xffx", "u", 0, 9)],
        "key binary, value binary, topic string, partition int, offset bigint")
    assert rows(from_kafka(records)) == sorted([("t", "v"), ("t", None), ("u", "�x")], key=repr)
    assert rows(from_kafka(records, lineage=True).where("offset = 7")) == [("t", "v", 1, 7)]
    assert to_kafka(from_kafka(records)).columns == ["topic", "value"]


def test_kafka_needs_the_connector(spark):
    conf = {"source.kafka.topic.and.threads": "t:1", "source.kafka.bootstrap.servers": "h:9092",
            "sink.kafka.bootstrap.servers": "h:9092"}
    msgs = spark.createDataFrame([("t", "1")], MESSAGE)
    for call in (lambda: read_kafka(spark, conf), lambda: stream_kafka(spark, conf, 100),
                 lambda: write_kafka(msgs, conf)):
        with pytest.raises(Exception, match="(?i)failed to find data source: kafka"):
            call()


def test_hot_topic_is_split_beyond_the_broadcast_limit(spark, tmp_path):
    """Half of the messages have one topic; AQE reads its partition in parts."""
    spark.range(0, 200_000, 1, 8).selectExpr(
        "IF(id % 2 = 0, 'hot', 't' || id % 50) AS topic", "uuid() AS data"
    ).write.parquet(str(tmp_path / "msgs"))
    msgs = spark.read.parquet(str(tmp_path / "msgs"))
    table = spark.range(50).selectExpr("'t' || id AS from_topic", "'z' || id AS to_topic").union(
        spark.createDataFrame([("hot", "cold")]))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        renamed = rename_topics(msgs, table, max_rows=10)
        renamed.write.format("noop").mode("overwrite").save()
        counts = renamed.groupBy("topic").count()
        assert ("cold", 100_000) in rows(counts) and renamed.count() == 200_000
        renamed.collect()
        assert "skew=true" in renamed._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in conf:
            spark.conf.unset(key)
