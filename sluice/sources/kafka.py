"""Kafka topics as message tables, and the translation of client properties.

The connector (`spark-sql-kafka`) is a package of the cluster; only `read_kafka`,
`stream_kafka` and `write_kafka` / `stream_to_kafka` need it.
"""

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import decode_utf8
from sluice.operators.convert import words
from sluice.schema import POSITION
from sluice.sources.statelog import StateLog

SOURCE_PREFIX = "source.kafka."
TOPICS_KEY = "source.kafka.topic.and.threads"

# How the reader's JSON says "from the start".
EARLIEST = -2

# Client properties that Spark sets by itself and refuses to be given.
REFUSED = {"key.deserializer", "value.deserializer", "enable.auto.commit", "interceptor.classes"}


def parse_topic_threads(text: str | None) -> dict[str, int]:
    """`t1:2,t2:1` as a dict; a repeated topic keeps its last number."""
    if not text:
        raise ValueError(f"{TOPICS_KEY} must be specified")
    numbers = {}
    for pair in words(text, ","):
        parts = words(pair, ":")
        if len(parts) != 2 or not re.fullmatch(r"[+-]?[0-9]+", parts[1]):
            raise ValueError(f"{pair!r}: the format should be topic1:number1,topic2:number2")
        numbers[parts[0]] = int(parts[1])
    return numbers


def kafka_source_options(conf: dict) -> dict[str, str]:
    """Reader options from `source.kafka.*` keys, which are consumer properties.

    The numbers per topic become a hint for the number of input partitions.
    """
    wanted = {t: n for t, n in parse_topic_threads(conf.get(TOPICS_KEY)).items() if n > 0}
    if not wanted:
        raise ValueError(f"{TOPICS_KEY} names no topic with a number of 1 or more")
    options = {"subscribe": ",".join(wanted), "minPartitions": str(sum(wanted.values()))}
    for key, value in conf.items():
        name = key.removeprefix(SOURCE_PREFIX)
        if name == key or key == TOPICS_KEY or name in REFUSED:
            continue
        if name == "auto.offset.reset":
            if value not in ("earliest", "latest"):
                raise ValueError(f"{key}={value}: use earliest or latest")
            options["startingOffsets"] = value
        else:
            options[f"kafka.{name}"] = value
    return options


def from_kafka(records: DataFrame, lineage: bool = False) -> DataFrame:
    """Messages of Kafka records; a null value stays null. Lineage is the partition and offset."""
    rest = ["partition", "offset"] if lineage else []
    data = decode_utf8(F.col("value").cast("string")).alias("data")
    return records.select("topic", data, *rest)


def read_kafka(spark: SparkSession, conf: dict, lineage: bool = False, span: dict | None = None,
               fmt: str = "kafka") -> DataFrame:
    """A batch over all records that the topics hold now, or over a `span` of positions; see `next_span`."""
    options = kafka_source_options(conf) | {"startingOffsets": "earliest"} | (span or {})
    return from_kafka(spark.read.format(fmt).options(**options).load(), lineage)


def offsets_json(offsets: dict) -> str:
    """{(topic, partition): offset} in the form that the reader takes."""
    topics = {}
    for (topic, partition), offset in sorted(offsets.items()):
        topics.setdefault(topic, {})[str(partition)] = offset
    return json.dumps(topics)


def next_span(start: dict, ends: dict, reset: str = "earliest") -> tuple[dict, dict]:
    """(reader options, next positions) of the records between the saved positions and the ends.

    Partitions without a position begin where `reset` says. A position beyond the end (a topic that was made anew) begins
    at the start again. Positions of partitions that are gone are kept.
    """
    fresh = {at: end if reset == "latest" else EARLIEST for at, end in ends.items()}
    begin = {at: start[at] if at in start and start[at] <= end else fresh[at] if at not in start else EARLIEST
             for at, end in ends.items()}
    span = {"startingOffsets": offsets_json(begin), "endingOffsets": offsets_json(ends)}
    return span, {**start, **ends}


def broker_ends(spark: SparkSession, conf: dict) -> dict:
    """{(topic, partition): end} of the configured topics, as the brokers say; no records are read."""
    options = kafka_source_options(conf)
    settings = spark._jvm.java.util.HashMap()
    for name, value in options.items():
        if name.startswith("kafka."):
            settings.put(name.removeprefix("kafka."), value)
    for part in ("key", "value"):
        settings.put(f"{part}.deserializer", "org.apache.kafka.common.serialization.ByteArrayDeserializer")
    consumer = spark._jvm.org.apache.kafka.clients.consumer.KafkaConsumer(settings)
    try:
        parts = spark._jvm.java.util.ArrayList()
        for topic in options["subscribe"].split(","):
            for info in consumer.partitionsFor(topic):
                parts.add(spark._jvm.org.apache.kafka.common.TopicPartition(info.topic(), info.partition()))
        return {(at.topic(), at.partition()): int(end) for at, end in dict(consumer.endOffsets(parts)).items()}
    finally:
        consumer.close()


def position_log(spark: SparkSession, path: str) -> StateLog:
    """The next offset of each partition."""
    return StateLog(spark, path, POSITION, ["topic", "partition"])


def stream_kafka(spark: SparkSession, conf: dict, max_offsets: int | None = None,
                 lineage: bool = False) -> DataFrame:
    options = kafka_source_options(conf)
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return from_kafka(spark.readStream.format("kafka").options(**options).load(), lineage)
