"""The Kafka sink. Failures surface as failed tasks; a retried task may write again."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SINK_PREFIX = "sink.kafka."

# Client properties that Spark sets by itself and refuses to be given.
REFUSED = {"key.serializer", "value.serializer"}


def kafka_sink_options(conf: dict) -> dict[str, str]:
    """Writer options from `sink.kafka.*` keys, which are producer properties."""
    names = {key: key.removeprefix(SINK_PREFIX) for key in conf if key.startswith(SINK_PREFIX)}
    return {f"kafka.{name}": conf[key] for key, name in names.items() if name not in REFUSED}


def to_kafka(msgs: DataFrame) -> DataFrame:
    """One record per message, to the topic of the message and without a key."""
    return msgs.select("topic", F.col("data").alias("value"))


def write_kafka(msgs: DataFrame, conf: dict) -> None:
    to_kafka(msgs).write.format("kafka").options(**kafka_sink_options(conf)).save()


def stream_to_kafka(msgs: DataFrame, conf: dict, checkpoint: str, name: str | None = None,
                    **trigger):
    writer = (
        to_kafka(msgs).writeStream.format("kafka").options(**kafka_sink_options(conf))
        .option("checkpointLocation", checkpoint)
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return (writer.queryName(name) if name else writer).start()
