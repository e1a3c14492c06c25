"""The file sink: message tables in folders per topic."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from sluice.schema import MESSAGE

FOLDER = "topic_folder"


def write_files(msgs: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                rebalance: bool = False) -> None:
    """Write topic and data, in one folder per topic.

    The topic is also kept in the files: folder names cannot tell an empty topic from a null
    one, and turn numbers into numbers. Each task writes its own files. With `rebalance`, a
    shuffle first gathers a topic's rows, and AQE splits topics that are too large for a task.
    """
    out = _with_folder(msgs)
    if rebalance:
        out = out.hint("rebalance", FOLDER)
    out.write.format(fmt).mode(mode).partitionBy(FOLDER).save(path)


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet",
                  topic: str | None = None) -> DataFrame:
    """The messages of a folder; a given `topic` reads that topic's folder only."""
    schema = T.StructType([*MESSAGE.fields, T.StructField(FOLDER, T.StringType())])
    msgs = spark.read.schema(schema).format(fmt).load(path)
    if topic is not None:
        folder = F.col(FOLDER).isNull() if topic == "" else F.col(FOLDER) == topic
        msgs = msgs.where(folder & (F.col("topic") == topic))
    return msgs.select("topic", "data")


def stream_files(msgs: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 name: str | None = None, **trigger):
    """Start a query that writes each message exactly once, as tracked by the checkpoint."""
    writer = (
        _with_folder(msgs).writeStream.format(fmt).partitionBy(FOLDER).outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return (writer.queryName(name) if name else writer).start()


def _with_folder(msgs):
    return msgs.select("topic", "data", F.col("topic").alias(FOLDER))
