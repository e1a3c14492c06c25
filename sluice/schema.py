"""Schemas of the tables that the operators read and write."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("data", T.StringType()),
])

LISTING = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("length", T.LongType()),
])

LEDGER = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("completed", T.BooleanType()),
])

# How far a Kafka partition has been read: the offset of the record that comes next.
POSITION = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])

# One record of a text scan: the bytes between two line feeds, and where they lie.
# (file_path, block, rec) orders the records of a file.
RECORD = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("block", T.LongType()),
    T.StructField("rec", T.LongType()),
])

COUNTER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("delta", T.LongType()),
])

ENTRY = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("message", T.StringType()),
])

# The partition columns (pipeline, run, batch_id) come from the folder names.
DEAD_LETTER = T.StructType([
    T.StructField("letter_no", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("failed_at", T.TimestampType()),
    T.StructField("pipeline", T.StringType()),
    T.StructField("run", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])
