"""Converters: message table in, message table out. All of them also work on streams."""

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.joins import lookup_join

LITERAL_MAPPINGS = 64


def identity(msgs: DataFrame) -> DataFrame:
    return msgs


def words(text: str, separator: str) -> list[str]:
    """Split and drop trailing empty words; empty words before a word are kept."""
    return re.sub(f"{re.escape(separator)}+$", "", text).split(separator)


def parse_mappings(text: str | None) -> dict[str, str]:
    """`a:b,c:d` as a dict. Pairs without exactly two words are skipped; the last one wins."""
    pairs = (words(pair, ":") for pair in words(text or "", ","))
    return {pair[0]: pair[1] for pair in pairs if len(pair) == 2}


def rename_topics(msgs: DataFrame, mappings, order_col: str | None = None,
                  **limits) -> DataFrame:
    """Rename mapped topics by one lookup, so `a:b,b:c` turns `a` into `b`.

    `mappings` is a dict, the string form, or a table (from_topic, to_topic). If a table
    names a topic twice, the row with the greatest `order_col` wins.
    """
    if isinstance(mappings, str) or mappings is None:
        mappings = parse_mappings(mappings)
    if isinstance(mappings, DataFrame):
        return _rename_by_table(msgs, mappings, order_col, limits)
    if not mappings:
        return msgs
    if len(mappings) > LITERAL_MAPPINGS:
        table = msgs.sparkSession.createDataFrame(
            list(mappings.items()), "from_topic string, to_topic string")
        return _rename_by_table(msgs, table, None, limits)
    lookup = F.create_map(*[F.lit(word) for pair in mappings.items() for word in pair])
    return msgs.withColumn("topic", F.coalesce(lookup[F.col("topic")], F.col("topic")))


def _rename_by_table(msgs, table, order_col, limits):
    winner = F.max_by("to_topic", order_col) if order_col else F.max("to_topic")
    unique = table.groupBy(F.col("from_topic").alias("topic")).agg(winner.alias("_to"))
    columns = msgs.columns
    return (
        lookup_join(msgs, unique, "topic", "left", **limits)
        .withColumn("topic", F.coalesce("_to", "topic")).select(*columns)
    )


def filter_messages(msgs: DataFrame, condition: Column | str) -> DataFrame:
    """Keep the messages that meet a condition (a Column or SQL text)."""
    return msgs.where(condition)


def apply_converter(msgs: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a user converter, which may rename, rewrite or drop messages."""
    out = msgs.transform(fn)
    missing = {"topic", "data"} - set(out.columns)
    if missing:
        raise ValueError(f"the converter dropped the columns {sorted(missing)}")
    return out


def convert_batches(msgs: DataFrame, fn: Callable) -> DataFrame:
    """Run a pandas converter (pandas frame in, pandas frame out) where columns do not suffice.

    Rows that `fn` leaves out are dropped. The frames are Arrow batches of a partition.
    """
    def run(frames: Iterable) -> Iterator:
        for frame in frames:
            yield fn(frame)

    return msgs.mapInPandas(run, msgs.schema)


def drop_empty(msgs: DataFrame) -> DataFrame:
    """Drop null and empty data; blanks are kept."""
    return msgs.where(F.col("data").isNotNull() & (F.col("data") != ""))


def add_host_prefix(msgs: DataFrame, host) -> DataFrame:
    """The endpoint's form: category and `host|data`. An unknown host is written `null`."""
    prefix = host if isinstance(host, Column) else F.lit("null" if host is None else host)
    rest = [c for c in msgs.columns if c not in ("topic", "data")]
    return msgs.select(
        F.col("topic").alias("category"),
        F.concat(prefix, F.lit("|"), F.col("data")).alias("message"), *rest)
