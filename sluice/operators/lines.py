"""From text to lines: cutting, byte offsets, resuming, tagging.

Each line feed and each carriage return ends a line, so a CR LF pair gives an extra empty
line. Empty lines are lines. A last line without a terminator is a line; an empty rest is not.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.joins import lookup_join, stored
from sluice.functions.text import (
    LINE_END, byte_length, cuttable, piece_bytes, piece_text, with_running_total)

BLOCK_LINES = 1 << 16
# A task accumulates about so many lines.
TASK_LINES = 500_000


def split_lines(df: DataFrame, text_col: str, id_cols: list, keep_empty=True,
                offsets=False) -> DataFrame:
    """One row per line of a text column: `id_cols`, `pos`, `line` and optionally `end_offset`.

    Row-wise, without a shuffle, and so usable on streams. `end_offset` is the byte position
    just after the line's terminator, counted on the undecoded bytes.
    """
    text, valid = F.col(text_col), F.col("_valid")
    pieces = df.select(
        *id_cols, F.is_valid_utf8(text).alias("_valid"), byte_length(text).alias("_size"),
        F.split(cuttable(text), LINE_END, -1).alias("_pieces"))
    # The outer form keeps Spark from adding a filter on the array, which would cut twice.
    # There is always a piece; the last one is not a line if it is empty.
    is_line = (F.col("pos") < F.col("_n") - 1) | (F.col("line") != "")
    keep = [*id_cols, "_valid", "_size", F.size("_pieces").alias("_n")]
    if offsets:
        measured = with_running_total(pieces.withColumn(
            "_lengths", F.transform("_pieces", lambda p: piece_bytes(p, valid) + 1)),
            "_lengths", "_ends")
        zipped = F.arrays_zip(F.col("_pieces").alias("line"), F.col("_ends").alias("end"))
        lines = measured.select(*keep, F.posexplode_outer(zipped).alias("pos", "_at")).withColumn(
            "line", F.col("_at.line")).where(is_line)
        end = [F.least("_at.end", "_size").alias("end_offset")]
    else:
        lines = pieces.select(*keep, F.posexplode_outer("_pieces").alias("pos", "line")).where(is_line)
        end = []
    lines = lines.select(*id_cols, "pos", piece_text(F.col("line"), valid).alias("line"), *end)
    return lines if keep_empty else lines.where(F.col("line") != "")


def line_offsets(lines: DataFrame, raw_length: str, file_cols: list, order: str = "pos",
                 line_col: str = "line", block=None) -> DataFrame:
    """Add `end_offset` to lines that are rows already, counted on undecoded lines.

    A file may hold a third of all lines, so no window spans a file. Lines are totalled per
    (file, block) first, the totals are accumulated over the blocks of the file, and only the
    lines of one block are accumulated together. `block` must not decrease along `order`.
    The totals, which are stored, also tell among how many tasks the lines are dealt, so that
    no task grows with the table. First blocks of files start at 0 and are not looked up.
    """
    block = F.floor(F.col(order) / BLOCK_LINES) if block is None else block
    # As one struct the keys may hold nulls, and join and window share one shuffle.
    sized = lines.withColumn("_key", F.struct(*file_cols, block.alias("_block"))).withColumn(
        "_bytes", byte_length(line_col) + 1).drop(*(c for c in file_cols if c != raw_length))
    earlier = Window.partitionBy(*[F.col(f"_key.{c}") for c in file_cols]).orderBy(
        "_key._block").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored(sized.groupBy("_key").agg(F.sum("_bytes").alias("_sum"), F.count(F.lit(1)).alias("_n")))
    bases = totals.select("_key", F.sum("_sum").over(earlier).alias("_base")).where("_base > 0")
    n = totals.agg(F.sum("_n")).first()[0] or 0
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_LINES))
    so_far = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        lookup_join(sized.repartition(tasks, "_key"), stored(bases), "_key")
        .withColumn("end_offset", F.least(
            F.coalesce("_base", F.lit(0)) + F.sum("_bytes").over(so_far), F.col(raw_length)))
        .select(*[F.col(f"_key.{c}") if c in file_cols else c for c in lines.columns], "end_offset")
    )


def resume_lines(lines: DataFrame, ledger: DataFrame, path_col: str = "file_path",
                 **limits) -> DataFrame:
    """Keep the lines that end after the ledger's offset of their file."""
    saved = ledger.groupBy(F.col("path").alias(path_col)).agg(F.max("offset").alias("_saved"))
    return (
        lookup_join(lines, saved, path_col, "left", **limits)
        .where(F.col("end_offset") > F.coalesce("_saved", F.lit(0)))
        .drop("_saved")
    )


def tag_category(df: DataFrame, category, line_col: str = "line") -> DataFrame:
    """Lines become messages: the category is the topic. Other columns stay as lineage."""
    topic = category if isinstance(category, Column) else F.lit(category)
    rest = [c for c in df.columns if c not in (line_col, "topic", "data")]
    return df.select(topic.alias("topic"), F.col(line_col).alias("data"), *rest)
