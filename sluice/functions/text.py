"""Line cutting on byte-exact text.

Spark strings may hold bytes that are not valid UTF-8 (`spark.read.text` keeps them), and
most string functions replace such bytes on the way. Positions are counted in bytes of the
file, so anything that measures must cut first and decode last.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_END = "[\r\n]"
LATIN_1 = "ISO-8859-1"


def decode_utf8(col) -> Column:
    """Replace malformed UTF-8 by U+FFFD as the JVM's decoder does, and keep the rest.

    `make_valid_utf8` differs from that decoder for encoded surrogates (three replacement
    characters in place of one), so the malformed rows go through a JVM string instead.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.is_valid_utf8(col), F.format_string("%s", col)).otherwise(col)


def cuttable(col: Column) -> Column:
    """Text whose one-byte patterns cut as they would cut its bytes.

    Malformed text is read as Latin-1, one character per byte, as Spark's string functions
    would replace the malformed bytes. `piece_text` turns the pieces back.
    """
    return F.when(F.is_valid_utf8(col), col).otherwise(F.decode(col.cast("binary"), LATIN_1))


def piece_text(piece, valid: Column) -> Column:
    """The decoded text of a piece of `cuttable` text; `valid` tells if the whole was UTF-8."""
    return F.when(valid, piece).otherwise(decode_utf8(F.encode(piece, LATIN_1).cast("string")))


def piece_bytes(piece, valid: Column) -> Column:
    """The length of a piece of `cuttable` text in its original bytes."""
    return F.when(valid, F.octet_length(piece)).otherwise(F.char_length(piece)).cast("bigint")


def byte_length(col) -> Column:
    return F.octet_length(col).cast("bigint")


def with_running_total(df: DataFrame, numbers: str, out: str) -> DataFrame:
    """Add the array of running totals of an array<bigint> column, within the row.

    A window over the exploded rows would shuffle the data, and appending to one long array
    costs the square of its length. Cutting the array into about sqrt(n) runs of sqrt(n)
    numbers keeps the copying at n * sqrt(n) words, without a shuffle.
    """
    zero = F.array(F.lit(0).cast("bigint"))

    def add(totals, value):
        return F.array_append(totals, F.element_at(totals, -1) + value)

    step, runs, bases = f"_{out}_step", f"_{out}_runs", f"_{out}_bases"
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    last_run = F.ceil(F.size(numbers) / F.col(step)).cast("int") - 1
    return (
        df.withColumn(step, F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers))).cast("int")))
        .withColumn(runs, F.when(F.size(numbers) > 2, F.transform(
            F.sequence(F.lit(0), last_run),
            lambda i: F.aggregate(F.slice(numbers, i * F.col(step) + 1, F.col(step)), zero, add),
        )))
        .withColumn(bases, F.aggregate(
            runs, zero, lambda totals, run: add(totals, F.element_at(run, -1))))
        .withColumn(out, F.when(F.size(numbers) < 2, F.col(numbers)).when(
            F.size(numbers) == 2, F.array(first, first + second)
        ).otherwise(F.flatten(F.zip_with(
            runs, F.slice(bases, 1, F.size(runs)),
            lambda run, base: F.transform(
                F.slice(run, 2, F.size(run) - 1), lambda total: total + base)))))
        .drop(step, runs, bases)
    )
