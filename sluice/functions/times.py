"""Elapsed time that no session time zone changes.

Adding intervals to, or subtracting, zoned timestamps counts local days, which are 23 or 25
hours long twice a year. Ages are therefore differences of microseconds.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T


def epoch_micros(df: DataFrame, name: str, value: Column | None = None) -> Column:
    """Microseconds since 1970 of a timestamp column, or of `value` taken as its type."""
    kind = df.schema[name].dataType
    value = F.col(name) if value is None else value.cast(kind)
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value)
    since = (value - F.lit("1970-01-01 00:00:00").cast(kind)).cast("interval second")
    return (since.cast("decimal(18,6)") * 1_000_000).cast("bigint")


def interval_start(df: DataFrame, name: str, seconds: int) -> Column:
    """The start of the interval that holds the time, as `window` has it, but null for null."""
    kind = df.schema[name].dataType
    at = epoch_micros(df, name)
    start = at - F.pmod(at, F.lit(seconds * 1_000_000))
    if not isinstance(kind, T.TimestampNTZType):
        return F.timestamp_micros(start)
    zero = F.lit(0)
    since = F.make_dt_interval(zero, zero, zero, start.cast("decimal(18,0)") / 1_000_000)
    return F.lit("1970-01-01 00:00:00").cast(kind) + since


def older_than(df: DataFrame, name: str, now, seconds: int) -> Column:
    """Strictly older than so many seconds; `now` is a datetime or a Column."""
    now = now if isinstance(now, Column) else F.lit(now)
    return epoch_micros(df, name, now) - epoch_micros(df, name) > F.lit(seconds * 1_000_000)
