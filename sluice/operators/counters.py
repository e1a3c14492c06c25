"""Message counts at both ends of a pipeline, their comparison, rates and alerts."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.joins import null_safe_lookup, stored
from sluice.functions.times import epoch_micros, interval_start
from sluice.operators.convert import rename_topics

MOVING_MINUTES = (1, 5, 15)
DAY_MICROS = 86_400_000_000


def count_messages(msgs: DataFrame, name: str) -> DataFrame:
    """Messages per (component name, topic). Counts are partial before the shuffle."""
    return msgs.groupBy(F.lit(name).alias("name"), "topic").agg(
        F.count(F.lit(1)).alias("delta"))


def count_by_interval(msgs: DataFrame, name: str, ts_col: str, seconds: int = 60,
                      watermark: str | None = None) -> DataFrame:
    """Messages per (name, topic, interval); intervals without traffic give no row.

    Messages without a time are counted with a null interval. On a stream give a `watermark`
    delay, which lets closed intervals be written and forgotten, and leaves out messages that
    have no time or come later than the delay.
    """
    keys, count = [F.lit(name).alias("name"), "topic"], F.count(F.lit(1)).alias("delta")
    if watermark is None:
        start = interval_start(msgs, ts_col, seconds).alias("window_start")
        return msgs.groupBy(*keys, start).agg(count)
    window = F.window(ts_col, f"{seconds} seconds").alias("_window")
    return msgs.withWatermark(ts_col, watermark).groupBy(*keys, window).agg(count).select(
        "name", "topic", F.col("_window.start").alias("window_start"), "delta")


def reconcile(source_counts: DataFrame, sink_counts: DataFrame, mappings=None) -> DataFrame:
    """Read and written counts per topic name at the sink, and the difference.

    A full outer join loses topics that are null on both ends; stacking the two sides and
    summing keeps them, and needs one shuffle of counts.
    """
    read = rename_topics(source_counts, mappings) if mappings is not None else source_counts
    both = read.select("topic", F.col("delta").alias("read"), F.lit(0).alias("written")).unionByName(
        sink_counts.select("topic", F.lit(0).alias("read"), F.col("delta").alias("written")))
    return both.groupBy("topic").agg(
        F.sum("read").alias("read"), F.sum("written").alias("written")
    ).withColumn("missing", F.col("read") - F.col("written"))


def reconcile_streams(read: DataFrame, written: DataFrame, ts_col: str, seconds: int = 60,
                      watermark: str = "10 minutes", mappings=None) -> DataFrame:
    """Read and written messages per interval and topic name at the sink, from the streams of both ends.

    The streams are stacked and counted with one watermark, so the state is one row per open interval and topic. An
    interval comes out once, when the later messages of both ends have moved the watermark past it: what is missing then
    was lost, or came later than the delay. `delivery_alerts` picks the intervals that stay short.
    """
    read = rename_topics(read, mappings) if mappings is not None else read
    one, none = F.lit(1), F.lit(0)
    both = read.select("topic", ts_col, one.alias("read"), none.alias("written")).unionByName(
        written.select("topic", ts_col, none.alias("read"), one.alias("written")))
    window = F.window(ts_col, f"{seconds} seconds").alias("_window")
    return both.withWatermark(ts_col, watermark).groupBy(window, "topic").agg(
        F.sum("read").alias("read"), F.sum("written").alias("written")).select(
        F.col("_window.start").alias("window_start"), "topic", "read", "written",
        (F.col("read") - F.col("written")).alias("missing"))


def delivery_alerts(reconciled: DataFrame, max_missing_ratio: float) -> DataFrame:
    """Topics that miss more than the given part of what was read."""
    return reconciled.where(F.col("missing") > F.col("read") * F.lit(max_missing_ratio))


def mean_rates(msgs: DataFrame, ts_col: str) -> DataFrame:
    """Messages per second of each topic, over the time between its first and last message."""
    at = epoch_micros(msgs, ts_col)
    return msgs.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), ((F.max(at) - F.min(at)) / 1_000_000).alias("seconds")
    ).withColumn("mean_rate", F.try_divide("n", "seconds"))


def throughput(msgs: DataFrame, ts_col: str, bucket_seconds: int = 5) -> DataFrame:
    """Per topic and bucket: the count and the rates over the last 1, 5 and 15 minutes.

    The rates are plain means over the minutes that end with the bucket. Messages are counted
    per bucket first, and a window holds the buckets of one topic and day. The last buckets of
    a day are also given to the next day, whose first rates reach back to them. A rate covers
    whole buckets, so the bucket must divide a minute.
    """
    if bucket_seconds < 1 or 60 % bucket_seconds:
        raise ValueError(f"bucket_seconds must divide 60, not {bucket_seconds}")
    start = interval_start(msgs, ts_col, bucket_seconds)
    buckets = msgs.groupBy("topic", start.alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))
    buckets = buckets.withColumn("_at", epoch_micros(buckets, "bucket_start"))
    day, reach = F.floor(F.col("_at") / DAY_MICROS), max(MOVING_MINUTES) * 60_000_000
    days = F.when(F.floor((F.col("_at") + reach) / DAY_MICROS) > day, F.array(day, day + 1)).otherwise(
        F.array(day))
    order = Window.partitionBy("topic", "_day").orderBy("_at")
    rates = [
        (F.sum("n").over(order.rangeBetween((bucket_seconds - 60 * m) * 1_000_000, 0)) / (60 * m))
        .alias(f"rate_{m}m") for m in MOVING_MINUTES
    ]
    return (
        buckets.withColumn("_own", day).withColumn("_day", F.explode(days))
        .select("topic", "bucket_start", "n", "_own", "_day", *rates)
        .where(F.col("_day").eqNullSafe(F.col("_own"))).drop("_own", "_day")
    )


def decayed_rates(msgs: DataFrame, ts_col: str, tick_seconds: int = 5, minutes=MOVING_MINUTES) -> DataFrame:
    """Per topic and tick with messages: the count and, for each number of minutes, the exponentially decayed rate.

    This is the rate of a meter that ticks: the first tick sets it, and each later one moves it towards its own rate by
    1 - exp(-tick / minutes); ticks without messages decay it. Within an hour, decayed sums are running sums of scaled
    counts. What an hour leaves behind is one number, which decays into the hours after it until it is below rounding,
    so that no window is longer than an hour, and days, months and gaps make no difference. Messages without a time are
    left out. `minutes` are 1 or more; a tick must divide a minute.
    """
    if tick_seconds < 1 or 60 % tick_seconds or min(minutes) < 1:
        raise ValueError(f"a tick must divide 60 and minutes be 1 or more, not {tick_seconds} and {minutes}")
    ticks = 3600 // tick_seconds
    keep = {m: math.exp(-tick_seconds / (60 * m)) for m in minutes}
    start = interval_start(msgs, ts_col, tick_seconds)
    buckets = msgs.where(F.col(ts_col).isNotNull()).groupBy("topic", start.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("n"))
    at = epoch_micros(buckets, "bucket_start")
    buckets = stored(buckets.withColumn("_tick", F.floor(at / (tick_seconds * 1_000_000))).withColumns({
        "_hour": F.expr(f"floor(_tick / {ticks})"), "_in": F.expr(f"pmod(_tick, {ticks})")}))
    first = buckets.groupBy("topic").agg(F.min("_tick").alias("_first"))
    given = null_safe_lookup(buckets, first, ["topic"])
    within = Window.partitionBy("topic", "_hour").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    shares, sums, left = {}, {}, []
    for m, q in keep.items():
        # Scaled by the place in the hour, at most exp(60), all counts of an hour decay alike.
        share = F.when(F.col("_tick") == F.col("_first"), 1.0).otherwise(1 - q) * F.col("n") / tick_seconds
        shares[f"_share_{m}"] = share * F.pow(F.lit(q), -F.col("_in"))
        sums[f"_sum_{m}"] = F.sum(f"_share_{m}").over(within) * F.pow(F.lit(q), F.col("_in"))
        left.append((F.sum(f"_share_{m}") * q ** (ticks - 1)).alias(f"_left_{m}"))
    shared = given.withColumns(shares)
    hours = 2 + max(minutes) * 40 // 60
    later = F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("_later")
    carried = shared.groupBy("topic", "_hour").agg(*left).select("*", later).groupBy(
        "topic", (F.col("_hour") + F.col("_later")).alias("_hour")).agg(*(
            F.sum(F.col(f"_left_{m}") * F.pow(F.lit(q ** ticks), F.col("_later") - 1)).alias(f"_carried_{m}")
            for m, q in keep.items()))
    rates = null_safe_lookup(shared.withColumns(sums), carried, ["topic", "_hour"])
    return rates.select("topic", "bucket_start", "n", *(
        (F.coalesce(f"_carried_{m}", F.lit(0.0)) * F.pow(F.lit(q), F.col("_in") + 1) + F.col(f"_sum_{m}")).alias(f"rate_{m}m")
        for m, q in keep.items()))


def write_counters(counters: DataFrame, path: str, fmt: str = "parquet",
                   mode: str = "append") -> None:
    """The built-in exporter. Any function of a DataFrame can stand in for it."""
    counters.write.format(fmt).mode(mode).save(path)
