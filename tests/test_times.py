"""Ages do not depend on the session's time zone."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sluice.functions.times import epoch_micros, interval_start, older_than
from sluice.operators.counters import throughput
from sluice.sources.cleanup import expire_older_than_days


@pytest.fixture(params=["UTC", "Europe/Berlin", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_age_over_a_clock_change(spark, zone):
    # Between the two instants both zones move their clocks by an hour.
    now = datetime(2024, 4, 5, tzinfo=timezone.utc)
    day = 86_400
    at = int(now.timestamp())
    ages = [28 * day - 1, 28 * day, 28 * day + 1]
    df = spark.createDataFrame([(a, at - a) for a in ages], "age int, s bigint").select(
        "age", F.timestamp_seconds("s").alias("modified"))
    assert [r.age for r in df.where(older_than(df, "modified", now, 28 * day)).collect()] == ages[2:]
    assert sorted(r.age for r in expire_older_than_days(df, now, 27).collect()) == ages[1:]


def test_local_timestamps(spark, zone):
    df = spark.sql("""SELECT explode(array(
        TIMESTAMP_NTZ '2024-03-31 01:59:58', TIMESTAMP_NTZ '2024-03-31 02:30:00',
        TIMESTAMP_NTZ '2024-03-31 03:00:01', TIMESTAMP_NTZ '1969-12-31 23:59:59.5')) AS ts""")
    got = [r[0] for r in df.select(epoch_micros(df, "ts")).collect()]
    want = [datetime(2024, 3, 31, 1, 59, 58), datetime(2024, 3, 31, 2, 30),
            datetime(2024, 3, 31, 3, 0, 1)]
    assert got == [int(w.replace(tzinfo=timezone.utc).timestamp()) * 10 ** 6 for w in want] + [-500_000]
    rates = throughput(df.where("ts > '2024-01-01'").withColumn("topic", F.lit("a")), "ts")
    assert [r.rate_15m for r in rates.collect()] == [1 / 900] * 3


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_interval_start_is_that_of_windows(spark, zone, kind):
    df = spark.range(-3000, 3000).select(
        F.timestamp_micros(F.col("id") * 1_777_777_777 + F.lit(1_711_843_200_000_000)).cast(kind).alias("ts"))
    df = df.withColumn("ours", interval_start(df, "ts", 300))
    got = df.select("ours", F.window("ts", "300 seconds")["start"].alias("want")).where("ours <> want")
    assert got.count() == 0 and df.schema["ours"].dataType.simpleString() == kind
    empty = df.select(F.lit(None).cast(kind).alias("ts"))
    assert empty.where(interval_start(empty, "ts", 60).isNotNull()).count() == 0
