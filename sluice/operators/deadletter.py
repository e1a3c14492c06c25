"""Dead letters: messages that a sink could not deliver.

The letters of a batch are one folder, pipeline=…/run=…/batch_id=…, which a retry of the same
batch replaces. A run is the id of a streaming query, which a new checkpoint changes.
Replays add the keys of what they delivered to a second table; nothing is rewritten. `replay_due`
also keeps count of the tries of each letter, pauses between them, and gives up in the end.
"""

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from sluice.functions.joins import scratch_tables, stored
from sluice.schema import DEAD_LETTER
from sluice.sources.statelog import StateLog

KEY = ["pipeline", "run", "batch_id", "letter_no"]
LETTER_KEY = T.StructType([DEAD_LETTER[name] for name in KEY])
ATTEMPT = T.StructType([
    *LETTER_KEY.fields, T.StructField("tries", T.IntegerType()), T.StructField("next_at", T.TimestampType()),
    T.StructField("state", T.StringType()), T.StructField("error", T.StringType())])


def batch_folder(path: str, pipeline: str, run: str, batch_id: int) -> str:
    """The folder of one batch, with names escaped as Spark's partition folders are."""
    return f"{path}/pipeline={quote(pipeline, safe='')}/run={quote(run, safe='')}/batch_id={batch_id}"


def store_failures(failed: DataFrame, path: str, pipeline: str, run: str, batch_id: int = 0) -> None:
    """Keep failed messages (topic, data, error), replacing an earlier try of the batch."""
    failed.select(
        F.monotonically_increasing_id().alias("letter_no"), "topic", "data", "error",
        F.current_timestamp().alias("failed_at"),
    ).write.mode("overwrite").parquet(batch_folder(path, pipeline, run, batch_id))


def discard(failed: DataFrame, path: str = "", pipeline: str = "", run: str = "",
            batch_id: int = 0) -> None:
    """The store that keeps nothing. The rows are still counted as failed by the pipeline."""


def load_letters(spark: SparkSession, path: str) -> DataFrame:
    """All letters that were ever stored."""
    return _read(spark, path, DEAD_LETTER)


def pending_letters(spark: SparkSession, path: str, replayed: str) -> DataFrame:
    """Letters that no replay has delivered yet."""
    done = _read(spark, replayed, LETTER_KEY)
    return load_letters(spark, path).join(done, KEY, "left_anti")


def replay(spark: SparkSession, path: str, replayed: str,
           send: Callable[[DataFrame], DataFrame]) -> int:
    """Deliver the pending letters again; returns how many were delivered.

    `send` takes the letters and returns them with `error` set anew, null for delivered ones.
    Its result is written once, so it is evaluated once.
    """
    outcome = send(pending_letters(spark, path, replayed).drop("error", "failed_at"))
    folder = f"{replayed}/attempt={uuid.uuid4().hex}"
    outcome.where(F.col("error").isNull()).select(*KEY).write.parquet(folder)
    return spark.read.schema(LETTER_KEY).parquet(folder).count()


def attempts_log(spark: SparkSession, path: str) -> StateLog:
    """The tries of each letter: how many, since when it may be tried again, and whether that is needed."""
    return StateLog(spark, path, ATTEMPT, KEY)


def due_letters(spark: SparkSession, path: str, tried: DataFrame, now: datetime) -> DataFrame:
    """Letters, with `tries`, that were never tried or whose pause is over; not those delivered or in quarantine."""
    letters = load_letters(spark, path).join(tried.select(*KEY, "tries", "next_at", "state"), KEY, "left")
    waits = F.col("state").isNull() | ((F.col("state") == "waiting") & (F.col("next_at") <= F.lit(now)))
    return letters.where(waits).withColumn("tries", F.coalesce("tries", F.lit(0))).drop("next_at", "state")


def replay_due(spark: SparkSession, path: str, attempts: str, send: Callable[[DataFrame], DataFrame],
               now: datetime | None = None, max_tries: int = 5, pause_seconds: int = 60) -> dict[str, int]:
    """Try the letters that are due; returns how many were delivered, wait again, or are in quarantine now.

    `send` takes letters with `tries` and returns them with `error` set anew, null for delivered ones. A letter that fails
    waits `pause_seconds`, twice as long after each further try; after `max_tries` it is in quarantine and is not tried
    again. The outcome of a run is one change of the log at `attempts`: a run that crashes before tries its letters again,
    and of two runs at a time the second one is refused.
    """
    now = now or datetime.now(timezone.utc)
    log = attempts_log(spark, attempts)
    with scratch_tables(spark):
        number, tried = log.load()
        outcome = stored(send(due_letters(spark, path, tried, now).drop("error", "failed_at")).select(*KEY, "tries", "error"))
        tries = F.col("tries") + 1
        state = F.when(F.col("error").isNull(), "delivered").when(tries >= max_tries, "quarantined").otherwise("waiting")
        pause = F.make_dt_interval(secs=(F.lit(pause_seconds) * F.pow(F.lit(2), F.col("tries"))).cast("decimal(18,6)"))
        changes = stored(outcome.select(*KEY, tries.cast("int").alias("tries"), (F.lit(now) + pause).alias("next_at"),
                                        state.alias("state"), "error"))
        counts = {row["state"]: row["n"] for row in changes.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        if counts:
            log.save(changes, number)
    return {state: counts.get(state, 0) for state in ("delivered", "waiting", "quarantined")}


def quarantined_letters(spark: SparkSession, path: str, attempts: str) -> DataFrame:
    """Letters that failed too often, with their `tries` and last `error`, for someone to look at."""
    out = attempts_log(spark, attempts).load()[1].where("state = 'quarantined'").select(*KEY, "tries", "error")
    return load_letters(spark, path).drop("error").join(out, KEY)


def release(spark: SparkSession, attempts: str, letters: DataFrame) -> None:
    """Let letters be tried from the beginning, such as those in quarantine once their cause is mended."""
    log = attempts_log(spark, attempts)
    number = log.load()[0]
    gone = letters.select(*KEY, *(F.lit(None).cast(f.dataType).alias(f.name) for f in ATTEMPT if f.name not in KEY))
    log.save(gone.withColumn("removed", F.lit(True)), number)


def _read(spark, path, schema):
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
