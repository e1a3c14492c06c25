"""One query per operator over the test tables, each with the same result in DuckDB SQL.

`QUERIES[name](spark, sf_dir)` runs the operator; `SQL[name]` says what it must return. The
tables stand in for logs: events are messages, documents are the contents of text files, orders
are entries of a file listing and of a ledger. All queries run over whole tables.
"""

import json
import os
import uuid
from datetime import datetime, timedelta, timezone
from functools import reduce

import pyarrow.dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.functions.joins import computed_once, lookup_join, stored
from sluice.functions.ranking import row_numbers
from sluice.functions.text import decode_utf8
from sluice.functions.times import epoch_micros
from sluice.operators import convert, counters, deadletter
from sluice.operators.batching import assign_batches
from sluice.operators.lines import line_offsets, resume_lines, split_lines, tag_category
from sluice.operators.snapshots import snapshot_diff
from sluice.plans.flow import Pipeline
from sluice.plans.sources import FileSource, KafkaSource
from sluice.session import scratch_dir
from sluice.sinks.delivery import EndpointSink, FileSink, deliver
from sluice.sinks.endpoint import EndpointOptions, deliver_to_endpoint
from sluice.sinks.files import read_messages, stream_files, write_files
from sluice.sinks.kafka import to_kafka
from sluice.sources import cleanup, files, ledger, ranges
from sluice.sources.kafka import from_kafka
from sluice.streaming.files import stream_lines

QUERIES, SQL = {}, {}


def check(sql: str):
    """Register the query under its function's name."""
    def register(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; it may be one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    try:
        return reader.parquet(files.folder_uri(spark, path))
    except ValueError:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def event_messages(spark, sf_dir, *extra):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"), F.col("props").alias("data"), *extra)


def windows_text(spark, sf_dir):
    """Documents with CR LF in place of sentence ends, so that there are blank lines."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.replace(
        F.col("text"), F.lit(". "), F.lit("\r\n")).alias("text"))


def order_path():
    return F.concat(F.lit("file:/logs/"), F.col("o_orderkey").cast("string"), F.lit(".log"))


def order_listing(spark, sf_dir):
    """Files: all orders that are not pending. The price stands for the length."""
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        order_path().alias("path"), F.col("o_orderdate").alias("modified"),
        F.floor("o_totalprice").alias("length"))


def order_ledger(spark, sf_dir):
    """Ledger: all orders that are not of low priority. Urgent ones are read completely."""
    return table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(
        order_path().alias("path"), F.floor(F.col("o_totalprice") / 2).alias("offset"),
        (F.col("o_orderpriority") == "1-URGENT").alias("completed"))


LISTING_SQL = """listing AS (
  SELECT 'file:/logs/' || o_orderkey || '.log' AS path, o_orderdate AS modified,
         CAST(floor(o_totalprice) AS BIGINT) AS length
  FROM orders WHERE o_orderstatus <> 'P')"""
LEDGER_SQL = """ledger AS (
  SELECT 'file:/logs/' || o_orderkey || '.log' AS path,
         CAST(floor(o_totalprice / 2) AS BIGINT) AS "offset",
         o_orderpriority = '1-URGENT' AS completed
  FROM orders WHERE o_orderpriority <> '5-LOW')"""
CRLF_PARTS_SQL = r"""parts AS (
  SELECT doc_id, source, octet_length(encode(body)) AS size,
         string_split_regex(body, '[\r\n]') AS p
  FROM (SELECT doc_id, source, replace(text, '. ', chr(13) || chr(10)) AS body FROM documents)),
cut AS (
  SELECT doc_id, source, size, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p
  FROM parts),
lines AS (
  SELECT doc_id, source, size, CAST(i - 1 AS INTEGER) AS pos, line
  FROM (SELECT doc_id, source, size, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM cut))"""
MESSAGES_SQL = "msgs AS (SELECT event_id, event_type AS topic, props AS data, value, ts FROM events)"


# Sources

@check(f"WITH {CRLF_PARTS_SQL} SELECT doc_id, pos, line FROM lines")
def split_text_lines(spark, sf_dir):
    return split_lines(windows_text(spark, sf_dir), "text", ["doc_id"])


@check(f"""WITH {CRLF_PARTS_SQL}
SELECT doc_id, pos, line, CAST(least(size, sum(strlen(line) + 1) OVER (
  PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS end_offset FROM lines""")
def split_lines_with_offsets(spark, sf_dir):
    return split_lines(windows_text(spark, sf_dir), "text", ["doc_id"], offsets=True)


@check(f"""WITH {CRLF_PARTS_SQL}
SELECT doc_id, pos, CAST(least(size, sum(strlen(line) + 1) OVER (
  PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS end_offset FROM lines""")
def line_end_offsets(spark, sf_dir):
    text = windows_text(spark, sf_dir).withColumn("size", F.octet_length("text").cast("bigint"))
    lines = split_lines(text, "text", ["doc_id", "size"])
    return line_offsets(lines, "size", ["doc_id"]).select("doc_id", "pos", "end_offset")


@check(f"""WITH {CRLF_PARTS_SQL},
ends AS (SELECT doc_id, pos, line, size, least(size, sum(strlen(line) + 1) OVER (
  PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS end_offset FROM lines)
SELECT e.doc_id, e.pos, e.line FROM ends e JOIN documents d ON d.doc_id = e.doc_id
WHERE e.end_offset > CASE WHEN d.lang <> 'en' THEN e.size // 2 ELSE 0 END""")
def resume_from_ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = windows_text(spark, sf_dir)
    saved = text.join(docs.where("lang <> 'en'").select("doc_id"), "doc_id").select(
        F.col("doc_id").alias("path"), F.floor(F.octet_length("text") / 2).alias("offset"))
    lines = split_lines(text, "text", ["doc_id"], offsets=True)
    return resume_lines(lines, saved, "doc_id").select("doc_id", "pos", "line")


@check(r"""SELECT doc_id, topic, data FROM (
  SELECT doc_id, 'app' AS topic, unnest(string_split_regex(text, '[\r\n]')) AS data FROM documents)""")
def tag_with_category(spark, sf_dir):
    lines = split_lines(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return tag_category(lines, "app").select("doc_id", "topic", "data")


@check("SELECT doc_id, chr(65533) || text || chr(65533) || 'a' || chr(65533) AS text FROM documents")
def decode_malformed_utf8(spark, sf_dir):
    """Each text between a stray byte, a cut sequence and an encoded surrogate."""
    raw = F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary"), F.unhex(F.lit("E4B861EDA080")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", decode_utf8(raw.cast("string")).alias("text"))


@check(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS file_name FROM pages
WHERE regexp_full_match(regexp_extract(url, '[^/]*$'), '\d+')""")
def match_file_names(spark, sf_dir):
    listing = table(spark, sf_dir, "pages").select(
        "page_id", F.substring_index("url", "/", -1).alias("file_name"))
    return files.match_files(listing, r"\d+")


@check("""SELECT event_id, ts AS modified,
  ts < TIMESTAMP '2024-01-16 00:00:00' - INTERVAL 86400 SECOND AS expired FROM events""")
def split_expired_files(spark, sf_dir):
    listing = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("modified"))
    now = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    live, expired = files.split_expired(listing, now)
    return live.withColumn("expired", F.lit(False)).unionByName(
        expired.withColumn("expired", F.lit(True)))


@check("""SELECT event_id, ts AS modified FROM events
WHERE floor((epoch_us(TIMESTAMP '2024-01-16 00:00:00') - epoch_us(ts)) / 86400000000) > 6""")
def files_older_than_days(spark, sf_dir):
    listing = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("modified"))
    return cleanup.expire_older_than_days(
        listing, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))


@check(f"""WITH {LISTING_SQL}, {LEDGER_SQL}
SELECT path, modified, length FROM listing l
WHERE NOT EXISTS (SELECT 1 FROM ledger g WHERE g.path = l.path)""")
def unread_files(spark, sf_dir):
    return files.unread_files(order_listing(spark, sf_dir), order_ledger(spark, sf_dir))


@check(f"""WITH {LISTING_SQL}, {LEDGER_SQL}
SELECT path, "offset", completed, modified, length FROM ledger JOIN listing USING (path)
WHERE NOT completed""")
def unfinished_files(spark, sf_dir):
    return files.unfinished_files(order_ledger(spark, sf_dir), order_listing(spark, sf_dir))


@check("""SELECT 'f' || event_id AS path, ts AS modified,
  row_number() OVER (ORDER BY ts DESC, 'f' || event_id) AS place FROM events""")
def order_files_newest_first(spark, sf_dir):
    """The order as a number, since a result set has no order."""
    listing = table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), "event_id").alias("path"), F.col("ts").alias("modified"))
    placed = files.order_files(listing, "desc").withColumn("_at", F.monotonically_increasing_id())
    return row_numbers(placed, [], [F.col("_at")], "place").drop("_at")


@check(f"""WITH {LISTING_SQL}, {LEDGER_SQL}, progress AS (
  SELECT 'file:/logs/' || o_orderkey || '.log' AS path,
         CAST(floor(o_totalprice * 0.75) AS BIGINT) AS "offset",
         o_orderpriority = '2-HIGH' AS completed
  FROM orders WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW'))
SELECT coalesce(g.path, p.path, l.path) AS path,
  greatest(coalesce(g."offset", 0), coalesce(p."offset", 0)) AS "offset",
  coalesce(g.completed, FALSE) OR coalesce(p.completed, FALSE) AS completed
FROM ledger g FULL OUTER JOIN progress p ON g.path = p.path
RIGHT JOIN listing l ON l.path = coalesce(g.path, p.path)""")
def advance_file_ledger(spark, sf_dir):
    progress = table(spark, sf_dir, "orders").where(
        F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM", "5-LOW")).select(
        order_path().alias("path"), F.floor(F.col("o_totalprice") * 0.75).alias("offset"),
        (F.col("o_orderpriority") == "2-HIGH").alias("completed"))
    return ledger.advance_ledger(
        order_ledger(spark, sf_dir), progress, order_listing(spark, sf_dir))


@check(f"""WITH {LEDGER_SQL} SELECT path, "offset", completed FROM ledger""")
def saved_ledger(spark, sf_dir):
    """Saved unread and then as it is: the later snapshot counts."""
    path = scratch_dir(spark, "ledger")
    now = order_ledger(spark, sf_dir)
    ledger.save_ledger(now.withColumn("offset", F.lit(0).cast("bigint")), path)
    ledger.save_ledger(now, path)
    return ledger.load_ledger(spark, path)


@check(f"""WITH {LEDGER_SQL} SELECT path, "offset", completed FROM ledger""")
def ledger_of_changes(spark, sf_dir):
    """Saved unread, then part by part as changes, so that a new base is written on the way; odd rows go and return."""
    log = ledger.ledger_log(spark, scratch_dir(spark, "ledger"))
    now = order_ledger(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("path"), F.lit(10)))
    number = log.replace(now.withColumn("offset", F.lit(0).cast("bigint")), log.number())
    number = log.save(now.where("part < 5").withColumn("removed", F.lit(True)), number)
    for part in range(10):
        number = log.save(now.where(F.col("part") == part), number)
    return log.load()[1]


@check(f"""WITH {LISTING_SQL}, shares AS (
  SELECT path, modified, greatest(length::HUGEINT * 40, 5000000) AS share FROM listing)
SELECT path, CAST((sum(share) OVER (ORDER BY modified DESC, path) - share) // 200000000 AS BIGINT) AS "group"
FROM shares""")
def plan_backlog_groups(spark, sf_dir):
    """Files in groups of 40 files or 5 MB, newest first."""
    return files.plan_groups(order_listing(spark, sf_dir), "desc", 40, 5_000_000).select("path", "group")


@check("""SELECT '/logs/order ' || o_orderkey || '.log' AS path, o_custkey AS "offset",
  o_orderstatus = 'F' AS completed FROM orders WHERE o_orderstatus <> 'P'""")
def parse_text_ledger(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "True").otherwise("false")
    path = F.concat(F.lit("/logs/order "), F.col("o_orderkey").cast("string"), F.lit(".log"))
    lines = table(spark, sf_dir, "orders").select(F.when(
        F.col("o_orderstatus") == "P", F.concat(path, F.lit(" pending"))).otherwise(
        F.concat_ws(" ", path, F.col("o_custkey").cast("string"), state)).alias("line"))
    return ledger.parse_ledger_lines(lines)


@check("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'absent' WHEN doc_id % 4 = 1 THEN 'kept' ELSE 'deleted' END AS state
FROM documents""")
def delete_in_tasks(spark, sf_dir):
    """One file a document; some are gone before, some are folders, the others are deleted. A second try finds them done."""
    folder = scratch_dir(spark, "doomed").removeprefix("file://")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.lit(f"file:{folder}/"), "doc_id", F.lit(".log")).alias("path"))

    def prepare(batches):
        for batch in batches:
            os.makedirs(folder, exist_ok=True)
            for number, path in zip(batch["doc_id"].to_pylist(), batch["path"].to_pylist()):
                if number % 4 == 1:
                    os.makedirs(path.removeprefix("file:"), exist_ok=True)
                elif number % 4:
                    open(path.removeprefix("file:"), "w").close()
            yield batch

    made = cleanup.dealt(docs).mapInArrow(prepare, "doc_id long, path string")
    outcomes = cleanup.delete_in_tasks(stored(made), folder, f"{folder}-outcomes")
    cleanup.delete_in_tasks(docs, folder, f"{folder}-outcomes")
    return docs.join(outcomes, "path").select("doc_id", F.when(
        F.col("state") == "not a file", "kept").otherwise(F.col("state")).alias("state"))


@check(f"""WITH {LISTING_SQL}, {LEDGER_SQL}
SELECT count(*) AS files, CAST(sum(length - coalesce("offset", 0)) AS BIGINT) AS bytes
FROM listing LEFT JOIN ledger USING (path) WHERE NOT coalesce(completed, FALSE)""")
def backlog(spark, sf_dir):
    return ledger.backlog(order_listing(spark, sf_dir), order_ledger(spark, sf_dir))


FILE_LINES_SQL = r"""SELECT 'app' AS topic, unnest(p[1:len(p) - 1]) AS data FROM (
  SELECT string_split_regex(replace(text, '. ', chr(13) || chr(10)) || chr(10), '[\r\n]') AS p
  FROM documents)"""


def written_as_text(spark, sf_dir):
    """A folder of text files that hold the documents."""
    folder = scratch_dir(spark, "text")
    windows_text(spark, sf_dir).select("text").write.text(folder)
    return folder


@check(FILE_LINES_SQL)
def read_file_lines(spark, sf_dir):
    """The documents as text files, listed, matched and read back line by line."""
    listing = files.list_files(spark, written_as_text(spark, sf_dir))
    matching = files.match_files(listing, r"part-.*\.txt")
    return files.read_lines(spark, matching, "app").select("topic", "data")


ODD_LINES_SQL = FILE_LINES_SQL.replace(
    "string_split_regex(replace(",
    "string_split_regex(CASE WHEN doc_id % 3 > 0 THEN chr(65279) ELSE '' END || replace(")


def written_with_odd_ends(spark, sf_dir):
    """Files that end with a bare carriage return, start with a byte order mark, or both."""
    folder, docs = scratch_dir(spark, "text"), windows_text(spark, sf_dir)
    for part, (mark, end) in enumerate([("", "\r"), (files.MARK, "\n"), (files.MARK, "\r")]):
        docs.where(F.col("doc_id") % 3 == part).select(F.concat(F.lit(mark), "text").alias("value")).write.mode(
            "append").option("lineSep", end).text(folder)
    return folder


@check(ODD_LINES_SQL)
def read_files_with_odd_ends(spark, sf_dir):
    """Odd files, read exactly."""
    listing = files.match_files(files.list_files(spark, written_with_odd_ends(spark, sf_dir)), r"part-.*\.txt")
    return files.read_lines(spark, listing, "app").select("topic", "data")


@check(ODD_LINES_SQL)
def stream_files_with_odd_ends(spark, sf_dir):
    """The same as a stream, which opens and cuts files in its tasks."""
    out = scratch_dir(spark, "stream")
    lines = stream_lines(spark, written_with_odd_ends(spark, sf_dir), "app", include_pattern=r"^.*\.txt$", max_files=5)
    stream_files(lines, f"{out}/messages", f"{out}/checkpoint", availableNow=True).awaitTermination()
    return read_messages(spark, f"{out}/messages").select("topic", "data")


@check(FILE_LINES_SQL)
def read_byte_ranges(spark, sf_dir):
    """The documents as text files, in ranges of 10,000 bytes that tasks open by themselves."""
    listing = files.match_files(files.list_files(spark, written_as_text(spark, sf_dir)), r"part-.*\.txt")
    found = ranges.ranges_of(listing.withColumn("offset", F.lit(0)), 10_000)
    return tag_category(ranges.read_ranges(found), "app").select("topic", "data")


@check(FILE_LINES_SQL)
def scan_directory_lines(spark, sf_dir):
    folder = written_as_text(spark, sf_dir)
    records = files.scan_directory(spark, folder, r"part-.*\.txt")
    return tag_category(files.lines_of(records, exact=False), "app").select("topic", "data")


@check(FILE_LINES_SQL)
def stream_file_lines(spark, sf_dir):
    """The same files as a stream, written by the exactly-once file sink."""
    lines = stream_lines(spark, written_as_text(spark, sf_dir), "app",
                         include_pattern=r"^.*\.txt$", retention_seconds=None, max_files=4)
    out = scratch_dir(spark, "stream")
    stream_files(lines, f"{out}/messages", f"{out}/checkpoint", availableNow=True).awaitTermination()
    return read_messages(spark, f"{out}/messages")


@check(FILE_LINES_SQL)
def stream_with_future_file(spark, sf_dir):
    """Files of two rounds, one of the first dated 30 days ahead: it hides none of the second."""
    folder, out = scratch_dir(spark, "text"), scratch_dir(spark, "stream")
    for part in (0, 1):
        windows_text(spark, sf_dir).where(F.col("doc_id") % 2 == part).select("text").write.mode(
            "append").text(folder)
        if part == 0:
            path = spark._jvm.org.apache.hadoop.fs.Path(files.list_files(spark, folder).select("path").first()[0])
            ahead = spark.sql("SELECT unix_millis(current_timestamp() + INTERVAL 30 DAYS)").first()[0]
            path.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(path, ahead, -1)
        lines = stream_lines(spark, folder, "app", include_pattern=r"^.*\.txt$")
        stream_files(lines, f"{out}/messages", f"{out}/checkpoint", availableNow=True).awaitTermination()
    return read_messages(spark, f"{out}/messages")


class CrashingSource(FileSource):
    """Fails between the delivery of a batch and its ledger."""

    def finish(self, spark):
        raise InterruptedError("after delivery")


@check(FILE_LINES_SQL)
def rerun_after_crash(spark, sf_dir):
    """A batch in groups of files, whose first one crashes after delivery and is run again: each line once."""
    folder, state = written_as_text(spark, sf_dir), scratch_dir(spark, "flow")
    for source in (CrashingSource, FileSource):
        flow = Pipeline("docs", source(folder, "app", r"^.*\.txt$", ledger_path=f"{state}/ledger", max_files=3),
                        FileSink(f"{state}/out"), state)
        try:
            flow.run_batch(spark)
        except InterruptedError:
            pass
    return read_messages(spark, f"{state}/out").select("topic", "data")


@check(FILE_LINES_SQL)
def resume_file_lines(spark, sf_dir):
    """Files read up to a line near their middle, then from the ledger's offset to their end."""
    listing = files.match_files(
        files.list_files(spark, written_as_text(spark, sf_dir)), r"part-.*\.txt")
    lines = stored(files.read_lines(spark, listing, "app", offsets=True).withColumnRenamed("file_path", "path"))
    reached = computed_once(
        lines.join(listing, "path").where("end_offset <= length / 2").groupBy("path").agg(
            F.max("end_offset").alias("offset")).withColumn("completed", F.lit(False)))
    before = lookup_join(lines, reached, "path", "inner").where("end_offset <= offset")
    after = files.read_pending(spark, listing, reached, "app")
    return before.select("topic", "data").unionByName(after.select("topic", "data"))


KAFKA_SQL = "SELECT event_type AS topic, props AS {data} FROM events"


@check(KAFKA_SQL.format(data="data"))
def from_kafka_records(spark, sf_dir):
    records = table(spark, sf_dir, "events").select(
        F.lit(None).cast("binary").alias("key"), F.col("props").cast("binary").alias("value"),
        F.col("event_type").alias("topic"), F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"))
    return from_kafka(records)


class TopicFolder(DataSource):
    """Topics kept as Parquet files, read like the Kafka connector reads: by the offsets given for each partition."""

    @classmethod
    def name(cls):
        return "topic_folder"

    def schema(self):
        return "topic string, partition int, offset bigint, value binary"

    def reader(self, schema):
        return TopicReader(self.options)


class TopicReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["kafka.folder"].removeprefix("file://")
        self.start, self.end = (json.loads(options[name]) for name in ("startingOffsets", "endingOffsets"))

    def partitions(self):
        return [InputPartition((topic, int(number), self.start[topic][number], end))
                for topic, ends in self.end.items() for number, end in ends.items()]

    def read(self, partition):
        topic, number, start, end = partition.value
        own = pyarrow.dataset.dataset(f"{self.folder}/topic={topic}/partition={number}", format="parquet")
        rows = own.to_table(filter=(pyarrow.dataset.field("offset") >= start) & (pyarrow.dataset.field("offset") < end))
        for offset, value in zip(rows["offset"].to_pylist(), rows["value"].to_pylist()):
            yield topic, number, offset, value


class CrashingKafkaSource(KafkaSource):
    """Fails between the delivery of a batch and its positions."""

    def finish(self, spark):
        raise InterruptedError("after delivery")


@check("SELECT event_type AS topic, props AS data FROM events")
def kafka_batches_resume(spark, sf_dir):
    """Records arrive between batches, one of which crashes after delivery and is run again: each record once.

    A folder stands in for the brokers: a third of its records is there at first, then two thirds, then all.
    """
    state = scratch_dir(spark, "kafka")
    numbered = row_numbers(table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), "event_id",
        F.col("props").cast("binary").alias("value")), ["topic", "partition"], [F.col("event_id")], "offset")
    numbered.withColumn("offset", F.col("offset") - 1).drop("event_id").write.partitionBy("topic", "partition").parquet(
        f"{state}/topics")
    spark.dataSource.register(TopicFolder)
    topics = spark.read.parquet(f"{state}/topics")
    names = [r["topic"] for r in topics.select("topic").distinct().collect()]
    conf = {"source.kafka.topic.and.threads": ",".join(f"{name}:1" for name in names),
            "source.kafka.folder": f"{state}/topics"}
    for thirds, source in ((1, KafkaSource), (2, CrashingKafkaSource), (2, KafkaSource), (3, KafkaSource), (3, KafkaSource)):
        def ends(spark, conf, thirds=thirds):
            there = topics.groupBy("topic", "partition").agg(F.max("offset").alias("last")).collect()
            return {(r["topic"], r["partition"]): (r["last"] + 1) * thirds // 3 for r in there}

        read = source(conf, positions=f"{state}/positions", ends=ends, fmt="topic_folder")
        try:
            Pipeline("kafka", read, FileSink(f"{state}/out"), state).run_batch(spark)
        except InterruptedError:
            pass
    return read_messages(spark, f"{state}/out").select("topic", "data")


@check(KAFKA_SQL.format(data="value"))
def to_kafka_records(spark, sf_dir):
    return to_kafka(event_messages(spark, sf_dir))


# Converters

RENAMES = "click:view,view:seen,error:failure,missing:never"
RENAME_CASE = """CASE {c} WHEN 'click' THEN 'view' WHEN 'view' THEN 'seen'
  WHEN 'error' THEN 'failure' ELSE {c} END"""


@check("SELECT event_type AS topic, props AS data FROM events")
def identity_converter(spark, sf_dir):
    return convert.identity(event_messages(spark, sf_dir))


@check(f"SELECT {RENAME_CASE.format(c='event_type')} AS topic, props AS data FROM events")
def rename_topics(spark, sf_dir):
    return convert.rename_topics(event_messages(spark, sf_dir), RENAMES)


@check("""WITH renames AS (
  SELECT source, 'lang-' || max(lang) AS to_topic FROM documents WHERE lang <> 'en' GROUP BY source)
SELECT doc_id, coalesce(r.to_topic, d.source) AS topic, text AS data
FROM documents d LEFT JOIN renames r ON r.source = d.source""")
def rename_topics_by_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.where("lang <> 'en'").select(
        F.col("source").alias("from_topic"), F.concat(F.lit("lang-"), "lang").alias("to_topic"))
    msgs = docs.select("doc_id", F.col("source").alias("topic"), F.col("text").alias("data"))
    return convert.rename_topics(msgs, names)


@check("SELECT event_type AS topic, props AS data, value FROM events WHERE value >= 10")
def filter_messages(spark, sf_dir):
    return convert.filter_messages(event_messages(spark, sf_dir, "value"), "value >= 10")


@check("SELECT upper(event_type) AS topic, props AS data FROM events WHERE event_type <> 'view'")
def user_converter(spark, sf_dir):
    return convert.apply_converter(event_messages(spark, sf_dir), lambda msgs: msgs.where(
        "topic <> 'view'").withColumn("topic", F.upper("topic")))


@check("SELECT event_type AS topic, upper(props) AS data FROM events WHERE event_type <> 'view'")
def pandas_converter(spark, sf_dir):
    def shout(frame):
        kept = frame[frame["topic"] != "view"]
        return kept.assign(data=kept["data"].str.upper())
    return convert.convert_batches(event_messages(spark, sf_dir), shout)


@check(f"WITH {CRLF_PARTS_SQL} SELECT source AS topic, line AS data FROM lines WHERE line <> ''")
def drop_empty_lines(spark, sf_dir):
    lines = split_lines(windows_text(spark, sf_dir), "text", ["source"])
    msgs = tag_category(lines.drop("pos"), F.col("source")).drop("source")
    return convert.drop_empty(msgs)


@check("SELECT event_type AS category, 'host-1|' || props AS message FROM events")
def host_prefix(spark, sf_dir):
    return convert.add_host_prefix(event_messages(spark, sf_dir), "host-1")


# Sinks and dead letters

@check("""SELECT event_id, user_id, CAST((row_number() OVER (
  PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS BIGINT) AS batch_no, event_type
FROM events""")
def assign_batch_numbers(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return assign_batches(entries, ["event_type"], ["ts", "event_id"]).drop("ts")


@check("""SELECT event_id, user_id % 6 AS lane, CAST((row_number() OVER (
  PARTITION BY user_id % 6 ORDER BY ts, event_id) - 1) // 100 AS BIGINT) AS batch_no FROM events""")
def assign_batch_numbers_by_range(spark, sf_dir):
    """The way taken for lanes that one task cannot sort."""
    entries = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 6).alias("lane"), "ts")
    return assign_batches(entries, ["lane"], ["ts", "event_id"], one_task_rows=0).drop("ts")


@check("SELECT event_type AS topic, props AS data FROM events")
def write_and_read_files(spark, sf_dir):
    folder = scratch_dir(spark, "files")
    write_files(event_messages(spark, sf_dir), folder)
    return read_messages(spark, folder)


@check("""SELECT event_type AS category, 'host-1|' || props AS message,
  event_type = 'error' AS failed FROM events""")
def deliver_to_hosts(spark, sf_dir):
    """Entries sent one by one to a client that refuses errors; what it refuses is failed."""
    class Client:
        def __init__(self, host):
            if host == "down":
                raise ConnectionError(host)

        def send(self, batch):
            return all(category != "error" for category, _ in batch)

        def close(self):
            pass

    entries = convert.add_host_prefix(event_messages(spark, sf_dir), "host-1")
    options = EndpointOptions(("a", "b", "down"), batch_size=1, all_down_wait_ms=1)
    return deliver_to_endpoint(entries, Client, options).select(
        "category", "message", F.col("error").isNotNull().alias("failed"))


@check("""SELECT event_type AS category, 'host-1|' || props AS message, true AS failed FROM events""")
def all_hosts_down(spark, sf_dir):
    """No host accepts a connection: each sender waits within its budget, and every entry is failed."""
    def refuse(host):
        raise ConnectionError(host)

    entries = convert.add_host_prefix(event_messages(spark, sf_dir), "host-1")
    options = EndpointOptions(("a", "b"), all_down_wait_ms=50)
    return deliver_to_endpoint(entries, refuse, options).select(
        "category", "message", F.col("error").contains("no host accepts").alias("failed"))


def refuse_low_values(msgs):
    return msgs.withColumn("error", F.when(F.col("value") < 10, "low value"))


@check("""SELECT event_id, event_type AS topic, value >= 10 AS delivered FROM events""")
def delivered_and_failed(spark, sf_dir):
    msgs = event_messages(spark, sf_dir, "event_id", "value")
    ok, failed = deliver(msgs, refuse_low_values, scratch_dir(spark, "outcome"))
    return ok.select("event_id", "topic", F.lit(True).alias("delivered")).unionByName(
        failed.select("event_id", "topic", F.lit(False).alias("delivered")))


@check("""SELECT event_type AS topic, event_id || '|' || props AS data, 'low value' AS error
FROM events WHERE value < 10 AND event_type = 'error'""")
def dead_letter_replay(spark, sf_dir):
    """Low values fail and are kept; a replay delivers all of them but the errors."""
    msgs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        F.concat_ws("|", F.col("event_id").cast("string"), "props").alias("data"), "value")
    letters, replayed = scratch_dir(spark, "letters"), scratch_dir(spark, "replayed")
    failed = refuse_low_values(msgs).where(F.col("error").isNotNull())
    deadletter.store_failures(failed, letters, "events", "run")
    deadletter.replay(spark, letters, replayed, lambda again: again.withColumn(
        "error", F.when(F.col("topic") == "error", "still failing")))
    return deadletter.pending_letters(spark, letters, replayed).select("topic", "data", "error")


@check("""SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS tries,
  CASE event_type WHEN 'error' THEN 'quarantined' ELSE 'delivered' END AS state FROM events WHERE value < 10""")
def replay_with_attempts(spark, sf_dir):
    """Views are delivered at the first try, errors never, others at the second; pauses are kept between."""
    msgs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"), F.col("event_id").cast("string").alias("data"), "value")
    letters, attempts = scratch_dir(spark, "letters"), scratch_dir(spark, "attempts")
    deadletter.store_failures(refuse_low_values(msgs).where(F.col("error").isNotNull()), letters, "events", "run")

    def send(again):
        return again.withColumn("error", F.when((F.col("topic") == "error") | (
            (F.col("topic") != "view") & (F.col("tries") == 0)), "busy"))

    start = datetime(2024, 5, 1, tzinfo=timezone.utc)
    for minutes in (0, 0.5, 2, 2.5, 10, 60):  # the second and the fourth come too soon
        deadletter.replay_due(spark, letters, attempts, send, start + timedelta(minutes=minutes), max_tries=3)
    tried = deadletter.attempts_log(spark, attempts).load()[1]
    return deadletter.load_letters(spark, letters).join(tried.drop("error"), deadletter.KEY).select(
        F.col("data").cast("bigint").alias("event_id"), "tries", "state")


# Counts

@check("SELECT 'events' AS name, event_type AS topic, count(*) AS delta FROM events GROUP BY ALL")
def count_messages(spark, sf_dir):
    return counters.count_messages(event_messages(spark, sf_dir), "events")


@check(r"""SELECT 'chat' AS name, role AS topic, count(*) AS delta FROM (
  SELECT role, unnest(string_split_regex(text, '[\r\n]')) AS line FROM conversations) GROUP BY ALL""")
def count_conversation_lines(spark, sf_dir):
    lines = split_lines(table(spark, sf_dir, "conversations"), "text", ["role"])
    return counters.count_messages(tag_category(lines, F.col("role")), "chat")


INTERVAL_SQL = """SELECT 'events' AS name, event_type AS topic,
  time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS delta FROM events GROUP BY ALL"""


@check(INTERVAL_SQL)
def count_by_interval(spark, sf_dir):
    return counters.count_by_interval(event_messages(spark, sf_dir, "ts"), "events", "ts")


@check(INTERVAL_SQL)
def stream_count_by_interval(spark, sf_dir):
    """Each micro-batch writes the counts it adds, to a folder that a retry replaces."""
    out = scratch_dir(spark, "counts")

    def write(batch, batch_id):
        msgs = batch.select(F.col("event_type").alias("topic"), "ts")
        counters.write_counters(counters.count_by_interval(msgs, "events", "ts"),
                                f"{out}/counts/batch_id={batch_id}", mode="overwrite")

    stream(spark, sf_dir, "events").writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(
    ).awaitTermination()
    return spark.read.parquet(f"{out}/counts").groupBy("name", "topic", "window_start").agg(
        F.sum("delta").alias("delta"))


@check(f"""SELECT {RENAME_CASE.format(c='event_type')} AS topic, props AS data FROM events""")
def stream_rename_topics(spark, sf_dir):
    events = stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"), F.col("props").alias("data"))
    out = scratch_dir(spark, "renamed")
    stream_files(convert.rename_topics(events, RENAMES), f"{out}/messages", f"{out}/checkpoint",
                 availableNow=True).awaitTermination()
    return read_messages(spark, f"{out}/messages")


RECONCILE_SQL = f"""WITH read AS (
  SELECT {RENAME_CASE.format(c='event_type')} AS topic, count(*) AS n FROM events GROUP BY 1),
written AS (
  SELECT {RENAME_CASE.format(c='event_type')} AS topic, count(*) AS n FROM events
  WHERE value >= 10 GROUP BY 1)
SELECT topic, coalesce(read.n, 0) AS read, coalesce(written.n, 0) AS written,
  coalesce(read.n, 0) - coalesce(written.n, 0) AS missing
FROM read FULL OUTER JOIN written USING (topic)"""


@check(RECONCILE_SQL)
def reconcile(spark, sf_dir):
    msgs = event_messages(spark, sf_dir, "value")
    written = convert.rename_topics(convert.filter_messages(msgs, "value >= 10"), RENAMES)
    return counters.reconcile(counters.count_messages(msgs, "source"),
                              counters.count_messages(written, "sink"), RENAMES)


@check(f"SELECT * FROM ({RECONCILE_SQL}) WHERE missing > read * 0.18")
def delivery_alerts(spark, sf_dir):
    return counters.delivery_alerts(reconcile(spark, sf_dir), 0.18)


STREAM_RECONCILE_SQL = f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
  {RENAME_CASE.format(c='event_type')} AS topic, count(*) AS read, count(*) FILTER (WHERE NOT lost) AS written,
  count(*) FILTER (WHERE lost) AS missing
FROM (SELECT *, ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-10 23:00:00' AS lost FROM events)
GROUP BY 1, 2"""


@check(STREAM_RECONCILE_SQL)
def reconcile_two_streams(spark, sf_dir):
    """Both ends as streams of three rounds: some hours are lost at the sink, the last ones of a round come in the next.

    The third round is one message of a later time, which closes all intervals before.
    """
    base = scratch_dir(spark, "ends")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), "ts")
    cut, late = "ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'", "ts < TIMESTAMP_NTZ '2024-01-14 22:00:00'"
    lost = "ts >= TIMESTAMP_NTZ '2024-01-10 05:00:00' AND ts < TIMESTAMP_NTZ '2024-01-10 23:00:00'"
    renamed = convert.rename_topics(events.withColumn("data", F.lit("")), RENAMES).drop("data").where(f"NOT ({lost})")
    end = spark.range(1).select(F.lit("end").alias("topic"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    for name, rows, first in (("read", events, cut), ("written", renamed, late)):
        for part in (rows.where(first), rows.where(f"NOT ({first})"), end):
            at = F.timestamp_micros(epoch_micros(part, "ts"))
            part.select("topic", at.alias("ts")).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
    ends = [spark.readStream.schema("topic string, ts timestamp").option("maxFilesPerTrigger", "1").parquet(f"{base}/{name}")
            for name in ("read", "written")]
    counted = counters.reconcile_streams(*ends, "ts", 86_400, "3 hours", RENAMES)
    counted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True).start(f"{base}/out").awaitTermination()
    found = spark.read.schema(counted.schema).parquet(f"{base}/out")
    since = F.make_dt_interval(secs=(F.unix_micros("window_start") / 1_000_000).cast("decimal(18,6)"))
    return found.withColumn("window_start", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since)


@check(f"SELECT * FROM ({STREAM_RECONCILE_SQL}) WHERE missing > read * 0.5")
def alerts_of_streams(spark, sf_dir):
    """The intervals and topics that stay short by more than half."""
    return counters.delivery_alerts(reconcile_two_streams(spark, sf_dir), 0.5)


@check("""WITH b AS (
  SELECT event_type AS topic, time_bucket(INTERVAL 5 SECOND, ts) AS bucket_start, count(*) AS n
  FROM events GROUP BY 1, 2)
SELECT topic, bucket_start, n,
  round(sum(n) OVER (PARTITION BY topic ORDER BY epoch(bucket_start)
    RANGE BETWEEN 55 PRECEDING AND CURRENT ROW) / 60, 6) AS rate_1m,
  round(sum(n) OVER (PARTITION BY topic ORDER BY epoch(bucket_start)
    RANGE BETWEEN 295 PRECEDING AND CURRENT ROW) / 300, 6) AS rate_5m,
  round(sum(n) OVER (PARTITION BY topic ORDER BY epoch(bucket_start)
    RANGE BETWEEN 895 PRECEDING AND CURRENT ROW) / 900, 6) AS rate_15m
FROM b""")
def throughput(spark, sf_dir):
    rates = counters.throughput(event_messages(spark, sf_dir, "ts"), "ts")
    return rates.select("topic", "bucket_start", "n", *[
        F.round(c, 6).alias(c) for c in ("rate_1m", "rate_5m", "rate_15m")])


@check("""WITH b AS (
  SELECT event_type AS topic, time_bucket(INTERVAL 20 SECOND, ts) AS bucket_start, count(*) AS n
  FROM events GROUP BY 1, 2)
SELECT topic, bucket_start, n,
  round(sum(n) OVER (PARTITION BY topic ORDER BY epoch(bucket_start)
    RANGE BETWEEN 40 PRECEDING AND CURRENT ROW) / 60, 6) AS rate_1m,
  round(sum(n) OVER (PARTITION BY topic ORDER BY epoch(bucket_start)
    RANGE BETWEEN 880 PRECEDING AND CURRENT ROW) / 900, 6) AS rate_15m
FROM b""")
def throughput_of_20_seconds(spark, sf_dir):
    rates = counters.throughput(event_messages(spark, sf_dir, "ts"), "ts", 20)
    return rates.select("topic", "bucket_start", "n", *[F.round(c, 6).alias(c) for c in ("rate_1m", "rate_15m")])


def _decayed_sql(minutes):
    return (f"r.rate_{minutes} * pow(exp(-5 / {60 * minutes}.0), (epoch(b.bucket_start) - epoch(r.bucket_start)) / 5)"
            f" + (1 - exp(-5 / {60 * minutes}.0)) * b.n / 5.0")


@check(f"""WITH RECURSIVE b AS (
  SELECT topic, bucket_start, n, row_number() OVER (PARTITION BY topic ORDER BY bucket_start) AS k FROM (
    SELECT event_type AS topic, time_bucket(INTERVAL 5 SECOND, ts) AS bucket_start, count(*) AS n FROM events GROUP BY 1, 2)),
r AS (SELECT topic, bucket_start, n, k, n / 5.0::DOUBLE AS rate_1, n / 5.0::DOUBLE AS rate_5, n / 5.0::DOUBLE AS rate_15
  FROM b WHERE k = 1
  UNION ALL SELECT b.topic, b.bucket_start, b.n, b.k, {_decayed_sql(1)}, {_decayed_sql(5)}, {_decayed_sql(15)}
  FROM r JOIN b ON b.topic = r.topic AND b.k = r.k + 1)
SELECT topic, bucket_start, n, round(rate_1, 6) AS rate_1m, round(rate_5, 6) AS rate_5m, round(rate_15, 6) AS rate_15m
FROM r""")
def decayed_rates(spark, sf_dir):
    rates = counters.decayed_rates(event_messages(spark, sf_dir, "ts"), "ts")
    return rates.select("topic", "bucket_start", "n", *[
        F.round(c, 6).alias(c) for c in ("rate_1m", "rate_5m", "rate_15m")])


@check("""SELECT event_type AS topic, count(*) AS n,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 6) AS mean_rate
FROM events GROUP BY event_type""")
def mean_rates(spark, sf_dir):
    rates = counters.mean_rates(event_messages(spark, sf_dir, "ts"), "ts")
    return rates.withColumn("mean_rate", F.round("mean_rate", 6))


# Pipelines

@check("""WITH previous AS (
  SELECT 'order-' || o_orderkey AS key, o_custkey AS version
  FROM orders WHERE o_orderpriority <> '5-LOW'),
current AS (
  SELECT 'order-' || o_orderkey AS key, CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey + 1
    WHEN '2-HIGH' THEN o_custkey - 1 ELSE o_custkey END AS version
  FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(p.key, c.key) AS key, CASE WHEN p.key IS NULL THEN 'added'
  WHEN c.key IS NULL THEN 'removed' WHEN c.version > p.version THEN 'changed'
  ELSE 'unchanged' END AS change
FROM previous p FULL OUTER JOIN current c ON p.key = c.key""")
def snapshot_changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "key", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")))
    step = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(
        F.col("o_orderpriority") == "2-HIGH", -1).otherwise(0)
    previous = orders.where("o_orderpriority <> '5-LOW'").withColumn("version", F.col("o_custkey"))
    current = orders.where("o_orderstatus <> 'P'").withColumn("version", F.col("o_custkey") + step)
    return snapshot_diff(previous, current, "key", "version")


SOURCES = "src0:app,src1:app,src2:web,app:never"
SOURCE_CASE = """CASE source WHEN 'src0' THEN 'app' WHEN 'src1' THEN 'app' WHEN 'src2' THEN 'web'
  ELSE source END"""


@check(f"""WITH {CRLF_PARTS_SQL}
SELECT {SOURCE_CASE} AS topic, count(*) AS read, count(*) FILTER (WHERE line <> '') AS written,
  count(*) FILTER (WHERE line = '') AS missing FROM lines GROUP BY 1""")
def deliver_and_reconcile(spark, sf_dir):
    """From file contents to delivered files, counted at both ends.

    Documents are cut into lines, tagged with their source, renamed, freed of blank lines,
    given the endpoint's form, and written. The written files are counted, not the plan.
    """
    lines = split_lines(windows_text(spark, sf_dir), "text", ["source"]).drop("pos")
    msgs = tag_category(lines, F.col("source")).select("topic", "data")
    entries = convert.add_host_prefix(
        convert.drop_empty(convert.rename_topics(msgs, SOURCES)), "host-1")
    folder = scratch_dir(spark, "delivered")
    write_files(entries.select(
        F.col("category").alias("topic"), F.col("message").alias("data")), folder)
    return counters.reconcile(
        counters.count_messages(msgs, "documents-FileSource"),
        counters.count_messages(read_messages(spark, folder), "documents-FileSink"), SOURCES)


FLOW_SQL = f"""WITH all_lines AS ({FILE_LINES_SQL})
SELECT 'docs-FileSource' AS name, 'app' AS topic, 'read' AS event, count(*) AS n FROM all_lines
UNION ALL
SELECT 'docs-{{sink}}', 'lines', 'written', count(*) FILTER (WHERE data <> '') FROM all_lines"""


def flow_counts(spark, flow, *more):
    """Drain the folder in micro-batches and add up what each end has counted."""
    flow.start(spark, availableNow=True).awaitTermination()
    counts = reduce(DataFrame.unionByName, [flow.counts(spark, event) for event in ("read", "written", *more)])
    return counts.groupBy("name", "topic", "event").agg(F.sum("delta").alias("n"))


@check(FLOW_SQL.format(sink="FileSink"))
def folder_to_files(spark, sf_dir):
    """The documents as a watched folder; blank lines are dropped on the way to the files."""
    state = scratch_dir(spark, "flow")
    source = FileSource(written_as_text(spark, sf_dir), "app", r"^.*\.txt$", max_files=4)
    return flow_counts(spark, Pipeline(
        "docs", source, FileSink(f"{state}/out"), state,
        lambda msgs: convert.drop_empty(convert.rename_topics(msgs, "app:lines"))))


@check(f"""{FLOW_SQL.format(sink="EndpointSink")}
UNION ALL SELECT 'docs-EndpointSink', 'lines', 'skipped', count(*) FILTER (WHERE data = '') FROM all_lines
UNION ALL SELECT 'hosts', 'lines', 'received', count(*) FILTER (WHERE data <> '') FROM all_lines
UNION ALL SELECT 'hosts', 'lines', 'characters', sum(length(data))::BIGINT FROM all_lines""")
def folder_to_hosts(spark, sf_dir):
    """The same to remote hosts, one of them down and one busy at times; the sink skips blank lines by itself.

    The clients keep what they accept, one file a connection, which are counted, too.
    """
    state = scratch_dir(spark, "flow")
    folder = f"{state}/received".removeprefix("file://")

    class Client:
        def __init__(self, host):
            if host == "down":
                raise ConnectionError(host)
            self.busy, self.sent, self.out = host == "busy", 0, None
            os.makedirs(folder, exist_ok=True)

        def send(self, batch):
            self.sent += 1
            if self.busy and self.sent % 3 == 1:
                return False
            if self.out is None:
                self.out = open(f"{folder}/{uuid.uuid4().hex}.json", "w")
            self.out.writelines(json.dumps({"topic": topic, "data": data}) + "\n" for topic, data in batch)
            self.out.flush()

        def close(self):
            if self.out is not None:
                self.out.close()

    source = FileSource(written_as_text(spark, sf_dir), "app", r"^.*\.txt$", max_files=4)
    options = EndpointOptions(("a", "busy", "down"), try_later_wait_ms=10)
    sink = EndpointSink(Client, options, f"{state}/outcomes", host="host-1")
    flow = Pipeline("docs", source, sink, state, lambda msgs: convert.rename_topics(msgs, "app:lines"))
    counted = flow_counts(spark, flow, "skipped")
    received = spark.read.schema("topic string, data string").json(folder).groupBy("topic").agg(
        F.count("data").alias("received"),
        F.sum(F.length("data") - len("host-1|")).alias("characters")).unpivot(
        "topic", ["received", "characters"], "event", "n")
    return counted.unionByName(received.withColumn("name", F.lit("hosts")))
