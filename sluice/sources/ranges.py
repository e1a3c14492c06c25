"""Files read by byte ranges: the tasks open them, so a file may be read from any byte on.

A range has the lines that begin in it. Each carriage return and each line feed ends a line, positions are those of the
file, and nothing is dropped: neither a byte order mark nor a last line without an end. Ranges are rows, so neither
paths nor contents pass through the driver. Stores that PyArrow opens are read; for others, scan with Spark.
"""

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import decode_utf8

RANGE_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
# Read at once beyond a range, to find where its last line ends.
BEYOND_BYTES = 1 << 14
BATCH_LINES = 100_000
# Stores of PyArrow, by the schemes that Spark knows them by.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def readable(path: str) -> bool:
    """True if tasks can open files of this store by themselves."""
    return SCHEMES.get(_scheme(path)) is not None


def _scheme(path):
    head, colon, _ = path.partition(":")
    return head.lower() if colon and "/" not in head else ""


def store_of(path: str):
    """(file system, name in it) of a path as listings give it."""
    scheme = _scheme(path)
    if SCHEMES[scheme] == "file":
        name = path[len(scheme) + 1:] if scheme else path
        return pyarrow.fs.LocalFileSystem(), "/" + name.lstrip("/") if scheme else name
    rest = path[len(scheme):]
    return pyarrow.fs.FileSystem.from_uri(SCHEMES[scheme] + quote(rest, safe=":/@"))


def _line_start(file, offset):
    """The start of the line that the byte before `offset` belongs to; `offset` itself if that byte ends a line."""
    end = offset
    while end > 0:
        begin = max(0, end - CHUNK_BYTES)
        data = np.frombuffer(file.read_at(end - begin, begin), np.uint8)
        ends = np.flatnonzero((data == 10) | (data == 13))
        if len(ends):
            return begin + int(ends[-1]) + 1
        end = begin
    return 0


def lines_in(file, offset: int, start: int, stop: int, length: int):
    """Yield (bytes without line ends, ends of lines in it, positions after each line) of lines that begin in a range.

    The first range of a file starts at `offset`, with the whole line that `offset` lies in.
    """
    if start <= offset:
        at, searching = _line_start(file, offset), False
    else:  # a line begins at `start` only if the byte before ends one
        at, searching = start - 1, True
    begun, pieces, position = at, [], at
    while position < length and (begun < stop or pieces):
        data = file.read_at(min(CHUNK_BYTES, length - position, max(stop - position, BEYOND_BYTES)), position)
        if not data:
            break
        found = np.flatnonzero(np.isin(np.frombuffer(data, np.uint8), (10, 13))) + 1
        if not len(found):
            if not searching:
                pieces.append(data)
            position += len(data)
            if searching and position >= stop:
                return
            continue
        if searching:
            begun, searching = position + int(found[0]), False
            if begun >= stop:
                return
            held = data[int(found[0]):]
            found = found[1:] - found[0]
        else:
            held = b"".join([*pieces, data])
            found = found + (len(held) - len(data))
        position += len(data)
        starts = np.concatenate(([0], found[:-1])) if len(found) else found
        mine = int(np.searchsorted(starts, stop - begun))
        found = found[:mine]
        if len(found):
            values = np.frombuffer(held, np.uint8)[:found[-1]]
            yield np.delete(values, found - 1), found - np.arange(1, len(found) + 1), begun + found
        used = int(found[-1]) if len(found) else 0
        begun += used
        pieces = [held[used:]] if used < len(held) else []
        if begun >= stop:
            return
    if pieces and begun < stop:
        held = b"".join(pieces)
        yield np.frombuffer(held, np.uint8), np.array([len(held)]), np.array([min(begun + len(held), length)])


def ranges_of(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, offset, length, start and stop of the ranges of files from their `offset` (null is 0) to their `length`."""
    files = files.select("path", F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"),
                         F.col("length").cast("bigint").alias("length")).where("offset < length")
    return files.withColumn("start", F.explode(F.sequence("offset", F.col("length") - 1, F.lit(range_bytes)))).withColumn(
        "stop", F.least(F.col("start") + range_bytes, "length"))


def read_ranges(ranges: DataFrame, tasks: int | None = None) -> DataFrame:
    """file_path, block, rec, piece, line and end_offset of the lines of ranges, spread over `tasks`.

    (file_path, block, rec, piece) orders lines, as for scanned files. Files that go meanwhile are skipped. The place is
    the range's start and the line's end, so it does not depend on how the ranges are dealt out.
    """
    spark = ranges.sparkSession
    if tasks is None:
        most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        tasks = most if ranges.isStreaming else max(1, min(4 * most, ranges.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length, start, stop in zip(*(batch[c].to_pylist() for c in (
                    "path", "offset", "length", "start", "stop"))):
                store, name = store_of(path)
                try:
                    file = store.open_input_file(name)
                except FileNotFoundError:
                    continue
                with file:
                    for values, ends, positions in lines_in(file, offset, start, stop, length):
                        for i in range(0, len(ends), BATCH_LINES):
                            some = ends[i:i + BATCH_LINES]
                            first = int(ends[i - 1]) if i else 0
                            edges = np.concatenate(([first], some)) - first
                            lines = pa.BinaryArray.from_buffers(pa.binary(), len(some), [
                                None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(
                                    np.ascontiguousarray(values[first:int(some[-1])]))])
                            yield pa.RecordBatch.from_arrays(
                                [pa.repeat(path, len(some)), pa.repeat(start, len(some)),
                                 pa.array(positions[i:i + BATCH_LINES], pa.int64()), lines],
                                ["file_path", "block", "rec", "line"])

    spread = ranges.repartition(tasks, "path", "start")
    return spread.mapInArrow(read, "file_path string, block long, rec long, line binary").select(
        "file_path", "block", "rec", F.lit(0).alias("piece"), decode_utf8(F.col("line").cast("string")).alias("line"),
        F.col("rec").alias("end_offset"))


def probe_ends(files: DataFrame) -> DataFrame:
    """path, length, `marked` (begins with a byte order mark) and `open` (its last byte is a carriage return) of each file.

    A few bytes are read of each. Files that are gone are left out.
    """
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                store, name = store_of(path)
                try:
                    with store.open_input_file(name) as file:
                        size = file.size()
                        found.append((path, size, file.read_at(3, 0) == b"\xef\xbb\xbf",
                                      size > 0 and file.read_at(1, size - 1) == b"\r"))
                except FileNotFoundError:
                    pass
            columns = list(zip(*found)) or [(), (), (), ()]
            types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["path", "length", "marked", "open"])
    return files.select("path").mapInArrow(probe, "path string, length long, marked boolean, open boolean")
