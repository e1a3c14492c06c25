"""Cutting text into lines, and the byte positions of lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions.text import decode_utf8, with_running_total
from sluice.operators.lines import line_offsets, resume_lines, split_lines, tag_category
from tests.conftest import rows

# content -> lines and end offsets
CASES = {
    b"one\r\ntwo\n\nthree": (["one", "", "two", "", "three"], [4, 5, 9, 10, 15]),
    b"x\ry\r": (["x", "y"], [2, 4]),
    b"c1\n": (["c1"], [3]),
    b"\n": ([""], [1]),
    b"": ([], []),
    bytes.fromhex("FFFE6162E4B80A6F6B0A"): (["��ab�", "ok"], [7, 10]),
    bytes.fromhex("FF0D62E4B80A6F"): (["�", "b�", "o"], [2, 6, 7]),
    "é\r\rü".encode(): (["é", "", "ü"], [3, 4, 6]),
}


def expected(content):
    """The lines of a file, byte by byte."""
    lines, ends, line = [], [], b""
    for i, byte in enumerate(content):
        if byte in b"\r\n":
            lines.append(line)
            ends.append(i + 1)
            line = b""
        else:
            line += bytes([byte])
    if line:
        lines.append(line)
        ends.append(len(content))
    return [x.decode("utf-8", "replace") for x in lines], ends


def texts(spark, contents):
    raw = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "id int, b binary")
    return raw.select("id", F.col("b").cast("string").alias("text"))


@pytest.mark.parametrize("content", CASES, ids=repr)
def test_split_lines(spark, content):
    got = split_lines(texts(spark, [content]), "text", ["id"], offsets=True).orderBy("pos").collect()
    assert ([r.line for r in got], [r.end_offset for r in got]) == CASES[content]
    assert [r.pos for r in got] == list(range(len(got)))
    assert expected(content) == CASES[content]


def test_split_lines_equals_brute_force(spark):
    rng = random.Random(7)
    contents = [bytes(rng.choice(b"ab\r\n\n \xc3\xa9") for _ in range(rng.randrange(300)))
                for _ in range(40)] + [b"long line\n" * 3000 + b"\r"]
    df = texts(spark, contents)
    got = split_lines(df, "text", ["id"], offsets=True).orderBy("id", "pos").collect()
    plain = split_lines(df, "text", ["id"]).orderBy("id", "pos").collect()
    for i, content in enumerate(contents):
        lines, ends = expected(content)
        assert [r.end_offset for r in got if r.id == i] == ends
        assert [r.line for r in got if r.id == i] == lines
        assert [r.line for r in plain if r.id == i] == lines


def test_keep_empty_false_keeps_positions(spark):
    got = split_lines(texts(spark, [b"a\n\n b\n"]), "text", ["id"], keep_empty=False)
    assert rows(got.select("pos", "line")) == [(0, "a"), (2, " b")]


def test_split_lines_needs_no_shuffle(spark):
    plan = split_lines(texts(spark, [b"a\n"]), "text", ["id"], offsets=True)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_decode_utf8(spark):
    raw = [("FFFE6162E4B8", "��ab�"), ("EDA08041", "�A"), ("C3A9", "é"),
           ("F4908080", "�" * 4), ("C080", "��"), ("", ""), (None, None)]
    df = spark.createDataFrame(raw, "h string, want string").select(
        decode_utf8(F.unhex("h").cast("string")).alias("got"), "want")
    assert [r.got for r in df.collect()] == [want for _, want in raw]


def jvm_decoded(raw):
    """As Python replaces malformed bytes, but an encoded surrogate, cut or not, as one."""
    return re.sub(rb"\xed[\xa0-\xbf][\x80-\xbf]?", "\ufffd".encode(), raw).decode("utf-8", "replace")


def test_decode_utf8_of_random_bytes(spark):
    rng = random.Random(11)
    parts = [b"a", b"\x80", b"\xbf", b"\xa0", b"\xc3", b"\xe0", b"\xe4", b"\xed", b"\xf0", b"\xf4",
             b"\xff", b"\x90", "é".encode(), "你".encode(), "😀".encode()]
    raws = [b"".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(5000)]
    df = spark.createDataFrame([(r,) for r in raws], "b binary")
    got = [r.t for r in df.select(decode_utf8(F.col("b").cast("string")).alias("t")).collect()]
    assert got == [jvm_decoded(r) for r in raws]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
def test_running_total(spark, n):
    df = spark.range(1).select(F.when(
        F.lit(n) > 0, F.sequence(F.lit(1), F.lit(max(n, 1)))).otherwise(F.array()).cast(
            "array<bigint>").alias("a"))
    got = with_running_total(df, "a", "t").first().t
    assert (got or []) == [i * (i + 1) // 2 for i in range(1, n + 1)]


@pytest.mark.parametrize("block_lines", [None, 7, 1])
def test_line_offsets_over_blocks(spark, block_lines):
    block = F.floor(F.col("pos") / block_lines) if block_lines else None
    contents = [b"".join(b"%d\n" % (i ** 3) for i in range(50)) + b"tail", b"\n\n", b"a"]
    df = texts(spark, contents).withColumn("size", F.octet_length("text"))
    df = df.withColumn("id", F.when(F.col("id") < 2, F.col("id")))  # a null key is a key
    lines = split_lines(df, "text", ["id", "size"])
    got = line_offsets(lines, "size", ["id"], block=block).select("id", "pos", "end_offset")
    want = [(i if i < 2 else None, pos, end) for i, c in enumerate(contents)
            for pos, end in enumerate(expected(c)[1])]
    assert rows(got) == sorted(want, key=repr)


def test_line_offsets_deals_many_lines_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("sluice.operators.lines.TASK_LINES", 100)
    lines = spark.range(5000).selectExpr("id % 700 AS f", "id DIV 700 AS pos", "'xy' AS line", "1000 AS size")
    got = line_offsets(lines, "size", ["f"])
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 500
    assert got.where("end_offset <> 3 * (pos + 1)").isEmpty() and got.count() == 5000


@pytest.mark.parametrize("limits", [{}, {"max_rows": 0}])
def test_resume_lines(spark, limits):
    lines = spark.createDataFrame(
        [("a", "x", 2), ("a", "y", 4), ("b", "z", 2), ("c", "q", 2)],
        "file_path string, line string, end_offset bigint")
    ledger = spark.createDataFrame(
        [("a", 2, False), ("c", 2, True)], "path string, offset bigint, completed boolean")
    assert rows(resume_lines(lines, ledger, **limits).select("line")) == [("y",), ("z",)]


def test_tag_category(spark):
    lines = spark.createDataFrame([("f", "x")], "file_path string, line string")
    assert rows(tag_category(lines, "cat")) == [("cat", "x", "f")]
