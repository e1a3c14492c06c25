"""Listing, selecting and reading files; the ledger; deletion."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sluice.schema import LEDGER
from sluice.sources import cleanup, ranges
from sluice.sources.cleanup import delete_files, expire_older_than_days, inside
from sluice.sources.files import (
    list_files, lines_of, match_files, order_files, plan_groups, read_lines, read_pending,
    scan_directory,
    scan_files, split_expired, unfinished_files, unread_files)
from sluice.sources.ledger import (
    advance_ledger, backlog, completed, import_text_ledger, ledger_log, load_ledger, save_ledger)
from sluice.sources.statelog import StateConflict
from tests.conftest import rows
from tests.test_lines import CASES, expected

NAMES = ["a b.log", "a%20c.log", "a[1].log", "a{x}.log", "a?.log", "a*.log", "a+b.log", "é.log"]


def in_order(lines):
    return lines.orderBy("file_path", "block", "rec", "piece").collect()


def test_listing_is_flat_and_literal(spark, folder):
    root = folder({name: b"x\n" for name in NAMES} | {"k=1/in.log": b"x\n", "sub/in.log": b"x\n"})
    listing = list_files(spark, root)
    assert rows(listing.select("file_name", "length")) == sorted(((n, 2) for n in NAMES), key=repr)
    assert list_files(spark, root, recursive=True).count() == len(NAMES) + 2
    read = read_lines(spark, listing, "c")
    assert rows(read.select("file_path")) == rows(listing.select("path"))


def test_listing_needs_a_folder(spark, folder):
    root = folder({"a.log": b"x"})
    for wrong in (root + "/none", root + "/a.log"):
        with pytest.raises(ValueError, match="not a directory"):
            list_files(spark, wrong)


@pytest.mark.parametrize("pattern, kept", [
    (r"^.*\.test\.log$", ["a.test.log"]),
    (r"b\.log", ["b.log"]),
    (r"a|b\.log", ["b.log"]),
])
def test_match_files(spark, folder, pattern, kept):
    root = folder({n: b"x" for n in ("a.test.log", "a.test.log.gz", "atest.log", "b.log", "ab.log")})
    assert rows(match_files(list_files(spark, root), pattern).select("file_name")) == [
        (k,) for k in kept]


def test_split_expired(spark):
    now = datetime(2024, 5, 1, tzinfo=timezone.utc)
    ages = [0, 7199, 7200, 7201]
    listing = spark.createDataFrame(
        [(str(a), now - timedelta(seconds=a)) for a in ages], "path string, modified timestamp")
    live, expired = split_expired(listing, now, 7200)
    assert rows(live.select("path")) == [("0",), ("7199",), ("7200",)]
    assert rows(expired.select("path")) == [("7201",)]
    assert split_expired(listing, now, 2_592_000)[1].count() == 0


def test_order_files(spark):
    listing = spark.createDataFrame(
        [("b", 100), ("a", 100), ("c", 3_000_000_000)], "path string, at bigint").select(
        "path", F.timestamp_seconds("at").alias("modified"))
    assert [r.path for r in order_files(listing).collect()] == ["a", "b", "c"]
    assert [r.path for r in order_files(listing, "desc").collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        order_files(listing, "newest")


@pytest.mark.parametrize("mode", [{}, {"offsets": True}])
def test_read_lines_of_each_case(spark, folder, mode):
    mark = b"\xef\xbb\xbf"
    contents = [c for c in CASES if c] + [
        mark + b"m\r\nn\r", mark + b"m\nn\n", mark + b"m\nn", mark + b"m\rn\r\n", b"\r", b"\r\r\n"]
    root = folder({f"{i}.log": c for i, c in enumerate(contents)})
    got = in_order(lines_of(scan_files(spark, list_files(spark, root)), **mode))
    for i, content in enumerate(contents):
        mine = [r for r in got if r.file_path.endswith(f"/{i}.log")]
        lines, ends = expected(content)
        assert [r.line for r in mine] == lines, content
        if mode:
            assert [r.end_offset for r in mine] == ends, content


def test_ranges_of_random_bytes():
    """Whatever the ranges, chunks and offsets, the lines are those after the offset, each once."""
    class File:
        def __init__(self, content):
            self.content = content

        def read_at(self, size, at):
            return self.content[at:at + size]

    rng = random.Random(1)
    before = ranges.CHUNK_BYTES, ranges.BEYOND_BYTES
    try:
        for trial in range(2000):
            ranges.CHUNK_BYTES, ranges.BEYOND_BYTES = rng.choice([1, 2, 3, 7, 50]), rng.choice([1, 2, 100])
            weights = [5, 5, 1, 2] if trial % 2 else [20, 20, 1, 1]
            content = bytes(rng.choices(b"ab\r\n", weights=weights, k=rng.randrange(60)))
            offset, step = rng.randrange(len(content) + 1), rng.choice([1, 2, 5, 13, 100])
            got = []
            for start in range(offset, len(content), step):
                for values, ends, after in ranges.lines_in(
                        File(content), offset, start, min(start + step, len(content)), len(content)):
                    edges = [0, *ends]
                    got += [(values[a:b].tobytes().decode(), int(e)) for a, b, e in zip(edges, edges[1:], after)]
            assert got == [x for x in zip(*expected(content)) if x[1] > offset], (content, offset, step)
    finally:
        ranges.CHUNK_BYTES, ranges.BEYOND_BYTES = before


def test_lines_by_ranges_of_each_case(spark, folder, monkeypatch):
    mark = b"\xef\xbb\xbf"
    contents = [c for c in CASES if c] + [mark + b"m\r\nn\r", mark + b"m\nn", b"\r", b"\r\r\n", b"\xff\xc3\n\xe9\r"]
    root = folder({f"{i} a%b+c.log": c for i, c in enumerate(contents)})
    listing = list_files(spark, root).withColumn("offset", F.lit(None).cast("bigint"))
    for size in (2, 1000):
        got = in_order(ranges.read_ranges(ranges.ranges_of(listing, size)))
        for i, content in enumerate(contents):
            mine = [r for r in got if r.file_path.endswith(f"/{i} a%b+c.log")]
            lines, ends = expected(content)
            assert [r.line for r in mine] == lines, content
            assert [r.end_offset for r in mine] == ends, content


def test_exact_reading_scans_contents_once(spark, folder):
    root = folder({"a.log": b"x\r\ny\n", "b.log": b"z\r", "c.log": b"\xef\xbb\xbfm\n"})
    lines = read_lines(spark, list_files(spark, root), "c")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Join" not in plan
    assert rows(lines.select("data")) == sorted(
        [("",), ("x",), ("y",), ("z",), ("\ufeffm",)], key=repr)


def test_resuming_reads_the_rest_only(spark, folder, monkeypatch):
    body = b"".join(b"%06d\r\n" % i for i in range(5000))
    root = folder({"a.log": body, "b.log": body, "c.log": body + b"end"})
    listing = list_files(spark, root)
    at = {"a.log": 39_992, "b.log": 39_995, "c.log": len(body)}
    ledger = ledger_of(spark, *((f"file:{root}/{n}", offset, False) for n, offset in at.items()))
    seen = spark.sparkContext.accumulator(0)
    store_of = ranges.store_of

    def counting(path):
        store, name = store_of(path)

        class File:
            def __init__(self):
                self.file = store.open_input_file(name)

            def __enter__(self):
                return self

            def __exit__(self, *failure):
                self.file.close()

            def read_at(self, size, at):
                data = self.file.read_at(size, at)
                seen.add(len(data))
                return data

        class Store:
            def open_input_file(self, name):
                return File()
        return Store(), name
    monkeypatch.setattr(ranges, "store_of", counting)
    monkeypatch.setattr(ranges, "CHUNK_BYTES", 512)
    got = read_pending(spark, listing, ledger, "c").select("file_path", "data").collect()
    lines, ends = expected(body)
    for name, offset in at.items():
        wanted = [x for x, e in zip(lines, ends) if e > offset] + (["end"] if name == "c.log" else [])
        assert [r.data for r in got if r.file_path.endswith(name)] == wanted
    assert seen.value <= 10 * 512 + sum(len(body) + 3 - offset for offset in at.values())


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "1"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("mode", [{}, {"offsets": True}])
def test_read_lines_over_many_splits(spark, folder, small_splits, mode):
    rng = random.Random(3)
    contents = {
        f"{i}.log": b"".join(bytes(rng.choices(b"abc\r\xff\xc3\xa9", k=rng.randrange(40))) + b"\n"
                             for _ in range(600)) + tail
        for i, tail in enumerate([b"", b"\r", b"x", b"x\r"])}
    root = folder(contents)
    records = scan_files(spark, list_files(spark, root))
    assert records.select("file_path", "block").distinct().count() > 30
    got = in_order(lines_of(records, **mode))
    for name, content in contents.items():
        mine = [r for r in got if r.file_path.endswith("/" + name)]
        lines, ends = expected(content)
        assert [r.line for r in mine] == lines
        if mode:
            assert [r.end_offset for r in mine] == ends
            assert ends[-1] == len(content)


@pytest.mark.parametrize("mode", [{}, {"offsets": True}])
@pytest.mark.parametrize("planned, run", [(4, 40), (40, 4)])
def test_lines_do_not_depend_on_the_split_layout(spark, folder, mode, planned, run):
    body = b"".join(b"%d\r\n" % i for i in range(3000))
    contents = {"a.log": body + b"end\r", "b.log": b"\xef\xbb\xbf" + body + b"end\r",
                "c.log": body + b"end", "d.log": body}
    cores = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set(cores, str(planned))
        records = scan_files(spark, list_files(spark, folder(contents)))
        before, lines = records.rdd.getNumPartitions(), lines_of(records, **mode)
        spark.conf.set(cores, str(run))
        assert records.select("*").rdd.getNumPartitions() != before
        got = in_order(lines)
    finally:
        spark.conf.unset(cores)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, content in contents.items():
        mine = [r for r in got if r.file_path.endswith("/" + name)]
        wanted, ends = expected(content)
        assert [r.line for r in mine] == wanted, name
        if mode:
            assert [r.end_offset for r in mine] == ends


def test_fast_reading_is_one_narrow_scan(spark, folder):
    root = folder({"a.log": b"x\r\ny\n"})
    lines = lines_of(scan_files(spark, list_files(spark, root)), exact=False)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [r.line for r in in_order(lines)] == ["x", "", "y"]


def files_opened(df):
    """The number of files that the scans of an executed plan listed."""
    df.collect()
    found = []

    def walk(node):
        if node.metrics().contains("numFiles"):
            found.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_directory_scan_opens_only_matching_live_files(spark, folder):
    root = folder({"a b.log": b"1\n", "old.log": b"2\n", "c.txt": b"3\n", "d%e.log": b"4\n",
                   "k=1/e.log": b"5\n"}, {"old.log": 5000})
    records = scan_directory(spark, root, retention_seconds=3600)
    assert files_opened(records.select("value")) == [2]
    assert rows(records.select("value")) == [("1",), ("4",)]


def test_listing_reads_no_content(spark, folder):
    plan = list_files(spark, folder({"a.log": b"1"}))._jdf.queryExecution().executedPlan()
    assert "content:" not in plan.toString().split("ReadSchema")[1]


def ledger_of(spark, *entries):
    return spark.createDataFrame(list(entries), LEDGER)


def test_ledger_selection(spark, folder):
    root = folder({n: b"line\nline\n" for n in ("new.log", "done.log", "part.log")})
    listing = list_files(spark, root)
    uri = f"file:{root}/"
    ledger = ledger_of(spark, (uri + "done.log", 10, True), (uri + "part.log", 5, False),
                       (uri + "gone.log", 5, False))
    assert rows(unread_files(listing, ledger).select("file_name")) == [("new.log",)]
    assert rows(unfinished_files(ledger, listing).select("file_name")) == [("part.log",)]
    assert rows(backlog(listing, ledger)) == [(2, 15)]
    pending = read_pending(spark, listing, ledger, "c")
    assert rows(pending.groupBy(F.substring_index("file_path", "/", -1)).count()) == [
        ("new.log", 2), ("part.log", 1)]
    progress = completed(listing.where("file_name = 'part.log'"))
    after = advance_ledger(ledger, progress, listing)
    assert rows(after) == sorted([
        (uri + "new.log", 0, False), (uri + "done.log", 10, True), (uri + "part.log", 10, True)],
        key=repr)


def test_read_pending_of_nothing(spark, folder):
    listing = list_files(spark, folder({"a.log": b"1\n"}))
    assert read_pending(spark, listing, completed(listing), "c").count() == 0


def test_ledger_snapshots(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert load_ledger(spark, path).count() == 0
    save_ledger(ledger_of(spark, ("a", 1, False)), path)
    save_ledger(ledger_of(spark, ("a", 2, True), ("b c", 0, False)), path)
    assert rows(load_ledger(spark, path)) == [("a", 2, True), ("b c", 0, False)]
    # A table that was never committed is not read.
    ledger_of(spark, ("x", 9, True)).write.parquet(f"{path}/data/000000000099-x")
    assert load_ledger(spark, path).count() == 2


def test_state_log_changes_and_compaction(spark, tmp_path):
    log = ledger_log(spark, str(tmp_path / "log"))
    assert log.load()[0] == 0
    want, number = {}, 0
    for i in range(25):
        changes = {f"p{i % 7}": i, f"q{i}": i, "p0": i + 100}
        want.update(changes)
        rows_now = [(k, v, v % 2 == 0) for k, v in changes.items()]
        table = ledger_of(spark, *rows_now).withColumn("removed", F.lit(False))
        if i % 6 == 5:  # the key is ended, and comes back later
            want.pop(f"q{i - 1}")
            table = table.unionByName(ledger_of(spark, (f"q{i - 1}", 0, False)).withColumn("removed", F.lit(True)))
        loaded = log.load()[1]
        number = log.save(table, number)
        loaded.count()  # still readable
        got = log.load()
        assert got[0] == number
        assert rows(got[1]) == sorted(((k, v, v % 2 == 0) for k, v in want.items()), key=repr)
    commits = log.commits()
    assert len(commits) <= 2 * log.changes + 2 and sum(c.kind == "base" for c in commits) <= 2
    assert sorted(os.listdir(tmp_path / "log" / "data")) == sorted(c.folder for c in commits)


def test_second_writer_is_refused(spark, tmp_path):
    one, two = (ledger_log(spark, str(tmp_path / "log")) for _ in range(2))
    number = one.save(ledger_of(spark, ("a", 1, False)), 0)
    with pytest.raises(StateConflict):
        two.save(ledger_of(spark, ("a", 9, True)), 0)
    assert rows(two.load()[1]) == [("a", 1, False)]
    assert len(os.listdir(tmp_path / "log" / "data")) == 1
    # A writer that ended between the two steps of a commit leaves an empty file.
    open(tmp_path / "log" / "commits" / "000000000002", "w").close()
    number, table = two.load()
    assert number == 2 and rows(table) == [("a", 1, False)]
    assert two.save(ledger_of(spark, ("b", 1, True)), number) == 3
    assert rows(one.load()[1]) == [("a", 1, False), ("b", 1, True)]


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("max_files, max_bytes", [(3, None), (None, 50), (4, 60), (None, None), (1, 1)])
def test_plan_groups(spark, order, max_files, max_bytes):
    rng = random.Random(1)
    names = [(f"f{i:03d}", rng.randrange(5), rng.choice([0, 1, 7, 20, 49, 130])) for i in range(100)]
    listing = spark.createDataFrame(names, "path string, at long, length long").select(
        "path", F.timestamp_seconds("at").alias("modified"), "length")
    got = plan_groups(listing, order, max_files, max_bytes).collect()
    sign = 1 if order == "asc" else -1
    ordered = sorted(got, key=lambda r: (sign * r["modified"].timestamp(), r["path"]))
    assert len(got) == 100 and [r["group"] for r in ordered] == sorted(r["group"] for r in got)
    groups = {}
    for r in ordered:
        groups.setdefault(r["group"], []).append(r["length"])
    if not max_files and not max_bytes:
        assert list(groups) == [0]
    for lengths in groups.values():
        assert not max_files or len(lengths) <= max_files
        assert not max_bytes or sum(lengths[:-1]) < max_bytes
    if max_files and not max_bytes:
        assert all(len(lengths) == max_files for lengths in list(groups.values())[:-1])


def test_import_text_ledger(spark, folder):
    root = folder({"c.offset": b"/var/log/app/cdn-monitor.log 6785 true\nnot a ledger line\n"
                               b"/logs/a b.log 10 False\n\n/x 1 true\n/x 2 TRUE\n/y 99999999999999999999 true"})
    got = import_text_ledger(spark, root + "/c.offset", "file:")
    assert rows(got) == [
        ("file:/logs/a b.log", 10, False), ("file:/var/log/app/cdn-monitor.log", 6785, True),
        ("file:/x", 2, True)]


def test_delete_files(spark, folder, tmp_path):
    root = folder({"a.log": b"1", "b c.log": b"2", "keep.txt": b"3"})
    other = folder({"o.log": b"4"}, under="other")
    listing = match_files(list_files(spark, root))
    assert delete_files(listing, root) == 2
    assert len(os.listdir(root)) == 3
    with pytest.raises(ValueError, match="not below"):
        delete_files(listing.unionByName(list_files(spark, other)), root, dry_run=False)
    assert len(os.listdir(root)) == 3 and len(os.listdir(other)) == 1
    assert delete_files(listing, root, dry_run=False) == 2
    assert os.listdir(root) == ["keep.txt"]


def test_deletion_outcomes(spark, folder, tmp_path, monkeypatch):
    root = folder({"a.log": b"1", "b.log": b"2", "sub/x.log": b"3", "locked.log": b"4"})
    paths = spark.createDataFrame([(f"file:{root}/{n}",) for n in ("a.log", "b.log", "sub", "none.log", "locked.log", "a.log")], "path string")
    out = str(tmp_path / "outcomes")
    delete_file = cleanup._deleted
    monkeypatch.setattr(cleanup, "_deleted", lambda path: "failed: busy" if "locked" in path else delete_file(path))

    def states():
        return {r["path"].rsplit("/", 1)[1]: r["state"] for r in cleanup.delete_in_tasks(paths, root, out).collect()}
    want = {"a.log": "deleted", "b.log": "deleted", "sub": "not a file", "none.log": "absent"}
    assert states() == want | {"locked.log": "failed: busy"}
    assert sorted(os.listdir(root)) == ["locked.log", "sub"]
    monkeypatch.setattr(cleanup, "_deleted", delete_file)
    open(f"{root}/a.log", "w").close()  # a new file of that name is none of the old ones
    assert states() == want | {"locked.log": "deleted"}
    assert sorted(os.listdir(root)) == ["a.log", "sub"]
    with pytest.raises(ValueError, match="not below"):
        cleanup.delete_in_tasks(paths.union(spark.createDataFrame([(f"file:{root}/../x",)], "path string")), root, out)
    for wrong in ("/", " ", "file:///"):
        with pytest.raises(ValueError, match="refusing"):
            cleanup.delete_in_tasks(paths, wrong, out)


def test_deletion_deals_many_files_to_many_tasks(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(cleanup, "TASK_FILES", 5)
    root, out = folder({f"{n}.log": b"" for n in range(300)}), str(tmp_path / "outcomes")
    paths = spark.range(300).selectExpr(f"concat('file:{root}/', id, '.log') AS path")
    assert cleanup.delete_in_tasks(paths, root, out).where("state = 'deleted'").count() == 300
    assert os.listdir(root) == []
    assert len([n for n in os.listdir(out) if n.endswith(".parquet")]) > 30
    assert cleanup.dealt(paths).select(F.spark_partition_id().alias("p")).distinct().count() > 30


def test_inside():
    assert inside("file:/a/b/c.log", "/a/b")
    assert inside("file:/a/b/c#1?.log", "file:///a/b/")
    assert not inside("file:/a/b/../c.log", "/a/b")
    assert not inside("file:/a/bc.log", "/a/b")
    assert not inside("hdfs://n/a/b/c.log", "/a/b")


def test_expire_older_than_days(spark):
    now = datetime(2024, 5, 10, tzinfo=timezone.utc)
    day = 86_400
    listing = spark.createDataFrame(
        [(str(a), now - timedelta(seconds=a)) for a in (6 * day, 7 * day - 1, 7 * day, 8 * day)],
        "path string, modified timestamp")
    assert rows(expire_older_than_days(listing, now).select("path")) == [
        (str(7 * day),), (str(8 * day),)]
