"""Exact repeated substrings of a corpus: shard Burrows-Wheeler transforms, merged by interleave refinement.

Every string of `length` bytes belongs to an anchor, the smallest hash of 8 bytes in its first `window` places; equal
strings have equal anchors at equal distances. All strings of an anchor share its core, the bytes from the anchor to the end
of the shortest; cores that occur once rule out their strings. Anchors of one core differ in their flanks, the bytes before
and after the core, and their strings are the runs of half a flank's bytes, so strings of `length` bytes repeat where
flanks have a common run at the same place. These runs are found as intervals of the merged transform of all flanks.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from sluice.functions.joins import lookup_join, stored
from sluice.llm import words as W

LENGTH = 200
WINDOW = 65
SHARD = 256
BUFFER = 1024
HOT = 4096
_GRAM = 8
_PLACE = np.uint64((1 << 28) - 1)
_WIDTH = 4


def anchors(data, offsets, length, window):
    """(place, first start, last start) of each anchor: where the strings that start from first to last have theirs."""
    n = len(data) - _GRAM + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    grams = np.ndarray((n,), "<u8", np.ascontiguousarray(data).tobytes(), strides=(1,))
    low = (grams * np.uint64(0x9E3779B97F4A7C15)) & ~_PLACE | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    if window > width:
        low = np.minimum(low[:len(low) - (window - width)], low[window - width:])
    edge = np.zeros(len(data) + 1, np.int32)
    starts, stops = offsets[:-1], offsets[1:] - length + 1
    real = stops > starts
    np.add.at(edge, starts[real], 1)
    np.add.at(edge, stops[real], -1)
    s = np.flatnonzero(np.cumsum(edge)[:len(low)] > 0)
    if not len(s):
        return none, none, none
    p = (low[s] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (np.diff(s) != 1))))
    return p[new], s[new], s[np.append(new[1:] - 1, len(s) - 1)]


_ANCHOR = (T.StructType().add("key", T.LongType()).add("hull", T.LongType()).add("place", T.IntegerType())
           .add("low", T.ByteType()).add("high", T.ByteType()))


def _parser(length, window):
    core = length - window + 1

    @F.arrow_udf(T.ArrayType(_ANCHOR))
    def parse(texts: pa.Array) -> pa.Array:
        digest, columns, ends = xxhash.xxh3_64_intdigest, [[] for _ in range(5)], []
        for first, data, offsets in W.slices(texts):
            place, low, high = anchors(data, offsets, length, window)
            raw = memoryview(data.tobytes())
            keys = [digest(raw[p:p + core]) for p in place.tolist()]
            hulls = [digest(raw[a:b + length], p - a) for p, a, b in zip(place.tolist(), low.tolist(), high.tolist())]
            base = offsets[np.searchsorted(offsets, place, "right") - 1]
            for out, x in zip(columns, (np.array(keys, np.uint64).view(np.int64), np.array(hulls, np.uint64).view(np.int64),
                                        (place - base).astype(np.int32), (place - low).astype(np.int8),
                                        (place - high).astype(np.int8))):
                out.append(x)
            counts = np.bincount(np.searchsorted(offsets, place, "right") - 1, minlength=len(offsets) - 1)
            ends.append(counts)
        ends = np.concatenate(([0], np.cumsum(np.concatenate(ends)))) if ends else np.array([0])
        empty = (np.int64, np.int64, np.int32, np.int8, np.int8)
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in zip(columns, empty)]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(flat, _ANCHOR.names))
    return parse


# --- transforms ---------------------------------------------------------------------------------------------------------

def transform(symbols):
    """(suffix order, symbol before each suffix) of a shard: rows of equal length, each ended by a terminator of its own.

    `symbols` are above 0. Suffix row * (columns + 1) + c starts at column c; terminators are the smallest suffixes, in the
    order of rows, and stand as symbol 0 before the suffix of a whole row. Orders are made by doubling the
    length that ranks compare.
    """
    rows, columns = symbols.shape
    padded = np.zeros((rows, columns + 1), np.int64)
    padded[:, :columns] = symbols.astype(np.int64) + rows
    padded[:, columns] = np.arange(rows)
    rank, width = np.unique(padded, return_inverse=True)[1].reshape(padded.shape), 1
    while width <= columns:
        follow = np.zeros_like(rank)
        follow[:, :-width] = rank[:, width:] + 1
        pair = rank * (rank.max() + 2) + follow
        rank, width = np.unique(pair, return_inverse=True)[1].reshape(padded.shape), width * 2
    order = np.argsort(rank, axis=None, kind="stable")
    before = np.zeros((rows, columns + 1), symbols.dtype)
    before[:, 1:] = symbols
    return order, before.ravel()[order]


def merge(transforms, rows, depth):
    """(shard, rank in the shard, common prefix) of all suffixes in merged order.

    The interleave says which shard each merged place comes from. It starts as one shard after the other and is refined: read in
    its order, the symbols before the suffixes are dealt stably by symbol, which gives the interleave that is
    right for one symbol more. Places between which a boundary appears in round h share h - 1 symbols; those without one
    after `depth` rounds share `depth` or more. The suffixes themselves are never sorted again.
    """
    before = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    total, ended = len(before), sum(rows)
    terminators = np.repeat(np.arange(len(transforms), dtype=np.uint16), rows)
    item, block = np.arange(total), np.zeros(total, np.int64)
    common = np.full(total, depth, np.int32)
    cut = np.zeros(total, bool)
    for h in range(depth):
        symbol = before[item]
        order = np.argsort(symbol, kind="stable")
        source = shard[item[order]]
        source[:ended] = terminators
        symbol, came = symbol[order], block[order]
        edge = np.ones(total, bool)
        edge[1:] = (symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1])
        edge[:ended] = True
        common[edge & ~cut] = h
        cut |= edge
        # The k-th place of a shard holds its k-th suffix: places of equal shards are filled in order.
        place = np.argsort(source, kind="stable")
        item = np.empty(total, np.int64)
        item[place] = np.arange(total)
        block = np.cumsum(edge)
        if edge.all():
            break
    base = np.concatenate(([0], np.cumsum([len(t) for t in transforms])))
    return shard[item], item - base[shard[item]], common


def repeated_runs(flanks, run, shard_rows=SHARD):
    """Blocks of equal runs of `run` bytes: (block, row, place) for each place of each row whose run occurs elsewhere.

    `flanks` is a matrix of bytes. Four bytes are one symbol, so each row is read in four phases, and a run is
    run / 4 symbols; their ranks among all symbols are the alphabet.
    """
    rows, size = flanks.shape
    words = np.stack([np.pad(flanks, ((0, 0), (0, _WIDTH)))[:, k:k + size] for k in range(_WIDTH)], axis=-1)
    codes = words.astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
    alphabet, symbols = np.unique(codes, return_inverse=True)
    kind = np.uint16 if len(alphabet) < (1 << 16) - 1 else np.uint32
    symbols = (symbols.reshape(rows, size) + 1).astype(kind)
    phases = np.concatenate([symbols[:, k::_WIDTH] for k in range(_WIDTH)])
    columns = phases.shape[1]
    shards = [phases[i:i + shard_rows * _WIDTH] for i in range(0, len(phases), shard_rows * _WIDTH)]
    made = [transform(s) for s in shards]
    which, rank, common = merge([t for _, t in made], [len(s) for s in shards], run // _WIDTH)
    orders = [order for order, _ in made]
    suffix = np.empty(len(which), np.int64)
    for s, order in enumerate(orders):
        mine = which == s
        suffix[mine] = order[rank[mine]] + s * shard_rows * _WIDTH * (columns + 1)
    block = np.cumsum(common < run // _WIDTH)
    sizes = np.bincount(block)
    keep = sizes[block] > 1
    block, suffix = block[keep], suffix[keep]
    phase_row, column = suffix // (columns + 1), suffix % (columns + 1)
    place = column * _WIDTH + phase_row // rows
    real = place + run <= size
    return block[real], (phase_row % rows)[real], place[real]


def _shared_strings(keys, flanks, low, high, side):
    """(row, place) of the strings of each row that another row with its key has, too, at the same place."""
    block, row, place = repeated_runs(flanks, side)
    valid = (place >= side - low[row]) & (place <= side - high[row])
    block, row, place = block[valid], row[valid], place[valid]
    order = np.lexsort((row, place, keys[row], block))
    block, row, place = block[order], row[order], place[order]
    new = np.ones(len(row) + 1, bool)
    new[1:-1] = (np.diff(block) != 0) | (np.diff(place) != 0) | (np.diff(keys[row]) != 0)
    group = np.cumsum(new[:-1]) - 1
    many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    return row[many], place[many]


_FLANK = (T.StructType().add("key", T.LongType()).add("flank", T.BinaryType()).add("place", T.IntegerType())
          .add("low", T.ByteType()).add("high", T.ByteType()).add("alone", T.BooleanType()))


def _flank_reader(length, side):
    @F.arrow_udf(T.ArrayType(_FLANK))
    def read(texts: pa.Array, marks: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(texts, marks):
            raw = (text.as_py() or "").encode()
            found = []
            for m in own.as_py():
                p = m["place"]
                left, right = raw[max(0, p - side):p], raw[p + length - side:p + length]
                found.append({**m, "flank": left.rjust(side, b"\0") + right.ljust(side, b"\0")})
            rows.append(found)
        kind = pa.struct([("key", pa.int64()), ("flank", pa.binary()), ("place", pa.int32()), ("low", pa.int8()),
                          ("high", pa.int8()), ("alone", pa.bool_())])
        return pa.array(rows, pa.list_(kind))
    return read


def _compare(length, side, buffer_rows):
    """Whole groups of a sorted partition, buffer after buffer: the spans of strings shared within a group."""
    names = ["text_id", "start", "end"]

    def spans(table):
        keys = np.asarray(table.column("key"))
        data, _ = W.text_bytes(table.column("flank").combine_chunks())
        low, high = (np.asarray(table.column(c)).astype(np.int64) for c in ("low", "high"))
        row, place = _shared_strings(keys, data.reshape(len(keys), 2 * side), low, high, side)
        alone = np.asarray(table.column("alone"))[row]
        row, place = row[alone], place[alone]
        start = np.asarray(table.column("place")).astype(np.int64)[row] - side + place
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(start) > 1)))) if len(row) else row
        last = np.append(new[1:] - 1, len(row) - 1) if len(row) else row
        return pa.RecordBatch.from_arrays(
            [table.column("text_id").combine_chunks().take(pa.array(row[new])), pa.array(start[new].astype(np.int32)),
             pa.array((start[last] + length).astype(np.int32))], names)

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < buffer_rows:
                continue
            keys = np.asarray(held.column("key"))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            done = 0
            while len(cuts):
                i = np.searchsorted(cuts, done + buffer_rows)
                if i >= len(cuts):
                    break
                yield spans(held.slice(done, cuts[i] - done))
                done = int(cuts[i])
            held = held.slice(done)
        if held is not None and held.num_rows:
            yield spans(held)
    return compare


def _window_hashes(side):
    """The strings of a flank as (place, 128-bit hash)."""
    entry = T.StructType().add("at", T.IntegerType()).add("hash", T.BinaryType())

    @F.arrow_udf(T.ArrayType(entry))
    def hashes(flank: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        rows = []
        for f, a, b in zip(flank.to_pylist(), low.to_pylist(), high.to_pylist()):
            rows.append([{"at": j, "hash": xxhash.xxh3_128_digest(f[j:j + side])} for j in range(side - a, side - b + 1)])
        return pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.binary())])))
    return hashes


@F.arrow_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
def _united(spans: pa.Array) -> pa.Array:
    """Overlapping and touching spans as one, in order."""
    out = []
    for own in spans:
        merged = []
        for s in sorted((s["start"], s["end"]) for s in own.as_py()):
            if merged and s[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append(list(s))
        out.append([{"start": a, "end": b} for a, b in merged])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def text_id(text):
    """128 bits that stand for a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, hot: int = HOT, text_col="text",
                   buffer_rows: int = BUFFER) -> DataFrame:
    """(text_id, spans): for each different text the maximal runs of bytes covered by a repeated string of `length` bytes.

    A string repeats if it starts at any other place of the corpus, in the same or another row; strings do not
    cross rows. Spans are (start, end) in bytes, end exclusive, in order, neither touching nor overlapping. Texts without
    any are left out. Null texts are empty. Rows with equal texts are repeats of each other throughout. No rows, no spans.

    Only anchors (24 bytes each, about 2 in `window` + 1 bytes of text) are shuffled. Cores are counted with partial
    sums; those that occur again are joined back, where Spark splits hot ones. Anchors whose strings all repeat are settled by
    the hash of all their bytes. The flanks of the others are compared in groups of one core; cores with more
    than `hot` different flanks are not gathered: each of their strings is counted by its hash.
    """
    side = window - 1
    if side % _WIDTH or length < 2 * window or window > 100:
        raise ValueError("window - 1 must be a multiple of 4, window at most 100 and half of length")
    base = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).filter(F.octet_length("_text") >= length)
    base = base.withColumn("text_id", text_id(F.col("_text")))
    copies = stored(base.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("copies"), F.first(F.octet_length("_text")).alias("size")).filter("copies > 1"))
    parsed = stored(base.select("text_id", _parser(length, window)("_text").alias("anchors")))
    once = _one_of_each(parsed, copies)
    each = once.select("text_id", F.inline("anchors"))
    again = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    met = stored(each.join(again, "key"))
    hulls = met.groupBy("key", "hull").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("text_id", "place", "low", "high")).alias("at"))
    hulls = stored(hulls)
    settled = met.join(hulls.filter("n > 1").select("key", "hull"), ["key", "hull"]).select(
        "text_id", (F.col("place") - F.col("low")).alias("start"), (F.col("place") - F.col("high") + length).alias("end"))
    groups = stored(hulls.groupBy("key").agg(F.count(F.lit(1)).alias("hulls")).filter("hulls > 1"))
    marks = hulls.join(groups, "key").select("key", "at.*", (F.col("n") == 1).alias("alone"))
    marks = stored(marks.groupBy("text_id").agg(
        F.collect_list(F.struct("key", "place", "low", "high", "alone")).alias("marks")))
    reader = _flank_reader(length, side)
    found = lookup_join(base.select("text_id", "_text"), marks, "text_id", "inner")
    flanks = found.select("text_id", F.inline(reader("_text", "marks"))).dropDuplicates(["text_id", "place"])
    flanks = stored(flanks.join(groups, "key"))
    parts = max(1, int(flanks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cold = flanks.filter(F.col("hulls") <= hot).drop("hulls").repartition(parts, "key").sortWithinPartitions("key")
    shared = cold.mapInArrow(_compare(length, side, buffer_rows), "text_id binary, start int, end int")
    strings = flanks.filter(F.col("hulls") > hot).select(
        "key", "text_id", "place", "alone", F.inline(_window_hashes(side)("flank", "low", "high")))
    twice = strings.groupBy("key", "at", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    start = F.col("place") - side + F.col("at")
    counted = strings.filter("alone").join(twice, ["key", "at", "hash"]).select(
        "text_id", start.alias("start"), (start + length).alias("end"))
    parts = settled.unionByName(shared).unionByName(counted)
    whole = copies.select("text_id", F.lit(0).alias("start"), F.col("size").alias("end"))
    parts = lookup_join(parts, copies.select("text_id"), "text_id", "left_anti").unionByName(whole)
    return parts.groupBy("text_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumn(
        "spans", _united("spans"))


def _one_of_each(parsed, copies):
    """Rows with a text of their own, and one row for each other text, twice counted as it occurs elsewhere, too."""
    marked = lookup_join(parsed, copies, "text_id", "left")
    alone = marked.filter("copies IS NULL").select("text_id", "anchors")
    many = marked.filter("copies IS NOT NULL").select("text_id", "anchors").dropDuplicates(["text_id"])
    return alone.unionByName(many)


def without_spans(docs: DataFrame, spans: DataFrame, text_col="text") -> DataFrame:
    """`docs` with `n_bytes`, `n_removed`, `n_spans` and `kept`: the bytes outside the spans of each row's text.

    `kept` is binary, as a span may cut a character. Columns of these names are replaced. A null text is empty.
    """
    out = T.StructType().add("n_removed", T.LongType()).add("kept", T.BinaryType())

    @F.arrow_udf(out)
    def cut(texts: pa.Array, own: pa.Array) -> pa.Array:
        removed, kept = [], []
        for text, spans in zip(texts, own):
            raw = (text.as_py() or "").encode()
            pieces, at = [], 0
            for s in spans.as_py() or []:
                pieces.append(raw[at:s["start"]])
                at = s["end"]
            kept.append(b"".join([*pieces, raw[at:]]))
            removed.append(len(raw) - len(kept[-1]))
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["n_removed", "kept"])

    named = docs.drop(*({"n_bytes", "n_removed", "n_spans", "kept"} - {text_col}))
    keyed = named.withColumn("_text_id", text_id(F.col(text_col)))
    joined = lookup_join(keyed, spans.select(F.col("text_id").alias("_text_id"), F.col("spans").alias("_spans")), "_text_id", "left")
    joined = joined.withColumn("_cut", cut(text_col, "_spans"))
    return joined.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "n_removed": F.col("_cut.n_removed"),
        "n_spans": F.coalesce(F.size("_spans"), F.lit(0)).cast("long"), "kept": F.col("_cut.kept")}).drop(
            "_text_id", "_spans", "_cut")


def deduplicate(docs: DataFrame, length: int = LENGTH, text_col="text", **options) -> DataFrame:
    """`docs` without the bytes of repeated strings, as `without_spans` gives them."""
    return without_spans(docs, stored(repeated_spans(docs, length, text_col=text_col, **options)), text_col)
