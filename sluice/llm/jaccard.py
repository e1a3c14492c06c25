"""Exact Jaccard join of documents' shingle sets, by universe partitions and the pigeonhole principle.

Sets of a size band and a threshold differ in at most H elements. The universe of 64-bit shingle hashes is cut into m equal
ranges; a set's elements in a range are its segment. Some segments are indexed whole (they find a partner that differs
there in nothing), others also with each one-deletion neighbour (a partner that differs in at most one element). If whole ones
count 1 and neighbourhoods 2, and all together count H + 1 + spare, partners agree on segments that count 1 + spare at
least. Segments that hold nothing would be keys that very many sets share, so they are not indexed, unless a set has more of
them than `spare` covers: two partners that agree on nothing else have both more.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from sluice.functions.joins import lookup_join, scratch_tables, stored
from sluice.llm import words as W
from sluice.llm.graph import components

BAND_STEPS = 3
STAR_ROUNDS = 3
SAMPLE = 1.5
BLOCK_ELEMENTS = 500_000
BLOCK_SETS = 1_500
COMPARE_CELLS = 4 << 20
_RANDOM = 0xD6E8FEB86659FD93
_allocated = {}


def allocate(low: int, high: int, most: int):
    """(segments, neighbourhoods, spare) for sets of low to high elements that differ in at most `most`.

    The cheapest number of keys: a whole segment is one key, a neighbourhood as many as its elements and two more. Few
    segments have large neighbourhoods, many have empty segments, for which spare ones must be paid. Where those would be too
    many, all segments are whole and empty ones are indexed.
    """
    # A plain dict, as a decorated function would be sent by its name.
    if (low, high, most) not in _allocated:
        _allocated[low, high, most] = _cheapest(low, high, most)
    return _allocated[low, high, most]


def _cheapest(low, high, most):
    best = None
    for m in range(1, most + most // 4 + 8):
        empty = m * math.exp(-low / m) if m > 1 else 0.0
        spare = math.ceil(empty + 4 * math.sqrt(empty) - 1e-6) if empty > 1e-5 else 0
        raised = max(0, most + 1 + spare - m)
        if raised > m or m > most + 1 + spare:
            continue
        cost = (m - raised) + raised * (high / m + 2)
        if best is None or cost < best[0]:
            best = (cost, m, raised, spare)
    return best[1:] if best else (most + 1, 0, 0)


class Plan:
    """Size bands and the allocation of each, for a threshold num / den."""

    def __init__(self, num: int, den: int, steps: int = BAND_STEPS):
        self.num, self.den = num, den
        self.ratio = (den / num) ** steps

    def band(self, size):
        return int(math.log(size) / math.log(self.ratio) + 1e-9) if size > 1 else 0

    def range_of(self, band):
        low = math.ceil(self.ratio ** band - 1e-9)
        while self.band(low) < band:
            low += 1
        while low > 1 and self.band(low - 1) >= band:
            low -= 1
        high = max(low, int(self.ratio ** (band + 1)))
        while self.band(high + 1) <= band:
            high += 1
        while high > low and self.band(high) > band:
            high -= 1
        return low, high

    def keys(self, values):
        """The index keys of a sorted set of hashes: of its own band, and of the band below if it has partners there."""
        out, size = [], len(values)
        if not size:
            return np.zeros(0, np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(values ^ np.uint64(_RANDOM)))))
        own = self.band(size)
        for band in range(own, -1, -1):
            low, high = self.range_of(band)
            if band < own and size > high * self.den // self.num:
                break
            most = high * (self.den - self.num) // self.num
            if most and low <= high:
                out.append(self._band_keys(values, total, band, *allocate(low, high, most)))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    @staticmethod
    def _band_keys(values, total, band, m, raised, spare):
        cuts = np.searchsorted(values, (np.arange(1, m, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // m)))
        cuts = np.concatenate(([0], cuts, [len(values)]))
        sizes = np.diff(cuts)
        place = W.mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 40 | 1 << 39))
        whole = total[cuts[1:]] - total[cuts[:-1]]
        keys = [whole + place]
        held = [sizes]
        if raised:
            segment = np.repeat(np.arange(raised), sizes[:raised])
            element = total[1:cuts[raised] + 1] - total[:cuts[raised]]
            keys.append(whole[segment] - element + place[segment])
            held.append(sizes[segment] - 1)
        keys, held = np.concatenate(keys), np.concatenate(held)
        tiny = (sizes[raised:] == 0).sum() + 2 * (sizes[:raised] <= 1).sum()
        if tiny <= spare:
            keys = keys[held > 0]
        return W.mix(keys)


def _sets(texts, n):
    """The sorted distinct shingles of each text."""
    for _, data, offsets in W.slices(texts):
        hashes, _, _, bounds = W.split_words(data, offsets)
        pieces, at = W.shingles(hashes, bounds, n)
        for a, b in zip(at[:-1], at[1:]):
            yield np.unique(pieces[a:b])


def _lists(values):
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values])))
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _signer(n, num, den):
    most = np.uint64(min(1.0, SAMPLE * (den - num) / den) * ((1 << 64) - 2048))

    @F.arrow_udf(T.StructType().add("n", T.LongType()).add("set_id", T.LongType()).add("some", T.ArrayType(T.LongType())))
    def sign(texts: pa.Array) -> pa.Array:
        sizes, ids, some = [], [], []
        for values in _sets(texts, n):
            sizes.append(len(values))
            ids.append(xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63))
            some.append(values[:np.searchsorted(values, most)])
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), _lists(some)], ["n", "set_id", "some"])
    return sign


def _key_reader(n, num, den):
    plan = Plan(num, den)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def read(texts: pa.Array) -> pa.Array:
        return _lists([plan.keys(values) for values in _sets(texts, n)])
    return read


def _set_reader(n):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def read(texts: pa.Array) -> pa.Array:
        return _lists(list(_sets(texts, n)))
    return read


@F.arrow_udf(T.LongType())
def shared_elements(left: pa.Array, right: pa.Array) -> pa.Array:
    """The size of the intersection of two arrays without repeated values."""
    a, b = np.asarray(left.flatten()), np.asarray(right.flatten())
    a_ends = np.concatenate(([0], np.cumsum(np.asarray(left.value_lengths()))))
    b_ends = np.concatenate(([0], np.cumsum(np.asarray(right.value_lengths()))))
    out = np.empty(len(left), np.int64)
    for i in range(len(left)):
        both = np.concatenate((a[a_ends[i]:a_ends[i + 1]], b[b_ends[i]:b_ends[i + 1]]))
        both.sort(kind="stable")
        out[i] = np.count_nonzero(both[1:] == both[:-1])
    return pa.array(out)


def _verified(pairs, sets, num, den):
    """The pairs (a, b) of set ids that reach the threshold."""
    left = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("right"))
    sized = pairs.join(left, "a").join(right, "b").withColumn("common", shared_elements("left", "right"))
    union = F.size("left") + F.size("right") - F.col("common")
    return sized.filter(F.col("common") * den >= union * num).select("a", "b")


def linked(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col="doc_id", text_col="text") -> DataFrame:
    """One row a row of `docs`: id, n_shingles, component_id (the smallest id reachable by links, its own included), text_id.

    Documents link when den * |A and B| >= num * |A or B| for their sets of shingles of n words; a document with fewer words
    has its whole sequence as one shingle; a null or empty text has none and links with nothing. Documents with equal
    sets are one class, linked throughout. Rows that repeat an id are documents of their own with that id. Null ids are
    no smallest id; a group of only null ids has a null component. An empty table gives no rows. Sets are compared as
    64-bit hashes of shingles and classes as 64-bit hashes of sets.

    A set links only if no more than 1 - num / den of its elements are held by no other set. Sets that exceed this already in a
    sample range of the universe are not indexed. No pairs within a group are made: each key's sets are compared with the
    smallest of them only, and links merge into components. Then sets leave of which too few elements are held
    by other components; those compared with all others of a key leave the key, and keys that several components still
    hold have further rounds of the same kind. What is not settled by then is compared in blocks of bounded size.
    """
    spark = docs.sparkSession
    with W.small_batches(spark), scratch_tables(spark):
        return stored(_linked(docs, n, num, den, id_col, text_col), keep=True)


def _linked(docs, n, num, den, id_col, text_col):
    slim, classes, able = _indexed(docs, n, num, den, id_col, text_col)
    members = _members(docs, able, n, num, den, id_col, text_col)
    stars = stored(members.filter("a < b").select("a", "b").distinct())
    wanted = stars.select(F.col("a").alias("set_id")).union(stars.select("b")).distinct()
    sets = _elements(docs, classes, wanted, n, id_col, text_col)
    links = stored(_verified(_near_sizes(stars, classes, num, den), sets, num, den))
    found = stored(components(links))
    left = stored(_unsettled(members.filter("a < b"), found))
    shared = stored(_shared_with_others(left, sets, num, den))
    left = left.join(shared.select(F.col("set_id").alias("b")), "b", "left_semi")
    for _ in range(STAR_ROUNDS):
        left = stored(_unsettled(left, found))
        if left.isEmpty():
            break
        pairs = left.filter("a < b AND of_a <> component").select("a", "b").distinct()
        new = stored(_verified(_near_sizes(pairs, classes, num, den), sets, num, den))
        left = left.filter("a < b")
        if not new.isEmpty():
            links = links.unionByName(new)
            found = components(links)
    more = _links_in_bundles(_bundles(left, found), shared, num, den)
    found = components(links.unionByName(more))
    label = F.coalesce("component", "set_id")
    placed = classes.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", label)
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = stored(placed.join(smallest, "component").select("set_id", "component_id"))
    return slim.join(placed, "set_id", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_id")


def _indexed(docs, n, num, den, id_col, text_col):
    """(doc_id, text_id, n, set_id) of all documents, the classes of equal sets, and a document of each set that can link."""
    with scratch_tables(docs.sparkSession):  # the sample of all sets goes as soon as it is counted
        signed = stored(docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_id"),
            _signer(n, num, den)(text_col).alias("s")).select("doc_id", "text_id", "s.*"))
        slim = stored(signed.select("doc_id", "text_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")), keep=True)
        classes = stored(slim.filter("n > 0").groupBy("set_id").agg(
            F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_id")).alias("row"), F.max("n").alias("n")), keep=True)
        own = signed.filter("n > 0").select("set_id", F.explode("some").alias("e")).groupBy("e").agg(
            F.min("set_id").alias("set_id"), F.max("set_id").alias("z")).filter("set_id = z")
        own = own.groupBy("set_id").agg(F.count(F.lit(1)).alias("own"))
        able = stored(classes.join(own, "set_id", "left").filter(
            F.coalesce("own", F.lit(0)) * den <= F.col("n") * (den - num)).select("set_id", "row"), keep=True)
    return slim, classes, able


def _members(docs, able, n, num, den, id_col, text_col):
    """(key, a, b): sets of keys with several; a is the smallest. Keys are made for sets that can link only, from texts that are read again."""
    with scratch_tables(docs.sparkSession):
        once = stored(_texts_of(docs, able, id_col, text_col).select("set_id", _key_reader(n, num, den)("_text").alias("keys")))
        keys = once.select("set_id", F.explode("keys").alias("key"))
        common = keys.groupBy("key").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).filter("a < z")
        return stored(keys.join(common.select("key", "a"), "key").select("key", "a", F.col("set_id").alias("b")), keep=True)


def _near_sizes(pairs, classes, num, den):
    """The pairs whose sizes allow the threshold."""
    sized = pairs.join(classes.select(F.col("set_id").alias("a"), F.col("n").alias("na")), "a").join(
        classes.select(F.col("set_id").alias("b"), F.col("n").alias("nb")), "b")
    return sized.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b")


def _texts_of(docs, rows, id_col, text_col):
    """(set_id, _text) of the document `row` of each set."""
    picked = rows.select("set_id", F.coalesce("row.doc_id", F.lit(0)).alias("_id"), F.col("row.text_id").alias("_tid"))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"),
                        F.xxhash64(text_col).alias("_tid"), F.col(text_col).alias("_text"))
    return lookup_join(texts, picked, ["_id", "_tid"], "inner").select("set_id", "_text")


def _elements(docs, classes, wanted, n, id_col, text_col):
    """(set_id, elements) of the wanted classes, read again from one document of each."""
    found = _texts_of(docs, stored(classes.join(wanted, "set_id")), id_col, text_col)
    return stored(found.select("set_id", _set_reader(n)("_text").alias("elements")))


def _unsettled(members, found):
    """(key, a, of_a, b, component) of keys that hold more than one component; a is the smallest set of the key, of_a its own."""
    label = found.withColumnRenamed("node", "b")
    placed = members.select("key", "b").join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                      F.min(F.struct("b", "component")).alias("least")).filter("lo < hi")
    return placed.join(mixed.select("key", F.col("least.b").alias("a"), F.col("least.component").alias("of_a")), "key").select(
        "key", "a", "of_a", "b", "component")


def _shared_with_others(members, sets, num, den):
    """(set_id, n, elements): elements that several components hold, of the sets that have enough of them for a link."""
    inside = members.select(F.col("b").alias("set_id"), "component").distinct()
    held = sets.join(inside, "set_id").select("set_id", "component", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    both = held.groupBy("e").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("e")
    return held.join(both, "e").groupBy("set_id", "n").agg(F.collect_list("e").alias("elements")).filter(
        F.size("elements") * den >= F.col("n") * num)


def _bundles(members, found):
    """(set_id, component, bundle): sets of keys that more than one component holds; such keys' sets are one bundle."""
    placed = stored(_unsettled(members, found).select("a", "b", "component").distinct())
    bundle = components(placed.select("a", "b"))
    sets = placed.select(F.col("b").alias("node"), "component").distinct()
    return stored(sets.join(bundle.withColumnRenamed("component", "bundle"), "node").withColumnRenamed("node", "set_id"))


def _spanning(linked, components_):
    """Links (row, column) that join what the boolean matrix and equal components hold together, one fewer than rows at most."""
    n = len(components_)
    together = linked | (components_[:, None] == components_[None, :])
    todo, out = np.ones(n, bool), []
    for root in range(n):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            row = front.pop()
            new = np.flatnonzero(together[row] & todo)
            todo[new] = False
            front += new.tolist()
            out += [(row, c) for c in new.tolist() if linked[row, c]]
    return out


def _common_counts(values, ends):
    """The sizes of all intersections of a block's sets: products of 0/1 matrices, some shared elements at a time."""
    n = len(ends) - 1
    row = np.repeat(np.arange(n), np.diff(ends))
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts = np.zeros((n, n), np.float32)
    width = max(1, COMPARE_CELLS // max(1, n))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        counts += part @ part.T
    return counts


def _block_links(num, den):
    def compare(table: pa.Table) -> pa.Table:
        ids, labels = np.asarray(table.column("set_id")), np.asarray(table.column("component"))
        sizes = np.asarray(table.column("n")).astype(np.float64)
        lists = table.column("elements").combine_chunks()
        ends = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths())))).astype(np.int64)
        common = _common_counts(np.asarray(lists.flatten()), ends)
        union = sizes[:, None] + sizes[None, :] - common
        found = _spanning(common * np.float64(den) >= union * num, labels)
        a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return pa.table({"a": ids[a], "b": ids[b]})
    return compare


def _links_in_bundles(bundles, sets, num, den, block=BLOCK_ELEMENTS, block_sets=BLOCK_SETS):
    """Links between components, found by comparing all sets of a bundle block by block.

    `sets` holds the size n of each set and its elements that other components may hold. A bundle with more than `block` elements
    or `block_sets` sets is dealt into blocks by hash, and each pair of blocks is a group of its own, so a task holds the sets
    of two blocks at most. Of its links a group returns a spanning forest.
    """
    held = bundles.join(sets, "set_id")
    parts = held.groupBy("bundle").agg(F.greatest(
        F.ceil(F.sum(F.size("elements")) / block), F.ceil(F.count(F.lit(1)) / block_sets)).cast("int").alias("parts"))
    held = held.join(parts, "bundle").withColumn("part", F.pmod(F.xxhash64("set_id", F.lit("part")), "parts").cast("int"))
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = held.withColumn("other", other).withColumn("p", F.least("part", "other")).withColumn(
        "q", F.greatest("part", "other"))
    # A pair of different blocks holds both; a block alone is compared in its pair with the next one.
    dealt = dealt.filter("parts = 1 OR p <> q")
    return dealt.groupBy("bundle", "p", "q").applyInArrow(
        lambda table: _block_links(num, den)(table), "a long, b long")


def one_of_each_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col="doc_id",
                      text_col="text") -> DataFrame:
    """`docs` without the rows that `linked` puts into the component of a smaller id; all columns stay.

    Rows without words, and rows without an id, stay. Of rows that repeat an id and a text, one stays, where there are any.
    """
    found = stored(linked(docs, n, num, den, id_col, text_col).select(
        F.col(id_col).alias("_id"), F.col("text_id").alias("_tid"), "n_shingles", "component_id"))
    gone = stored(found.filter("n_shingles > 0 AND _id IS NOT NULL AND component_id <> _id").select("_id", "_tid").distinct())
    again = found.filter("n_shingles > 0 AND _id IS NOT NULL").groupBy("_id", "_tid").count().filter("count > 1")
    keyed = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_tid", F.xxhash64(text_col))
    left = lookup_join(keyed, gone, ["_id", "_tid"], "left_anti")
    if not again.isEmpty():
        again = stored(again.select("_id", "_tid"))
        left = lookup_join(left, again, ["_id", "_tid"], "left_anti").unionByName(
            lookup_join(left, again, ["_id", "_tid"], "left_semi").dropDuplicates(["_id", "_tid"]))
    return left.select(*docs.columns)
