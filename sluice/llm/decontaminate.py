"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from sluice.llm import words as W
from sluice.llm.shared import Shared

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-3
BLOCK_BYTES = 16 << 20
SMALLEST = 16
_HITS = T.ArrayType(T.StructType().add("item_id", T.LongType()).add("containment", T.DoubleType())
                    .add("start_word", T.IntegerType()).add("end_word", T.IntegerType()))


class Index:
    """Items by size band, each with its shingles and the minima of its band's hash functions.

    An item of a band has more than half of `top` and at most `top` shingles. Documents are searched in windows of 2 * top
    shingles that start every top shingles, so each run of top shingles lies in one. An item of which the share
    `threshold` is in a window has a Jaccard similarity of at least `likeness` with it; the number of hash
    functions is chosen from it so that an item shares no minimum with the window with a probability of `miss` at most.
    """

    def __init__(self, items, threshold=THRESHOLD, n=SHINGLE, miss=MISS, seed=11):
        self.threshold, self.n = threshold, n
        self.ids = [i for i, _ in items]
        self.sets, bands = [], {}
        for i, (_, text) in enumerate(items):
            data, offsets = W.text_bytes(W.texts_of([text]))
            hashes, _, _, bounds = W.split_words(data, offsets)
            pieces, _ = W.shingles(hashes, bounds, n, short=False)
            self.sets.append(np.unique(pieces))
            if len(self.sets[i]):
                top = max(SMALLEST, 1 << (len(self.sets[i]) - 1).bit_length())
                bands.setdefault(top, []).append(i)
        rng = np.random.default_rng(seed)
        self.bands = []
        for top, members in sorted(bands.items()):
            least = min(len(self.sets[i]) for i in members)
            likeness = threshold * least / (2 * top + (1 - threshold) * least)
            tries = math.ceil(math.log(miss) / math.log(1 - likeness))
            minima = []
            for factor in rng.integers(1, 1 << 63, tries, dtype=np.uint64) * np.uint64(2) + np.uint64(1):
                values = np.array([(self.sets[i] * factor).min() for i in members], np.uint64)
                order = np.argsort(values)
                seen = np.zeros(1 << 16, bool)
                seen[values >> np.uint64(48)] = True
                minima.append((factor, values[order], np.array(members)[order], seen))
            self.bands.append((top, minima))

    def candidates(self, pieces, bounds):
        """{(document, first shingle, last shingle, item)} of windows that share a minimum with an item."""
        found = set()
        for top, minima in self.bands:
            sizes = np.diff(bounds)
            blocks = -(-sizes // top)
            first = np.concatenate(([0], np.cumsum(blocks)))
            doc = np.repeat(np.arange(len(sizes)), blocks)
            if not len(doc):
                return found
            starts = bounds[:-1][doc] + (np.arange(len(doc)) - first[:-1][doc]) * top
            followed = np.append(doc[1:] == doc[:-1], False)
            for factor, values, members, seen in minima:
                low = np.minimum.reduceat(pieces * factor, starts)
                low[:-1] = np.where(followed[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                for w in np.flatnonzero(seen[low >> np.uint64(48)]):
                    a, b = np.searchsorted(values, low[w]), np.searchsorted(values, low[w], "right")
                    for item in members[a:b]:
                        d = doc[w]
                        found.add((int(d), int(starts[w]), int(min(starts[w] + 2 * top, bounds[d + 1])), int(item)))
        return found

    def _hits(self, pieces, item):
        """(places of an item's shingles, the share of them that is there)."""
        wanted = self.sets[item]
        place = np.minimum(np.searchsorted(wanted, pieces), len(wanted) - 1)
        hit = wanted[place] == pieces
        return np.flatnonzero(hit), len(np.unique(place[hit])) / len(wanted)

    def search(self, data, offsets):
        """{document: {item: (containment, first word, last word)}}, verified by exact containment in the document.

        The words are those of the best window, or of all parts where no window holds enough of the item.
        """
        hashes, _, _, word_bounds = W.split_words(data, offsets)
        pieces, bounds = W.shingles(hashes, word_bounds, self.n, short=False)
        out = {}
        if not len(pieces):
            return out
        best = {}
        for d, a, b, item in sorted(self.candidates(pieces, bounds)):
            places, share = self._hits(pieces[a:b], item)
            if share > best.get((d, item), (-1.0,))[0]:
                best[d, item] = share, places + a
        for (d, item), (share, places) in best.items():
            # Parts of an item may stand far apart, so what counts is the whole document.
            whole, contained = self._hits(pieces[bounds[d]:bounds[d + 1]], item)
            if contained >= self.threshold:
                at = (places if share >= self.threshold else whole + bounds[d]) - bounds[d]
                out.setdefault(d, {})[item] = (contained, int(at[0]), int(at[-1]) + self.n)
        return out


def item_blocks(items: DataFrame, id_col="item_id", text_col="text", block_bytes: int = BLOCK_BYTES):
    """The items in blocks of at most about `block_bytes`, each a list of (id, text)."""
    known = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        part = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield [(r["id"], r["text"]) for r in part.distinct().collect()]


def with_hits(docs: DataFrame, items: DataFrame, id_col="item_id", text_col="text", item_text_col="text",
              threshold: float = THRESHOLD, n: int = SHINGLE, hits_col="hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with `hits`: the items found in each whole text, as (item_id, containment, start_word, end_word).

    An item is found if the document holds at least `threshold` of its different shingles of n words, in one place or in parts.
    Words are runs of bytes other than ASCII white space, A-Z as a-z. Items with fewer than n words, or null text, are never
    found; a null text has no hits. Repeated items are found once for each id; items with a null id have null there.
    Extra columns stay; one named like `hits_col` is replaced. No rows are shuffled. Items are broadcast in blocks of at
    most `block_bytes` of text; each block is one more expression over the documents, so any number of items is searched.
    """
    spark = docs.sparkSession
    hits = None
    for block in item_blocks(items, id_col, item_text_col, block_bytes):
        shared = Shared(spark, Index(block, threshold, n))
        found = _finder(shared)(text_col)
        hits = found if hits is None else F.concat(hits, found)
    return docs.withColumn(hits_col, hits)


def _finder(shared):
    @F.arrow_udf(_HITS)
    def find(texts: pa.Array) -> pa.Array:
        index, rows = shared.value, [None] * len(texts)
        for first, data, offsets in W.slices(texts):
            for d, found in index.search(data, offsets).items():
                rows[first + d] = [
                    {"item_id": index.ids[i], "containment": c, "start_word": a, "end_word": b}
                    for i, (c, a, b) in sorted(found.items())]
        return pa.array([r or [] for r in rows], pa.list_(pa.struct([
            ("item_id", pa.int64()), ("containment", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())])))
    return find


def contaminated(docs: DataFrame, items: DataFrame, keep: list, **options) -> DataFrame:
    """One row for each document and item found in it: the columns `keep`, then the columns of a hit."""
    return with_hits(docs, items, hits_col="_hits", **options).select(*keep, F.inline("_hits"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no item is found, unchanged."""
    return with_hits(docs, items, hits_col="_hits", **options).filter(F.size("_hits") == 0).drop("_hits")
