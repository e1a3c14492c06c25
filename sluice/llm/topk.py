"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_QUERIES = 8192
BLOCK_BYTES = 32 << 20
TILE_ROWS = 4096
FAN_IN = 32
_EXACT = 2.0 ** 53
_LISTS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x). Rows with a null id, or with a vector that is null
    or holds a null or non-finite component, are left out."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array):
    """One matrix for each length of vector among the rows: (rows, matrix)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    values, ends = np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(sizes)))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[ends[rows][:, None] + np.arange(size)].astype(np.int64)


def _products(a, b):
    """Exact integer inner products: in double precision where every partial sum is below 2**53."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(scores, ids, own, k):
    """Positions (query, column) of each query's k best columns: partial selection, ties kept whole, then cut."""
    scores = np.where(own, np.iinfo(np.int64).min, scores)
    if scores.shape[1] > k:
        n = scores.shape[1]
        bar = np.partition(scores, n - k, axis=1)[:, n - k:n - k + 1]
        q, c = np.nonzero((scores >= bar) & ~own)
    else:
        q, c = np.nonzero(~own)
    order = np.lexsort((ids[c], -scores[q, c], q))
    q, c = q[order], c[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], c[rank < k]


def _searcher(blocks, k):
    def search(batches):
        best = {}
        for batch in batches:
            all_ids = np.asarray(batch.column("vec_id"))
            for rows, shard in _matrix(batch.column("v")):
                for first in range(0, len(rows), TILE_ROWS):
                    tile, ids = shard[first:first + TILE_ROWS], all_ids[rows[first:first + TILE_ROWS]]
                    for b, (query_ids, queries) in enumerate(blocks.value):
                        if queries.shape[1] != tile.shape[1]:
                            continue
                        scores = _products(queries, tile)
                        q, c = _best(scores, ids, query_ids[:, None] == ids[None, :], k)
                        found = (q, ids[c], scores[q, c])
                        if b in best:
                            q, i, s = (np.concatenate(x) for x in zip(best[b], found))
                            order = np.lexsort((i, -s, q))
                            q, i, s = q[order], i[order], s[order]
                            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                            found = q[keep], i[keep], s[keep]
                        best[b] = found
        for b, (q, i, s) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks.value[b][0][q]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])
    return search


def _blocks(rows, size):
    """Query rows by length of vector, as (ids, matrix) blocks of bounded size."""
    by_length = {}
    for r in rows:
        by_length.setdefault(len(r["v"]), []).append(r)
    for length, group in by_length.items():
        step = max(1, min(BLOCK_QUERIES, size // (8 * max(1, length))))
        for i in range(0, len(group), step):
            part = group[i:i + step]
            yield (np.array([r["vec_id"] for r in part], np.int64),
                   np.array([r["v"] for r in part], np.int64).reshape(len(part), length))


def _merge(lists, groups, k):
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank (from 1), vec_id, score.

    Both sides are (vec_id, v) as `quantised` gives them. A candidate with the query's own id is the query
    itself. Ties go to the smaller vec_id; a query with fewer candidates returns all of them, one without
    candidates returns none. Only vectors of equal length have a product. A repeated candidate row counts as
    often as it stands there; a repeated query id with one vector is one query. Extra columns are ignored.

    Queries are read in groups of at most `block_bytes`, one bounded broadcast and one pass over the shards
    each. A task multiplies query blocks with tiles of its shard and keeps k rows a query; the lists of all
    tasks are merged `FAN_IN` shards at a time.
    """
    spark = vectors.sparkSession
    shape = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    groups = max(1, -(-shape["n"] * max(1, shape["d"]) * 8 // block_bytes))
    asked = queries.select("vec_id", "v").distinct()
    results = []
    for g in range(groups):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g) if groups > 1 else asked
        blocks = spark.sparkContext.broadcast(list(_blocks(part.collect(), block_bytes)))
        lists = vectors.select("vec_id", "v").mapInArrow(_searcher(blocks, k), _LISTS)
        results.append(lists.withColumn("shard", F.spark_partition_id() % FAN_IN))
    merged = results[0]
    for other in results[1:]:
        merged = merged.unionByName(other)
    merged = _merge(merged, ["query_id", "shard"], k).drop("rank", "shard")
    return _merge(merged, ["query_id"], k).select("query_id", "rank", "vec_id", "score")
