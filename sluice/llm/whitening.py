"""Whitening of embeddings: the spectrum of the covariance grows by rank-one updates, in tasks and between them.

An update adds v v^T to a matrix of which the eigenvalues and eigenvectors are known. Its new eigenvalues are the roots of a
secular equation, one between each two old ones; parts that v does not touch, or that are equal, are deflated, which
means that they stay as they are. Rayleigh-Ritz over all rows then removes what rounding has left.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from sluice.functions.joins import scratch_tables, stored

COMPONENTS = 16
BLOCK_ROWS = 2048
FAN_IN = 8
# Directions with less than this part of the largest variance are rounding, not data.
LEAST = 1e-11
_EPS = np.finfo(float).eps
_LARGEST = 2.0 ** 53


def secular_roots(poles, weights):
    """The roots of 1 + sum(weights / (poles - x)), as (nearest pole, offset from it) so that differences stay exact.

    Poles ascend and differ; weights are positive. Root j lies between poles j and j + 1, the last one within
    sum(weights) of the last pole. All roots are refined together, by fitting two simple poles, and by halving where that leaves the bracket.
    """
    m = len(poles)
    gaps = np.append(np.diff(poles), weights.sum())
    middle = poles + gaps / 2
    value = 1 + (weights[:, None] / (poles[:, None] - middle)).sum(0)
    right = (value < 0) & (np.arange(m) < m - 1)
    nearest = np.arange(m) + right
    delta = poles[:, None] - poles[nearest]
    low = np.where(right, -gaps / 2, np.where(value < 0, gaps / 2, 0.0))
    high = np.where(right, 0.0, np.where(value < 0, gaps, gaps / 2))
    x = (low + high) / 2
    left = np.arange(m)[:, None] <= np.arange(m)
    ahead = np.append(delta[1:, :-1].diagonal(), gaps[-1])
    for _ in range(100):
        inverse = 1 / (delta - x)
        terms = weights[:, None] * inverse
        f = 1 + terms.sum(0)
        done = np.abs(f) <= 4 * _EPS * (1 + np.abs(terms).sum(0))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        slopes = terms * inverse
        before, after = (slopes * left).sum(0), (slopes * ~left).sum(0)
        p, q = delta.diagonal() - x, ahead - x
        a = (p + q) * f - p * q * (before + after)
        b = p * q * f
        c = f - p * before - q * after
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        wrong = ~(np.isfinite(new) & (new > low) & (new < high))
        new = np.where(wrong, (low + high) / 2, new)
        still = (new == low) | (new == high) | done
        x = np.where(done, x, new)
        if still.all():
            break
    return nearest, x


def updated(values, basis, vector):
    """Eigenvalues (ascending) and eigenvectors of basis * values * basis^T + vector * vector^T."""
    z = basis.T @ vector
    size = float(z @ z)
    if size == 0:
        return values, basis
    tolerance = 8 * _EPS * max(values[-1], size)
    basis = basis.copy()
    # Equal eigenvalues: turn their eigenvectors so that only the last one meets the vector.
    first = 0
    while first < len(values):
        last = int(np.searchsorted(values, values[first] + tolerance, "right")) - 1
        if last > first:
            part = z[first:last + 1]
            length = np.sqrt(part @ part)
            mirror = part.copy()
            mirror[-1] += length if part[-1] >= 0 else -length
            if (norm := mirror @ mirror) > 0:
                columns = basis[:, first:last + 1]
                basis[:, first:last + 1] = columns - np.outer(columns @ mirror, mirror) * (2 / norm)
                z[last] = -length if part[-1] >= 0 else length
                z[first:last] = 0
        first = last + 1
    touched = np.flatnonzero(np.abs(z) * np.sqrt(size) > tolerance)
    if not len(touched):
        return values, basis
    poles, parts = values[touched], z[touched]
    nearest, offset = secular_roots(poles, parts * parts)
    away = (poles[:, None] - poles[nearest]) - offset
    m = len(poles)
    # The vector for which the computed roots are exact, so that eigenvectors are orthogonal to rounding.
    steps = poles[None, :] - poles[:, None]
    ratio = np.ones((m, m))
    ratio[:, :-1] = np.where(np.arange(m - 1) < np.arange(m)[:, None], steps[:, :-1], steps[:, 1:])
    exact = np.sqrt(np.abs((-away / ratio).prod(1))) * np.where(parts < 0, -1.0, 1.0)
    turn = exact[:, None] / away
    turn /= np.sqrt((turn * turn).sum(0))
    values = values.copy()
    values[touched] = poles[nearest] + offset
    basis[:, touched] = basis[:, touched] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Of some integer vectors: their number, sums, and the eigenvalues and eigenvectors of their centred scatter."""

    def __init__(self, size: int):
        self.n, self.sums = 0, [0] * size
        self.values, self.basis = np.zeros(size), np.eye(size)

    def add(self, rows) -> None:
        """Add integer rows. A block is centred exactly and turned into a triangle of as many rows as there are dimensions
        at most, with the same scatter; each row of it is one update, and the shift of the means is one more."""
        n, sums = len(rows), rows.sum(0)
        if not n:
            return
        centred = (rows * n - sums) / n
        if n > rows.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        for row in centred:
            self.values, self.basis = updated(self.values, self.basis, row)
        self._shift(n, [int(s) for s in sums])

    def merge(self, other: "Spectrum") -> None:
        """Add what another spectrum has seen: one update for each of its directions, and one for the shift of the means."""
        for value, direction in zip(other.values, other.basis.T):
            if value > 0:
                self.values, self.basis = updated(self.values, self.basis, direction * np.sqrt(value))
        self._shift(other.n, other.sums)

    def _shift(self, n, sums):
        if self.n and n:
            apart = np.array([(a * n - b * self.n) / (self.n * n) for a, b in zip(self.sums, sums)])
            self.values, self.basis = updated(
                self.values, self.basis, apart * np.sqrt(self.n * n / (self.n + n)))
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums)]

    def row(self):
        return pa.table({"n": pa.array([self.n], pa.int64()), "sums": pa.array([self.sums], pa.list_(pa.int64())),
                         "spectrum": pa.array([np.concatenate((self.values, self.basis.ravel()))], pa.list_(pa.float64()))})

    @classmethod
    def of(cls, n, sums, spectrum):
        out = cls(len(sums))
        out.n, out.sums = n, list(sums)
        out.values = np.array(spectrum[:len(sums)])
        out.basis = np.array(spectrum[len(sums):]).reshape(len(sums), -1)
        return out


class Whitening:
    """`components` are columns, by falling `variances`; the fit had `n` vectors with `sums`, and a total variance `total`."""

    def __init__(self, n, sums, components, variances, total):
        self.n, self.sums = n, np.array(sums, np.int64)
        self.components, self.variances, self.total = components, variances, total

    def centred(self, rows):
        return (rows * self.n - self.sums) / self.n

    def whitened(self, rows):
        return self.centred(rows) @ (self.components / np.sqrt(self.variances))

    def deviations(self, rows):
        """The sum over dimensions of (n * x - sum)^2 of each row; None where it takes more than 64 bits."""
        apart = rows * self.n - self.sums
        most = int(np.abs(apart).max(initial=0))
        if most * most * max(1, rows.shape[1]) < 1 << 63:
            return pa.array((apart * apart).sum(1), pa.int64())
        exact = [sum(int(v) * int(v) for v in row) for row in apart]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def quantised(df: DataFrame, vec_col="embedding", scale: int = 64, offset: int = 1_000_000, out_col="x") -> DataFrame:
    """`df` with floor(scale * c) + offset of each component, without rows whose vector takes no part.

    A vector takes no part if it is null or empty, or holds a null, non-finite or huge entry (beyond 2**53 when scaled).
    """
    scaled = F.transform(vec_col, lambda c: c.cast("double") * scale)
    odd = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= _LARGEST))
    kept = df.filter(F.col(vec_col).isNotNull()).filter((F.size(vec_col) > 0) & ~odd)
    return kept.withColumn(out_col, F.transform(scaled, lambda c: F.floor(c).cast("long") + offset))


def matrix(column, size: int):
    """The rows of an Arrow list column of integers as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, size).astype(np.int64)


def fit(vectors: DataFrame, col="x", components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> Whitening | None:
    """The whitening of the different integer vectors of a column that all have the same length; None if there are none.

    Each task folds its vectors into one spectrum; spectra are merged `FAN_IN` at a time, in rounds, until one is left.
    Its eigenvectors are the start of one Rayleigh-Ritz step over all vectors. Only d x d numbers reach the driver.
    Components without variance are left out.
    """
    with scratch_tables(vectors.sparkSession):
        return _fit(vectors, col, components, block_rows)


def _fit(vectors, col, components, block_rows):
    each = stored(vectors.select(F.col(col).alias("x")).distinct())
    size = each.select(F.size("x").alias("d")).first()
    if size is None:
        return None
    size = size["d"]
    schema = "n long, sums array<long>, spectrum array<double>"

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Spectrum(size)
        for batch in batches:
            rows = matrix(batch["x"], size)
            for i in range(0, len(rows), block_rows):
                seen.add(rows[i:i + block_rows])
        if seen.n:
            yield from seen.row().to_batches()

    def merged(table: pa.Table) -> pa.Table:
        rows = [Spectrum.of(r["n"], r["sums"], r["spectrum"]) for r in table.to_pylist()]
        rows.sort(key=lambda s: (-s.n, s.sums))
        for other in rows[1:]:
            rows[0].merge(other)
        return rows[0].row()

    parts = stored(each.mapInArrow(spectra, schema).withColumn("part", F.monotonically_increasing_id()))
    while (left := parts.count()) > 1:
        groups = -(-left // FAN_IN)
        grouped = parts.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups))) if groups > 1 else \
            parts.withColumn("group", F.lit(0))
        parts = stored(grouped.groupBy("group").applyInArrow(merged, schema).withColumn(
            "part", F.monotonically_increasing_id()))
    whole = Spectrum.of(*parts.select("n", "sums", "spectrum").first())
    start = np.linalg.qr(whole.basis)[0]
    rough = Whitening(whole.n, whole.sums, start, np.ones(size), 0.0)
    covariance = _scatter(each, size, lambda rows: rough.centred(rows) @ start, size, block_rows) / whole.n
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
    values, basis = values[::-1], (start @ turn)[:, ::-1]
    count = min(components, int((values > max(values[0], 0) * LEAST).sum())) if values[0] > 0 else 0
    basis = basis[:, :count]
    largest = np.abs(basis).argmax(0)
    basis = basis * np.where(basis[largest, np.arange(count)] < 0, -1.0, 1.0)
    model = Whitening(whole.n, whole.sums, basis, values[:count], float(np.trace(covariance)))
    again = _scatter(each, size, lambda rows: np.column_stack((model.whitened(rows), np.ones(len(rows)))), count + 1, block_rows)
    means = again[-1, :-1] / model.n
    error = np.abs(again[:-1, :-1] / model.n - np.outer(means, means) - np.eye(count))
    model.identity_error = float(error.max(initial=0.0))
    return model


def _scatter(each, size, projected, width, block_rows):
    """The sum of y^T y over all rows, y being `projected` of them: one matrix a task, added by Spark."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = matrix(batch["x"], size)
            for i in range(0, len(rows), block_rows):
                y = projected(rows[i:i + block_rows])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["part"])

    added = each.mapInArrow(sums, "part array<double>").select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(
        F.sum("v").alias("v")).collect()
    out = np.zeros(width * width)
    for r in added:
        out[r["i"]] = r["v"]
    return out.reshape(width, width)


def whitened(vectors: DataFrame, model: Whitening, col="x", out_col="whitened", deviation_col="deviation") -> DataFrame:
    """`vectors` with the whitened components of each row as an array of doubles, and its exact `deviation`.

    The deviation is null where it takes more than 64 bits. Columns of these names are replaced.
    """
    size = len(model.sums)
    result = T.StructType().add("whitened", T.ArrayType(T.DoubleType())).add("deviation", T.LongType())

    @F.arrow_udf(result)
    def project(column: pa.Array) -> pa.Array:
        rows = matrix(column, size)
        y = model.whitened(rows)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel(), pa.float64()))
        return pa.StructArray.from_arrays([lists, model.deviations(rows)], ["whitened", "deviation"])
    return vectors.withColumn("_projected", project(col)).withColumns(
        {out_col: F.col("_projected.whitened"), deviation_col: F.col("_projected.deviation")}).drop("_projected")


def components(df: DataFrame, keep: list, vec_col="embedding", scale: int = 64, offset: int = 1_000_000,
               count: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row and component: `keep`, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors are quantised, see `quantised`; of several lengths the most frequent one takes part (of equally frequent
    ones the shortest). The fit sees each different vector once. Repeated rows and null ids are rows of their own. Where
    no component has variance (an empty table, or a single vector), the result is empty.
    """
    valid = quantised(df.select(*keep, vec_col), vec_col, scale, offset, "_x")
    length = valid.groupBy(F.size("_x").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    valid = valid.filter(F.size("_x") == (length["d"] if length else 0))
    model = fit(valid, "_x", count, block_rows)
    if model is None or not len(model.variances):
        model = Whitening(1, [0] * (length["d"] if length else 1), np.zeros((length["d"] if length else 1, 0)), np.zeros(0), 1.0)
        model.identity_error = 0.0
    explained = F.array(*(F.lit(float(v / model.total)) for v in model.variances)).cast("array<double>")
    rows = whitened(valid, model, "_x", "_whitened", "_deviation")
    return rows.select(
        *keep, F.col("_deviation").alias("deviation"), F.posexplode("_whitened").alias("_at", "whitened")).select(
        *keep, (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("_at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
