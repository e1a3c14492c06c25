"""Quality of documents: regularised quadratic discriminant analysis of document statistics."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from sluice.functions.joins import lookup_join, scratch_tables, stored
from sluice.llm import words as W
from sluice.llm.shared import Shared

SHRINKAGE = 0.1
RIDGE = 0.02
BATCH_BYTES = 8 << 20
FEATURES = ("log_words", "log_bytes", "word_length", "word_spread", "upper", "digit", "stop", "comma", "bang",
            "bar", "symbol", "space", "line", "high", "distinct", "echo", "repeated", "log_line_words")
_N = len(FEATURES)
_CLIP = 6.0
_KIND = np.full(256, 7, np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 0, 8, 9
for _kind, _chars in ((2, b".?;:"), (3, b","), (4, b"!"), (5, b"|"), (6, b" \t\v\f\r"), (10, b"\n")):
    _KIND[list(_chars)] = _kind


def _distinct(values, bounds):
    """How many different values each document has."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keyed = values ^ W.mix(doc.astype(np.uint64))
    order = np.argsort(keyed)
    keyed, doc = keyed[order], doc[order]
    new = np.ones(len(keyed), bool)
    new[1:] = keyed[1:] != keyed[:-1]
    return np.bincount(doc[new], minlength=len(bounds) - 1)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text: logarithms of sizes, and of shares with a small floor."""
    out = np.zeros((len(column), _N))
    for first, data, offsets in W.slices(column):
        n = len(offsets) - 1
        sizes = np.diff(offsets).astype(float)
        kinds = np.bincount(np.repeat(np.arange(n) * 11, np.diff(offsets)) + _KIND[data], minlength=n * 11).reshape(n, 11)
        hashes, starts, ends, bounds = W.split_words(data, offsets)
        count = np.diff(bounds).astype(float)
        lengths = (ends - starts).astype(float)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        some = np.maximum(count, 1)
        mean = np.bincount(doc, lengths, n) / some
        spread = np.sqrt(np.maximum(np.bincount(doc, lengths ** 2, n) / some - mean ** 2, 0))
        echo = np.zeros(len(hashes))
        echo[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        pieces, at = W.shingles(hashes, bounds, 3)
        shingles = np.maximum(np.diff(at), 1)
        share = lambda k: np.log(kinds[:, k] / np.maximum(sizes, 1) + 1e-3)
        out[first:first + n] = np.stack([
            np.log1p(count), np.log1p(sizes), mean, np.log1p(spread), share(0), share(1), share(2), share(3), share(4),
            share(5), share(7), share(6), share(10), share(9), np.log(_distinct(hashes, bounds) / some + 1e-2),
            np.log(np.bincount(doc, echo, n) / some + 1e-2), np.log(1.01 - _distinct(pieces, at) / shingles),
            np.log1p(count / (kinds[:, 10] + 1))], axis=1)
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def document_statistics(texts: pa.Array) -> pa.Array:
    rows = statistics(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * _N, pa.int32()), pa.array(rows.ravel()))


def _sums(batches):
    totals = {}
    for batch in batches:
        labels = np.asarray(batch.column("label"))
        values = np.asarray(batch.column("stats").flatten()).reshape(-1, _N)
        for label in (0, 1):
            rows = values[labels == label]
            part = np.concatenate(([len(rows)], rows.sum(0), (rows.T @ rows).ravel()))
            totals[label] = totals.get(label, 0) + part
    for label, part in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([label], pa.int32()), pa.array([part.tolist()], pa.list_(pa.float64()))], ["label", "part"])


class Discriminant:
    """Two Gaussian classes with shrunken covariances, kept as means and inverse Cholesky factors."""

    def __init__(self, moments, shrinkage=SHRINKAGE, ridge=RIDGE):
        sums = [np.asarray(moments.get(c, np.zeros(1 + _N + _N * _N))) for c in (0, 1)]
        self.counts = [s[0] for s in sums]
        self.fitted = min(self.counts) >= 2
        if not self.fitted:
            return
        total = sums[0] + sums[1]
        self.centre = total[1:1 + _N] / total[0]
        second = total[1 + _N:].reshape(_N, _N) / total[0]
        self.scale = np.sqrt(np.maximum(np.diag(second) - self.centre ** 2, 1e-8))
        means, spreads = [], []
        for s in sums:
            mean = s[1:1 + _N] / s[0]
            spread = s[1 + _N:].reshape(_N, _N) / s[0] - np.outer(mean, mean)
            means.append((mean - self.centre) / self.scale)
            spreads.append(spread / np.outer(self.scale, self.scale))
        pooled = (self.counts[0] * spreads[0] + self.counts[1] * spreads[1]) / sum(self.counts)
        self.classes = []
        for mean, spread in zip(means, spreads):
            covariance = (1 - shrinkage) * spread + shrinkage * pooled
            covariance = (1 - ridge) * covariance + ridge * np.trace(covariance) / _N * np.eye(_N)
            factor = np.linalg.cholesky(covariance + 1e-9 * np.eye(_N))
            self.classes.append((mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum()))
        self.prior = np.log(self.counts[1] / self.counts[0])

    def score(self, rows):
        """The probability of class 1, of log densities divided by the number of features, so that it does not
        saturate; 0.5 is where both classes are equally likely."""
        if not self.fitted:
            return np.full(len(rows), 0.5 if sum(self.counts) == 0 else float(self.counts[1] >= self.counts[0]))
        z = np.clip((rows - self.centre) / self.scale, -_CLIP, _CLIP)
        density = []
        for mean, inverse, log_det in self.classes:
            density.append(-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - log_det)
        margin = (density[1] - density[0] + self.prior) / _N
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(labelled: DataFrame, shrinkage=SHRINKAGE, ridge=RIDGE) -> Discriminant:
    """Fit on all rows of (stats, label). Each task sums counts, vectors and products of its rows by class; these
    sums, one short row a task and class, are added by Spark."""
    known = labelled.filter("label IN (0, 1) AND stats IS NOT NULL").select(F.col("label").cast("int"), "stats")
    parts = known.mapInArrow(_sums, "label int, part array<double>")
    rows = parts.select("label", F.posexplode("part").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    moments = {}
    for r in rows.collect():
        moments.setdefault(r["label"], np.zeros(1 + _N + _N * _N))[r["i"]] = r["x"]
    return Discriminant(moments, shrinkage, ridge)


def scored(docs: DataFrame, model: Discriminant, stats_col="stats", score_col="score") -> DataFrame:
    """`docs` with the score of each row's statistics."""
    shared = Shared(docs.sparkSession, model)

    @F.arrow_udf(T.DoubleType())
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(shared.value.score(np.asarray(part.flatten()).reshape(-1, _N)))
    return docs.withColumn(score_col, score(stats_col))


def classify(docs: DataFrame, labels: DataFrame, learn, id_col="doc_id", label_col="quality", text_col="text",
             score_col="score") -> DataFrame:
    """`docs` with `score` (0 to 1) for every row, learned from labels of the documents where `learn` holds.

    Statistics are computed from whole texts. A null text is an empty one and has a score, too. Rows with a null
    id have no label. Labels other than 0 and 1 are left out; of repeated ids or labels each pair counts. With
    rows of one class only, the score is that class; without any, 0.5. An existing column `score` is replaced.
    Texts are never shuffled: the statistics of documents are joined with labels by id.
    """
    stats = docs.filter(learn).select(F.col(id_col).alias("_id"), document_statistics(text_col).alias("stats"))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).filter("label IN (0, 1)")
    model = fit(stats.join(known, "_id"))
    out = scored(docs.withColumn("_stats", document_statistics(text_col)), model, "_stats", score_col)
    return out.drop("_stats")


def classify_slim(docs: DataFrame, labels: DataFrame, learn, keep: list, id_col="doc_id", label_col="quality",
                  text_col="text") -> DataFrame:
    """As `classify`, returning only the columns `keep` and the score: texts are read once, statistics are stored."""
    rows = stored(docs.select(*dict.fromkeys([id_col, *keep]), learn.alias("_learn"),
                              document_statistics(text_col).alias("_stats")))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).filter("label IN (0, 1)")
    stats = rows.filter("_learn").select(F.col(id_col).alias("_id"), F.col("_stats").alias("stats"))
    return scored(rows, fit(stats.join(known, "_id")), "_stats").select(*keep, "score")


def without_rejected(docs: DataFrame, labels: DataFrame, learn, least: float, id_col="doc_id", label_col="quality",
                     text_col="text") -> DataFrame:
    """`docs` without the rows that `classify` scores below `least`.

    Statistics are made once, of small batches of texts, and stored without the texts. Equal texts have equal scores, so
    rows go by the hash of their text. Texts are not shuffled unless very many are rejected.
    """
    tid = F.xxhash64(text_col).alias("_tid")
    with W.small_batches(docs.sparkSession, size=BATCH_BYTES), scratch_tables(docs.sparkSession):
        low = classify_slim(docs.withColumn("_tid", tid), labels, learn, ["_tid"], id_col, label_col, text_col)
        low = stored(low.filter(~(F.col("score") >= least)).select("_tid").distinct(), keep=True)
    return lookup_join(docs.withColumn("_tid", tid), low, "_tid", "left_anti").select(*docs.columns)
