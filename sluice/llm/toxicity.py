"""Toxicity of documents: a convolutional text classifier over hashed word embeddings, trained in numpy."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F, types as T

from sluice.functions.joins import stored
from sluice.llm.shared import Shared

BUCKETS = 1 << 18
WIDTH = 8
FILTERS = 6
SPANS = (1, 2, 3)
SAMPLE_ROWS = 3000
SAMPLE_WORDS = 3_000_000
EPOCHS = 6
BATCH = 64
RATE = 0.02
_SMOOTH = 6.0
_PIECE = 1 << 16
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def bucket_ids(texts: pa.Array):
    """For each word the buckets of the word and of its first four letters, and where each text's words begin.

    Words are cut at white space, lower-cased, and stripped of ASCII punctuation at both ends. Only the
    different words of a batch are hashed.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths())
    coded = lists.flatten().dictionary_encode()
    table = np.empty((len(coded.dictionary), 2), np.int32)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        word = word.strip(_EDGES)
        table[i, 0] = zlib.crc32(word.encode()) % BUCKETS if word else 0
        table[i, 1] = zlib.crc32(b"\x01" + word[:4].encode()) % BUCKETS if word else 0
    codes = np.asarray(coded.indices)
    ids = table[codes]
    real = np.ones(len(ids), bool)
    if len(ids):
        empty = np.array([not w.strip() for w in coded.dictionary.to_pylist()], bool)
        real = ~empty[codes]
    doc = np.repeat(np.arange(len(sizes)), sizes)[real]
    return ids[real], np.searchsorted(doc, np.arange(len(sizes) + 1))


class Network:
    """Embeddings, filters of several widths, maximum over the text, one logistic unit."""

    def __init__(self, odds, seed=0):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
        self.embedding[:, 0] = odds
        self.embedding[0] = 0
        self.filters = [rng.normal(0, 0.1, (k, WIDTH, FILTERS)).astype(np.float32) for k in SPANS]
        for f in self.filters:
            f[:, 0, 0] += 1.0 / len(f)
        self.bias = [np.zeros(FILTERS, np.float32) for _ in SPANS]
        self.out = rng.normal(0, 0.05, len(SPANS) * FILTERS).astype(np.float32)
        self.out[::FILTERS] = 1.0
        self.offset = np.float32(-2.0)
        self.shift = 0.0
        self.thresholds = {}

    def pooled(self, ids, bounds, where=False):
        """Maximum of each filter over each text, 0 at least; with `where`, also the positions of the maxima."""
        n = len(bounds) - 1
        top = np.zeros((n, len(SPANS) * FILTERS), np.float32)
        at = np.full(top.shape, -1, np.int64)
        total, most = len(ids), max(SPANS)
        for low in range(0, total, _PIECE):
            high = min(total, low + _PIECE)
            x = self.embedding[ids[low:high + most - 1]].sum(1)
            first, last = np.searchsorted(bounds, low, "right") - 1, np.searchsorted(bounds, high, "left")
            docs = np.arange(first, last)
            docs = docs[bounds[docs] < bounds[docs + 1]]
            for s, k in enumerate(SPANS):
                m = min(high - low, len(x) - k + 1)
                if m <= 0:
                    continue
                y = sum(x[j:j + m] @ self.filters[s][j] for j in range(k)) + self.bias[s]
                start = np.maximum(bounds[docs], low) - low
                stop = np.minimum(np.minimum(bounds[docs + 1] - k + 1, high) - low, m)
                for d, a, b in zip(docs[start < stop], start[start < stop], stop[start < stop]):
                    part = y[a:b]
                    best = part.max(0)
                    cols = slice(s * FILTERS, (s + 1) * FILTERS)
                    better = best > top[d, cols]
                    if where and better.any():
                        at[d, cols] = np.where(better, part.argmax(0) + a + low, at[d, cols])
                    top[d, cols] = np.maximum(top[d, cols], best)
        return (top, at) if where else top

    def margin(self, ids, bounds):
        return self.pooled(ids, bounds) @ self.out + self.offset

    def score(self, ids, bounds):
        margin = self.margin(ids, bounds) - self.shift
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30).astype(float)))

    def train(self, texts, labels, epochs=EPOCHS, seed=0):
        """Adagrad on the logistic loss, both classes weighted alike. The gradient reaches only the words at a maximum."""
        rng = np.random.default_rng(seed)
        labels = np.asarray(labels, np.float32)
        weight = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) * len(labels)
        seen = {}

        def step(name, value, gradient, index=slice(None)):
            sums = seen.setdefault(name, np.full(np.shape(value), 1e-2, np.float32))
            sums[index] += gradient ** 2
            value[index] -= RATE * gradient / np.sqrt(sums[index])

        offset = np.array([self.offset], np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for low in range(0, len(order), BATCH):
                rows = order[low:low + BATCH]
                ids = np.concatenate([texts[r] for r in rows])
                bounds = np.concatenate(([0], np.cumsum([len(texts[r]) for r in rows])))
                top, at = self.pooled(ids, bounds, True)
                p = 1 / (1 + np.exp(-np.clip(top @ self.out + offset[0], -30, 30)))
                error = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                back = error[:, None] * self.out[None, :] * (at >= 0)
                for s, k in enumerate(SPANS):
                    cols = slice(s * FILTERS, (s + 1) * FILTERS)
                    d, f = np.nonzero(at[:, cols] >= 0)
                    if not len(d):
                        continue
                    g, pos = back[:, cols][d, f], at[:, cols][d, f]
                    bias, filters = np.zeros(FILTERS, np.float32), np.zeros_like(self.filters[s])
                    np.add.at(bias, f, g)
                    for j in range(k):
                        words = ids[pos + j]
                        np.add.at(filters[j].T, f, g[:, None] * self.embedding[words].sum(1))
                        to_words = g[:, None] * self.filters[s][j].T[f]
                        for part in range(2):
                            index, where = np.unique(words[:, part], return_inverse=True)
                            sums = np.zeros((len(index), WIDTH), np.float32)
                            np.add.at(sums, where, to_words)
                            sums[index == 0] = 0
                            step("embedding", self.embedding, sums, index)
                    step(("bias", s), self.bias[s], bias)
                    step(("filter", s), self.filters[s], filters)
                step("out", self.out, top.T @ error)
                step("offset", offset, np.array([error.sum()], np.float32))
        self.offset = offset[0]


def best_cut(margins, labels):
    """The margin that parts labels best by F1: the middle of the gap at the best place; 0 if a class is missing."""
    margins, labels = np.asarray(margins, float), np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + labels.sum())
    f1[:-1][m[:-1] == m[1:]] = -1
    i = int(np.argmax(f1))
    return float((m[i] + m[i + 1]) / 2 if i + 1 < len(m) else m[i] - 1)


def fit(sample: DataFrame, calibrate_every: int = 4, pooled: int = 20, epochs=EPOCHS) -> Network:
    """Train on the rows (label, lang, ids, n) of a bounded sample, every fourth kept for the thresholds.

    Each language with a positive among those has its own threshold, drawn towards the common one as if by `pooled` positives.
    """
    rows = sorted(sample.collect(), key=lambda r: (r["n"], bytes(r["ids"])))
    rng = np.random.default_rng(1)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    texts = [np.frombuffer(r["ids"], np.int32).reshape(-1, 2) for r in rows]
    labels = np.array([r["label"] for r in rows])
    part = np.arange(len(rows)) % calibrate_every == 0
    odds = np.zeros(BUCKETS, np.float32)
    if len(rows):
        counts = np.full((2, BUCKETS), 0.0)
        for t, label in zip(texts, labels):
            counts[label, np.unique(t)] += 1
        rate = [(counts[c] + _SMOOTH) / ((labels == c).sum() + 2 * _SMOOTH) for c in (0, 1)]
        odds = np.maximum(np.log(rate[1] / rate[0]), -1).astype(np.float32)
    net = Network(odds)
    learn = [i for i in range(len(rows)) if not part[i]]
    if learn and 0 < labels[learn].sum() < len(learn):
        net.train([texts[i] for i in learn], labels[learn], epochs)
    held = [i for i in range(len(rows)) if part[i]]
    if held:
        bounds = np.concatenate(([0], np.cumsum([len(texts[i]) for i in held])))
        margins = net.margin(np.concatenate([texts[i] for i in held]), bounds)
        net.shift = best_cut(margins, labels[held])
        languages = np.array([rows[i]["lang"] or "" for i in held])
        for language in np.unique(languages):
            of = languages == language
            positive = int(labels[held][of].sum())
            if 0 < positive < of.sum():
                cut = (best_cut(margins[of], labels[held][of]) - net.shift) * positive / (positive + pooled)
                net.thresholds[str(language)] = float(1 / (1 + np.exp(-cut)))
    return net


@F.arrow_udf(T.StructType().add("n", T.IntegerType()).add("ids", T.BinaryType()))
def _hashed(texts: pa.Array) -> pa.Array:
    ids, bounds = bucket_ids(texts)
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(bounds), pa.int32()),
         pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["n", "ids"])


def training_sample(docs: DataFrame, labels: DataFrame, learn, id_col="doc_id", label_col="toxic", text_col="text",
                    rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> DataFrame:
    """(label, lang, n, ids): at most `rows` labelled documents of each class, chosen by a hash of the id.

    Ids are chosen from the labels, so only the chosen texts are hashed. Of these, each class has the
    shortest texts that together stay within half of `words`: only where all do not fit, the longest are left out.
    """
    label = F.col(label_col).cast("int")
    known = labels.select(F.col(id_col).cast("long").alias("_id"), label.alias("label")).filter(
        "label IN (0, 1) AND _id IS NOT NULL").filter(learn(F.col("_id")))
    place = F.xxhash64("_id", F.lit("sample"))
    picked = None
    for c in (0, 1):
        part = known.filter(F.col("label") == c).orderBy(place, "_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col("lang"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(picked), "_id")
    hashed = stored(found.withColumn("_h", _hashed("_text")).select("_id", "label", "lang", "_h.n", "_h.ids"))
    running = Window.partitionBy("label").orderBy("n", place, "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = hashed.select("_id", "n", "label").withColumn("_sum", F.sum("n").over(running)).filter(F.col("_sum") <= words // 2)
    chosen = F.broadcast(fits.select("_id", "label", "n").distinct())
    return hashed.join(chosen, ["_id", "label", "n"], "left_semi").select("label", "lang", "n", "ids").limit(2 * rows)


def scored(docs: DataFrame, model: Network, text_col="text", score_col="score") -> DataFrame:
    """`docs` with the toxicity score of each whole text."""
    shared = Shared(docs.sparkSession, model)

    @F.arrow_udf(T.DoubleType())
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(shared.value.score(*bucket_ids(part)))
    return docs.withColumn(score_col, score(text_col))


def flagged(docs: DataFrame, model: Network, lang_col="lang", score_col="score", flag_col="flagged") -> DataFrame:
    """`docs` with a flag: the score reaches the threshold of the row's language, 0.5 where none was calibrated."""
    threshold = F.lit(0.5)
    for language, value in model.thresholds.items():
        threshold = F.when(F.col(lang_col) == language, value).otherwise(threshold)
    return docs.withColumn(flag_col, F.col(score_col) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, learn, id_col="doc_id", label_col="toxic", text_col="text",
             lang_col="lang", rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> DataFrame:
    """`docs` with `score` (0 to 1, toxic from 0.5) and `flagged` (by the threshold of the row's language).

    `learn(id column)` says which labels may be used. The network is fitted on a bounded sample of these: `rows`
    of each class and half of `words` words for each, without the longest where they do not fit; it scores every whole text. Labels, language, source and id
    are no inputs of a score. Null and empty texts have the score of a text without words. Labels other than 0 and 1, and
    null ids, are left out of the sample. Without labels of both classes, scores stay those of the untrained
    network. Existing columns `score` and `flagged` are replaced. An empty table gives an empty result.
    """
    model = fit(training_sample(docs, labels, learn, id_col, label_col, text_col, rows, words))
    return flagged(scored(docs, model, text_col), model, lang_col)
