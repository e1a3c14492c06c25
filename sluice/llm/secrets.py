"""Secrets in texts: assigned values, access keys and long hexadecimal runs by pattern, random strings by token efficiency.

A tokenizer's vocabulary holds what is frequent in text, so words take few tokens and random strings take many. A run
of key characters with few characters per token is taken for random, unless it is a digest or an identifier by its form
or is listed as known.
"""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from sluice.functions.joins import lookup_join, stored
from sluice.llm.tokens import PATTERN, VOCABULARY, encoder

KINDS = ("assign", "access", "hex", "random")
MIN_CHARS = 16
MAX_RATIO = 1.8
WINDOW = 64
# Lengths of hexadecimal digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512. Fixed values.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
# Base patterns, given. The letters of keywords count in either case; ASCII keeps other scripts' letters out.
ASSIGN = (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
          re.ASCII | re.IGNORECASE)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
UUID = r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
# A part of an identifier: a word (small, large or with a large first letter, or several such in a row), a number, or short.
PART = r"[0-9]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[0-9]{0,3}|[A-Z]+[0-9]{0,3}|[A-Za-z0-9]{0,3}"
_SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.LongType())
                     .add("end", T.LongType()).add("value", T.StringType()))


def base_spans(text: str):
    """(start, end, kind number) by the base patterns.

    A run that is too short cannot become long enough from a later start, so lengths of access and hexadecimal runs
    are part of their patterns; an assigned value that is too short still uses up its text.
    """
    for m in re.finditer(ASSIGN[0], text, ASSIGN[1]):
        if m.end(2) - m.start(2) >= 6:
            yield m.start(), m.end(), 0
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in re.finditer(pattern, text):
            yield m.start(), m.end(), kind


def is_plain(run: str) -> bool:
    """True for digests and identifiers: by length, as a UUID, or as words and numbers between separators."""
    if len(run) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    return bool(re.fullmatch(UUID, run)) or all(re.fullmatch(PART, p) for p in re.split(r"[+/_=-]", run))


def random_spans(text: str, encoding, min_chars: int, max_ratio: float):
    """(start, end) of random strings.

    A run is tested in windows of equal size of at most `WINDOW` characters, so that a key inside a long run is seen and the
    cost stays in proportion; windows in a row that pass are one span. A run that continues as a word of other letters is
    part of that word.
    """
    for m in re.finditer(RUN % min_chars, text):
        a, b = m.span()
        if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()) or is_plain(m.group()):
            continue
        parts = -(-(b - a) // WINDOW)
        cuts = [a + (b - a) * i // parts for i in range(parts + 1)]
        begun = None
        for x, y in zip(cuts, cuts[1:]):
            if y - x <= max_ratio * len(encoding.encode_ordinary(text[x:y])):
                begun = x if begun is None else begun
            elif begun is not None:
                yield begun, x
                begun = None
        if begun is not None:
            yield begun, b


def spans_of(text: str, encoding, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO):
    """All spans as (start, end, kind number), by start, then kind. Random strings inside a base span are not said again."""
    base = sorted(base_spans(text), key=lambda s: (s[0], s[2]))
    reach, covers = [], 0
    for start, end, _ in base:
        covers = max(covers, end)
        reach.append(covers)
    out, at = list(base), 0
    for a, b in random_spans(text, encoding, min_chars, max_ratio):
        while at < len(base) and base[at][0] <= a:
            at += 1
        if not at or reach[at - 1] < b:
            out.append((a, b, 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def find(docs: DataFrame, text_col="text", spans_col="spans", known: DataFrame | None = None, min_chars: int = MIN_CHARS,
         max_ratio: float = MAX_RATIO, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`docs` with `spans`: the secrets of each whole text as (kind, start, end, value), by start, then kind.

    Positions count code points, ends are exclusive. Kinds are `assign`, `access` and `hex` by pattern, and `random`: runs of
    at least `min_chars` key characters with at most `max_ratio` characters per token of the vocabulary at `path` (a rank
    file, needed on each executor). `known` is a table of texts (`value`), such as published digests, that are not random;
    it may be of any size. Base spans stay whatever `known` says. A null text counts as empty and has no spans. Repeated
    rows are searched each. Extra columns stay; one named like `spans_col` is replaced. An empty table gives an
    empty result. Without `known`, no shuffle.
    """
    @F.arrow_udf(_SPANS)
    def search(texts: pa.Array) -> pa.Array:
        encoding, _ = encoder(path, pattern)
        out = []
        for text in texts:
            text = text.as_py() or ""
            out.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]}
                        for a, b, k in spans_of(text, encoding, min_chars, max_ratio)])
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                                 ("value", pa.string())])))
    found = docs.withColumn(spans_col, search(F.col(text_col).cast("string")))
    return found if known is None else _without_known(found, spans_col, known)


def _without_known(found, spans_col, known):
    """Drop random spans whose text is listed. Documents are joined back by a number that is stored with them."""
    found = stored(found.withColumn("_row", F.monotonically_increasing_id()))
    each = found.select("_row", F.explode(F.filter(spans_col, lambda s: s["kind"] == KINDS[3])).alias("_span"))
    listed = known.select(F.col("value").cast("string").alias("_value")).filter("_value IS NOT NULL").distinct()
    met = lookup_join(each.withColumn("_value", F.col("_span.value")), listed, "_value", "inner").groupBy("_row").agg(
        F.collect_list("_span.start").alias("_starts"))
    return found.join(met, "_row", "left").withColumn(spans_col, F.filter(spans_col, lambda s: (
        s["kind"] != KINDS[3]) | ~F.coalesce(F.array_contains("_starts", s["start"]), F.lit(False)))).drop("_row", "_starts")


def joined(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(docs: DataFrame, text_col="text", spans_col="spans", mark: str = "<secret>") -> DataFrame:
    """`docs` with each span of `spans_col` replaced by `mark` in the text; spans that overlap are replaced as one."""
    @F.arrow_udf(T.StringType())
    def mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            pieces, at = [], 0
            for s in found or []:
                if s["start"] >= at:
                    pieces += [text[at:s["start"]], mark]
                at = max(at, s["end"])
            out.append(None if text is None else "".join([*pieces, text[at:]]))
        return pa.array(out, pa.string())
    return docs.withColumn(text_col, mask(F.col(text_col).cast("string"), spans_col))
