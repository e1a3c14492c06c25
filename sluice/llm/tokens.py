"""Token counts by section: whole documents are encoded once, and token spans are joined with the spans of sections."""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the vocabulary's training cut texts before merging. Fixed pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most", "split")
_loaded = {}


def encoder(path: str, pattern: str):
    """The tokenizer of a rank file and the number of bytes of each of its tokens, loaded once a process."""
    if (path, pattern) not in _loaded:
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _loaded[path, pattern] = (
            tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _loaded[path, pattern]


def sections_of(parts):
    """The text of a row's fields and the spans, in bytes, of their sections: (text, starts, ends, field, number).

    Fields follow each other with a line feed between them. A section is a line of a field; its line feed
    belongs to it. An empty or null field has one empty section, so each field is counted.
    """
    starts, ends, fields, numbers, at = [], [], [], [], 0
    for f, part in enumerate(parts):
        size = len(part.encode()) + (f + 1 < len(parts))
        raw = np.frombuffer((part + "\n" * (f + 1 < len(parts))).encode(), np.uint8)
        cuts = np.flatnonzero(raw == 10) + 1
        cuts = cuts[cuts < size]
        edges = np.concatenate(([0], cuts, [size]))
        starts.append(edges[:-1] + at)
        ends.append(edges[1:] + at)
        fields.append(np.full(len(edges) - 1, f))
        numbers.append(np.arange(len(edges) - 1))
        at += size
    return "\n".join(parts), *(np.concatenate(x) for x in (starts, ends, fields, numbers))


def allocate(token_ends, starts, ends, rule):
    """(tokens, crossing) of each section.

    Token i covers bytes [token_ends[i-1], token_ends[i]). A token inside one section counts there. One that
    crosses boundaries counts for the section of its first byte, of its last byte, of most of its bytes (the
    earliest of equals), or for each by its share of the bytes (`split`). `crossing` is how many tokens that
    touch the section also touch another one.
    """
    counts, crossing = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    if not len(token_ends):
        return counts, crossing
    begins = np.concatenate(([0], token_ends[:-1]))
    solid = np.flatnonzero(ends > starts)
    low = solid[np.searchsorted(ends[solid], begins, "right")]
    high = solid[np.searchsorted(ends[solid], token_ends - 1, "right")]
    inside = low == high
    counts += np.bincount(low[inside], minlength=len(starts))
    for t in np.flatnonzero(~inside):
        touched = np.arange(low[t], high[t] + 1)
        touched = touched[ends[touched] > starts[touched]]
        shared = np.minimum(ends[touched], token_ends[t]) - np.maximum(starts[touched], begins[t])
        crossing[touched] += 1
        if rule == "split":
            counts[touched] += shared / shared.sum()
        else:
            counts[{"first": touched[0], "last": touched[-1], "most": touched[np.argmax(shared)]}[rule]] += 1
    return counts, crossing


def count_by_section(docs: DataFrame, keep: list, fields=("text",), rule: str = "first", path: str = VOCABULARY,
                     pattern: str = PATTERN) -> DataFrame:
    """One row for each section (line) of each field: `keep`, field, section, n_bytes, n_tokens, n_crossing, doc_tokens.

    The fields of a row are joined by line feeds and encoded once, as a whole; token spans come from the tokens'
    byte lengths. `rule` says who gets a token that crosses sections; with any rule n_tokens of a row
    adds up to doc_tokens. Null fields are empty, and an empty field has one section without tokens. Fields other than
    texts are taken as their text. `keep` may have any columns that are not named like the results. Repeated rows
    are counted each. The vocabulary file must be at `path` on each executor. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    result = T.ArrayType(T.StructType().add("field", T.StringType()).add("section", T.IntegerType())
                         .add("n_bytes", T.LongType()).add("n_tokens", T.DoubleType())
                         .add("n_crossing", T.LongType()).add("doc_tokens", T.LongType()))

    @F.arrow_udf(result)
    def count(*columns: pa.Array) -> pa.Array:
        encoding, sizes = encoder(path, pattern)
        lengths, rows = [0], [[] for _ in range(6)]
        for parts in zip(*(c.to_pylist() for c in columns)):
            text, starts, ends, field, number = sections_of([p or "" for p in parts])
            token_ends = np.cumsum(sizes[np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.int64)])
            counts, crossing = allocate(token_ends, starts, ends, rule)
            whole = np.full(len(starts), len(token_ends))
            for out, x in zip(rows, (field, number, ends - starts, counts, crossing, whole)):
                out.append(x)
            lengths.append(lengths[-1] + len(starts))
        field, number, size, counts, crossing, whole = (
            np.concatenate(x) if x else np.zeros(0, np.int64) for x in rows)
        labels = pa.array(names).take(pa.array(field.astype(np.int64)))
        structs = pa.StructArray.from_arrays(
            [labels, pa.array(number.astype(np.int32)), pa.array(size.astype(np.int64)), pa.array(counts.astype(float)),
             pa.array(crossing.astype(np.int64)), pa.array(whole.astype(np.int64))],
            ["field", "section", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"])
        return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), structs)

    counted = docs.withColumn("_sections", count(*(F.col(f).cast("string") for f in names)))
    return counted.select(*keep, F.inline("_sections"))
