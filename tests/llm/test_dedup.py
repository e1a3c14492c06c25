"""Exact substrings, near passages and the Jaccard join against brute force."""

import hashlib
import random

import numpy as np
import pytest

from sluice.llm import jaccard, passages, suffixes
from sluice.llm import words as W
from tests.llm.common import odd_documents, prose, shingles, words


def test_words_and_shingles_match_plain_ones():
    texts = ["Ab  cd\tEF", "", None, "x", "é Ü\x0bz", "a b c d e f", " lead trail "]
    data, offsets = W.text_bytes(W.texts_of(texts))
    hashes, starts, ends, bounds = W.split_words(data, offsets)
    got = [bytes(data[a:b]).decode().lower() for a, b in zip(starts, ends)]
    assert [w.lower() for w in got] == [w.lower() for t in texts for w in words(t)]
    assert hashes[got.index("ab")] == W.split_words(*W.text_bytes(W.texts_of(["aB"])))[0][0]
    pieces, at = W.shingles(hashes, bounds, 3)
    assert np.diff(at).tolist() == [len(words(t)) - 2 if len(words(t)) >= 3 else min(1, len(words(t))) for t in texts]
    assert len(np.unique(pieces)) == len(pieces)


def brute_repeats(texts, length):
    seen, twice = set(), set()
    for b in texts:
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            (twice if s in seen else seen).add(s)
    out = []
    for b in texts:
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k:k + length] in twice:
                covered[k:k + length] = b"\1" * length
        out.append(covered)
    return out


def repeating_texts():
    rng = random.Random(3)
    passage, tail = prose(10, 60), prose(11, 50)
    near = prose(12, 200).split()
    texts = [prose(i, 70) + " " + passage + " " + prose(i + 100, 40) for i in range(20, 26)]
    for i in range(6):
        changed = list(near)
        for _ in range(4):
            changed[rng.randrange(len(near))] = f"edit{i}"
        texts.append(" ".join(changed))
    return [*texts, tail * 3, "ab" * 400, "ab" * 300 + "c", passage[:150], "é" * 150, "x" * 199, "y" * 200, "y" * 201]


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_is_exact(spark, hot):
    docs = odd_documents(spark, [(100 + i, t, "en", "z") for i, t in enumerate(repeating_texts())])
    rows = suffixes.deduplicate(docs, 200, hot=hot, buffer_rows=8).collect()
    texts = [(r["text"] or "").encode() for r in rows]
    for r, raw, covered in zip(rows, texts, brute_repeats(texts, 200)):
        kept = bytes(x for x, c in zip(raw, covered) if not c)
        runs = len([x for x in bytes(covered).split(b"\0") if x])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), sum(covered), runs), r["doc_id"]
        assert hashlib.sha256(bytes(r["kept"])).digest() == hashlib.sha256(kept).digest()
    assert sum(r["n_removed"] for r in rows) > 5000 and "score" in rows[0]


def test_merged_transform_equals_sorted_suffixes():
    rng = np.random.default_rng(0)
    symbols = rng.integers(1, 4, (9, 12)).astype(np.uint16)
    shards = [symbols[:4], symbols[4:7], symbols[7:]]
    made = [suffixes.transform(s) for s in shards]
    shard, rank, common = suffixes.merge([b for _, b in made], [len(s) for s in shards], 6)
    suffix = []
    for s, k in zip(shard, rank):
        row, column = divmod(int(made[s][0][k]), 13)
        suffix.append((sum(len(x) for x in shards[:s]) + row, column))
    cut = [tuple(symbols[r, c:c + 6]) for r, c in suffix]
    full = [c for c in cut if len(c) == 6]
    assert sorted(suffix) == [(r, c) for r in range(9) for c in range(13)]
    assert full == sorted(full)
    for i in range(1, len(cut)):
        if len(cut[i]) == len(cut[i - 1]) == 6:
            same = next((k for k in range(6) if cut[i][k] != cut[i - 1][k]), 6)
            assert common[i] == same


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    smallest = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, len(s), smallest[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_join_is_exact(spark, n, num, den):
    rng = random.Random(5)
    extra = []
    for base in range(6):
        w = prose(50 + base, rng.choice([4, 9, 30, 150])).split()
        for copy in range(7):
            changed = list(w)
            for _ in range(rng.randint(0, 1 + len(w) // 20)):
                changed[rng.randrange(len(w))] = f"w{rng.randrange(3)}"
            extra.append((1000 + base * 10 + copy, " ".join(changed), "en", "a"))
    docs = odd_documents(spark, extra)
    got = jaccard.linked(docs, n, num, den).drop("text_id").collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], n, num, den)
    assert sorted((tuple(r) for r in got), key=repr) == want
    left = jaccard.one_of_each_group(docs, n, num, den)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(1) == 1 and 3 in ids and 4 in ids and 5 in ids and ids.count(None) == 1


def test_keys_are_made_for_sets_that_can_link_only(spark, monkeypatch):
    """300 texts without a partner and two with one; keys of all sets were on disk before."""
    near = prose(5, 200)
    docs = spark.createDataFrame([(i, prose(1000 + i, 80)) for i in range(300)] + [(400, near), (401, near + " end")], "doc_id long, text string")
    held, store = [], jaccard.stored

    def counting(df, **options):
        out = store(df, **options)
        if "keys" in out.columns:
            held.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "stored", counting)
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.linked(docs).collect()}
    assert groups == {**{i: i for i in range(300)}, 400: 400, 401: 400}
    assert 2 <= sum(held) < 60


def test_blocks_of_one_bundle_find_the_same_links(spark, monkeypatch):
    rows = [(i, " ".join(f"t{k}" for k in range(40) if k != i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = jaccard._links_in_bundles
    monkeypatch.setattr(jaccard, "_links_in_bundles", lambda *a: whole(*a, block=200, block_sets=3))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.linked(docs, 1, 95, 100).collect()}
    assert [got[i] for i in range(30)] == [c for _, _, c in brute_components(rows, 1, 95, 100)]


@pytest.mark.parametrize("size", [(1, 1, 0), (2, 2, 1), (8, 10, 2), (20, 30, 7), (200, 300, 75)])
def test_allocation_covers_all_differences(size):
    low, high, most = size
    m, raised, spare = jaccard.allocate(low, high, max(most, 1))
    assert m + raised >= max(most, 1) + 1 + spare and raised <= m


def test_near_passages(spark):
    passage = prose(70, 60).split()
    near = list(passage)
    near[30] = "changed"
    extra = [(20, prose(71, 90) + " " + " ".join(passage) + " " + prose(72, 30), "en", "a"),
             (21, " ".join(passage) + " " + prose(73, 100), "en", "a"), (22, prose(74, 100), "en", "a"),
             (23, prose(75, 40) + " " + " ".join(near), "en", "a"),
             (24, prose(76, 60) + " " + " ".join(passage[:30]) + " " + prose(77, 60), "en", "a")]
    docs = odd_documents(spark, extra)
    found = passages.repeated_passages(docs)
    rows = {(r["doc_id"], r["first_doc_id"]): r for r in found.collect()}
    hit = rows[21, 20]
    assert (hit["start_word"], hit["end_word"], hit["first_start"]) == (0, 60, 90) and hit["similarity"] == 1.0
    assert abs(rows[23, 20]["start_word"] - 40) <= 1 and rows[23, 20]["similarity"] >= 0.8
    assert rows[2, 1]["end_word"] == 120 and rows[2, 1]["similarity"] == 1.0
    assert {b for b, _ in rows} <= {2, 21, 23, 7, None}, "clean texts are left alone"
    for (b, a), r in rows.items():
        texts = {x["doc_id"]: x["text"] for x in docs.collect() if x["doc_id"] in (20, 21, 23)}
        if a == 20 and b in texts:
            left = shingles(" ".join(words(texts[b])[r["start_word"]:r["end_word"]]), 5)
            right = shingles(" ".join(words(texts[a])[r["first_start"]:r["first_end"]]), 5)
            assert len(left & right) / len(left | right) == pytest.approx(r["similarity"])
    left = passages.without_repeats(docs, found)
    texts = {r["doc_id"]: r["text"] for r in left.collect() if r["doc_id"] in (20, 21, 22)}
    assert left.columns == docs.columns
    assert words(texts[21]) == words(prose(73, 100)) and texts[22] == prose(74, 100) and len(words(texts[20])) == 180


def test_compact_windows_hold_the_minima():
    rng = np.random.default_rng(1)
    values = (rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(40)) + np.uint64(1)
    bounds, span = np.array([0, 180, 185, 300]), 12
    windows = passages.compact_windows(values, bounds, span)
    for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for i in range(a, b - span + 1):
            least = int(values[i:i + span].min() >> np.uint64(passages._PLACE_BITS))
            place, end = i - a, i - a + span - 1
            assert any(w[0] == d and w[1] == least and w[2] <= place and end <= w[5] and w[3] <= end and w[4] >= place
                       for w in windows)
    assert not [w for w in windows if w[0] == 1]


@pytest.mark.parametrize("run", [
    lambda d: suffixes.deduplicate(d), lambda d: jaccard.linked(d), lambda d: jaccard.one_of_each_group(d),
    lambda d: passages.repeated_passages(d)])
def test_empty_tables(spark, run):
    assert run(odd_documents(spark).limit(0)).collect() == []
