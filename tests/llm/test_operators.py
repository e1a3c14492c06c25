"""Classifiers, counts, search, mixing and filters against plain versions."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from sluice.llm import decontaminate, mixing, quality, queries, tokens, topk, toxicity, urls
from sluice.llm.graph import components
from tests.llm.common import odd_documents, prose, shingles

SMALL = "/root/testdata/sf0.01"


def held_out(rows, labels, name):
    known = {r["doc_id"]: r[name] for r in labels.collect()}
    return [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]


def test_quality_on_held_out_rows(spark):
    rows = queries.op3_quality(spark, SMALL).collect()
    pairs = held_out(rows, queries.table(spark, SMALL, "labels"), "quality")
    assert len(rows) == 1000 and np.mean([a == b for a, b in pairs]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op1_toxicity(spark, "/root/testdata/sf0.1").collect()
    pairs = held_out(rows, queries.table(spark, "/root/testdata/sf0.1", "labels"), "toxic")
    assert len(rows) == 10000 and np.mean([a == b for a, b in pairs]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def some_labels(spark, docs):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 1, 1), (7, 0, 0), (2, None, None), (6, 1, 5), (99, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def test_classifiers_take_odd_rows(spark):
    docs = odd_documents(spark)
    labels = some_labels(spark, docs)
    for out in (quality.classify(docs, labels, F.lit(True)), toxicity.classify(docs, labels, lambda i: F.lit(True))):
        rows = out.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    for empty in (labels.limit(0), labels):
        assert quality.classify(docs.limit(0), empty, F.lit(True)).collect() == []
        assert toxicity.classify(docs.limit(0), empty, lambda i: F.lit(True)).collect() == []
    assert {r["score"] for r in quality.classify(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_score_needs_no_other_column(spark):
    docs, labels = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels")
    model = toxicity.fit(toxicity.training_sample(docs, labels, lambda i: F.lit(True), rows=50))
    one = toxicity.scored(docs.select("text"), model).collect()
    two = toxicity.scored(docs.select(F.lit("x").alias("lang"), "text"), model).collect()
    assert [r["score"] for r in one] == [r["score"] for r in two]


def test_pooling_in_pieces_equals_whole(monkeypatch):
    net = toxicity.Network(np.random.default_rng(0).normal(0, 1, toxicity.BUCKETS).astype(np.float32))
    ids = np.random.default_rng(1).integers(0, toxicity.BUCKETS, (500, 2)).astype(np.int32)
    bounds = np.array([0, 0, 3, 200, 201, 499, 500])
    whole = net.pooled(ids, bounds)
    monkeypatch.setattr(toxicity, "_PIECE", 37)
    assert np.allclose(net.pooled(ids, bounds), whole, atol=1e-6)


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_of_sections_add_up(spark, rule):
    docs = odd_documents(spark, [(30, "x\n\n\n\nend of it\n", "en", "a\nb"), (31, "\n", "en", "a")])
    rows = tokens.count_by_section(docs, ["doc_id"], ["source", "text"], rule).collect()
    encoding, _ = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN)
    by_doc = {}
    for r in rows:
        if r["doc_id"] not in (2, None):
            by_doc.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        if d["doc_id"] in (2, None):
            continue
        got = by_doc[d["doc_id"]]
        whole = f"{d['source'] or ''}\n{d['text'] or ''}"
        assert got[0]["doc_tokens"] == len(encoding.encode_ordinary(whole))
        assert sum(r["n_tokens"] for r in got) == pytest.approx(got[0]["doc_tokens"])
        assert sum(r["n_bytes"] for r in got) == len(whole.encode())
    assert any(r["n_crossing"] for r in by_doc[30])


def test_allocation_rules_by_hand():
    ends, starts, stops = np.array([2, 5, 6]), np.array([0, 3, 3]), np.array([3, 3, 6])
    want = {"first": [2, 0, 1], "last": [1, 0, 2], "most": [1, 0, 2], "split": [4 / 3, 0, 5 / 3]}
    for rule, counts in want.items():
        got, crossing = tokens.allocate(ends, starts, stops, rule)
        assert got == pytest.approx(counts) and crossing.tolist() == [1, 0, 1]


def test_token_counts_of_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    encoding, sizes = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN)
    want = {}
    for d, text in docs.items():
        at, line = 0, 0
        raw = text.encode()
        for t in encoding.encode_ordinary(text):
            want[d, raw.count(b"\n", 0, at)] = want.get((d, raw.count(b"\n", 0, at)), 0) + 1
            at += int(sizes[t])
    rows = queries.op4_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert {(r["doc_id"], r["section"]): r["n_tokens"] for r in rows if r["n_tokens"]} == want


def test_top_k_with_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.001, 2.0]), (4, None), (5, [nan, 1.0]),
               (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [1e6, 1e9]), (10, [0.0, 0.1])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    fine = topk.quantised(table)
    for block in (1 << 20, 40):
        rows = topk.top_k(fine, fine.filter("vec_id IN (0, 8, 9)"), 3, block).collect()
        assert [tuple(r) for r in sorted(rows)] == [
            (0, 1, 10, 128 * 256 * 10 ** 6 + 128 * 256 * 10 ** 9), (0, 2, 3, 128 * -1 + 128 * 512), (0, 3, 1, 32768)]
    assert topk.top_k(fine.limit(0), fine.limit(0), 3).collect() == []


def test_url_parts_and_rules(spark):
    rows = [(1, "HTTP://Sub.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://a.org"), (4, None), (5, "nothing"),
            (6, "http://x.com/fr/1"), (7, "x://y.com?z://w/"), (8, "http://com/de/"), (9, "http://badorg/"), (10, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    pages = pages.withColumn("host", F.lit("mine")).withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in urls.filter_urls(pages, queries.URL_RULES).collect()}
    assert got[1] == ("sub.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    # The path of a url without one is empty, and no rule path starts it.
    assert got[3] == ("a.org", "", None, "allow") and got[7] == ("y.com", "", None, "allow")
    assert got[4] == got[5] == got[10] == ("", "", None, "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][2] is None
    assert urls.filter_urls(pages.limit(0), queries.URL_RULES).collect() == []


def test_trust_and_distrust_follow_links(spark):
    link = '<a href="http://{}/p">x</a>'
    rows = [(1, "http://good.org/a", link.format("Friend.net")), (2, "http://friend.net/", link.format("far.net")),
            (3, "http://x.com/de/1", ""), (4, "http://helper.net/", link.format("x.com") + link.format("x.com")),
            (5, "http://behind.net/", "<A HREF=//helper.net/z>"), (6, "http://far.net/", None), (7, "http://alone.net/", "<a href=/x>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: r for r in urls.filter_urls(pages, queries.URL_RULES).collect()}
    trust, distrust = plain_rank(
        {"good.org": ["friend.net"], "friend.net": ["far.net"], "helper.net": ["x.com"], "behind.net": ["helper.net"]},
        {"good.org": 1.0}), plain_rank(
        {"friend.net": ["good.org"], "far.net": ["friend.net"], "x.com": ["helper.net"], "helper.net": ["behind.net"]},
        {"x.com": 1.0})
    for host, row in got.items():
        assert row["trust"] == pytest.approx(trust.get(host, 0)) and row["distrust"] == pytest.approx(distrust.get(host, 0))
    verdicts = {h: r["verdict"] for h, r in got.items()}
    assert verdicts == {"good.org": "allow", "friend.net": "allow", "far.net": "allow", "x.com": "block",
                        "helper.net": "block", "behind.net": "block", "alone.net": "allow"}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    """Thirty hosts that link on to a blocked one, in a ring with a side way; scores equal those of many rounds."""
    link = '<a href="http://{}/p">x</a>'
    rows = [(i, f"http://h{i}.net/", link.format(f"h{i + 1}.net") + (link.format("h3.net") if i == 9 else "")) for i in range(29)]
    rows += [(29, "http://h29.net/", link.format("x.com")), (30, "http://x.com/de/1", link.format("h20.net")), (31, "http://else.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: r for r in urls.filter_urls(pages, queries.URL_RULES).collect()}
    back = {f"h{i + 1}.net": [f"h{i}.net"] for i in range(29)} | {"x.com": ["h29.net"]}
    back["h3.net"] = ["h2.net", "h9.net"]
    back["h20.net"] = ["h19.net", "x.com"]
    want = plain_rank(back, {"x.com": 1.0})
    for host, row in got.items():
        assert row["distrust"] == pytest.approx(want.get(host, 0), abs=1e-6)
        assert row["verdict"] == ("allow" if host == "else.net" else "block")


def plain_rank(targets, seeds, damping=0.85, rounds=200):
    start = {h: (1 - damping) * w for h, w in seeds.items()}
    scores = dict(start)
    for _ in range(rounds):
        new = dict(start)
        for host, score in scores.items():
            for t in targets.get(host, ()):
                new[t] = new.get(t, 0) + damping * score / len(targets[host])
        scores = new
    return scores


def test_url_verdicts_of_pages(spark):
    pages = queries.table(spark, SMALL, "pages").collect()
    rows = queries.op10_url_filter(spark, SMALL).collect()
    assert len(rows) == len(pages)
    hosts = {}
    for r in rows:
        hosts.setdefault(r["host"], []).append((r["rule"] is not None, r["verdict"]))
    shares = {h: [sum(a and b == v for a, b in x) / len(x) for v in ("allow", "block")] for h, x in hosts.items()}
    total = [sum(s[k] for s in shares.values()) for k in (0, 1)]
    for r in rows:  # no page links to another host here, so a host has only what it starts with
        trust, distrust = (0.15 * shares[r["host"]][k] / total[k] for k in (0, 1))
        assert r["trust"] == pytest.approx(trust) and r["distrust"] == pytest.approx(distrust)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if distrust > 0 and distrust >= 0.75 * (trust + distrust) else "allow")


def test_decontamination_equals_brute_force(spark):
    docs, items = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "benchmark")
    sets = {r["item_id"]: shingles(r["text"], 5, False) for r in items.collect()}
    want = set()
    for r in docs.collect():
        own = shingles(r["text"], 5, False)
        want |= {(r["doc_id"], i) for i, s in sets.items() if s and len(s & own) >= 0.8 * len(s)}
    got = queries.op8_decontamination(spark, SMALL).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want


def test_decontamination_of_odd_rows(spark):
    item = prose(90, 40)
    changed = item.split()
    changed[3] = "zz"
    docs = odd_documents(spark, [(50, prose(91, 3000) + " " + item.upper() + " " + prose(92, 3000), "en", "a"),
                                 (51, " ".join(changed), "en", "a"), (52, " ".join(item.split()[:25]), "en", "a")])
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two"), (None, prose(2, 80)), (1, item)],
                                  "item_id long, text string")
    for block in (1 << 20, 100):
        rows = decontaminate.contaminated(docs, items, ["doc_id"], block_bytes=block).collect()
        assert sorted(((r["doc_id"], r["item_id"]) for r in rows), key=repr) == [(50, 1), (51, 1), (None, None)]
        hit = next(r for r in rows if r["doc_id"] == 50)
        assert (hit["start_word"], hit["end_word"], hit["containment"]) == (3000, 3040, 1.0)
    clean = decontaminate.decontaminated(docs, items)
    assert clean.count() == docs.count() - 3 and clean.columns == docs.columns
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.decontaminated(docs.limit(0), items).count() == 0


def test_an_item_in_parts_is_found(spark):
    """Halves far apart hold .89 of an item's shingles together, and neither holds enough alone."""
    item = prose(90, 40).split()
    halves = " ".join(item[:20]) + " {} " + " ".join(item[20:])
    docs = spark.createDataFrame(
        [(1, halves.format(prose(91, 100))), (2, halves.format(prose(92, 5000)) + " " + prose(93, 900)),
         (3, " ".join(item[:20]) + " " + prose(94, 500))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    rows = decontaminate.contaminated(docs, items, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in rows) == [(1, 0, 140), (2, 0, 5040)]
    assert all(r["containment"] == pytest.approx(32 / 36) for r in rows)


def plain_fill(budget, children):
    """Water filling with exact fractions: {child: tokens}."""
    given, left = {}, dict(children)
    while left:
        total = sum(w for _, w in left.values())
        full = {c: cap for c, (cap, w) in left.items() if cap * total <= budget * w}
        if not full:
            given.update({c: budget * w // total for c, (_, w) in left.items()})
            break
        c = min(full, key=lambda x: left[x][0] / left[x][1])
        given[c] = full[c]
        budget -= full[c]
        left.pop(c)
    return given


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "en", "s1", 10, 1), ("a", "en", "s2", 1000, 1), ("a", "de", "s1", 5, 1), ("b", "en", "s3", 100, 1)],
        "domain string, lang string, source string, tokens long, _rows long")
    one = F.lit(1)
    for total in (0, 100, 700, 2000, 10 ** 9):
        rows = {(r["domain"], r["lang"], r["source"]): r["budget"]
                for r in mixing.budgets(leaves, [one, one, one], total, 2).collect()}
        cap = {"a": 2030, "b": 200}
        top = plain_fill(min(total, 2230), {k: (v, 1) for k, v in cap.items()})
        langs = plain_fill(top["a"], {"en": (2020, 1), "de": (10, 1)})
        sources = plain_fill(langs["en"], {"s1": (20, 1), "s2": (2000, 1)})
        assert rows == {("a", "en", "s1"): sources["s1"], ("a", "en", "s2"): sources["s2"], ("a", "de", "s1"): langs["de"],
                        ("b", "en", "s3"): top["b"]}


def test_mixing_takes_odd_rows(spark):
    docs = odd_documents(spark).withColumn("domain", F.lit(7)).withColumn("copies", F.lit("c"))
    one = F.lit(1)
    rows = mixing.mix(docs, F.lit("all"), [one, one, one], 10 ** 9, max_epochs=3).collect()
    assert {r["copies"] for r in rows if r["tokens"]} == {3} and all(r["domain"] == "all" for r in rows)
    some = mixing.mix(docs, F.lit("all"), [one, one, one], 200, rows_per_range=1).collect()
    assert 0 < sum(r["tokens"] * r["copies"] for r in some) <= 200
    assert mixing.mix(docs.limit(0), F.lit("all"), [one, one, one], 0.5).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3)]
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(table).collect()}
    assert got == {r["node"]: r["component"] for r in components(table, per_group=len(edges) // 5 + 1).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i
    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in parent}


def test_results_hold_plain_columns(spark):
    shown = {f.name: f.dataType.simpleString() for f in queries.op7_top_k(spark, SMALL).schema.fields}
    assert json.dumps(shown) == json.dumps({"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"})


def test_rejected_texts_go_and_python_takes_small_batches(spark, monkeypatch):
    """As the filter on `classify`, with nulls and repeated rows; statistics are made of at most 500 texts at once."""
    docs = odd_documents(spark, [(100 + i, prose(i, 5 + i % 40) if i % 3 else "!| 77 " * i, "en", "z") for i in range(1200)]).coalesce(1)
    labels = spark.createDataFrame([(100 + i, int(i % 3 > 0)) for i in range(0, 1200, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scored = quality.classify(docs, labels, F.lit(True), score_col="_score")
    for least in (0.1, 0.5):
        want = sorted(map(repr, scored.filter(F.col("_score") >= least).select(*docs.columns).collect()))
        found = sorted(map(repr, quality.without_rejected(docs, labels, F.lit(True), least).collect()))
        assert found == want
    assert 0 < len(want) < docs.count()

    width = len(quality.FEATURES)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def strict(texts):
        if len(texts) > 500:
            raise ValueError(f"{len(texts)} texts")
        return pa.array([[0.0] * width] * len(texts), pa.list_(pa.float64()))
    monkeypatch.setattr(quality, "document_statistics", strict)
    assert quality.without_rejected(docs, labels, F.lit(True), 2.0).count() == 0
