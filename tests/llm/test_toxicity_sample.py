"""The word bound of the training sample."""

import random

from pyspark.sql import functions as F

from sluice.llm import toxicity


def test_one_very_long_text_leaves_the_others_in_the_sample(spark):
    rows = [(i, "word " * (5000 if i in (3, 4, 5) else 10), "en", i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = docs.select("doc_id", "toxic")
    sample = toxicity.training_sample(docs.drop("toxic"), labels, lambda i: F.lit(True), words=1000).collect()
    assert sorted(r["label"] for r in sample) == [0] * 19 + [1] * 18
    assert {r["n"] for r in sample} == {10}


def test_each_language_with_positives_has_a_threshold(spark):
    rng = random.Random(3)
    rows = []
    for lang, n, bad in (("en", 300, 3), ("de", 60, 3), ("fr", 80, 4), ("es", 40, 10 ** 6)):
        for i in range(n):
            toxic = int(i % bad == 0 and lang != "es")
            words = [rng.choice(["vile", "scum"] if toxic and k % 4 == 0 else ["plain", "word", "text", "of", lang]) for k in range(20)]
            rows.append((len(rows), " ".join(words), lang, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(toxicity.training_sample(docs.drop("toxic"), docs.select("doc_id", "toxic"), lambda i: F.lit(True)))
    assert {"en", "de", "fr"} <= set(model.thresholds) and "es" not in model.thresholds
    assert all(0 < t < 1 for t in model.thresholds.values())
