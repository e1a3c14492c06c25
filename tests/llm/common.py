"""Small tables with the cases that every operator must take."""

import random

LONG = "alpha beta gamma delta " * 6000


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubdfglmnrst") for _ in range(rng.randint(2, 8))) for _ in range(words))


def odd_documents(spark, extra=()):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns named like results."""
    same = prose(1, 120)
    rows = [
        (1, same, "en", "a"), (2, same, "en", "a"), (2, same, "en", "a"), (3, None, None, None), (4, "", "de", "b"),
        (5, " \t\n", "fr", "b"), (6, "one", None, "a"), (7, LONG, "en", None), (None, prose(2, 80), "en", "b"),
        (8, "émile Über " + prose(3, 70), "fr", "a"), (9, "One", "en", "a"), (2, prose(4, 90), "en", "c"), *extra]
    clash = ("s", 1, 0.5)
    return spark.createDataFrame(
        [(*r, *clash) for r in rows],
        "doc_id long, text string, lang string, source string, score string, n int, hits double")


def words(text):
    """Words by the rule of the library: runs of bytes other than ASCII white space, A-Z as a-z."""
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def shingles(text, n, short=True):
    w = words(text)
    if not w or (len(w) < n and not short):
        return set()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}
