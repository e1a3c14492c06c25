"""Secrets: base patterns against a plain scanner, random strings against planted ones, odd rows."""

import hashlib
import random
import string

from pyspark.sql import functions as F

from sluice.llm import queries, secrets
from tests.llm.common import odd_documents, prose

ALNUM = string.ascii_letters + string.digits
VALUE = set(ALNUM + "+/_.=-")
RNG = random.Random(5)


def key(n, letters=ALNUM):
    return "".join(RNG.choice(letters) for _ in range(n))


def plain_assign(text):
    """The assign rule, character by character."""
    out, i = [], 0
    words = ("password", "passwd", "secret", "token", "api_key", "apikey")
    while i < len(text):
        word = next((w for w in words if text[i:i + len(w)].translate(
            {c: c + 32 for c in range(65, 91)}) == w), None)
        j = i + len(word) if word else 0
        end = None
        for quoted in (True, False) if word and text[j:j + 1] in ("'", '"') else (False,) if word else ():
            k = j + quoted
            while text[k:k + 1] == " ":
                k += 1
            if text[k:k + 1] not in (":", "="):
                continue
            k += 1
            while text[k:k + 1] == " ":
                k += 1
            k += text[k:k + 1] in ("'", '"') and text[k:k + 1] != ""
            e = k
            while text[e:e + 1] in VALUE and e < len(text):
                e += 1
            if e > k:
                end = (k, e)
                break
        if end:
            if end[1] - end[0] >= 6:
                out.append((i, end[1], 0))
            i = end[1]
        else:
            i += 1
    return out


def plain_runs(text, letters, least, kind, prefix=""):
    out, i = [], 0
    while i < len(text):
        if text.startswith(prefix, i) and text[i + len(prefix):i + len(prefix) + 1] in letters and i + len(prefix) < len(text):
            e = i + len(prefix)
            while e < len(text) and text[e] in letters:
                e += 1
            if e - i >= least:
                out.append((i, e, kind))
            i = e
        else:
            i += 1
    return out


def plain_base(text):
    return sorted(plain_assign(text) + plain_runs(text, set(string.ascii_uppercase + string.digits), 20, 1, "AKIA")
                  + plain_runs(text, set("0123456789abcdef"), 24, 2), key=lambda s: (s[0], s[2]))


def test_base_spans_equal_a_plain_scanner():
    parts = ["password", "Token", "SECRET", "api_key", "apiKEY", "passwd", "toKen", "ſecret", "=", ":", " ", "  ", "'", '"',
             "AKIA", "AKIAAKIA", "abc", "0123456789ab", "XYZ012345678", "\n", "é", "-", "/", ".", "deadbeefcafe", "q"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    found = 0
    for text in texts:
        got = sorted(secrets.base_spans(text), key=lambda s: (s[0], s[2]))
        assert got == plain_base(text), text
        found += len(got)
    assert found > 1000


def test_random_strings_are_found_and_forms_are_left():
    planted = [key(20), key(32), key(40, ALNUM + "+/") + "==", key(64), key(200), key(24, string.ascii_lowercase + string.digits)]
    clean = ["550e8400-e29b-41d4-a716-446655440000", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "4871316720949013",
             "getHttpResponseStatusCode", "MAX_BUFFER_SIZE_BYTES_PER_TASK", "http_proxy_timeout_ms_v2",
             "2026-12-01/logs/app/server-12", "einpfauaueinchpf", "Donaudampfschifffahrtsgesellschaft"]
    encoding, _ = secrets.encoder(secrets.VOCABULARY, secrets.PATTERN)
    text = "".join(f"{prose(i, 9)} {p}, " for i, p in enumerate([*planted, *clean]))
    got = [text[a:b] for a, b, k in secrets.spans_of(text, encoding) if k == 3]
    assert got == planted
    # In the middle of long words, and inside a long path.
    long = "/".join(["directory"] * 30) + "/" + planted[3] + "/" + "/".join(["another"] * 30)
    (a, b, _), = secrets.spans_of(f"é {long}", encoding)
    assert planted[3][16:48] in long[a - 2:b - 2] and b - a < 300
    assert secrets.spans_of(f"é{planted[0]}", encoding) == []
    # What lies in a base span is not said again; what sticks out is.
    assert [k for _, _, k in secrets.spans_of(f"token = {planted[1]}", encoding)] == [0]


def test_query_on_odd_rows(spark, tmp_path):
    value = key(32)
    extra = [(20, f"x token='{value}' AKIA{'Q1' * 10} {'0a' * 20}", "en", "a"), (21, "", None, None),
             (22, key(30) + " " + key(30), "en", "a"), (23, "token=short token=longer1", "en", "a")]
    docs = odd_documents(spark, extra).withColumn("spans", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_secrets(spark, str(tmp_path)).collect()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert len(got) == docs.count()
    encoding, _ = secrets.encoder(secrets.VOCABULARY, secrets.PATTERN)
    want = []
    for i, several in texts.items():
        for text in several:
            base = plain_base(text)
            line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in base)
            every = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in secrets.spans_of(text, encoding))
            want.append((i, *(sum(s[2] == k for s in base) for k in range(3)), hashlib.sha256(line.encode()).hexdigest(), every))
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want, key=repr)
    by = {r["doc_id"]: r for r in got}
    assert by[20]["spans"].count(":") == 6 and by[22]["n_random"] == 2 and by[23]["n_assign"] == 1


def test_known_values_and_masks(spark):
    a, b = key(28), key(28)
    docs = spark.createDataFrame([(1, f"x {a} y {b}"), (1, f"{a}"), (2, None), (3, f"token={a}")], "doc_id long, text string")
    known = spark.createDataFrame([(a,), (a,), (None,), ("else",)], "value string")
    found = secrets.find(docs, known=known)
    got = sorted((r["doc_id"], [(s["kind"], s["value"]) for s in r["spans"]]) for r in found.collect())
    assert got == [(1, []), (1, [("random", b)]), (2, []), (3, [("assign", f"token={a}")])]
    masked = {r["text"] for r in secrets.masked(found).collect()}
    assert masked == {f"x {a} y <secret>", a, None, "<secret>"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find(none).count() == 0 and secrets.find(none, known=none.selectExpr("text AS value")).count() == 0
