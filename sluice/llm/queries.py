"""The operators of this package over the test tables, each with its whole intended table.

`QUERIES[name](spark, sf_dir)` applies an operator and returns its full result; `SQL[name]` is the same in DuckDB,
where SQL can express it.
"""

from pyspark.sql import functions as F

from sluice.llm import (
    decontaminate, jaccard, mixing, passages, quality, secrets, suffixes, tokens, topk, toxicity, trie, urls,
    whitening)

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col, n):
    """crc32 of the id as text, modulo n."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def predicted(score):
    return (score >= 0.5).cast("int").alias("predicted")


@query
def op1_toxicity(spark, sf_dir):
    """Toxicity of each document, learned from rows whose remainder by 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.classify(docs, labels, lambda i: remainder(i, 5) != 0)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", predicted(F.col("score")), "flagged")


@query
def op2_suffix_dedup(spark, sf_dir):
    """What is left of each document without strings of 200 bytes that occur elsewhere, too."""
    out = suffixes.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_quality(spark, sf_dir):
    """Quality of each document, learned from rows whose remainder by 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    out = quality.classify_slim(docs.withColumn("held_out", held), labels, ~held, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", predicted(F.col("score")))


@query
def op4_token_counts(spark, sf_dir):
    """Tokens of each line of each document, a crossing token counting for the line of its first byte."""
    docs = table(spark, sf_dir, "documents")
    return tokens.count_by_section(docs, ["doc_id"], ["text"], "first").withColumn(
        "n_tokens", F.col("n_tokens").cast("long"))


MIX = {"total": 0.5, "seed": 17, "max_epochs": 4}


def mix_documents(docs, tokens_col=None):
    """Sources src0 to src9 are one domain and the others another, with twice the weight."""
    return mixing.mix(
        docs, F.when(F.length("source") <= 4, "core").otherwise("wide"),
        [F.when(F.col("domain") == "core", 1).otherwise(2),
         F.when(F.col("lang") == "en", 5).when(F.col("lang") == "de", 3).when(F.col("lang") == "fr", 2).otherwise(1),
         F.when(F.col("source") == "src0", 1).otherwise(2)], tokens=tokens_col, **MIX)


@query
def op5_near_passages(spark, sf_dir):
    """Passages of 50 words or more that nearly repeat one of an earlier document."""
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("text_id")


@query
def op6_mixing(spark, sf_dir):
    """Half of all tokens, drawn by the weights of domains, languages and sources."""
    docs = table(spark, sf_dir, "documents")
    slim = mixing.stored(docs.select("doc_id", "lang", "source", mixing.word_tokens(F.col("text")).alias("n")))
    return mix_documents(slim, F.col("n")).select("doc_id", "domain", "lang", "source", "tokens", "copies")


def _fill_sql(level, parents, table):
    """One level of the division in SQL: `table` has the parents, the child, cap, w and budget."""
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    keys = ", ".join([*parents, level])
    return f"""
{level}_a AS (SELECT *,
    budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} ORDER BY cap / w, {level}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
    FROM {table}),
{level}_b AS (SELECT *, cap::HUGEINT * ws <= rest::HUGEINT * w AS is_full FROM {level}_a),
{level}_c AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE
    ((max(CASE WHEN NOT is_full THEN rest END) OVER ({by}))::HUGEINT * w) //
    (max(CASE WHEN NOT is_full THEN ws END) OVER ({by})) END::BIGINT AS budget FROM {level}_b)"""


SQL["op6_mixing"] = rf"""
WITH docs AS (SELECT doc_id, lang, source, CASE WHEN length(source) <= 4 THEN 'core' ELSE 'wide' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * 4)::BIGINT AS cap
    FROM docs GROUP BY ALL),
domain_in AS (SELECT domain, sum(cap)::BIGINT AS cap, CASE WHEN domain = 'core' THEN 1 ELSE 2 END AS w,
    (SELECT least(sum(cap), CAST(floor(sum(tokens) * 0.5) AS BIGINT)) FROM leaves)::BIGINT AS budget
    FROM leaves GROUP BY domain),
{_fill_sql("domain", [], "domain_in")},
lang_in AS (SELECT domain, lang, cap, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END AS w, budget
    FROM (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL) JOIN domain_c USING (domain)),
{_fill_sql("lang", ["domain"], "lang_in")},
source_in AS (SELECT domain, lang, source, tokens, cap, CASE source WHEN 'src0' THEN 1 ELSE 2 END AS w, budget
    FROM leaves JOIN lang_c USING (domain, lang)),
{_fill_sql("source", ["domain", "lang"], "source_in")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
    FROM source_c JOIN leaves USING (domain, lang, source)),
drawn AS (SELECT docs.*, epochs, rest, md5(concat_ws('|', '17', epochs, doc_id)) AS k
    FROM docs JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id) AS upto FROM drawn)
SELECT doc_id, domain, lang, source, tokens, (epochs + (upto <= rest)::BIGINT)::BIGINT AS copies
FROM placed WHERE epochs + (upto <= rest)::BIGINT > 0"""


@query
def op7_top_k(spark, sf_dir):
    """The 5 best candidates of each vector whose id is divisible by 50."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


SQL["op7_top_k"] = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query
def op8_decontamination(spark, sf_dir):
    """The benchmark items inside each document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, items, ["doc_id"])


@query
def op9_jaccard_join(spark, sf_dir):
    """Groups of documents whose sets of 3-word shingles have a similarity of 0.9 or more."""
    return jaccard.linked(table(spark, sf_dir, "documents"), 3, 90, 100).drop("text_id")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


@query
def op10_url_filter(spark, sf_dir):
    """A verdict on every page: the rule that fits, else the trust of its host."""
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@query
def op11_secrets(spark, sf_dir):
    """Secrets in each document, by pattern and by token efficiency."""
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *(secrets.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.KINDS),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def rebuilt(turns):
    """(turns, conversations): each conversation c begins with h turns of conversation c - c % 100 in place of its own first h.

    h is the CRC-32 of the id in decimal, modulo 6. Only five turns of each hundredth conversation are gathered.
    """
    ids = turns.groupBy("conv_id").agg(F.max("depth").alias("n")).withColumn("h", remainder(F.col("conv_id"), 6))
    heads = turns.filter("conv_id % 100 = 0 AND depth <= 5").groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "content", "n_chars"))).alias("head"))
    headed = mixing.stored(ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left").select(
        "conv_id", "h", F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array()).alias("head")))
    own = turns.join(headed.select("conv_id", "h", F.size("head").alias("k")), "conv_id").filter("depth > h").select(
        "conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "content", "n_chars")
    return headed.select("conv_id", F.inline("head")).unionByName(own), headed.select("conv_id")


@query
def op12_prefix_trie(spark, sf_dir):
    """The nodes of the trie of rebuilt conversations."""
    turns = mixing.stored(trie.turns_of(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(*rebuilt(turns))


SQL["op12_prefix_trie"] = """
WITH own AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b:
    CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
headed AS (SELECT ids.conv_id, h, count(own.pos) AS k FROM ids LEFT JOIN own
    ON own.conv_id = ids.conv_id - ids.conv_id % 100 AND own.pos <= h GROUP BY ALL),
turns AS (SELECT i.conv_id, own.pos AS d, r, x FROM headed i JOIN own
    ON own.conv_id = i.conv_id - i.conv_id % 100 AND own.pos <= h
    UNION ALL SELECT i.conv_id, own.pos - h + k, r, x FROM headed i JOIN own ON own.conv_id = i.conv_id AND own.pos > h),
members AS (SELECT conv_id, d, x, list({'r': r, 'x': x}) OVER (PARTITION BY conv_id ORDER BY d
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM turns
    UNION ALL SELECT conv_id, 0, '', [] FROM ids),
lasts AS (SELECT conv_id, max(d) AS last FROM members GROUP BY conv_id),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(length(x)) AS saved,
    sha256(coalesce(string_agg(CASE WHEN d = last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM members JOIN lasts USING (conv_id) GROUP BY d, k),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.k[1:n.d] = n.k)
    AS n_children FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]),
below AS (SELECT m.d, m.k, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
    FROM linked n JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.d, m.k)
SELECT l.conv_id::BIGINT AS conv_id, l.d::BIGINT AS depth, l.parent_conv_id::BIGINT AS parent_conv_id,
    l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
    b.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256 FROM linked l JOIN below b ON b.d = l.d AND b.k = l.k"""


@query
def op13_whitening(spark, sf_dir):
    """The first 16 whitened components of each vector."""
    return whitening.components(table(spark, sf_dir, "embeddings"), ["vec_id"])
