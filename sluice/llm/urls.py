"""Verdicts on urls: host and path rules, then trust and distrust propagated over the links between hosts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.joins import stored

DAMPING = 0.85
TOLERANCE = 1e-6
CUT_EVERY = 5
THRESHOLD = 0.75
# What a tag points to. Fixed pattern.
_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?([a-z][a-z0-9+.-]*:)?//([^/?#"'\s>\\]+)"""


def lower_ascii(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url):
    """(host, path) of a url: what follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased;
    then up to '?', '#' or the end. Both are empty for null and for a url without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def parse_rules(rules):
    """[(verdict, 'host/path')] as (verdict, host, path, rule), longest first; of equals, the first given."""
    parsed = [(v, *_cut(r), r) for v, r in rules]
    return sorted(parsed, key=lambda r: -len(r[3]))


def _cut(rule):
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def rule_for(host, path, rules):
    """The longest rule that fits, as a struct of rule and verdict; null if none does.

    The rules are a short list that the caller wrote; each is a condition of one expression.
    """
    chosen = None
    for verdict, rule_host, rule_path, rule in reversed(parse_rules(rules)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else F.when(fits, value).otherwise(chosen)
    if chosen is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return chosen


def judged(pages: DataFrame, rules, url_col="url") -> DataFrame:
    """`pages` with `_host`, `_path` and `_said` (the rule that fits)."""
    host, path = host_and_path(F.col(url_col))
    return pages.withColumn("_host", host).withColumn("_path", path).withColumn(
        "_said", rule_for(F.col("_host"), F.col("_path"), rules))


def host_edges(pages: DataFrame, html_col="html") -> DataFrame:
    """(src, dst, n): links of judged pages to other hosts. Relative links stay on a host and are no edges."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(2))
    found = pages.filter(F.col("_host") != "").select(
        F.col("_host").alias("src"), F.explode(F.array_distinct(links)).alias("link"))
    dst = lower_ascii(F.regexp_replace("link", "^[^@]*@", ""))
    return found.select("src", dst.alias("dst")).filter("src <> dst AND dst <> ''").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (host, score) for hosts that seeds reach over `edges` (src, dst, n).

    `seeds` is (host, weight); weights are made to sum to 1. score = (1 - damping) * seed + damping * what
    comes in, each host giving its score to its targets by n; what hosts without targets hold goes nowhere, so
    a score depends only on paths from seeds. Each round is one join and one pre-aggregated sum by host.
    Every few rounds the lineage is cut by a table in the shared folder. Scores only grow, so it ends when
    rounds reach no further host and add `tolerance` at most to the sum of all scores.
    """
    seeds = seeds.filter("weight > 0")
    total = seeds.agg(F.sum("weight").alias("total")).first()["total"] or 1.0
    start = stored(seeds.select("host", (F.col("weight") / total * (1 - damping)).alias("score")))
    if edges.isEmpty():
        return start
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = stored(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    scores, seen = start, (-1, 0.0)
    while True:
        for _ in range(CUT_EVERY):
            moved = shares.join(scores, F.col("src") == F.col("host")).select(
                F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            scores = start.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"))
        scores = stored(scores)
        now = tuple(scores.agg(F.count("host"), F.coalesce(F.sum("score"), F.lit(0.0))).first())
        if now[0] == seen[0] and now[1] - seen[1] <= tolerance:
            return scores
        seen = now


def host_scores(pages: DataFrame, edges: DataFrame, damping=DAMPING, tolerance=TOLERANCE) -> DataFrame:
    """(host, trust, distrust). A host is a seed by the share of its pages that rules allow or block. Trust follows
    links; distrust follows them backwards: to hosts that link to blocked ones."""
    verdict = F.col("_said.verdict")
    seeds = stored(pages.filter(F.col("_host") != "").groupBy(F.col("_host").alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((verdict == "allow").cast("long")).alias("good"),
        F.sum((verdict == "block").cast("long")).alias("bad")))
    backwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = propagate(edges, seeds.select("host", (F.col("good") / F.col("n")).alias("weight")), damping, tolerance)
    distrust = propagate(backwards, seeds.select("host", (F.col("bad") / F.col("n")).alias("weight")), damping, tolerance)
    zero = F.lit(0.0)
    both = trust.select("host", F.col("score").alias("trust"), zero.alias("distrust")).unionByName(
        distrust.select("host", zero.alias("trust"), F.col("score").alias("distrust")))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def filter_urls(pages: DataFrame, rules, url_col="url", html_col="html", threshold: float = THRESHOLD,
                damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """All rows of `pages` with host, path, rule, verdict, trust and distrust; columns of these names are replaced.

    A rule is (allow or block, 'host/path'): it fits its host and all subdomains, if the url's path starts with
    the rule's path; the longest fitting rule decides. Where none fits, a host is blocked if its distrust is above
    zero and at least `threshold` of trust plus distrust; a host that no seed reaches is allowed, as is a page
    without a host. Null urls and null html are empty. Repeated rows stay. An empty table gives an empty result.

    Pages are scanned twice and never shuffled by page; only hosts and edges are, summed within tasks first. Host
    scores come back by a join on the host, which Spark splits where one host has many pages.
    """
    names = ["host", "path", "rule", "verdict", "trust", "distrust"]
    pages = judged(pages.drop(*(set(names) - {url_col, html_col})), rules, url_col)
    edges = stored(host_edges(pages, html_col))
    scores = host_scores(pages, edges, damping, tolerance).withColumnRenamed("host", "_host")
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    said = F.coalesce(F.col("_said.verdict"), F.when(bad, "block").otherwise("allow"))
    out = pages.join(scores, "_host", "left").withColumns({
        "host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_said.rule"), "verdict": said,
        "trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    return out.drop("_host", "_path", "_said")
