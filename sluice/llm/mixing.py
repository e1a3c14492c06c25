"""Mixing sources to target weights: budgets passed down a tree, filled from seeded epochs. DataFrame operations only."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.joins import stored

MAX_EPOCHS = 4
ROWS_PER_RANGE = 1024
_SPACES = r"[\x20\x09-\x0D]+"


def word_tokens(text):
    """Words of a text: runs of bytes other than ASCII white space; null has none."""
    spaced = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    return (F.size(F.split(spaced, _SPACES)) - 1 - spaced.rlike(r"[\x20\x09-\x0D]\z").cast("int")).cast("long")


def _filled(level: DataFrame, parent, budget, cap, weight) -> DataFrame:
    """Divide each parent's budget among its children by weight, none above its capacity.

    Children are taken in the order of capacity over weight. Those whose share reaches their capacity are full, and
    what they leave is shared by the later siblings. All arithmetic is on integers; the remainders of the
    divisions, less than one token a child, are not given out.
    """
    order = Window.partitionBy(*parent).orderBy(F.col(cap) / F.col(weight), "_node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    level = level.withColumn("_left", left).withColumn("_weights", weights)
    level = level.withColumn("_full", F.expr(
        f"cast({cap} as decimal(38,0)) * _weights <= cast(_left as decimal(38,0)) * {weight}"))
    open_left = F.max(F.when(~F.col("_full"), F.col("_left"))).over(whole)
    open_weights = F.max(F.when(~F.col("_full"), F.col("_weights"))).over(whole)
    level = level.withColumn("_open_left", open_left).withColumn("_open_weights", open_weights)
    return level.withColumn("_given", F.expr(
        f"case when _full then {cap} else cast((cast(_open_left as decimal(38,0)) * {weight}) div _open_weights as bigint) end"))


def budgets(leaves: DataFrame, weights: list, total, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The tokens that each leaf of a domain-language-source tree is to give.

    `leaves` is (domain, lang, source, tokens); `weights` holds for each of the three levels a column of positive
    integers. A node can give `max_epochs` times its tokens. The root divides `total` (a number, cut to what the
    whole tree can give) among domains by weight, each domain its part among languages, and so on. A child that
    cannot give its share is filled, and its shortage goes to its siblings; only what all siblings together cannot
    give is left to the level above. Returns the leaves with `capacity` and `budget`.
    """
    levels = ["domain", "lang", "source"]
    capped = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    frame = None
    for depth in range(3):
        keys, parent = levels[:depth + 1], levels[:depth]
        sums = capped.groupBy(*keys).agg(F.sum("capacity").alias("_cap"))
        sums = sums.withColumn("_weight", weights[depth].cast("long")).withColumn("_node", F.col(levels[depth]))
        if frame is None:
            sums = sums.withColumn("_budget", F.least(
                F.lit(int(total)), F.sum("_cap").over(Window.partitionBy(F.lit(0)))))
            sums = _filled(sums, [F.lit(0)], "_budget", "_cap", "_weight")
        else:
            sums = sums.join(frame, parent)
            sums = _filled(sums, parent, "_budget", "_cap", "_weight")
        frame = sums.select(*keys, F.col("_given").alias("_budget"))
    return capped.join(frame, levels).withColumnRenamed("_budget", "budget")


def draw_key(seed: int, epoch, id_col):
    """A document's place in an epoch's order: the MD5 of seed, epoch and id, as hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), id_col.cast("string")))


def _slot(key, ranges):
    """The range of a draw key: its first 13 digits, as a number, cut into equal parts."""
    return F.floor(F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(1 << 52) * ranges).cast("long")


def select_prefix(docs: DataFrame, plan: DataFrame, seed: int, id_col="doc_id",
                  rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Documents with `copies`: how many times the leaf's token prefix over its epochs holds them.

    `docs` has the leaf columns and `tokens`; `plan` the leaf columns, leaf tokens (`_leaf`) and `budget`. All whole
    epochs are taken whole. In the last, documents follow each other by `draw_key`, ties by id, and are taken while
    their running total stays within what is left. A leaf's order is cut into ranges of the key; sums of
    ranges give where the prefix ends, and only the range that holds the end is accumulated row by row, so no leaf
    is gathered in one task.
    """
    leaf = ["domain", "lang", "source"]
    plan = plan.select(
        *leaf, F.expr("case when _leaf > 0 then budget div _leaf else 0 end").alias("_epochs"),
        F.expr("case when _leaf > 0 then budget % _leaf else 0 end").alias("_rest"),
        F.greatest(F.lit(1), F.ceil(F.col("_rows") / rows_per_range)).alias("_ranges"))
    docs = docs.join(plan, leaf)
    docs = docs.withColumn("_key", draw_key(seed, F.col("_epochs"), F.col(id_col)))
    docs = docs.withColumn("_range", _slot(F.col("_key"), F.col("_ranges")))
    ranges = docs.groupBy(*leaf, "_range").agg(F.sum("tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    running = Window.partitionBy(*leaf).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0))).select(
        *leaf, "_range", "_before",
        F.when(F.col("_before") + F.col("_sum") <= F.col("_rest"), 1).when(
            F.col("_before") > F.col("_rest"), -1).otherwise(0).alias("_state"))
    docs = docs.join(ranges, [*leaf, "_range"])
    within = Window.partitionBy(*leaf, "_range").orderBy("_key", id_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ended = docs.filter("_state = 0").withColumn(
        "_extra", (F.col("_before") + F.sum("tokens").over(within) <= F.col("_rest")).cast("long"))
    clear = docs.filter("_state <> 0").withColumn("_extra", F.greatest(F.col("_state"), F.lit(0)).cast("long"))
    both = clear.unionByName(ended).withColumn("copies", F.col("_epochs") + F.col("_extra"))
    return both.drop("_epochs", "_rest", "_ranges", "_key", "_range", "_before", "_state", "_extra")


def mix(docs: DataFrame, domain, weights: list, total, seed: int = 0, id_col="doc_id", tokens=None,
        max_epochs: int = MAX_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Choose documents so that domains, languages and sources get `total` tokens by weight.

    `docs` has `lang` and `source`; `domain` is an expression of its columns, `tokens` too (the words of `text`, if
    none is given). `weights` are the columns of integer weights for domain, language and source. `total` is a number
    of tokens, or a fraction (a float) of all there are. Returns the documents that are chosen at least once,
    with `domain`, `tokens` and `copies`; columns of these names are replaced. Documents are scanned twice
    and, but for those of one range of a leaf, not shuffled.

    A document without words, or with null text, has no tokens and is taken when its place in the order comes. A null domain,
    language or source counts as ''. Null ids are ordered by seed and epoch alone. Repeated rows are documents
    of their own; of equal rows at the very end of a prefix an arbitrary one fits. An empty table gives an empty result.
    """
    count = word_tokens(F.col("text")) if tokens is None else tokens
    named = docs.withColumns({
        "_domain": F.coalesce(domain, F.lit("")), "_tokens": F.coalesce(count.cast("long"), F.lit(0)),
        "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    named = named.drop("domain", "tokens", "copies").withColumnsRenamed(
        {"_domain": "domain", "_tokens": "tokens"})
    leaves = stored(named.groupBy("domain", "lang", "source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("_rows")))
    if isinstance(total, float):
        total = int(leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"] * total)
    plan = stored(budgets(leaves, weights, total, max_epochs).withColumnRenamed("tokens", "_leaf"))
    return select_prefix(named, plan, seed, id_col, rows_per_range).filter("copies > 0")
