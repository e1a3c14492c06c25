"""The prefix trie of conversations, with subtree sums by an Euler tour that Spark ranks.

A node is a sequence of turns that some conversation starts with. Each node has an arc into it and one out of it; a walk
around the tree visits all arcs. Where each arc stands in the walk comes from list ranking, and what a subtree holds
is the difference of two prefix sums at the places of its root's arcs.

Nothing is gathered by conversation, node or parent: running sums go block by block over dense positions, chains
are contracted in groups of bounded size, and what is left of the list is ranked by pointer jumping.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.joins import scratch_tables, stored
from sluice.functions.ranking import row_numbers

BLOCK_BITS = 12
ARCS_PER_GROUP = 200_000
_EMPTY = hashlib.sha256(b"").hexdigest()
_SUM = "decimal(38,0)"


def running_sums(df: DataFrame, keys: list, position: str, values: list, bits: int = BLOCK_BITS) -> DataFrame:
    """Add `_to_<value>`, the sum of the rows of the same keys up to each position, itself included.

    Positions start at 1 and have no gaps, so a block of positions is a group of at most 2**`bits` rows, however many a
    key has. The sums of blocks have positions again, and are summed up in the same way. `df` is read twice: store it.
    """
    most = df.agg(F.max(position)).first()[0] or 0
    blocked = df.withColumn("_block", F.shiftright(F.col(position) - 1, bits))
    within = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.withColumns({f"_to_{v}": F.sum(v).over(within) for v in values})
    if most <= 1 << bits:
        return out.drop("_block")
    totals = stored(blocked.groupBy(*keys, (F.col("_block") + 1).alias("_at")).agg(
        *(F.sum(v).cast(df.schema[v].dataType).alias(v) for v in values)))
    before = running_sums(totals, keys, "_at", values, bits).select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), (F.col("_at") - 1).alias("_k_block"),
        *((F.col(f"_to_{v}") - F.col(v)).alias(f"_before_{v}") for v in values))
    met = F.col("_block") == F.col("_k_block")
    for k in keys:
        met = met & (F.col(k) == F.col(f"_k_{k}"))
    out = out.join(before, met).withColumns({f"_to_{v}": F.col(f"_to_{v}") + F.col(f"_before_{v}") for v in values})
    return out.drop("_block", "_k_block", *(f"_k_{k}" for k in keys), *(f"_before_{v}" for v in values))


def turns_of(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, depth (from 1), content (a SHA-256 of role and text) and n_chars of each turn, in the order of turns.

    Null turns come first; equal turns are ordered by role, then text, and repeated rows are turns of their own. A null role
    or text counts as empty. Rows without a conversation id are left out. Other columns are dropped.
    """
    plain = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).filter("conv_id IS NOT NULL")
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text")]
    hashed = F.sha2(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)
    return row_numbers(plain, ["conv_id"], order, "depth").select(
        "conv_id", "depth", hashed.alias("content"), F.length("_text").cast("long").alias("n_chars"))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, depth, content and n_chars, as `turns_of` gives them, with depths from 1 without gaps for each
    conversation; `conversations` has each conv_id once, and may hold some without turns. A node is named by its depth and
    the smallest conversation that starts with it: its texts are that conversation's first turns. The root has depth
    0 and no parent. `n_convs` counts the conversations that start with the node, `n_children` and `n_leaves` its children and the
    childless nodes of its subtree, itself included. `saved_tokens` adds up, over the subtree, the characters of a node's
    last text for each further conversation that has it. `ends_sha256` is the SHA-256 of the ids of the conversations that
    end there, ascending, comma-joined. Without conversations there is no root and the result is empty.

    Sequences are told apart by two sums of 60 bits of SHA-256 of (content, depth).
    """
    with scratch_tables(turns.sparkSession):
        nodes = stored(_nodes(turns, conversations))
        linked = stored(_linked(nodes))
        sums = _subtree_sums(linked)
        return stored(linked.join(sums, "node").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"),
            keep=True)


def _nodes(turns, conversations):
    """One row a node: conv_id, depth, parent_conv_id, n_convs, saved (its own) and ends_sha256."""
    digest = F.sha2(F.concat_ws("|", "content", F.col("depth").cast("string")), 256)

    def piece(start):
        return F.conv(F.substring("_digest", start, 15), 16, 10).cast(_SUM)

    hashed = stored(turns.withColumn("_digest", digest).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "n_chars",
        piece(1).alias("e1"), piece(16).alias("e2")))
    ids = stored(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).filter("conv_id IS NOT NULL").distinct())
    last = hashed.groupBy("conv_id").agg(F.max("depth").alias("last"))
    summed = running_sums(hashed, ["conv_id"], "depth", ["e1", "e2"]).join(last, "conv_id")
    prefixes = stored(summed.select(
        "conv_id", "depth", "n_chars", F.col("_to_e1").cast(_SUM).alias("p1"), F.col("_to_e2").cast(_SUM).alias("p2"),
        (F.col("_to_e1") - F.col("e1")).cast(_SUM).alias("q1"), (F.col("_to_e2") - F.col("e2")).cast(_SUM).alias("q2"),
        (F.col("depth") == F.col("last")).alias("ends")))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs")).filter("n_convs > 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("n_chars"),
        *(F.lit(0).cast(_SUM).alias(c) for c in ("p1", "p2", "q1", "q2")))
    nodes = stored(prefixes.groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2")).select(*root.columns).unionByName(root))
    # All nodes of depth 1 have the same parent, so only deeper ones are joined.
    top = nodes.filter("depth = 0").first()
    above = nodes.filter("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(above, ["depth", "q1", "q2"])
    high = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(
        F.col("depth") == 1, F.lit(top["conv_id"] if top else None).cast("long")))
    endless = ids.join(last, "conv_id", "left_anti").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast(_SUM).alias("p1"), F.lit(0).cast(_SUM).alias("p2"), "conv_id")
    ends = _ends(prefixes.filter("ends").select("depth", "p1", "p2", "conv_id").unionByName(endless))
    return high.unionByName(deep.select(*high.columns)).join(ends, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def _ends(members):
    """The digest of the ids of each node's members: texts of at most 2**`BLOCK_BITS` ids, hashed one after the other.

    A hash takes its bytes in order, but not at once: tasks stream a node's texts through it and keep none.
    """
    node = ["depth", "p1", "p2"]
    texts = members.groupBy(*node, F.shiftright("conv_id", BLOCK_BITS).alias("part")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    texts = texts.withColumn("node", F.concat_ws("|", *(F.col(c).cast("string") for c in node)))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist()):
                if name != current:
                    if current is not None:
                        done.append((current, total.hexdigest()))
                    current, total = name, hashlib.sha256(ids.encode())
                else:
                    total.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()),
                                              pa.array([h for _, h in done], pa.string())], ["node", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([total.hexdigest()])], ["node", "ends_sha256"])

    sorted_texts = texts.select("node", "part", "ids").repartition("node").sortWithinPartitions("node", "part")
    hashed = sorted_texts.mapInArrow(hashes, "node string, ends_sha256 string")
    parts = F.split("node", r"\|")
    return hashed.select(parts[0].cast("long").alias("depth"), parts[1].cast(_SUM).alias("p1"),
                         parts[2].cast(_SUM).alias("p2"), "ends_sha256")


def _linked(nodes):
    """Nodes numbered so that siblings follow each other, with the first child, the parent and the last sibling."""
    numbered = stored(row_numbers(nodes, [], [F.col("parent_conv_id").asc_nulls_first(), "depth", "conv_id"], "node"))
    children = numbered.filter("depth > 0").groupBy("parent_conv_id", "depth").agg(
        F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n_children")).select(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "first", "last", "n_children")
    own = stored(numbered.join(children, ["conv_id", "depth"], "left"))
    parents = own.filter("n_children > 0").select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"),
        F.col("last").alias("last_sibling"))
    return own.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).drop("last").join(
        parents, ["parent_conv_id", "depth"], "left")


def _subtree_sums(linked):
    """node, n_leaves and saved_tokens, by prefix sums over the Euler tour."""
    into, out_of = F.col("node") * 2, F.col("node") * 2 + 1
    leaf = F.col("n_children") == 0
    arcs = stored(linked.select(F.xxhash64("conv_id", F.shiftright("depth", BLOCK_BITS)).alias("chain"), F.inline(F.array(
        F.struct(into.alias("arc"), F.when(leaf, out_of).otherwise(F.col("first") * 2).alias("next"),
                 leaf.cast("long").alias("leaves"), F.col("saved").alias("saved")),
        F.struct(out_of.alias("arc"), F.when(F.col("node") < F.col("last_sibling"), into + 2).otherwise(
            F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("leaves"),
            F.lit(0).cast("long").alias("saved"))))))
    placed = stored(tour_positions(arcs).join(arcs.select("arc", "leaves", "saved"), "arc"))
    summed = running_sums(placed, [], "position", ["leaves", "saved"])
    # What is summed between the two arcs of a node belongs to its descendants.
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    return summed.groupBy(F.shiftright("arc", 1).alias("node")).agg(
        F.sum(sign * F.col("_to_leaves") + F.col("leaves")).cast("long").alias("n_leaves"),
        F.sum(sign * F.col("_to_saved") + F.col("saved")).cast("long").alias("saved_tokens"))


def tour_positions(arcs: DataFrame, per_group: int = ARCS_PER_GROUP) -> DataFrame:
    """(arc, position) of each arc of one list, from 1: `next` names the arc that follows, null at the end.

    Neighbours in the list mostly have the same `chain`, or numbers close by. Chains within groups of about `per_group`
    arcs are contracted to their heads, first by `chain`, then by number. The heads that are left are ranked by
    pointer jumping: each learns the sum up to twice as far ahead in each round.
    """
    total = arcs.count()
    first = stored(_contracted(arcs.select("arc", "next", F.lit(1).cast("long").alias("size"), F.pmod(
        F.col("chain"), F.lit(1 + total // per_group)).alias("group"))))
    second = stored(_contracted(_heads(first).withColumn("group", F.expr(f"arc div {per_group}"))))
    ranked = _ranked(_heads(second))
    starts = ranked.select(F.col("arc").alias("head"), (F.lit(total + 1) - F.col("left")).alias("start"))
    middle = second.join(starts, "head").select(F.col("arc").alias("head"), (F.col("start") + F.col("before")).alias("start"))
    return first.join(middle, "head").select("arc", (F.col("start") + F.col("before")).alias("position"))


def _heads(contracted):
    return contracted.filter("arc = head").select("arc", "next", "size")


def _contracted(arcs):
    """(arc, head, before, next, size): the first arc of the chain that holds the arc within its group, and the sizes between.
    `next` and `size` are those of the whole chain, on its head only."""
    def contract(table: pa.Table) -> pa.Table:
        arc, size = np.asarray(table["arc"]), np.asarray(table["size"])
        follow = np.asarray(table["next"].fill_null(-1) if table["next"].null_count else table["next"])
        order = np.argsort(arc)
        arc, size, follow = arc[order], size[order], follow[order]
        at = np.minimum(np.searchsorted(arc, follow), len(arc) - 1)
        at = np.where(arc[at] == follow, at, -1)
        # Jump backwards to the head, twice as far each time, adding the sizes on the way.
        back = np.arange(len(arc))
        before = np.zeros(len(arc), np.int64)
        inner = np.flatnonzero(at >= 0)
        back[at[inner]] = inner
        before[at[inner]] = size[inner]
        while True:
            further = back[back]
            if (further == back).all():
                break
            before = before + before[back]
            back = further
        ends = np.flatnonzero(at < 0)
        next_of = np.full(len(arc), -1)
        whole = np.zeros(len(arc), np.int64)
        next_of[back[ends]] = follow[ends]
        whole[back[ends]] = before[ends] + size[ends]
        return pa.table({
            "arc": arc, "head": arc[back], "before": before,
            "next": pa.array(next_of, mask=next_of < 0), "size": whole})
    return arcs.groupBy("group").applyInArrow(contract, "arc long, head long, before long, next long, size long")


def _ranked(heads, rows_per_task: int = ARCS_PER_GROUP):
    """(arc, left): the sum of the sizes from an arc to the end, by pointer jumping."""
    now = stored(heads.select("arc", "next", F.col("size").alias("left")))
    tasks = 1 + now.count() // rows_per_task
    while not now.filter("next IS NOT NULL").isEmpty():
        ahead = now.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        now = stored(now.join(ahead, "next", "left").select(
            "arc", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")).coalesce(tasks))
    return now
