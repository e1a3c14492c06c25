"""The prefix trie against a plain trie, running sums and tours against plain ones, in groups of any size."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sluice.llm import queries, trie


def plain_trie(rows, rebuild=True):
    """The result of the query, from (conv_id, turn, role, text) rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}

    def whole(c):
        h = zlib.crc32(str(c).encode()) % 6
        return own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]  # % as in SQL
    convs = {c: whole(c) if rebuild else turns for c, turns in own.items()}
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    saved, leaves = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        own_saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        saved[k] = own_saved + sum(saved[b] for b in below)
        leaves[k] = sum(leaves[b] for b in below) if below else 1
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])),
                    leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def answered(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                        "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def odd_rows():
    rng = random.Random(2)
    rows = []
    for c in [0, 1, 2, 3, 50, 99, 100, 101, 250, 251, 7000, 7001, -5]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé\U0001f600", "", None])))
    # Ties, null turns, repeated rows, one turn only (which the base may take away), no id.
    rows += [(2, 1, "user", "tie"), (2, 1, "assistant", "tie"), (2, None, "user", "first"), (2, None, "user", "first"),
             (301, 0, "user", "alone"), (302, 0, "user", "alone"), (303, 0, None, None), (None, 0, "user", "lost"),
             (400, 0, "user", "x" * 200_000), (401, 3, "ab", "c"), (402, 3, "a", "bc")]
    return rows


def test_query_equals_a_plain_trie(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("node", F.lit(1)).write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert answered(queries.op12_prefix_trie(spark, str(tmp_path))) == plain_trie(rows)


def test_turnless_conversations_and_no_conversations(spark, tmp_path):
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 5, 6)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = answered(queries.op12_prefix_trie(spark, f"{tmp_path}/a"))
    assert got == plain_trie(rows) and any(r[1] == 0 and r[3] == 6 for r in got)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert answered(queries.op12_prefix_trie(spark, f"{tmp_path}/b")) == []


def test_a_long_conversation_and_many_copies(spark, monkeypatch):
    """One conversation of 300 turns, cut into blocks of 8, and a group of 500 copies."""
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    monkeypatch.setattr(trie.running_sums, "__defaults__", (3,))
    monkeypatch.setattr(trie.tour_positions, "__defaults__", (64,))
    rows = [(1, t, "user", f"t{t % 7}") for t in range(300)] + [
        (c, t, "user", f"t{t}") for c in range(2, 502) for t in range(3)] + [(600, t, "user", f"t{t % 7}") for t in range(150)]
    turns = trie.stored(trie.turns_of(spark.createDataFrame(rows, SCHEMA)))
    got = trie.prefix_trie(turns, turns.select("conv_id").distinct())
    assert answered(got) == plain_trie(rows, rebuild=False)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_running_sums(spark, bits):
    rng = random.Random(bits)
    rows = [(k, i + 1, rng.randint(-9, 9)) for k, n in ((0, 1), (1, 77), (2, 8), (3, 9)) for i in range(n)]
    rng.shuffle(rows)
    df = trie.stored(spark.createDataFrame(rows, "k int, at long, v long"))
    got = {(r["k"], r["at"]): r["_to_v"] for r in trie.running_sums(df, ["k"], "at", ["v"], bits).collect()}
    assert got == {(k, at): sum(v for q, i, v in rows if q == k and i <= at) for k, at, _ in rows}


@pytest.mark.parametrize("per_group, chains", [(4, 3), (50, 10), (10_000, 1)])
def test_tour_positions_of_a_shuffled_list(spark, per_group, chains):
    """Neighbours of the list share nothing here, so most of it is left to pointer jumping."""
    order = list(range(400))
    random.Random(1).shuffle(order)
    rows = [(a, b, a % chains) for a, b in zip(order, [*order[1:], None])]
    arcs = trie.stored(spark.createDataFrame(rows, "arc long, next long, chain long"))
    got = {r["arc"]: r["position"] for r in trie.tour_positions(arcs, per_group).collect()}
    assert got == {a: i + 1 for i, a in enumerate(order)}
