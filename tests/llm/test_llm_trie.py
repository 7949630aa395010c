"""Prefix trie of conversations against a plain one."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from lattica.llm import prefix_trie
from lattica.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, part int, key string, tail string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """Rows of (conversation, turn, role, text) to rows of the trie; equal turns must hold equal texts."""
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by_conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in by_conv.items()}
    members = defaultdict(list)
    whole = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[x] for x in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(df):
    assert df.columns == COLUMNS and all(t == "bigint" for c, t in df.dtypes if c != "ends_sha256")
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "k", "t") for r in rows], SCHEMA).repartition(parts)


def varied(seed):
    rng = random.Random(seed)
    turns = [("user", f"text {i} é") for i in range(6)]
    rows = []
    for c in list(range(70)) + [1001, 1002, 1004]:
        if rng.random() < 0.1:
            continue
        own = rng.choice([turns[:3], turns, turns[:1] * 4, [rng.choice(turns) for _ in range(rng.randrange(1, 14))]])
        rows += [(c, t, *x) for t, x in enumerate(own)]
    return rows


@pytest.mark.parametrize("counters", [(1 << 16, 1 << 25), (8 << 13, 1 << 16)])
def test_table(spark, counters):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert built(prefix_trie.trie(table, counters=counters)) == plain_trie(rows)


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert built(QUERIES["op13_prefix_trie"].build(spark, "/root/testdata/sf0.001")) == plain_trie(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_varied(spark, seed, monkeypatch):
    if seed == 2:  # every conversation spans segments and pieces
        monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
        monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = varied(seed)
    rows += [(2000 + i, t, "user", f"same {t}") for i in range(40) for t in range(12)]  # one large group of copies
    rows += [(3000, None, "user", "first"), (3000, 5, None, "x"), (3000, 5, None, "x"), (3000, 7, "", None), (None, 1, "user", "lost")]
    rows += [(4000 + i, 0, "user", None) for i in range(9)] + [(5000, t, "user", "y" * (t % 7)) for t in range(900)]
    assert built(prefix_trie.trie(conversations(spark, rows))) == plain_trie(rows)


def test_a_full_sketch_only_costs_work(spark, monkeypatch):
    rows = varied(3)
    monkeypatch.setattr(prefix_trie, "screen", lambda prefixes, width: __import__("numpy").zeros(2 * width // 8, "uint8"))
    assert built(prefix_trie.trie(conversations(spark, rows))) == plain_trie(rows)


def test_a_conversation_that_spans_tasks(spark):
    rows = [(10, t, "user", f"turn {t}") for t in range(600)] + [(c, t, "user", f"turn {t}") for c in range(11, 15) for t in range(30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = prefix_trie.ordered_turns(conversations(spark, rows))
        assert ordered.where("conv = 10").select("part").distinct().count() > 1
        assert sorted(r.place for r in ordered.where("conv = 10").collect()) == list(range(600))
        assert built(prefix_trie.trie(conversations(spark, rows))) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_and_lonely(spark):
    assert built(prefix_trie.trie(conversations(spark, []))) == []
    for rows in ([(0, 0, "user", "x")], [(7, None, None, None)], [(3, 0, "user", "a"), (3, 1, "user", "b")]):
        assert built(prefix_trie.trie(conversations(spark, rows))) == plain_trie(rows)
