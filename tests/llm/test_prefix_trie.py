"""The conversation trie against brute force, with shards as small as a list, and its double arrays."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm.prefix_trie import OP13_SQL, _nodes, conversation_trie, op13_conversation_trie, pack

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    """``rows``: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, r or "", t or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = own
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        seqs = {c: own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, m in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def made(seed, n=400, kinds=5, most=7):
    """Conversations of few kinds of turns: deep shared prefixes, many copies, one first turn in most of them."""
    rng = random.Random(seed)
    return [(c, t, "user" if t % 2 else "assistant", f"say {rng.randrange(kinds) if t and rng.random() < 0.5 else 0} word") for c in range(n) for t in range(rng.randrange(1, most))]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_turns", [1, 30, 100_000])
def test_shards_of_any_size_give_one_trie(spark, shard_turns):
    rows = made(shard_turns)
    turns = spark.createDataFrame(rows, TURNS)
    assert got(conversation_trie(turns, shard_turns=shard_turns)) == brute(rows)


def test_nodes_meet_their_parents_by_shuffle_too(spark):
    rows = made(3)
    assert got(conversation_trie(spark.createDataFrame(rows, TURNS), rebuild=False, shard_turns=20, broadcast_nodes=0)) == brute(rows, False)


EDGES = [
    (0, 1, "user", "first turn"), (0, None, None, None), (0, 2, "user", "second"), (5, 1, "user", "own"), (40, 3, None, "three"), (40, 1, "", "one"), (41, 1, "user", ""), (None, 1, "user", "of no conversation"),
    (19, 1, "user", "a"), (18, 7, "x", "same number"), (18, 7, "x", "same number"), (60, 1, "u", "w " * 30_000), (61, 1, "u", "w " * 30_000), (-3, 1, "u", "below zero"), (100_007, 1, "u", "far"),
    *[(80, i, "u", f"turn {i}") for i in range(900)], *[(81, i, "u", f"turn {i}") for i in range(899)], *[(c, 1, "u", "a copy") for c in range(1000, 1700)],
]


@pytest.mark.parametrize("shard_turns", [50, 100_000])
def test_edge_rows(spark, shard_turns):
    turns = spark.createDataFrame(EDGES, TURNS).withColumn("seq", F.lit("clash")).withColumn("path", F.lit("clash")).withColumn("n", F.lit("clash"))
    assert got(conversation_trie(turns, shard_turns=shard_turns)) == brute(EDGES)


def test_empty_table(spark):
    assert got(conversation_trie(spark.createDataFrame([], TURNS))) == []


def test_query_equals_brute_force_and_sql(spark, small):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = got(op13_conversation_trie(spark, small))
    assert found == brute(rows)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    assert sorted(db.sql(OP13_SQL).project(", ".join(COLUMNS)).fetchall(), key=str) == found


def test_double_arrays_hold_every_child_and_nothing_else():
    rng = np.random.default_rng(7)
    lens = rng.integers(0, 6, 500)
    codes = (rng.zipf(1.3, int(lens.sum())) % 300).astype(np.int64)
    parent, code = _nodes(codes, np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    base, check, place = pack(parent, code)
    assert len(set(place)) == len(parent) and place[0] == 0
    assert (base[place[parent[1:]]] + code[1:] == place[1:]).all() and (check[place[1:]] == place[parent[1:]]).all()
    children = {(int(place[p]), int(c)) for p, c in zip(parent[1:], code[1:], strict=True)}
    for s in place[:50]:
        for c in range(300):
            t = base[s] + c
            assert (0 < t < len(check) and check[t] == s) == ((int(s), c) in children)
    assert len(base) <= len(parent) + 600
