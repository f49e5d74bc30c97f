"""Conversations as a prefix trie, packed into double arrays shard by shard.

1. A turn is a 128-bit hash of its role and text with the number of its words; a
   conversation is the list of its turns.  Conversations with one and the same list
   become one row with their number and smallest id, aggregated before the shuffle.
2. The distinct lists are dealt out by range of their order, so a prefix's lists lie side
   by side: a first turn that a third of all conversations share is split over as many
   shards as it needs, and only prefixes that reach over the border of two shards occur
   in several.  How deep these go is read from the ends of neighbouring shards.
3. Each shard numbers its turns densely, packs its trie into BASE and CHECK arrays (a
   state's child by turn ``c`` is at BASE + c, and CHECK there names the state), follows
   all its lists through the arrays at once, depth by depth, and sums up from the leaves.
4. Nodes that lie in one shard only are complete.  The parts of the others, at most
   depth times shards, are merged by their path; each such node counts as owned in the
   first shard that has it, so children, leaves and words add up.

The ids of the conversations that end at a node are joined in chunks by range of id and
hashed as a stream, so that a very common conversation is never held as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import bounded_broadcast, cut, n_words, shared_path

#: Turns in a shard, about.
SHARD_TURNS = 50_000
#: Ids of a chunk differ by less than this.
CHUNK_IDS = 256
#: Up to so many merged nodes are broadcast to their children (counted first).
BROADCAST_NODES = 200_000
#: Free places that are tried for a node of several children before it goes to the end.
TRIES = 4096
SEQ = "array<struct<a:long,b:long,w:long>>"


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, seq)``: each conversation's turns in order."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), n_words(text).alias("w")).alias("t"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return per.select("conv_id", F.transform("ts", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["w"].alias("w"))).alias("seq"))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % every and goes on with its own after its first h; h = crc32(c) % most."""
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_of"), F.slice("seq", 1, most - 1).alias("_head"))
    own = convs.withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    rows = own.join(heads, own["conv_id"] - own["conv_id"] % every == F.col("_of"), "left")
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array().cast(SEQ))
    return rows.select("conv_id", F.concat(head, F.slice("seq", F.col("_h") + 1, F.greatest(F.size("seq") - F.col("_h"), F.lit(0)))).alias("seq"))


def pack(parent: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE and CHECK of a trie, and each node's place.

    Node 0 is the root; node i > 0 hangs under ``parent[i]`` by ``code[i]``.  Nodes of
    several children are placed first, those with most children before the others; the
    children of the rest fill the gaps, as one child fits anywhere.
    """
    n = len(parent)
    kids = np.lexsort((code[1:], parent[1:])) + 1
    owners, starts, counts = np.unique(parent[kids], return_index=True, return_counts=True)
    place, base_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used, top = np.zeros(max(2 * n, 16), bool), 1
    used[0] = True
    several = np.flatnonzero(counts > 1)
    low = 1
    for k in several[np.argsort(-counts[several], kind="stable")]:
        own = kids[starts[k] : starts[k] + counts[k]]
        gaps = code[own] - code[own[0]]
        if top + gaps[-1] + 1 > len(used):
            used = np.concatenate([used, np.zeros(top + gaps[-1] + 1, bool)])
        low += int(np.argmin(used[low:]))
        first = top
        free = np.flatnonzero(~used[low : min(low + 8 * TRIES, top)])[:TRIES] + low
        free = free[free + gaps[-1] < len(used)]
        for at in range(0, len(free), 128):
            fits = ~used[free[at : at + 128, None] + gaps].any(1)
            if fits.any():
                first = int(free[at + int(np.argmax(fits))])
                break
        place[own] = first + gaps
        used[place[own]] = True
        base_of[owners[k]] = first - code[own[0]]
        top = max(top, int(place[own[-1]]) + 1)
    single = np.flatnonzero(counts == 1)
    own = kids[starts[single]]
    free = np.flatnonzero(~used[:top])[: len(own)]
    place[own] = np.concatenate([free, np.arange(top, top + len(own) - len(free))])
    base_of[owners[single]] = place[own] - code[own]
    size = int(place.max(initial=0)) + 1
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    base[place] = base_of
    check[place[1:]] = place[parent[1:]]
    return base, check, place


def _nodes(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and code of the nodes of all lists, the root first, parents before children."""
    parent, code = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    at, n = np.zeros(len(lens), np.int64), 1
    span = int(codes.max(initial=0)) + 1
    for d in range(int(lens.max(initial=0))):
        rows = np.flatnonzero(lens > d)
        edges, back = np.unique(at[rows] * span + codes[starts[rows] + d], return_inverse=True)
        parent.append(edges // span)
        code.append(edges % span)
        at[rows] = n + back
        n += len(edges)
    return np.concatenate(parent), np.concatenate(code)


def shard_nodes(rows: pa.Table) -> pa.Table:
    """A shard's nodes; ``rows``: its distinct lists in order, with how deep its first and last path go on in the shards beside it (-1: not at all)."""
    rows = rows.combine_chunks()
    seq = rows["seq"].chunk(0)
    starts = np.asarray(seq.offsets)[:-1].astype(np.int64)
    lens = np.diff(np.asarray(seq.offsets)).astype(np.int64)
    a, b, w = (np.asarray(seq.values.field(k)).astype(np.int64) for k in ("a", "b", "w"))
    pairs = np.empty(len(a), [("a", np.int64), ("b", np.int64)])
    pairs["a"], pairs["b"] = a, b
    codes = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    base, check, place = pack(*_nodes(codes, starts, lens))
    n_rows, conv = np.asarray(rows["n"]).astype(np.int64), np.asarray(rows["conv_id"]).astype(np.int64)
    left, right = rows["d_left"][0].as_py(), rows["d_right"][0].as_py()

    size = len(base)
    members, least, words, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    ends = np.full(size, -1, np.int64)
    state = np.zeros(len(lens), np.int64)
    members[0], least[0] = n_rows.sum(), conv.min()
    ends[state[lens == 0]] = np.flatnonzero(lens == 0)
    first, last = [0], [0]  # places on the path of the first and the last list
    for d in range(int(lens.max(initial=0))):
        on = np.flatnonzero(lens > d)
        to = base[state[on]] + codes[starts[on] + d]
        if (check[to] != state[on]).any():
            raise AssertionError("a list leaves its double array")
        state[on] = to
        np.add.at(members, to, n_rows[on])
        np.minimum.at(least, to, conv[on])
        words[to], depth[to] = w[starts[on] + d], d + 1
        ends[to[lens[on] == d + 1]] = on[lens[on] == d + 1]
        if lens[0] > d:
            first.append(int(state[0]))
        if lens[-1] > d:
            last.append(int(state[-1]))

    before, after = first[: left + 1], last[: right + 1]
    owned = np.ones(size, bool)
    owned[before] = False
    paths: dict[int, str] = {}
    for row, places in ((0, before), (len(lens) - 1, after)):
        digest = hashlib.md5()
        for d, p in enumerate(places):
            if d:
                digest.update(pairs[starts[row] + d - 1].tobytes())
            paths[p] = f"{d}:{digest.hexdigest()}"
    children, leaves = np.zeros(size, np.int64), np.zeros(size, np.int64)
    nodes = np.sort(place)
    real = nodes[nodes > 0]
    np.add.at(children, check[real], owned[real].astype(np.int64))
    has = np.zeros(size, bool)
    has[check[real]] = True
    leaves[nodes] = ~has[nodes]
    leaves[after] = np.where(has[after], leaves[after], 0)
    saved = members * words - np.where(owned, words, 0)
    for d in range(int(depth[nodes].max(initial=0)), 0, -1):
        own = real[depth[real] == d]
        np.add.at(leaves, check[own], leaves[own])
        np.add.at(saved, check[own], saved[own])

    above = check[nodes]
    at_end = ends[nodes]
    text = lambda places: pa.array([paths.get(int(p)) for p in places], pa.string())
    inside = np.array([int(p) < 0 or int(p) in paths for p in above])
    long = lambda x, null=None: pa.array(x, pa.int64(), mask=null)
    key = lambda name: long(np.where(at_end < 0, 0, np.asarray(rows[name]).astype(np.int64)[at_end]), at_end < 0)
    return pa.table({
        "path": text(nodes), "parent_path": text(above), "conv_id": long(least[nodes]), "depth": long(depth[nodes]), "parent_conv_id": long(np.where(inside, 0, least[above]), inside),
        "n_convs": long(members[nodes]), "n_children": long(children[nodes]), "n_leaves": long(leaves[nodes]), "saved_tokens": long(saved[nodes]), "e1": key("e1"), "e2": key("e2"),
    })


NODES = "path string, parent_path string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, e1 long, e2 long"


def _tries(batches):
    rows = list(batches)
    rows = pa.Table.from_batches(rows) if rows else None
    if rows is not None and rows.num_rows:
        yield from shard_nodes(rows).to_batches()


def _shared_depth(x: str, y: str) -> F.Column:
    """Length of the common prefix of two lists; -1 without one of them."""
    n = f"least(size({x}), size({y}))"
    return F.expr(f"case when {x} is null or {y} is null then -1 else coalesce(nullif(array_position(zip_with(slice({x}, 1, {n}), slice({y}, 1, {n}), (p, q) -> p = q), false), 0) - 1, {n}) end").cast("int")


def _ends(convs: DataFrame) -> DataFrame:
    """``(e1, e2, ends_sha256)`` of ``(conv_id, e1, e2)``: ids in ascending order, joined by commas."""
    chunk = F.floor(F.col("conv_id") / CHUNK_IDS)
    parts = convs.groupBy("e1", "e2", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    parts = parts.select("e1", "e2", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def digests(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for e1, e2, ids in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "ids")), strict=True):
                if (e1, e2) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (e1, e2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digest_rows(out)
        if key is not None:
            yield _digest_rows([(*key, digest.hexdigest())])

    return parts.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "chunk").mapInArrow(digests, "e1 long, e2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["e1", "e2", "ends_sha256"])


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """One row for each distinct prefix of the lists ``(conv_id, seq)``, the empty one included.

    Returns ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    Defined cases: a list without turns is a member of the root only and ends there; ids
    are distinct; lists of any length are followed depth by depth; no lists, no rows.
    """
    rows = convs.select("conv_id", "seq", F.xxhash64("seq").alias("e1"), F.xxhash64(F.lit(1), "seq").alias("e2"))
    rows = cut(rows)
    distinct = rows.groupBy("seq", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    turns = rows.select(F.size("seq").alias("n")).agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    ranged = cut(distinct.repartitionByRange(shards, "seq").sortWithinPartitions("seq")).withColumn("shard", F.spark_partition_id())
    ends = ranged.groupBy("shard").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    order = W.orderBy("shard")
    ends = ends.withColumns({"before": F.lag("hi").over(order), "after": F.lead("lo").over(order)})
    ends = ends.select("shard", _shared_depth("lo", "before").alias("d_left"), _shared_depth("hi", "after").alias("d_right"))  # one row for each shard
    found = shared_path(convs.sparkSession, "trie-nodes")
    ranged.join(F.broadcast(ends), "shard").drop("shard").mapInArrow(_tries, NODES).write.parquet(found)
    parts = convs.sparkSession.read.schema(NODES).parquet(found)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.where("path is not null").groupBy("path").agg(F.max("parent_path").alias("parent_path"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), *sums, F.max("e1").alias("e1"), F.max("e2").alias("e2"))
    merged = cut(merged)
    nodes = parts.where("path is null").unionByName(merged)
    parents = bounded_broadcast(merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("_parent")), broadcast_nodes)
    hanging = nodes.where("parent_path is not null").join(parents, "parent_path").withColumn("parent_conv_id", F.col("_parent"))
    nodes = nodes.where("parent_path is null").unionByName(hanging.select(nodes.columns)).drop("path", "parent_path")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nowhere = nodes.where("e1 is null").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return nodes.where("e1 is not null").join(_ends(rows.select("conv_id", "e1", "e2")), ["e1", "e2"]).select(out).unionByName(nowhere.select(out))


def conversation_trie(turns: DataFrame, rebuild: bool = True, shard_turns: int = SHARD_TURNS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """The trie of ``(conv_id, turn, role, text)``, by default of the rebuilt conversations.

    Defined cases: a null role or text is empty; turns are ordered by number, null first,
    and those of one number by role and then by hash; rows without a conversation id
    belong to none; a repeated row is a turn of its own; an empty table gives an empty
    result; other columns are ignored.
    """
    convs = sequences(turns)
    return prefix_trie(rebuilt(convs) if rebuild else convs, shard_turns, broadcast_nodes)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 13 over all conversations."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _crc_table() -> list[int]:
    """What CRC-32 makes of each byte, for SQL, which has no such function."""
    table = list(range(256))
    for _ in range(8):
        table = [(v >> 1) ^ (0xEDB88320 if v & 1 else 0) for v in table]
    return table


#: The same in DuckDB: prefixes as text, subtrees by all ancestors of each node; conversations of turns with distinct numbers.
OP13_SQL = r"""
with o as (
  select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first) as own from conversations where conv_id is not null group by conv_id
), h as (
  select o.*, (xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(conv_id::varchar, '')]),
    lambda c, x: xor(c >> 8, [{LUT}][(xor(c, x) & 255) + 1])), 4294967295) % 4)::bigint as h from o
), b as (
  select h.conv_id, list_concat(coalesce(s.own[1 : h.h], []), h.own[h.h + 1 :]) as turns from h left join o s on s.conv_id = h.conv_id - h.conv_id % 20
), p as (
  select conv_id, unnest(range(0, len(turns) + 1)) as depth, turns from b
), q as (
  select conv_id, depth, len(turns) as n, md5(turns[1 : depth]::json::varchar) as path, case when depth > 0 then md5(turns[1 : depth - 1]::json::varchar) end as above,
    case when depth > 0 then len(regexp_extract_all(turns[depth].t, '[^\x20\x09-\x0D]+')) else 0 end as words, turns from p
), n as (
  select depth, path, min(above) as above, min(conv_id) as conv_id, count(*) as n_convs, min(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256, arg_min(turns, conv_id) as turns
  from q group by depth, path
), c as (
  select depth - 1 as depth, above as path, count(*) as n_children from n where depth > 0 group by 1, 2
), m as (
  select n.*, coalesce(n_children, 0) as n_children from n left join c using (depth, path)
), u as (
  select unnest(range(0, depth + 1)) as depth, depth as own, turns, n_children = 0 as leaf, (n_convs - 1) * words as saved from m
), s as (
  select depth, md5(turns[1 : depth]::json::varchar) as path, count(*) filter (where leaf) as n_leaves, sum(saved) as saved_tokens from u group by 1, 2
)
select m.conv_id, m.depth::bigint as depth, a.conv_id as parent_conv_id, m.n_convs::bigint as n_convs, m.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, m.ends_sha256
from m join s on s.depth = m.depth and s.path = m.path left join m a on a.depth = m.depth - 1 and a.path = m.above
""".replace("{LUT}", ", ".join(map(str, _crc_table())))
