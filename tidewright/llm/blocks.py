"""Blocks of documents, rolling hashes and the block/bucket exchange.

Operators that must compare every stretch of text with every other one share a
plan.  Documents are dealt into *blocks* of about ``block_bytes`` of text by a hash.
A block sends one packed row to each *bucket* (a range of hash values; as many buckets
as the text needs at ``bucket_bytes`` each), the bucket answers with one
packed row for each block, and the answer meets the block again.  A stretch that
a third of all documents hold reaches its bucket once for each block, never once
for each document; from HOT blocks on it is split (see ``names_in_blocks``).  The three
uses of the document exchange have the same plan, so Spark shuffles the texts once.

On a cluster with much memory for each core larger blocks and buckets mean fewer rows:
16 MB and 512 MB send about 50 names a row from 100 TB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers for the levels of the rolling hash and the mixers (fixed values).
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xA24BAED4963EE407],
    dtype=U64,
)
#: Stands for a null doc_id inside a block; it sorts before every other id.
NULL_ID = -(2**63)
EXCHANGE = "bucket int, block long, kind int, payload binary"


#: Names that so many blocks hold are hot; a name below that brings a bucket some megabytes at most.
HOT = 4096


@dataclass
class Dealt:
    """``(block, doc_id, text)`` and the number of buckets."""

    rows: DataFrame
    buckets: int


def text_blocks(docs: DataFrame, block_bytes: int, bucket_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> Dealt:
    """Rows dealt to blocks by a hash of id, text and input partition, whatever the ids are: null, repeated or far apart.

    A block holds about ``block_bytes``, and one text more where texts are longer.
    """
    text = F.col(text_col).cast("string")
    total, n = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    blocks = 1 + max((total or 0) // block_bytes, n // 4096)
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    # repeated rows are told apart by the partition that they come from
    block = F.pmod(F.xxhash64(own, text, F.spark_partition_id()), F.lit(blocks))
    return Dealt(docs.select(block.cast("long").alias("block"), own.alias("doc_id"), text.alias("text")), 4 + (total or 0) // bucket_bytes)


def packed(dealt: Dealt) -> DataFrame:
    """The dealt rows with the documents that a task has for one block compressed together.

    They are partitioned by block, the same for all uses: Spark shuffles the texts once.
    """

    def pack(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.take(pc.sort_indices(rows, [("block", "ascending")])).combine_chunks()
            number = rows["block"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.empty(0, np.int64)
            for a, b in zip(first, np.append(first[1:], len(number)), strict=True):
                sink = pa.BufferOutputStream()
                own = rows.slice(a, b - a).select(["doc_id", "text"])
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_table(own)
                yield pa.record_batch([pa.array([number[a]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    return dealt.rows.mapInArrow(pack, "block long, payload binary").repartition(dealt.buckets, "block")


def unpacked(table: pa.Table) -> pa.Table:
    """``doc_id, text`` of a block's packed rows."""
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return pa.concat_tables([kinds.empty_table(), *(pa.ipc.open_stream(x.as_buffer()).read_all().cast(kinds) for x in table["payload"])])


def sorted_block(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The block's rows in (doc_id, text) order, and their ids."""
    table = table.set_column(table.schema.get_field_index("text"), "text", pc.fill_null(table["text"], ""))
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
    return table, table["doc_id"].to_numpy()


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column of strings, and the offsets of its rows."""
    array = column.combine_chunks().cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_codes(column: pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row as codes, the offsets of the rows, and the words by code.

    ``lower`` maps A-Z only.
    """
    texts = column.combine_chunks().cast(pa.large_string()).fill_null("")  # no chunks make an empty array
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    words = flat.filter(full).dictionary_encode()
    counts = np.bincount(parents.filter(full).to_numpy(), minlength=len(lists))
    return words.indices.to_numpy(), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), words.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit of ``x``."""
    x = (x ^ (x >> U64(32))) * MULTIPLIERS[4]
    x = (x ^ (x >> U64(29))) * MULTIPLIERS[5]
    return x ^ (x >> U64(32))


class Stretches:
    """Hashes of any stretch of ``x`` from prefix sums of ``x[i] * base**i``."""

    BASE = MULTIPLIERS[0]
    BACK = U64(pow(int(MULTIPLIERS[0]), -1, 2**64))
    _powers = _backs = np.ones(1, U64)

    def __init__(self, x: np.ndarray):
        if len(Stretches._powers) <= len(x):
            n = 2 * len(x) + 1
            Stretches._powers, Stretches._backs = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, f)])) for f in (self.BASE, self.BACK))
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(x * self._powers[: len(x)])])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._backs[start] + (end - start).astype(U64) * MULTIPLIERS[5])


#: Words from so many bytes on are hashed one by one.
LONG_WORD = 128
_BYTES = mix(np.arange(1, 257, dtype=U64) * MULTIPLIERS[7])


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(vocabulary):
        return np.empty(0, U64)
    data, at = text_bytes(pa.chunked_array([vocabulary]))
    out = Stretches(_BYTES[data]).hashes(at[:-1], at[1:])
    for i in np.flatnonzero(np.diff(at) >= LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i + 1]].tobytes())
    return out


def rolling(base: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size the hash of ``base[i:i+size]`` for every i, by doubling: log2(size) passes."""
    powers, spans, level = [base], [1], 0
    while spans[-1] * 2 <= max(sizes):
        x, s = powers[-1], spans[-1]
        n = max(0, len(x) - s)
        powers.append(x[:n] * MULTIPLIERS[level % 8] + x[s : s + n] + (x[s : s + n] >> U64(31)))
        spans.append(2 * s)
        level += 1
    out = []
    for size in sizes:
        h, done = None, 0
        for x, s in zip(reversed(powers), reversed(spans), strict=True):
            while done + s <= size:
                if h is None:
                    h = x
                else:
                    n = max(0, len(base) - done - s + 1)
                    h = h[:n] * MULTIPLIERS[(done + s) % 8] + x[done : done + n] + (h[:n] >> U64(33))
                done += s
        out.append(mix(h[: max(0, len(base) - size + 1)]))
    return out


def cover(gram: np.ndarray, offsets: np.ndarray, window: int, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cover sample: in every window the leftmost gram of least hash.

    ``grams`` is the number of gram positions in a window.  Equal windows choose
    the same place, so two windows that tie share an offset to a sampled position,
    which is what a difference cover gives for fixed residues.  Returns sampled
    positions and for each the first and last start of the windows that chose it.
    """
    none = np.empty(0, np.int64)
    n = len(gram) - grams + 1
    if n <= 0:
        return none, none, none
    low, at, span = gram, np.arange(len(gram), dtype=np.int32), 1
    while span < grams:
        step = min(span, grams - span)
        m = len(low) - step
        left = low[:m] <= low[step : step + m]
        low, at = np.where(left, low[:m], low[step : step + m]), np.where(left, at[:m], at[step : step + m])
        span += step
    valid = np.zeros(n + 1, np.int32)
    start, end = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - window + 1)
    np.add.at(valid, np.minimum(start, n), 1)
    np.add.at(valid, np.minimum(end, n), -1)
    s = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(s):
        return none, none, none
    chosen = at[s].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(s)]]) - 1
    return chosen[first], s[first], s[last]


def bucket_slices(names: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bounds of each bucket in sorted ``names``; a bucket is a range of the upper 32 bits."""
    at = ((names >> U64(32)) * U64(n_buckets)) >> U64(32)
    return np.searchsorted(at, np.arange(n_buckets + 1, dtype=U64))


def pack48(names: np.ndarray) -> bytes:
    """The upper 48 bits of each name, six bytes each."""
    return np.ascontiguousarray(names >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes | memoryview) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def rows(schema: str, **columns) -> pa.Table:
    """A table for the Spark types named in ``schema``."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.table([pa.array(columns[n], kinds[t]) for n, t in (c.strip().split(" ") for c in schema.split(","))], names=[c.strip().split(" ")[0] for c in schema.split(",")])


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts[i], starts[i]+1, ...`` (``counts[i]`` of them) for every i, and i for each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return starts[which] + np.arange(len(which)) - (np.cumsum(counts) - counts)[which], which


# -- first round: which sampled grams occur more than once ------------------------


def gram_rows(block: int, names: np.ndarray, n_buckets: int) -> pa.Table:
    """One packed row for each bucket with the block's distinct sorted ``names``."""
    at = bucket_slices(names, n_buckets)
    full = [b for b in range(n_buckets) if at[b + 1] > at[b]]
    return rows(EXCHANGE, bucket=full, block=[block] * len(full), kind=[0] * len(full), payload=[pack48(names[at[b] : at[b + 1]]) for b in full])


def names_in_blocks(table: pa.Table, hot: int) -> pa.Table:
    """For each block's row of a bucket two bits for each name: does another block have it; do ``hot`` blocks have it.

    A hot name is only the place where a stretch is cut: blocks send its windows one by
    one under names of their own, so that no bucket gathers all that surrounds it.
    """
    parts = [unpack48(x) for x in table["payload"].to_pylist()]
    _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    bits, at, out = np.stack([counts[inverse] > 1, counts[inverse] >= hot], axis=1), 0, []
    for p in parts:
        out.append(np.packbits(bits[at : at + len(p)].ravel()).tobytes())
        at += len(p)
    n = len(out)
    return rows(EXCHANGE, bucket=table["bucket"].to_pylist(), block=table["block"].to_pylist(), kind=[1] * n, payload=out)


def answer(table: pa.Table, kind: int, lengths: np.ndarray, width: int = 1) -> np.ndarray:
    """The bits that buckets sent back, ``width`` for each item, in the order in which the block sent its items.

    ``lengths``: how many items the block sent to each bucket.
    """
    own = table.filter(pc.equal(table["kind"], kind))
    bits = np.zeros((int(lengths.sum()), width), bool)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for b, data in zip(own["bucket"].to_pylist(), own["payload"].to_pylist(), strict=True):
        n = int(lengths[b])
        bits[at[b] : at[b] + n] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return bits[:, 0] if width == 1 else bits


def split_hot(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, hot: np.ndarray, whole: np.ndarray):
    """Stretches ``(name, lo, hi, pos)`` with those of hot names cut into their windows, each named by its own hash."""
    if not hot.any():
        return name, lo, hi, pos
    at, which = spread(lo[hot], (hi - lo + 1)[hot])
    own = mix(whole[at] ^ MULTIPLIERS[4])
    return (*(np.concatenate([x[~hot], y]) for x, y in ((name, own), (lo, at), (hi, at), (pos, pos[hot][which]))),)


def exchange(docs_by_block: DataFrame, first, second, repeated, last, out_schema: str, hot: int) -> DataFrame:
    """The two rounds: grams to buckets and back, stretches to buckets and back, result.

    ``first(block)``, ``second(block, answers)`` and ``last(block, answers)`` see the
    rows of a block; ``repeated(bucket)`` sees the stretches that reached a bucket.
    """
    by_block = docs_by_block.groupBy("block")
    grams = by_block.applyInArrow(first, EXCHANGE)
    known = grams.groupBy("bucket").applyInArrow(lambda table: names_in_blocks(table, hot), EXCHANGE)
    stretches = by_block.cogroup(known.groupBy("block")).applyInArrow(second, EXCHANGE)
    found = stretches.groupBy("bucket").applyInArrow(repeated, EXCHANGE)
    return by_block.cogroup(known.unionByName(found).groupBy("block")).applyInArrow(last, out_schema)
