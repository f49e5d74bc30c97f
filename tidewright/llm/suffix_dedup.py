"""Suffix-array dedup: remove bytes of strings that an earlier document holds too.

A suffix of a document matters up to ``window`` bytes.  The construction goes
blockwise over suffix buckets:

1. *Cover sample.* In every window the gram (``gram`` bytes) of least hash is
   sampled, about one position in fourteen.  Fixed residues would give tied
   suffixes different phases; a content-defined sample gives them the same offset,
   and keeps the property that any two suffixes which tie for ``window`` bytes
   meet a sampled position at a common offset.
2. *Candidates.* Sampled grams are named and counted in hash buckets.  Suffixes
   whose sampled gram occurs once can't tie for ``window`` bytes and go no further.
3. *Cover ranks.* The others go to the bucket of their gram's name.  A bucket sorts a
   bounded batch at a time: the sampled suffixes in byte order and, for what precedes
   them, the reversed prefixes in byte order, each with the longest common prefixes of
   neighbours.  The rank of a sample at a depth is the number of neighbours before it
   that part earlier.
4. *Ties.* A suffix that begins ``p`` bytes before its sample ties with another for
   ``window`` bytes if their samples have one prefix rank at depth ``p`` and one suffix
   rank at depth ``window - p``: two numbers stand for the bytes, which are never
   compared again.  Suffixes are sorted by these ranks, and the smallest document of
   each tie is known.
5. The verdicts return to the documents as one bit for each window.

Memory: a block (``block_bytes`` of text) or a batch (``batch_windows`` suffixes).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import blocks as B

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Block:
    """A block's bytes, its cover sample and the distinct stretches around repeated grams."""

    def __init__(self, table: pa.Table, window: int, gram: int, n_buckets: int):
        self.table, self.ids = B.sorted_block(table)
        self.data, self.at = B.text_bytes(self.table["text"])
        symbols = B.mix(np.arange(1, 257, dtype=B.U64) * B.MULTIPLIERS[0])[self.data]
        grams, self.whole = B.rolling(symbols, gram, window) if len(symbols) >= window else (np.empty(0, B.U64), np.empty(0, B.U64))
        self.pos, self.lo, self.hi = B.cover(grams, self.at, window, window - gram + 1)
        self.name = B.mix(grams[self.pos] + B.MULTIPLIERS[1])
        self.names, self.inverse, self.counts = np.unique(self.name, return_inverse=True, return_counts=True)
        self.sent = np.diff(B.bucket_slices(self.names, n_buckets))

    def stretches(self, answers: pa.Table, n_buckets: int) -> None:
        """Sampled positions whose gram occurs again; equal stretches of the block share a record."""
        told = B.answer(answers, 1, self.sent, 2)
        keep = (told[:, 0] | (self.counts > 1))[self.inverse]
        hot = told[:, 1][self.inverse][keep]
        self.name, self.lo, self.hi, self.pos = B.split_hot(self.name[keep], self.lo[keep], self.hi[keep], self.pos[keep], hot, self.whole)
        self.n = self.hi - self.lo + 1
        self.doc = np.searchsorted(self.at, self.pos, "right") - 1
        key = B.mix(self.whole[self.lo] * B.MULTIPLIERS[2] + self.whole[self.hi]) + (self.n * 64 + self.pos - self.lo).astype(B.U64)
        order = np.lexsort((self.pos, key, self.name))  # the first of a run is the smallest document
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (self.name[order][1:] != self.name[order][:-1])
        self.first = order[new]
        self.record = np.empty(len(order), np.int64)
        self.record[order] = np.cumsum(new) - 1
        self.bounds = B.bucket_slices(self.name[self.first], n_buckets)


def _pieces(block: _Block, number: int, window: int, n_buckets: int) -> pa.Table:
    full, payload = [], []
    for b in range(n_buckets):
        own = block.first[block.bounds[b] : block.bounds[b + 1]]
        if not len(own):
            continue
        at, _ = B.spread(block.lo[own], block.n[own] + window - 1)
        head = np.array([len(own)], "<i8").tobytes() + B.pack48(block.name[own]) + (block.pos - block.lo)[own].astype("u1").tobytes()
        head += block.n[own].astype("u1").tobytes() + block.ids[block.doc[own]].astype("<i8").tobytes()
        full.append(b)
        payload.append(zstandard.ZstdCompressor(level=1).compress(head + block.data[at].tobytes()))
    return B.rows(B.EXCHANGE, bucket=full, block=[number] * len(full), kind=[0] * len(full), payload=payload)


class _Sorted:
    """Strings of ``width`` bytes in byte order, and the common prefixes of neighbours."""

    def __init__(self, strings: np.ndarray):
        wide = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
        wide[:, : strings.shape[1]] = strings
        words = wide.view(">u8").astype(B.U64)
        order = np.lexsort(words.T[::-1])
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        differ = wide[order][1:] != wide[order][:-1]
        self.common = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), wide.shape[1])])

    def rank(self, depth: int) -> np.ndarray:
        """Ranks of the strings cut to ``depth`` bytes, in the order given: equal ones have one rank."""
        return np.cumsum(self.common < depth)[self.place]


def _flags(name: np.ndarray, offset: np.ndarray, count: np.ndarray, doc: np.ndarray, start: np.ndarray, data: np.ndarray, window: int):
    """Place of each record's windows among all of the batch, and whether a smaller document has the same."""
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]), bool)
    reach = start + count + window - 1
    deep = int(offset.max())
    sample = start + offset
    after = sample[:, None] + np.arange(window)
    suffixes = _Sorted(np.where(after < reach[:, None], data[np.minimum(after, len(data) - 1)], 0))
    before = sample[:, None] - 1 - np.arange(max(1, deep))
    prefixes = _Sorted(np.where(before >= start[:, None], data[np.maximum(before, 0)], 0))
    _, code = np.unique(name, return_inverse=True)
    for p in range(deep + 1):
        own = np.flatnonzero((p <= offset) & (p > offset - count))
        if len(own) < 2:
            continue
        size = len(name) + 1
        left = np.unique(code[own] * size + prefixes.rank(p)[own], return_inverse=True)[1]
        tie = left * size + suffixes.rank(window - p)[own]
        order = np.lexsort((doc[own], tie))
        new = np.ones(len(own), bool)
        new[1:] = tie[order][1:] != tie[order][:-1]
        least = doc[own][order][new][np.cumsum(new) - 1]
        out[(ends - count + offset)[own[order]] - p] = least < doc[own][order]
    return out


def _sort_bucket(table: pa.Table, window: int, batch_windows: int) -> pa.Table:
    """One bit for each window of each record: a smaller document has the same window."""
    names, offset, count, doc, data, sizes = [], [], [], [], [], []
    for packed in table["payload"].to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        names.append(B.unpack48(raw[8 : 8 + 6 * n]))
        offset.append(np.frombuffer(raw, "u1", n, 8 + 6 * n))
        count.append(np.frombuffer(raw, "u1", n, 8 + 7 * n))
        doc.append(np.frombuffer(raw, "<i8", n, 8 + 8 * n))
        data.append(np.frombuffer(raw, "u1", offset=8 + 16 * n))
        sizes.append(int(count[-1].sum()))
    names, offset, count, doc, data = map(np.concatenate, (names, offset, count, doc, data))
    count, offset = count.astype(np.int64), offset.astype(np.int64)
    start = np.cumsum(count + window - 1) - (count + window - 1)
    bit_at = np.cumsum(count) - count
    flags = np.zeros(int(count.sum()), bool)
    order = np.argsort(names, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1], [True]]))
    done = np.concatenate([[0], np.cumsum(count[order])])
    at = 0
    while at < len(edges) - 1:  # whole names, as many as a batch holds
        to = max(at + 1, int(np.searchsorted(done[edges], done[edges[at]] + batch_windows, "right")) - 1)
        own = order[edges[at] : edges[to]]
        where, _ = B.spread(bit_at[own], count[own])
        flags[where] = _flags(names[own], offset[own], count[own], doc[own], start[own], data, window)
        at = to
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - s : e]).tobytes() for e, s in zip(ends, sizes, strict=True)]
    return B.rows(B.EXCHANGE, bucket=table["bucket"].to_pylist(), block=table["block"].to_pylist(), kind=[2] * len(bits), payload=bits)


def _cut(block: _Block, answers: pa.Table, window: int, n_buckets: int, schema: str) -> pa.Table:
    """The bytes that stay."""
    per_record = block.n[block.first]
    ends = np.concatenate([[0], np.cumsum(per_record)])
    flags = B.answer(answers, 2, np.diff(ends[block.bounds]))
    inside, which = B.spread(ends[:-1][block.record], block.n)
    own = block.ids[block.doc]
    later = own > own[block.first][block.record]
    removed = flags[inside] | later[which]
    start = (block.lo[which] + inside - ends[:-1][block.record][which])[removed]
    step = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + window, -1)
    gone = np.cumsum(step[:-1]) > 0
    out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    for i, (a, b) in enumerate(zip(block.at[:-1], block.at[1:], strict=True)):
        g = gone[a:b]
        kept = block.data[a:b][~g].tobytes()
        out["doc_id"].append(None if block.ids[i] == B.NULL_ID else int(block.ids[i]))
        out["n_bytes"].append(int(b - a))
        out["n_removed"].append(int(g.sum()))
        out["n_spans"].append(int((g[1:] & ~g[:-1]).sum() + (len(g) > 0 and g[0])))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept)
    return B.rows(schema, **out)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 24, block_bytes: int = 600_000, batch_windows: int = 250_000, texts: bool = True, hot_blocks: int = B.HOT) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that starts in a smaller document too.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``,
    ``kept`` (the bytes that stay).  Strings are judged on the input, overlaps count, and no
    string crosses a document.

    Defined cases: a null or empty text has 0 bytes and nothing removed; a null
    ``doc_id`` sorts before all others and stays null; rows with one ``doc_id`` are
    not smaller than each other, so they keep what only they share; a text below
    ``window`` bytes is kept; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    dealt = B.text_blocks(docs, block_bytes, id_col=id_col, text_col=text_col)
    n = dealt.buckets
    schema = f"{OUT}, kept binary" if texts else OUT

    def first(key, table):
        block = _Block(table.select(["doc_id", "text"]), window, gram, n)
        return B.gram_rows(key[0].as_py(), block.names, n)

    def second(key, left, right):
        block = _Block(left.select(["doc_id", "text"]), window, gram, n)
        block.stretches(right, n)
        return _pieces(block, key[0].as_py(), window, n)

    def repeated(table):
        return _sort_bucket(table, window, batch_windows)

    def last(key, left, right):
        block = _Block(left.select(["doc_id", "text"]), window, gram, n)
        block.stretches(right, n)
        return _cut(block, right, window, n, schema)

    return B.exchange(dealt.rows, first, second, repeated, last, schema, hot_blocks)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query 1 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs, texts=False)
