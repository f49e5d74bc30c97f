"""Substring dedup: remove word passages that recur anywhere, by repeated-phrase automata.

1. *Candidates.* Of every window of ``window`` words the gram of least hash is
   sampled and counted in hash buckets; a window that recurs has a gram that recurs.
2. *Confirm.* The windows around recurring grams meet in buckets and are counted.
   Runs of recurring windows make the recurring passages; a block reads each once,
   from the first of its equal stretches.
3. *Automata.* Each block of documents is a shard: its recurring passages are
   compiled to an Aho-Corasick automaton over word codes.  Its size is bounded by
   the block, however many passages the corpus has.
4. *Stream.* Every document of the shard runs whole through the automaton, which alone
   locates the occurrences: buckets confirm passages, they don't say where these are.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Block:
    """A block's word codes, sampled grams and the distinct stretches around recurring grams."""

    def __init__(self, table: pa.Table, window: int, gram: int, n_buckets: int):
        self.table, self.ids = B.sorted_block(table)
        self.codes, self.at, self.vocabulary = B.word_codes(self.table["text"])
        symbols = B.word_hashes(self.vocabulary)[self.codes] if len(self.codes) else np.empty(0, B.U64)
        grams, self.whole = B.rolling(symbols, gram, window) if len(symbols) >= window else (np.empty(0, B.U64), np.empty(0, B.U64))
        pos, self.lo, self.hi = B.cover(grams, self.at, window, window - gram + 1)
        self.name = B.mix(grams[pos] + B.MULTIPLIERS[1])
        self.names, self.inverse, self.counts = np.unique(self.name, return_inverse=True, return_counts=True)
        self.sent = np.diff(B.bucket_slices(self.names, n_buckets))

    def stretches(self, answers: pa.Table, n_buckets: int) -> None:
        told = B.answer(answers, 1, self.sent, 2)
        keep = (told[:, 0] | (self.counts > 1))[self.inverse]
        self.name, self.lo, self.hi, _ = B.split_hot(self.name[keep], self.lo[keep], self.hi[keep], self.lo[keep], told[:, 1][self.inverse][keep], self.whole)
        self.n = self.hi - self.lo + 1
        key = B.mix(self.whole[self.lo] * B.MULTIPLIERS[2] + self.whole[self.hi]) + self.n.astype(B.U64)
        order = np.lexsort((key, self.name))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (self.name[order][1:] != self.name[order][:-1])
        self.first = order[new]
        self.record = np.empty(len(order), np.int64)
        self.record[order] = np.cumsum(new) - 1
        self.times = np.bincount(self.record, minlength=len(self.first))
        self.bounds = B.bucket_slices(self.name[self.first], n_buckets)


def _pieces(block: _Block, number: int, n_buckets: int) -> pa.Table:
    """Each distinct stretch once: its gram's name, how often the block has it, its windows' hashes."""
    full, payload = [], []
    for b in range(n_buckets):
        sel = slice(block.bounds[b], block.bounds[b + 1])
        own = block.first[sel]
        if len(own):
            at, _ = B.spread(block.lo[own], block.n[own])
            full.append(b)
            payload.append(
                np.array([len(own)], "<i8").tobytes() + B.pack48(block.name[own]) + block.n[own].astype("u1").tobytes() + np.minimum(block.times[sel], 2).astype("u1").tobytes() + block.whole[at].tobytes()
            )
    return B.rows(B.EXCHANGE, bucket=full, block=[number] * len(full), kind=[0] * len(full), payload=payload)


def _confirm(table: pa.Table) -> pa.Table:
    """One bit for each window of each record: it occurs twice or more in the corpus."""
    keys, times, sizes = [], [], []
    for raw in table["payload"].to_pylist():
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        count = np.frombuffer(raw, "u1", n, 8 + 6 * n).astype(np.int64)
        whole = np.frombuffer(raw, "<u8", offset=8 + 8 * n)
        # the gram's name and the window's own hash: over 100 bits stand for its words
        pair = np.empty((len(whole), 2), B.U64)
        pair[:, 0], pair[:, 1] = whole, np.repeat(B.unpack48(raw[8 : 8 + 6 * n]), count)
        keys.append(pair)
        times.append(np.repeat(np.frombuffer(raw, "u1", n, 8 + 7 * n).astype(np.int64), count))
        sizes.append(len(whole))
    pair, times = np.concatenate(keys), np.concatenate(times)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (pair[order][1:] != pair[order][:-1]).any(axis=1)
    total = np.add.reduceat(times[order], np.flatnonzero(new)) if len(order) else times
    flags = np.empty(len(order), bool)
    flags[order] = (total > 1)[np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - s : e]).tobytes() for e, s in zip(ends, sizes, strict=True)]
    return B.rows(B.EXCHANGE, bucket=table["bucket"].to_pylist(), block=table["block"].to_pylist(), kind=[2] * len(bits), payload=bits)


def _passages(block: _Block, answers: pa.Table, window: int) -> set[tuple[int, ...]]:
    """The block's confirmed passages: runs of recurring windows in each distinct stretch, read where it occurs first."""
    ends = np.concatenate([[0], np.cumsum(block.n[block.first])])
    flags = B.answer(answers, 2, np.diff(ends[block.bounds]))
    at, record = B.spread(block.lo[block.first], block.n[block.first])
    start, record = at[flags], record[flags]
    if not len(start):
        return set()
    first = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(record) > 0)]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return {tuple(block.codes[start[a] : start[b] + window].tolist()) for a, b in zip(first, last, strict=True)}


def _automaton(passages: set[tuple[int, ...]]):
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        out.add_word(p, len(p))
    out.make_automaton()
    return out


def _cut(block: _Block, answers: pa.Table, window: int, schema: str) -> pa.Table:
    passages = _passages(block, answers, window)
    machine = _automaton(passages) if passages else None
    words = block.vocabulary.to_pylist()
    out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
    for i, (a, b) in enumerate(zip(block.at[:-1], block.at[1:], strict=True)):
        codes = block.codes[a:b]
        if machine is not None:
            hits = np.array(list(machine.iter(tuple(codes.tolist()))), np.int64).reshape(-1, 2)
            step = np.zeros(len(codes) + 1, np.int32)
            np.add.at(step, hits[:, 0] - hits[:, 1] + 1, 1)
            np.add.at(step, hits[:, 0] + 1, -1)
            gone = np.cumsum(step[:-1]) > 0
        else:
            gone = np.zeros(len(codes), bool)
        kept = " ".join([words[c] for c in codes[~gone].tolist()])
        out["doc_id"].append(None if block.ids[i] == B.NULL_ID else int(block.ids[i]))
        out["n_words"].append(len(codes))
        out["n_removed"].append(int(gone.sum()))
        out["kept_sha256"].append(hashlib.sha256(kept.encode()).hexdigest())
        out["kept"].append(kept)
    return B.rows(schema, **out)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8, block_bytes: int = 600_000, texts: bool = True, hot_blocks: int = B.HOT) -> DataFrame:
    """Remove every word covered by a ``window``-word passage that also starts anywhere else.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept``
    (the words that stay, joined by one space).  Every occurrence goes, the first
    included; the same document may hold both.  Words are ``[^\\x20\\x09-\\x0D]+``.

    Defined cases: a null, empty or blank text has no words; a text below ``window``
    words is kept; a null ``doc_id`` stays null; repeated rows count as occurrences
    of their own; an empty table gives an empty result; other columns are ignored.
    """
    dealt = B.text_blocks(docs, block_bytes, id_col=id_col, text_col=text_col)
    n = dealt.buckets
    schema = f"{OUT}, kept string" if texts else OUT

    def first(key, table):
        return B.gram_rows(key[0].as_py(), _Block(table.select(["doc_id", "text"]), window, gram, n).names, n)

    def second(key, left, right):
        block = _Block(left.select(["doc_id", "text"]), window, gram, n)
        block.stretches(right, n)
        return _pieces(block, key[0].as_py(), n)

    def last(key, left, right):
        block = _Block(left.select(["doc_id", "text"]), window, gram, n)
        block.stretches(right, n)
        return _cut(block, right, window, schema)

    return B.exchange(dealt.rows, first, second, _confirm, last, schema, hot_blocks)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query 2 over all documents."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
