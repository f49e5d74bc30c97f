"""Language-model scoring with a probabilistic suffix tree.

Symbols are the base's own: the V distinct training tokens and one more for every
other word.  The root is the distribution of all training tokens.  Every run of 1 to
``depth`` preceding words that training holds at least twice is a candidate context,
however often it occurs.  It stays in the tree if its next-word distribution gains more
likelihood over that of the next shorter run than the description of its branches
costs (``types * ln N``).  A token is scored from the longest context that stayed,
else from the root.

One length is one round of the exchange: blocks send their distinct (context, next)
pairs, added up, and for each context the sum of the shorter run's log probabilities over
its training tokens, which is all that the test needs of them; buckets answer with the
pairs' counts in all training text.  Where the shorter run's pair (at first: the next word)
occurs in training once, here, and in no held-out text, the pair occurs once too; a
context's such pairs travel as their number and need no answer.  Nor do held-out texts'
pairs whose shorter run's pair training doesn't have.  These counts are also how often the contexts of the
next length occur, so that contexts seen once are left out without asking.  Contexts
with more than 1/SHARDS of all tokens are dealt over SHARDS keys by their next word;
a block adds the shards' answers up.

Contexts that can't matter are never sent.  A context of count c whose next shorter run
has count C gains at most ``c * ln(C / c)`` and ``ln 2`` for each branch (at context
discount 0.5), as the shorter run gives a word that follows n times at least
(n - 0.5) / C.  At the last length that alone rules most contexts out; before it, only
those are left out that also no longer run can need: runs that begin with the context
have at most its counts, and runs that end with it at most C = c.  Both counts are
known to every block, so all blocks leave out the same ones and scores don't change.

Smoothing is absolute discounting: what a context discounts goes to the next shorter
one, what the root discounts (the Good-Turing mass of words seen once) to the unseen
word, so every state's distribution sums to one.

With ``unseen="spelled"`` the unseen word is no single symbol but is spelled by a
second tree over bytes, with contexts up to five bytes that stay if their divergence
from the next shorter one, times their count, reaches ``divergence``; scores are
then probabilities of the words themselves and not comparable with the base.

A block is some megabytes of one task's documents.  It is made where they are read and
travels as numbers of its words, shuffled once; all steps read it, and no text is shuffled.

Counts come from all training documents.  They stay distributed: word counts live
in hash buckets, blocks of documents ask for what they need, contexts are tested in
the bucket that holds all their branches.  Only the byte tree is sent to tasks; it
grows from at most ``max_contexts`` contexts.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .shared import cut, slices

END = " "  # no word is a space
END_HASH = B.word_hashes(pa.array([END]))[0] >> B.U64(16) << B.U64(16)
DEPTH = 5
#: Contexts with more than one in SHARDS tokens (and this many) are dealt over SHARDS keys.
SHARDS, SHARDED_FROM = 64, 1000
#: A context's sum of shorter runs' probabilities travels as whole steps of log10.
LOG_STEPS = 1000.0
BUCKET_BYTES = 16_000_000  # of text for each bucket
PACKED = "bucket int, payload binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id in (None, B.NULL_ID) else str(doc_id).encode()) % 5 == 1


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next: the upper ones are alike and compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(data: bytes, kind: str, n: int, at: int) -> np.ndarray:
    """What ``_planes`` wrote."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


# -- counts of training tokens, in buckets -----------------------------------------


def _pack(words: pa.Array, counts: np.ndarray) -> bytes:
    data, at = B.text_bytes(pa.chunked_array([words]))
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(words)], "<i8").tobytes(), counts.astype("<i8").tobytes(), np.diff(at).astype("<i4").tobytes(), data.tobytes()]))


def _unpack(data: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i4", n, 8 + 8 * n))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(raw[8 + 12 * n :])), np.frombuffer(raw, "<i8", n, 8)


def word_counts(rows: DataFrame, n_buckets: int) -> DataFrame:
    """One row per bucket with its distinct training words and, of each, twice its count, and one more if held-out texts have it too."""

    def count(batches):
        for part in slices(batches, 8192, 16_000_000):
            train = np.array([not held_out(i) for i in part["doc_id"].to_pylist()])
            codes, at, vocabulary = B.word_codes(part["text"], lower=True)
            words = pa.concat_arrays([vocabulary.cast(pa.large_string()), pa.array([END], pa.large_string())])
            own = np.repeat(train, np.diff(at))
            outside = np.append(np.bincount(codes[~own], minlength=len(vocabulary)), (~train).sum()) > 0
            counts = 2 * np.append(np.bincount(codes[own], minlength=len(vocabulary)), train.sum()).astype(np.int64) + outside
            names = np.concatenate([B.word_hashes(vocabulary), [END_HASH]])
            order = np.argsort(names)
            bounds = B.bucket_slices(names[order], n_buckets)
            words, counts = words.take(pa.array(order)), counts[order]
            full = [b for b in range(n_buckets) if bounds[b + 1] > bounds[b]] if part.num_rows else []
            sel = [slice(bounds[b], bounds[b + 1]) for b in full]
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array([_pack(words[s], counts[s]) for s in sel], pa.binary())], names=["bucket", "payload"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpack(data) for data in table["payload"].to_pylist()]
        found = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
        code, c = found.indices.to_numpy(), np.concatenate([c for _, c in parts])
        total = np.zeros(len(found.dictionary), np.int64)
        np.add.at(total, code, c >> 1)
        outside = np.bincount(code[c & 1 > 0], minlength=len(total)) > 0
        by = pa.compute.sort_indices(found.dictionary).to_numpy()
        by = by[total[by] > 0]
        return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([_pack(found.dictionary.take(pa.array(by)), (2 * total + outside)[by])], pa.binary())], names=["bucket", "payload"])

    return rows.mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(merge, PACKED)


def _grams_of(words: list[str]) -> np.ndarray:
    """DEPTH bytes of context and the next byte, packed, for every byte of every word and its end."""
    pad = b" " * DEPTH
    data = np.frombuffer(b"".join([pad + w.encode() + b" " for w in words]), np.uint8).astype(np.int64)
    if len(data) <= DEPTH:
        return np.empty(0, np.int64)
    packed = np.zeros(len(data) - DEPTH, np.int64)
    for i in range(DEPTH + 1):
        packed = (packed << 8) | data[i : len(data) - DEPTH + i]
    length = np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words))
    start = np.cumsum(length + DEPTH) - length - DEPTH
    at, _ = B.spread(start, length)
    return packed[at]


def _statistics(counts: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
    """Byte grams of distinct words, and (N, V, words seen once)."""

    def grams(batches):
        for batch in batches:
            for data in batch.column("payload").to_pylist():
                words = _unpack(data)[0].to_pylist()
                for at in range(0, len(words), 20_000):
                    g, n = np.unique(_grams_of([w for w in words[at : at + 20_000] if w != END]), return_counts=True)
                    yield pa.record_batch([pa.array(g), pa.array(n.astype(np.int64))], names=["gram", "n"])

    def totals(batches):
        for batch in batches:
            for data in batch.column("payload").to_pylist():
                c = _unpack(data)[1] >> 1
                yield pa.record_batch([pa.array([int(x)], pa.int64()) for x in (c.sum(), len(c), (c == 1).sum())], names=["n", "v", "one"])

    one = counts.mapInArrow(totals, "n long, v long, one long").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "v", "one")]).first()
    return counts.mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), tuple(one)


class ByteTree:
    """Retained contexts (sorted codes) and each one's distribution of the next byte."""

    def __init__(self, codes: np.ndarray, probabilities: np.ndarray):
        self.codes, self.logs = codes, np.log10(probabilities)

    def spell(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word's bytes and its end, from the longest retained contexts."""
        if not words:
            return np.empty(0)
        grams = _grams_of(words)
        symbol, state = grams & 255, np.full(len(grams), -1)
        for depth in range(DEPTH, -1, -1):
            code = (depth << 40) | ((grams >> 8) & ((1 << 8 * depth) - 1))
            spot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            state = np.where((state < 0) & (self.codes[spot] == code), spot, state)
        lengths = np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words))
        return np.add.reduceat(self.logs[state, symbol], np.cumsum(lengths) - lengths)


def byte_tree(grams: DataFrame, max_contexts: int, divergence: float) -> ByteTree:
    """Grow, test and smooth the byte tree; a context's code is its length and its bytes."""
    context = F.col("gram").bitwiseAND(F.lit((1 << 48) - 1))
    depth = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    rows = grams.select("gram", "n", depth.alias("depth"))
    bytes_ = F.shiftright(context, 8)
    mask = (F.expr("shiftleft(1L, 8 * depth)") - 1).cast("long")
    code = F.expr("shiftleft(cast(depth as long), 40)").bitwiseOR(bytes_.bitwiseAND(mask))
    branch = cut(rows.select(code.alias("code"), "depth", F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n").groupBy("code", "depth", "symbol").agg(F.sum("n").alias("n")))
    total = branch.groupBy("code").agg(F.sum("n").alias("total"))
    p = branch.join(total, "code").withColumn("parent", F.when(F.col("depth") > 0, F.expr("shiftleft(cast(depth - 1 as long), 40)").bitwiseOR(F.col("code").bitwiseAND(F.expr("shiftleft(1L, 8 * (depth - 1)) - 1")))))
    own = p.select("code", "parent", "depth", "symbol", "n", "total")
    above = p.select(F.col("code").alias("parent"), "symbol", (F.col("n") / F.col("total")).alias("q"))
    gain = own.join(above, ["parent", "symbol"]).groupBy("code", "depth").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).alias("gain"))
    kept = gain.where(F.col("gain") >= divergence).orderBy(F.desc("gain"), "code").limit(max_contexts).select("code", "depth")
    codes = {0}
    for code_, depth_ in kept.toLocalIterator():  # at most max_contexts rows
        codes |= {(d << 40) | (code_ & ((1 << 8 * d) - 1)) for d in range(depth_ + 1)}  # with all shorter ones
    codes_df = branch.sparkSession.createDataFrame([(c,) for c in sorted(codes)], "code long")
    table = branch.join(F.broadcast(codes_df), "code").select("code", "symbol", "n").toPandas()  # at most 6 * max_contexts codes
    order = np.array(sorted(codes), np.int64)  # shorter contexts first
    count = np.zeros((len(order), 256))
    count[np.searchsorted(order, table["code"].to_numpy()), table["symbol"].to_numpy()] = table["n"].to_numpy()
    out = np.empty_like(count)
    for i, c in enumerate(order.tolist()):
        d = c >> 40
        shorter = out[np.searchsorted(order, ((d - 1) << 40) | (c & ((1 << 8 * (d - 1)) - 1)))] if d else np.full(256, 1 / 256)
        types = max(1, (count[i] > 0).sum())
        out[i] = (count[i] + types * shorter) / (count[i].sum() + types)
    return ByteTree(order, out)


# -- scoring ------------------------------------------------------------------------


class _Block:
    """Documents as numbers of the block's words, from their texts or from what ``packed`` made of them."""

    def __init__(self, table: pa.Table, n_buckets: int):
        if "text" in table.column_names:
            table, self.ids = B.sorted_block(table)
            codes, at, self.vocabulary = B.word_codes(table["text"], lower=True)
            hashes = np.append(B.word_hashes(self.vocabulary), END_HASH) >> B.U64(16) << B.U64(16)
            self.words = np.argsort(hashes)  # of each name, by its rank
            self.names, rank = hashes[self.words], np.empty(len(hashes), np.int64)
            rank[self.words] = np.arange(len(hashes))
            self.place, self.at = np.insert(rank[codes], at[1:], rank[-1]), at + np.arange(len(at))
        else:
            raw = zstandard.ZstdDecompressor().decompress(table["payload"][0].as_py())
            d, w, t = np.frombuffer(raw, "<i8", 3).tolist()
            self.ids = _numbers(raw, "<i8", d, 24)
            self.at = np.concatenate([[0], np.cumsum(_numbers(raw, "<i8", d, 24 + 8 * d))])
            self.names = np.cumsum(_numbers(raw, "<u8", w, 24 + 16 * d), dtype=B.U64) << B.U64(16)
            often = np.argsort(-_numbers(raw, "<u4", w, 24 + 16 * d + 8 * w).astype(np.int64), kind="stable")
            self.place = often[_numbers(raw, "<u4", t, 24 + 16 * d + 12 * w)]
            rest = raw[24 + 16 * d + 12 * w + 4 * t :]
            self.vocabulary = _unpack(rest)[0] if rest else None
        self.sent = np.diff(B.bucket_slices(self.names, n_buckets))
        self.train = np.array([not held_out(int(i)) for i in self.ids])
        self.learns = np.repeat(self.train, np.diff(self.at))

    def packed(self, with_words: bool) -> bytes:
        """The block, some times smaller than its texts; ``with_words``: for spelling."""
        raw = np.array([len(self.ids), len(self.names), len(self.place)], "<i8").tobytes() + _planes(self.ids.astype("<i8")) + _planes(np.diff(self.at).astype("<i8"))
        times = np.bincount(self.place, minlength=len(self.names))
        rank = np.empty(len(times), "<u4")
        rank[np.argsort(-times, kind="stable")] = np.arange(len(times))  # the commonest words have the smallest numbers
        raw += _planes(np.diff(self.names >> B.U64(16), prepend=B.U64(0))) + _planes(times.astype("<u4")) + _planes(rank[self.place])
        if with_words:
            words = pa.concat_arrays([self.vocabulary.cast(pa.large_string()), pa.array([END], pa.large_string())])
            raw += _pack(words.take(pa.array(self.words)), np.zeros(len(words)))
        return zstandard.ZstdCompressor(level=3).compress(raw)

    def learn(self, answers: pa.Table, tree: ByteTree | None, stats: tuple) -> None:
        """Counts and root probabilities of the block's tokens."""
        total, types, discount = stats
        own = answers.filter(pa.compute.equal(answers["kind"], 1))
        c, number, spelled = np.zeros(len(self.names), np.int64), np.zeros(len(self.names), B.U64), np.zeros(len(self.names))
        ends = np.cumsum(self.sent)
        for b, data in zip(own["bucket"].to_pylist(), own["payload"].to_pylist(), strict=True):
            n = int(self.sent[b])
            raw = zstandard.ZstdDecompressor().decompress(data)
            c[ends[b] - n : ends[b]] = _numbers(raw, "<i8", n, 0)
            number[ends[b] - n : ends[b]] = _numbers(raw, "<u8", n, 8 * n)
            if tree is not None:
                spelled[ends[b] - n : ends[b]] = np.frombuffer(raw, "<f4", n, 16 * n)
        self.c, self.outside = c >> 1, (c & 1) > 0
        by = np.argsort(number, kind="stable")
        self.numbers, self.nth = number[by], np.empty(len(by), np.int64)  # of the words, in order; each word's place there
        self.nth[by] = np.arange(len(by))
        c = self.c
        if not total:
            self.root = np.zeros(len(c))
            return
        left = discount * types / total  # for words that training didn't see
        if tree is None:
            self.root = np.log10(np.where(c > 0, np.maximum(c - discount, 1e-12) / total, max(left, 0.5 / total)))
            return
        new = np.flatnonzero((c == 0) & (self.names != END_HASH))
        spelled[new] = tree.spell(self.vocabulary.take(pa.array(new)).to_pylist())
        spelled = np.where(self.names == END_HASH, -np.inf, spelled)
        self.root = np.log10(np.maximum(np.maximum(c - discount, 0) / total + left * 10.0**spelled, 1e-300))

    def start(self, total: int) -> None:
        """Before the first round every token is at the root."""
        self.back = np.arange(len(self.place)) - np.repeat(self.at[:-1], np.diff(self.at))  # words before it in its document
        self.hashed = np.zeros(len(self.place), B.U64)
        self.parent = self.root[self.place].astype(float)  # log10 P(token | the run of the length before)
        self.value = self.parent.copy()
        self.once = self.learns & ((self.c == 1) & ~self.outside)[self.place]  # the pair's only place at all
        self.never = ~self.learns & (self.c == 0)[self.place]  # training doesn't have the pair
        self.seen = np.concatenate([[0], self.c[self.place][:-1]])[: len(self.place)]  # of the run before each token, in training
        self.above = np.full(len(self.place), total)  # of the next shorter run

    def pairs(self, length: int, n_buckets: int, total: int, needs: float, last: bool, asks: bool = False) -> None:
        """Distinct (context, next) pairs of contexts of ``length`` words that training holds twice and that can matter.

        A context or a longer run must gain ``needs`` for that; ``asks``: what buckets are told is made, too.
        """
        name = self.names[self.place]
        t = np.flatnonzero((self.back >= length) & (self.seen >= 2))
        c, above = self.seen[t].astype(float), self.above[t].astype(float)
        self.above[t] = self.seen[t]
        gains = lambda x: x * np.log(above / x) >= needs - 1e-9
        self.t = t = t[gains(c) if last else gains(np.minimum(c, above / math.e)) | (c >= math.e * needs)]
        self.hashed[t] = B.mix(self.hashed[t] * B.MULTIPLIERS[0] + name[t - length] + B.U64(length))
        # Names travel as 48 bits; so do these, that blocks and buckets cut them alike.
        short = self.hashed[t] >> B.U64(16) << B.U64(16)
        if length == 1:  # a context is a word: no sort of the tokens, and numbers of a bucket's words are near each other
            before = self.place[t - 1]
            word = np.zeros(len(self.names), np.int64)
            word[before] = 1
            used = np.flatnonzero(word)
            number = self.numbers[self.nth[used]]
            bucket, nth = number % B.U64(n_buckets), number // B.U64(n_buckets)
            start = ((bucket << B.U64(32)) + B.U64(n_buckets - 1)) // B.U64(n_buckets) << B.U64(32)
            short = start + (nth << B.U64(16))
            by = np.argsort(short)
            self.contexts = short[by]
            word[used[by]] = np.arange(len(used))
            self.context_of = word[before]
        else:
            self.contexts, self.context_of = np.unique(short, return_inverse=True)
        symbol, size = self.nth[self.place[t]], len(self.contexts)
        self.count = np.zeros(size, np.int64)
        self.count[self.context_of] = self.seen[t]
        often = np.flatnonzero(self.count > max(total // SHARDS, SHARDED_FROM))
        shards = np.arange(1, SHARDS + 1, dtype=B.U64) * B.MULTIPLIERS[1]
        every = (B.mix(self.contexts[often][:, None] ^ shards[None, :]) >> B.U64(16) << B.U64(16)).ravel()  # all shards are asked, also those without a pair here
        whole = np.ones(size, bool)
        whole[often] = False
        self.keys = np.sort(np.concatenate([self.contexts[whole], every]), kind="stable")  # of sorted ones and few more
        self.keys = self.keys[np.append(True, self.keys[1:] != self.keys[:-1])[: len(self.keys)]]
        at_shard, at_context = np.searchsorted(self.keys, every), np.searchsorted(self.keys, self.contexts)
        self.hot = np.zeros(len(self.keys), bool)
        self.hot[at_shard] = True
        self.owner = np.full(len(self.keys), -1)
        self.owner[at_context[whole]] = np.flatnonzero(whole)
        self.owner[at_shard] = np.repeat(often, SHARDS)
        place = at_context[self.context_of] if size else self.context_of
        hot = np.flatnonzero(~whole[self.context_of]) if size else self.context_of
        place[hot] = at_shard[np.searchsorted(often, self.context_of[hot]) * SHARDS + (name[t[hot]] % B.U64(SHARDS)).astype(np.int64)]
        self.single, self.none = self.once[t], self.never[t]
        rest = np.flatnonzero(~(self.single | self.none))
        both = place[rest] * len(self.names) + symbol[rest]
        by = np.argsort(both)
        both = both[by]
        new = np.ones(len(by), bool)
        new[1:] = both[1:] != both[:-1]
        self.pair = np.zeros(len(t), np.int64)
        self.pair[rest[by]] = np.cumsum(new) - 1
        first = rest[by[new]]
        self.size = len(first)
        self.width = np.bincount(place[first], minlength=len(self.keys))
        if asks:
            own, learns = self.learns[t], self.learns[t[rest]]
            self.singles = np.bincount(place[self.single], minlength=len(self.keys))
            self.logs = np.bincount(place[own], weights=-self.parent[t[own]], minlength=len(self.keys))
            outside = np.bincount(self.pair[rest[~learns]], minlength=self.size) > 0
            self.n = 2 * np.bincount(self.pair[rest[learns]], minlength=self.size) + outside
            self.symbol = symbol[first]
        self.bounds = B.bucket_slices(self.keys, n_buckets)
        self.pair_at = np.concatenate([[0], np.cumsum(self.width)])[self.bounds]

    def grow(self, answers: pa.Table, length: int, total: int, discount: float) -> None:
        """Probabilities after the contexts of ``length`` words, and how often longer ones occur."""
        types, raw, kept = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys)), np.zeros(len(self.keys), bool)
        n = np.zeros(self.size, np.int64)
        own = answers.filter(pa.compute.equal(answers["kind"], length + 1))
        for b, data in zip(own["bucket"].to_pylist(), own["payload"].to_pylist(), strict=True):
            data = zstandard.ZstdDecompressor().decompress(data)
            s, m = slice(self.bounds[b], self.bounds[b + 1]), slice(self.pair_at[b], self.pair_at[b + 1])
            k, j = s.stop - s.start, m.stop - m.start
            told = _numbers(data, "<u4", k, 0)
            types[s], kept[s] = told >> 1, told & 1
            n[m] = _numbers(data, "<u4", j, 4 * k)
            raw[s][self.hot[s]] = np.frombuffer(data, "<f8", int(self.hot[s].sum()), 4 * (k + j))
        size = len(self.contexts)
        types = np.bincount(self.owner, weights=types, minlength=size) if len(self.keys) else np.zeros(size)
        stays = np.zeros(size, bool)
        stays[self.owner[kept]] = True
        if self.hot.any():
            gain = np.bincount(self.owner[self.hot], weights=raw[self.hot], minlength=size) - self.count * np.log(self.count)
            stays[self.owner[self.hot]] = (gain >= types * math.log(max(2, total)))[self.owner[self.hot]]
        t, c = self.t, self.context_of
        own = np.where(self.single, 2, np.where(self.none, 0, n[self.pair] if len(n) else 0))
        own_n, self.once[t], self.never[t] = own >> 1, self.learns[t] & (own == 2), ~self.learns[t] & (own < 2)
        p = np.maximum(own_n - discount, 0) / self.count[c] + discount * types[c] / self.count[c] * 10.0 ** self.parent[t]
        self.parent[t] = np.log10(np.maximum(p, 1e-300))  # the last answers have no branches of contexts that go
        self.value[t] = np.where(stays[c], self.parent[t], self.value[t])
        self.seen = np.zeros(len(self.seen), np.int64)
        self.seen[t[t + 1 < len(self.seen)] + 1] = own_n[t + 1 < len(self.seen)]


def _ask_pairs(block: _Block, number: int, n_buckets: int) -> pa.Table:
    full, payload = [], []
    for b in range(n_buckets):
        s, m = slice(block.bounds[b], block.bounds[b + 1]), slice(block.pair_at[b], block.pair_at[b + 1])
        if s.stop > s.start:
            # keys ascend, and so do the symbols of one key: steps are smaller than the numbers
            raw = np.array([s.stop - s.start, m.stop - m.start], "<i8").tobytes() + _planes(np.diff(block.keys[s] >> B.U64(16), prepend=B.U64(0)))
            raw += _planes(np.diff(block.numbers[block.symbol[m]], prepend=B.U64(0)))
            raw += _planes(block.width[s].astype("<u4")) + _planes(block.singles[s].astype("<u4")) + _planes(np.rint(LOG_STEPS * block.logs[s]).astype("<u8"))
            raw += _planes(block.n[m].astype("<u4")) + np.packbits(block.hot[s]).tobytes()
            full.append(b)
            payload.append(zstandard.ZstdCompressor(level=3).compress(raw))
    return B.rows(B.EXCHANGE, bucket=full, block=[number] * len(full), kind=[0] * len(full), payload=payload)


def _answer_pairs(table: pa.Table, kind: int, total: int, last: bool) -> pa.Table:
    """To each block: its keys' branches and whether they pass, its pairs' counts, its hot keys' share of the likelihood.

    The last answers are zeros for contexts that don't pass.
    """
    names, widths, hots, singles, logs, symbols, counts = ([] for _ in range(7))
    for data in table["payload"].to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(data)
        k, m = np.frombuffer(raw, "<i8", 2).tolist()
        names.append(np.cumsum(_numbers(raw, "<u8", k, 16), dtype=B.U64) << B.U64(16))
        symbols.append(np.cumsum(_numbers(raw, "<u8", m, 16 + 8 * k), dtype=B.U64))
        at = 16 + 8 * (k + m)
        widths.append(_numbers(raw, "<u4", k, at))
        singles.append(_numbers(raw, "<u4", k, at + 4 * k))
        logs.append(_numbers(raw, "<u8", k, at + 8 * k))
        counts.append(_numbers(raw, "<u4", m, at + 16 * k))
        hots.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=at + 16 * k + 4 * m), count=k).astype(bool))
    key_ends, pair_ends = np.cumsum([len(x) for x in names]), np.cumsum([len(x) for x in symbols])
    keys, code = np.unique(np.concatenate(names), return_inverse=True)
    k, s, c = np.repeat(code, np.concatenate(widths)), np.concatenate(symbols), np.concatenate(counts).astype(np.int64)
    both = k.astype(B.U64) * (s.max(initial=0) + B.U64(1)) + s
    order = np.argsort(both)
    new = np.ones(len(order), bool)
    new[1:] = both[order][1:] != both[order][:-1]
    first = np.flatnonzero(new)
    n = np.add.reduceat(c[order] >> 1, first) if len(first) else np.zeros(0, np.int64)
    outside = np.maximum.reduceat(c[order] & 1, first) if len(first) else n
    group = k[order][first]
    alone = np.bincount(code, weights=np.concatenate(singles), minlength=len(keys))
    t = np.bincount(group, weights=n, minlength=len(keys)) + alone
    types = (np.bincount(group, weights=n > 0, minlength=len(keys)) + alone).astype(np.int64)
    raw = np.bincount(group, weights=n * np.log(np.maximum(n, 1)), minlength=len(keys))
    raw += np.bincount(code, weights=np.concatenate(logs).astype(float), minlength=len(keys)) / LOG_STEPS * math.log(10)
    kept = (t >= 2) & (raw - t * np.log(np.maximum(t, 1)) >= types * math.log(max(2, total)))
    told, of_pair = (types * 2 + kept).astype("<u4"), np.empty(len(order), "<u4")
    counted = 2 * n + outside
    if last:
        tells = kept | (np.bincount(code, weights=np.concatenate(hots), minlength=len(keys)) > 0)
        told, counted = told * tells.astype("<u4"), counted * tells[group]
    of_pair[order] = counted[np.cumsum(new) - 1]
    payload = []
    for i, (a, b, hot) in enumerate(zip(key_ends, pair_ends, hots, strict=True)):
        own = code[a - len(hot) : a]
        data = _planes(told[own]) + _planes(of_pair[b - len(symbols[i]) : b]) + raw[own[hot]].astype("<f8").tobytes()
        payload.append(zstandard.ZstdCompressor(level=3).compress(data))
    return B.rows(B.EXCHANGE, bucket=table["bucket"].to_pylist(), block=table["block"].to_pylist(), kind=[kind] * len(payload), payload=payload)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 3_000_000, max_contexts: int = 8000, divergence: float = 12.0, depth: int = 3, context_discount: float = 0.5, unseen: str = "class") -> DataFrame:
    """Scores of all documents by a model of those whose crc32(id) mod 5 is not 1; returns OUT.

    score: log10 probability of the document's words and its end; base_score: the
    same by add-half counts of single tokens.

    Defined cases: null, empty and blank texts are a lone end token; a null id is
    hashed as the empty string; without training documents counts and scores are 0
    (base_score is defined by its formula); repeated rows count each time; an
    empty table gives an empty result; other columns are ignored.
    """
    n = 4 + (docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0) // BUCKET_BYTES
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(B.NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = cut(word_counts(rows, n))
    grams, (total, types, once) = _statistics(counts)
    discount = min(0.9, once / types) if once else 0.1
    spell = unseen == "spelled"
    tree = docs.sparkSession.sparkContext.broadcast(byte_tree(grams, max_contexts, divergence) if spell else None)
    stats = (total, types, discount)
    # one branch at least, at its description less what discounting can add to its gain
    needs = math.log(max(2, total) * (1 - max(discount, context_discount)))

    def ask(key, table):
        block = _Block(table, n)
        at = B.bucket_slices(block.names, n)
        full = [b for b in range(n) if at[b + 1] > at[b]]
        steps = [_planes(np.diff(block.names[at[b] : at[b + 1]] >> B.U64(16), prepend=B.U64(0))) for b in full]
        return B.rows(B.EXCHANGE, bucket=full, block=[key[0].as_py()] * len(full), kind=[0] * len(full), payload=[zstandard.ZstdCompressor(level=3).compress(x) for x in steps])

    def tell(left, right):
        words, c = _unpack(right["payload"][0].as_py()) if right.num_rows else (pa.array([], pa.large_string()), np.empty(0, np.int64))
        names = B.word_hashes(words) >> B.U64(16) << B.U64(16)
        spelled = np.zeros(len(words), np.float32)
        if spell:
            known = words.to_pylist()
            spelled[np.array([w != END for w in known], bool)] = tree.value.spell([w for w in known if w != END])
        order = np.argsort(names)
        names, c, spelled = names[order], c[order], spelled[order]
        # the words' own numbers, the commonest first, take fewer bytes than their hashes
        number = np.empty(len(c), np.int64)
        number[np.argsort(-c, kind="stable")] = np.arange(len(c))
        number = number * n + (left["bucket"][0].as_py() if left.num_rows else 0)
        out = []
        for data in left["payload"].to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(data)
            want = np.cumsum(_numbers(raw, "<u8", len(raw) // 8, 0), dtype=B.U64) << B.U64(16)
            spot = np.minimum(np.searchsorted(names, want), max(0, len(names) - 1))
            hit = names[spot] == want if len(names) else np.zeros(len(want), bool)
            told = np.zeros((2, len(want)), "<i8")
            told[:, hit] = c[spot[hit]], number[spot[hit]]
            raw = _planes(told[0]) + _planes(told[1])
            if spell:
                letters = np.zeros(len(want), "<f4")
                letters[hit] = spelled[spot[hit]]
                raw += letters.tobytes()
            out.append(zstandard.ZstdCompressor(level=3).compress(raw))
        return B.rows(B.EXCHANGE, bucket=left["bucket"].to_pylist(), block=left["block"].to_pylist(), kind=[1] * len(out), payload=out)

    def grown(left, right, lengths):
        block = _Block(left, n)
        block.learn(right, tree.value, stats)
        block.start(total)
        for length in range(1, lengths + 1):
            block.pairs(length, n, total, needs, length == depth)
            block.grow(right, length, total, context_discount)
        return block

    def asking(length):
        def ask_length(key, left, right):
            block = grown(left, right, length - 1)
            block.pairs(length, n, total, needs, length == depth, asks=True)
            return _ask_pairs(block, key[0].as_py(), n)

        return ask_length

    def answering(length):
        return lambda table: _answer_pairs(table, length + 1, total, length == depth)

    def last(key, left, right):
        block = grown(left, right, depth)
        value = block.value
        c = block.c[block.place]
        base = np.log10(c + 0.5)
        m = np.diff(block.at)
        sums = lambda x: np.add.reduceat(x, block.at[:-1]) if len(m) else x
        return B.rows(
            OUT, doc_id=[None if i == B.NULL_ID else int(i) for i in block.ids], held_out=[bool(not x) for x in block.train], n_tokens=m, n_known=sums((c > 0).astype(np.int64)),
            train_tokens=[total] * len(m), base_score=sums(base) - m * math.log10(total + 0.5 * (types + 1)), score=sums(value),
        )

    def numbered(batches):
        first = TaskContext.get().partitionId() << 32
        for i, part in enumerate(slices(batches, 4096, block_bytes)):
            yield pa.record_batch([pa.array([first + i], pa.int64()), pa.array([_Block(part, n).packed(spell)], pa.binary())], names=["block", "payload"])

    by_block = rows.mapInArrow(numbered, "block long, payload binary").repartition(n, "block").groupBy("block")
    known = by_block.applyInArrow(ask, B.EXCHANGE).groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(tell, B.EXCHANGE)
    told = known.repartition(n, "block")  # parts of one partitioning: their union is not shuffled again
    for length in range(1, depth + 1):
        asked = by_block.cogroup(told.groupBy("block")).applyInArrow(asking(length), B.EXCHANGE)
        found = asked.groupBy("bucket").applyInArrow(answering(length), B.EXCHANGE)
        told = told.unionByName(found.repartition(n, "block"))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(last, OUT)


def op8_score_texts(spark, sf_dir: str) -> DataFrame:
    """Contract query 8 over all documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
