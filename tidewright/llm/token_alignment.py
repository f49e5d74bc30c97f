"""Which tokens of two tokenizers cover the same bytes.

A text is tokenized by a byte-level BPE (``tokenizers``) and by a sentencepiece model
with byte fallback.  Where a space follows a character that isn't white space, tokens of
both end: byte-level BPE splits there before it merges, and no piece of the model holds
a space after another character (checked when the model is loaded).  So a text is cut
there into stretches, words mostly, and a stretch's tokens don't depend on what
surrounds it.  Each distinct stretch of a task is tokenized and aligned once:

* coarse cuts: the character offsets that ``tokenizers`` gives and the spans that
  sentencepiece gives, both as byte offsets;
* refined: tokens inside a character of several bytes, and byte-fallback tokens, share or
  lack such a span; their ends are counted from the bytes they decode to;
* a stretch whose joined token bytes aren't its own bytes makes its text tokenless.

A text is its stretches put together.  The id pairs of all links are counted over the
corpus (partial sums in tasks, then by pair); then every text looks its pairs up: pairs
that more than one in ``HOT`` of (text, pair) rows hold are broadcast, so at most ``HOT``
of them, the rest meet their counts by a shuffle on the pair.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .shared import cut, shared_path, slices

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Pairs held by more than one in so many rows of (text, pair) are hot; there can't be more of them.
HOT = 200_000
#: Stretches that a task remembers, and the characters in them: beyond either it starts anew.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8_000_000
#: Stretches that are tokenized together.
TOGETHER = 1024
#: A pair is ``a * SHIFT + b``.
SHIFT = 1 << 20
#: Before a space after a character that isn't white space; a text's last character stays with what is before it.
_CUT = re.compile(r"(?<=\S)(?= (?!\Z))")
_META = "▁"


def byte_alphabet() -> dict[str, int]:
    """What byte each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Tokenizes and aligns stretches; one for each task."""

    def __init__(self, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        alphabet = byte_alphabet()
        vocabulary = {i: token for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in (vocabulary.get(i, "?") for i in range(max(vocabulary) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{_META}]{_META}", p) for p in pieces):
            raise ValueError("a piece goes on over a space: texts can't be cut there")
        fallback = re.compile(r"<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(f[1], 16)]) if (f := fallback.fullmatch(p)) else p.replace(_META, " ").encode() for p in pieces]
        self.b_fallback = np.array([bool(fallback.fullmatch(p)) for p in pieces])
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a token spells nothing")
        self.a_lens, self.b_lens = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.names = pa.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))])

    def a_ends(self, text: str, own: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids, byte offsets of the tokens' ends, and whether their bytes are the text's (``own``)."""
        encoding = self.a.encode(text, add_special_tokens=False)
        found = encoding.ids
        ids = np.fromiter(found, np.int64, len(found))
        spans = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        char = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at = np.concatenate([[0], np.cumsum(1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000))])
        # the next token starts inside the character that this one ends in
        inside = np.zeros(len(ids), bool)
        inside[:-1] = spans[1:, 0] < spans[:-1, 1]
        return ids, _refined(byte_at[spans[:, 1]], inside, self.a_lens[ids]), b"".join(map(self.a_bytes.__getitem__, found)) == own

    def b_ends(self, text: str, own: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
        """The same for sentencepiece, which puts the text's first space before it by itself and whose spans are byte offsets."""
        found = self.b.encode(text[1:], return_type="offset_mapping", return_bytes=True, num_threads=1)
        ids = np.fromiter(found["ids"], np.int64, len(found["ids"]))
        ends = np.fromiter(chain.from_iterable(found["offsets"]), np.int64, 2 * len(ids))[1::2] + 1
        return ids, _refined(ends, self.b_fallback[ids], self.b_lens[ids]), b"".join(map(self.b_bytes.__getitem__, found["ids"])) == own

    def align(self, stretches: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of stretches, which begin with a space: groups as text, a row ``A, B, groups, links, not whole`` of numbers each, and all linked pairs.

        Stretches are tokenized together, as each ends where tokens of both end; if the
        tokens don't spell them, in halves down to the one that is to blame.
        """
        text = "".join(stretches)
        own = text.encode()
        (a, a_ends, a_whole), (b, b_ends, b_whole) = self.a_ends(text, own), self.b_ends(text, own)
        if not (a_whole and b_whole):
            if len(stretches) == 1:
                return [""], np.array([[0, 0, 0, 0, 1]]), np.zeros(0, np.int64)
            half = len(stretches) // 2
            halves = self.align(stretches[:half]), self.align(stretches[half:])
            return halves[0][0] + halves[1][0], np.concatenate([h[1] for h in halves]), np.concatenate([h[2] for h in halves])
        at = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
        both = np.flatnonzero(b_ends[at] == a_ends)
        cuts, to_a, to_b = a_ends[both], both + 1, at[both] + 1
        borders = np.cumsum([len(s.encode()) for s in stretches])
        upto = np.searchsorted(cuts, borders, "right")
        left, right = (_joined(self.names.take(pa.array(ids)), to, ",") for ids, to in ((a, to_a), (b, to_b)))
        texts = _joined(pc.binary_join_element_wise(left, right, "|"), upto, ";").to_pylist()
        counts = np.diff(np.stack([to_a[upto - 1], to_b[upto - 1], upto, upto, np.zeros_like(upto)], 1), axis=0, prepend=0)
        return texts, counts, a[to_a - 1] * SHIFT + b[to_b - 1]


def _joined(strings: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    """Runs of strings that end at ``ends``, each as one string."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), strings), by)


def _stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct stretches of texts that aren't empty, where ``_CUT`` cuts them; which one each stretch is, and where the texts' begin."""
    data, at = B.text_bytes(pa.chunked_array([pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))]))
    space = data == 0x20
    space[at[1:] - 1] = False
    space[at[:-1]] = False
    i = np.flatnonzero(space)
    p, q, r = data[i - 1], data[i - 2], data[np.maximum(i - 3, 0)]
    # the characters beyond ASCII that are white space, by their bytes
    white = (q == 0xC2) & ((p == 0x85) | (p == 0xA0)) | (q == 0x9A) & (r == 0xE1) & (p == 0x80) | (q == 0x81) & (r == 0xE2) & (p == 0x9F)
    white |= (q == 0x80) & ((r == 0xE2) & ((p <= 0x8A) | (p == 0xA8) | (p == 0xA9) | (p == 0xAF)) | (r == 0xE3) & (p == 0x80))
    starts = np.sort(np.concatenate([at[:-1], i[(p > 0x20) & ~((p >= 0x80) & white)]]), kind="stable")
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), np.searchsorted(starts, at[:-1])


def _refined(ends: np.ndarray, inside: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Ends by spans; those inside a character are counted from the last end before that isn't, by decoded bytes."""
    if not inside.any():
        return ends
    counted = np.cumsum(lens)
    before = np.maximum.accumulate(np.where(inside, -1, np.arange(len(ends))))
    known = np.where(before >= 0, ends[before] - counted[before], 0)
    return np.where(inside, counted + known, ends)


class _Memory:
    """What a task knows of the stretches it has met, as tables by number."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.counts = array("q")  # five for each: A, B, groups, links, not whole
        self.pairs, self.ends, self.used = array("q"), array("q", [0]), array("q")

    def learn(self, stretches: list[str]) -> None:
        """Stretches together, but for those that end in white space, which could merge with the space of the next: one by one."""
        plain = [s for s in stretches if not s[-1].isspace()]
        parts = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)] + [[s] for s in stretches if s[-1].isspace()]
        for part in parts:
            groups, counts, pairs = self.aligner.align(part)
            self.number.update(zip(part, range(len(self.groups), len(self.groups) + len(part)), strict=True))
            self.chars += sum(map(len, part))
            self.groups += groups
            self.counts.frombytes(counts.astype(np.int64).tobytes())
            self.ends.frombytes((len(self.pairs) + np.cumsum(counts[:, 3])).astype(np.int64).tobytes())
            self.pairs.frombytes(pairs.tobytes())
            self.used.frombytes(bytes(8 * len(part)))

    def forget(self) -> None:
        """Only stretches that were met more than once since the last time stay, unless they are too many."""
        used = np.array(self.used, np.int64)
        keep = np.flatnonzero(used > 1)
        if len(keep) > REMEMBERED // 2 or self.chars > REMEMBERED_CHARS:
            keep = keep[:0]
        number, groups = self.number, self.groups
        counts, pairs, ends = self.tables()
        self.clear()
        new = np.full(len(groups), -1, np.int64)
        new[keep] = np.arange(len(keep))
        self.number = {s: int(new[i]) for s, i in number.items() if new[i] >= 0}
        self.chars = sum(map(len, self.number))
        self.groups = [groups[i] for i in keep.tolist()]
        self.counts.frombytes(counts[keep].tobytes())
        self.pairs.frombytes(pairs[_places(ends[keep], counts[keep, 3])].tobytes())
        self.ends.frombytes(np.cumsum(counts[keep, 3]).tobytes())
        self.used.frombytes((used[keep] // 4).tobytes())

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.counts, np.int64).reshape(-1, 5), np.array(self.pairs, np.int64), np.array(self.ends, np.int64)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray]]:
        """Numbers of tokens, groups and links, digest of the groups, and pairs of each text."""
        if len(self.groups) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        column = pa.array(texts, pa.large_string())
        full = pc.fill_null(pc.greater(pc.binary_length(column), 0), False)
        met, which, begin = _stretches(column.filter(full))
        met = met.to_pylist()
        self.learn([s for s in met if s not in self.number])
        counts, flat, ends = self.tables()
        number = np.fromiter(map(self.number.__getitem__, met), np.int64, len(met))
        np.frombuffer(self.used, np.int64)[number] += np.bincount(which, minlength=len(met))
        begin = np.append(begin, len(which)).tolist()
        at = 0
        for has in full.to_pylist():
            own = number[which[begin[at] : begin[at + 1]]] if has else number[:0]
            at += has
            n = counts[own].sum(0)
            if not has or n[4]:
                yield [0, 0, 0, 0], "", np.zeros(0, np.int64)
                continue
            yield n[:4].tolist(), hashlib.sha256(";".join(map(self.groups.__getitem__, own.tolist())).encode()).hexdigest(), flat[_places(ends[own], counts[own, 3])]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of ``sizes`` from ``starts`` on, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


#: A Python worker's memory outlives its tasks.
_KNOWN: dict[tuple[str, str], _Memory] = {}


def _memory(byte_bpe: str, piece_bpe: str) -> _Memory:
    if (byte_bpe, piece_bpe) not in _KNOWN:
        _KNOWN[byte_bpe, piece_bpe] = _Memory(Aligner(byte_bpe, piece_bpe))
    return _KNOWN[byte_bpe, piece_bpe]


ENCODED = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def encoded(rows: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """``doc_id, row`` with the figures of the text and its distinct linked pairs with how often it holds them, of ``(doc_id, row, text)``."""

    def run(batches):
        memory = _memory(byte_bpe, piece_bpe)
        for part in slices(batches, most_bytes=2_000_000):
            numbers, digests, pairs, times = [], [], [], []
            for n, digest, links in memory.texts(part["text"].to_pylist()):
                own, often = np.unique(links, return_counts=True)
                numbers.append(n)
                digests.append(digest)
                pairs.append(own)
                times.append(often)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *pairs]), pa.int64())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *times]), pa.int32())))
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]
            yield from pa.table([part["doc_id"], part["row"], *columns, pa.array(digests, pa.string()), *lists], ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]).to_batches()

    return rows.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ENCODED}")


def _summed(batches):
    """``(pair, links, texts)``: partial sums over some megabytes of pairs."""

    def flush(kept):
        pair, back = np.unique(np.concatenate([p for p, _ in kept]), return_inverse=True)
        links = np.bincount(back, np.concatenate([t for _, t in kept])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(links, pa.int64()), pa.array(np.bincount(back).astype(np.int64), pa.int64())], ["pair", "links", "texts"])

    kept, size = [], 0
    for batch in batches:
        pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
        kept.append((pairs, times))
        size += len(pairs)
        if size > 1_000_000:
            yield flush(kept)
            kept, size = [], 0
    if size:
        yield flush(kept)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``(pair, links, texts, best)`` over the corpus: best if no pair of the same B id has more links."""
    counts = texts.select("pairs", "times").mapInArrow(_summed, "pair long, links long, texts long").groupBy("pair").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    counts = cut(counts)
    b = F.col("pair") % SHIFT
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))  # one row for each id of the vocabulary
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "links", "texts", (F.col("links") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, hot: int = HOT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Defined cases: a null or empty text, and one whose tokens of either kind don't spell
    it, has zeros and '' (it is no error); rows that repeat an id are counted each by
    itself; a null id is kept; texts of any length are read whole; ties for the highest
    count are all best; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "aligned")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    encoded(rows, byte_bpe, piece_bpe).write.parquet(path)  # a row's number is drawn once
    texts = spark.read.parquet(path)
    counts = cut(pair_counts(texts))
    total = counts.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    often = counts.where(F.col("texts") * hot > total).select("pair", "links", "best").orderBy("pair").toPandas()  # at most ``hot`` rows
    known = spark.sparkContext.broadcast((often["pair"].to_numpy(np.int64), often["links"].to_numpy(np.int64), often["best"].to_numpy(bool)))

    def look_up(batches):
        pair, links, best = known.value
        for batch in batches:
            own, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            ends = np.asarray(batch.column("pairs").offsets).astype(np.int64)
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            total_of = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            sums = total_of(np.where(hit, links[at] if len(pair) else 0, 0) * times)
            bests = total_of(np.where(hit & (best[at] if len(pair) else False), times, 0))
            rest = ~hit
            rest_ends = np.concatenate([[0], np.cumsum(rest)])[ends]
            lists = [pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), pa.array(x[rest], t)) for x, t in ((own, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums.astype(np.int64)), pa.array(bests.astype(np.int64)), *lists], ["row", "count_sum", "n_best", "pairs", "times"])

    looked = shared_path(spark, "looked-up")
    texts.select("row", "pairs", "times").mapInArrow(look_up, "row long, count_sum long, n_best long, pairs array<long>, times array<int>").write.parquet(looked)
    looked = spark.read.parquet(looked)
    rest = looked.where(F.size("pairs") > 0).select("row", F.inline(F.arrays_zip("pairs", "times"))).toDF("row", "pair", "times")
    rare = counts.where(F.col("texts") * hot <= total).select("pair", "links", "best")
    rest = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.col("links") * F.col("times")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    sums = looked.select("row", "count_sum", "n_best").unionByName(rest).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return texts.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 12 over all documents."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
