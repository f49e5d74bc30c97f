"""Toxicity by nearest labelled examples.

Labelled documents are the examples, as TF-IDF vectors of unit length over all their
words.  A word's IDF is raised by how much more other toxic documents hold it than chance
explains (z, never below 0: no word is left out).  The vectors lie in a block-max
inverted index: examples in blocks of 64, for each word its postings and its largest
weight in each block that holds it.  A document meets blocks from the highest bound
down, and stops when no block can still reach its k-th neighbour, so the k nearest
are exact.  Neighbours vote by similarity; a monotone curve fitted on the
examples, each scored without itself, turns votes into probabilities.

Only labels of training rows (crc32 of the id, mod 5, not 0) are read.  The index
holds at most ``max_examples`` labelled documents, half of them of each class: with more,
those of least id hash stay (the documented bound), and an example's vote counts for as
many labelled rows of its class as it stands for.  IDF and z count all labelled training
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .shared import bounded_broadcast, cut, slices

BLOCK = 64
OUT = "doc_id long, score double, neighbours array<long>, words array<string>"


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _word_counts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Distinct (row, word) pairs with counts; words are runs of letters in lower case."""
    codes, at, vocabulary = B.word_codes(column)
    lists = pc.split_pattern_regex(pc.utf8_lower(vocabulary), r"[^\pL]+")
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    words = flat.filter(full).dictionary_encode()
    own, parts = words.indices.to_numpy().astype(np.int64), parents.filter(full).to_numpy()
    n = np.bincount(parts, minlength=len(vocabulary))
    start = np.cumsum(n) - n
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside, which = B.spread(start[codes], n[codes]) if len(codes) else (codes.astype(np.int64), codes)
    size = max(1, len(words.dictionary))
    key, count = np.unique(row[which] * size + own[inside], return_counts=True)
    return key // size, key % size, count, words.dictionary


def _hashes(words: pa.Array) -> np.ndarray:
    return B.word_hashes(words).view(np.int64)


def word_statistics(labelled: DataFrame) -> DataFrame:
    """``word, toxic, clean, example``: documents of each class and examples that hold the word (its hash); added up in tasks first."""

    def count(batches):
        for part in slices(batches, 2048):
            row, word, _, words = _word_counts(part["text"])
            toxic, example = (part[c].to_numpy()[row] if len(row) else np.empty(0, int) for c in ("toxic", "example"))
            found = [np.bincount(word[x], minlength=len(words)).astype(np.int64) for x in (toxic == 1, toxic == 0, example == 1)]
            yield pa.record_batch([pa.array(_hashes(words)), *map(pa.array, found)], names=["word", "toxic", "clean", "example"])

    found = labelled.select("text", "toxic", "example").mapInArrow(count, "word long, toxic long, clean long, example long")
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "example")])


@dataclass
class Index:
    """A block-max inverted index over unit vectors, sorted so that like examples share blocks.

    Postings lie by word, then place; a word's entry for a block begins at ``entry_at`` among them.
    """

    words: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    base_rate: float
    k: int
    place: np.ndarray
    weight: np.ndarray
    raised: np.ndarray
    share: np.ndarray | None = None
    common: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.n_blocks = -(-len(self.ids) // BLOCK)

    def build(self, word: np.ndarray, place: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort((place, word))
        word, self.place, self.weight = word[order], place[order].astype(np.int32), weight[order].astype(np.float32)
        block = self.place // BLOCK
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.block = block[first]
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.entry_at = np.append(first, len(word)).astype(np.int32)
        self.word_at = np.searchsorted(word[first], np.arange(len(self.words) + 1))

    @property
    def postings(self):
        """Places and weights of each word."""
        return ((self.place[a:b], self.weight[a:b]) for a, b in zip(self.entry_at[self.word_at[:-1]], self.entry_at[self.word_at[1:]], strict=True))

    def known(self, words: pa.Array) -> np.ndarray:
        """Places of the words in the vocabulary; -1 for others."""
        h = _hashes(words)
        if not len(self.words) or not len(h):
            return np.full(max(1, len(h)), -1)
        spot = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[spot] == h, spot, -1)

    def vectors(self, row: np.ndarray, words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Weights of the (row, word) pairs of ``n`` texts, of unit length for each text."""
        w = (1 + np.log(counts)) * self.idf[words]
        return w / np.sqrt(np.maximum(np.bincount(row, weights=w * w, minlength=n), 1e-300))[row]

    def _dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that a block holds once or more on average lie as rows of a matrix: its row for each word (-1: none), the matrix, its block maxima."""
        if self.common is None:
            n = self.entry_at[self.word_at[1:]] - self.entry_at[self.word_at[:-1]]
            often = np.flatnonzero(n * BLOCK >= len(self.ids))
            self.common = np.full(len(self.words), -1)
            self.common[often] = np.arange(len(often))
            i, of = B.spread(self.entry_at[self.word_at[often]].astype(np.int64), n[often])
            self.matrix = np.zeros((len(often), self.n_blocks * BLOCK), np.float32)
            self.matrix[of, self.place[i]] = self.weight[i]
            self.maxima = self.matrix.reshape(len(often), self.n_blocks, BLOCK).max(axis=2)
        return self.common, self.matrix, self.maxima

    def nearest(self, row: np.ndarray, words: np.ndarray, weights: np.ndarray, n: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples of each of ``n`` texts, exact; ties by place; cosine 0: none.

        A text meets blocks from its highest bound down, a round for each rank, until its
        bound is below its k-th cosine; texts that meet one block in a round are scored together.
        ``own``: ids of the texts, which don't meet themselves.
        """
        if not len(self.ids):
            return np.zeros((n, self.k), np.int64), np.zeros((n, self.k), np.float32)
        common, matrix, maxima = self._dense()
        often = common[words] >= 0
        q = np.zeros((n, len(matrix)), np.float32)
        q[row[often], common[words[often]]] = weights[often]
        rare, r_row, r_q = words[~often], row[~often], weights[~often]
        i, of = B.spread(self.entry_at[self.word_at[rare]].astype(np.int64), self.entry_at[self.word_at[rare + 1]] - self.entry_at[self.word_at[rare]])
        width = self.n_blocks * BLOCK
        scores = np.bincount(r_row[of] * width + self.place[i], weights=r_q[of] * self.weight[i], minlength=n * width).astype(np.float32).reshape(n, self.n_blocks, BLOCK)
        bound = scores.max(axis=2) + q @ maxima
        order = np.argsort(-bound, axis=1, kind="stable")
        itself = np.full(n, -1)
        if own is not None and len(self.ids):
            by = np.argsort(self.ids, kind="stable")
            spot = np.minimum(np.searchsorted(self.ids[by], own), len(self.ids) - 1)
            itself = np.where(self.ids[by][spot] == own, by[spot], -1)
        places, cosines = np.full((n, self.k), width, np.int64), np.zeros((n, self.k), np.float32)
        active = np.arange(n)
        for rank in range(self.n_blocks):
            limit = bound[active, order[active, rank]]
            active = active[(limit > 0) & (limit >= cosines[active, -1] - 1e-5)]  # later blocks of the others are no better
            if not len(active):
                break
            block = order[active, rank]
            met = np.empty((len(active), BLOCK), np.float32)
            by = np.argsort(block, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
                b, texts = block[group[0]], active[group]
                met[group] = scores[texts, b] + q[texts] @ matrix[:, b * BLOCK : (b + 1) * BLOCK]
            at = block[:, None] * BLOCK + np.arange(BLOCK)
            met[at == itself[active][:, None]] = 0
            both, where = np.concatenate([cosines[active], met], axis=1), np.concatenate([places[active], at], axis=1)
            best = np.lexsort((where, -np.round(both, 6)), axis=1)[:, : self.k]
            cosines[active], places[active] = np.take_along_axis(both, best, 1), np.take_along_axis(where, best, 1)
        return places, np.where(places < len(self.ids), cosines, 0)

    def votes(self, places: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Distance-weighted shares of toxic neighbours, drawn to the base rate when they are far; an example stands for ``share`` labelled rows."""
        if not len(self.ids):
            return np.full(len(places), self.base_rate)
        at = np.minimum(places, len(self.ids) - 1)
        w = cosines.astype(float) ** 2 * self.share[at]
        return ((w * self.toxic[at]).sum(axis=1) + 0.25 * self.base_rate) / (w.sum(axis=1) + 0.25)


def _monotone(votes: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that are out of order; a weak prior keeps it off 0 and 1."""
    pools: list[list[float]] = []
    for x, y, n in sorted(zip(votes.tolist(), toxic.tolist(), share.tolist(), strict=True)):
        pools.append([x, y * n, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            x2, y2, n2 = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][2] + x2 * n2) / (pools[-1][2] + n2), pools[-1][1] + y2, pools[-1][2] + n2]
    xs, ys = np.array([p[0] for p in pools]), np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])
    return np.concatenate([[0.0], xs, [1.0]]), np.concatenate([[ys[0]], ys, [ys[-1]]])


def _scorer(shared, curve: tuple[np.ndarray, np.ndarray] | None):
    """``curve`` turns votes into scores; without one each text is an example, scored without itself."""

    def score(batches):
        index: Index = shared.value
        for part in slices(batches, 512):
            n = part.num_rows
            row, word, count, words = _word_counts(part["text"])
            w = index.known(words)[word] if len(word) else word
            row, word, w, count = row[w >= 0], word[w >= 0], w[w >= 0], count[w >= 0]
            places, cosines = index.nearest(row, w, index.vectors(row, w, count, n), n, None if curve else pc.fill_null(part["doc_id"], B.NULL_ID).to_numpy())
            votes = index.votes(places, cosines)
            if curve:
                votes = np.where(np.bincount(row, minlength=n) > 0, np.interp(votes, *curve), index.base_rate)
            near = [index.ids[p[c > 0]].tolist() for p, c in zip(places[:, :5], cosines[:, :5], strict=True)]
            raised = index.raised[w]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[raised], minlength=n))]).astype(np.int32)
            shown = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(word[raised])).cast(pa.string()))
            yield pa.record_batch([part["doc_id"].combine_chunks(), pa.array(votes), pa.array(near, pa.list_(pa.int64())), shown], names=["doc_id", "score", "neighbours", "words"])

    return score


def build_index(labelled: DataFrame, k: int = 15, max_examples: int = 4_000):
    """The index over examples of ``(doc_id, text, toxic)``, sent to the tasks, and the calibration curve (None without examples)."""
    spark = labelled.sparkSession
    by_hash = lambda toxic, n: labelled.where(F.col("toxic") == toxic).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    kept = cut(by_hash(1, max_examples // 2).unionByName(by_hash(0, max_examples - max_examples // 2)).withColumn("example", F.lit(1)))
    marked = labelled.select("doc_id", "text", "toxic").join(bounded_broadcast(kept, max_examples), "doc_id", "left").withColumn("example", F.coalesce("example", F.lit(0)))
    n1, n0 = (labelled.agg(F.sum((F.col("toxic") == 1).cast("long")), F.sum((F.col("toxic") == 0).cast("long"))).first())
    n1, n0 = n1 or 0, n0 or 0
    held = word_statistics(marked).where("example > 0").select("word", "toxic", "clean").toArrow()  # the words of at most max_examples documents
    by = np.argsort(held["word"].to_numpy())
    words, a, c = (held[x].to_numpy()[by] for x in ("word", "toxic", "clean"))
    p = (a + c) / (n1 + n0 or 1)
    others = np.maximum(0, a - 1)  # a word is not raised by the document itself
    apart = (others / max(1, n1) - c / max(1, n0)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(1, n1) + 1 / max(1, n0)))
    z = np.maximum(0, apart)
    idf = ((np.log((n1 + n0 + 1) / (a + c + 1)) + 1) * (1 + z) ** 2).astype(np.float32)
    names = spark.sparkContext.broadcast(words)

    def vectors(batches):
        for part in slices(batches):
            row, word, count, own = _word_counts(part["text"])
            w = np.searchsorted(names.value, _hashes(own))[word] if len(word) else word
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (w, count)]
            yield pa.record_batch([part["doc_id"].combine_chunks(), part["toxic"].combine_chunks(), *lists], names=["doc_id", "toxic", "w", "c"])

    found = marked.where("example = 1").select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic long, w array<int>, c array<int>").where("size(w) > 0")
    sample = found.toArrow().combine_chunks()  # at most max_examples documents
    names.destroy()
    none = np.empty(0, np.int64)
    index = Index(words, idf, none, np.empty(0), n1 / (n1 + n0) if n1 + n0 else 0.0, k, none, np.empty(0), z >= 2)
    if not sample.num_rows:
        return spark.sparkContext.broadcast(index), None
    lists = [sample[x].combine_chunks() for x in ("w", "c")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    w, c = (x.flatten().to_numpy() for x in lists)
    n = pc.list_value_length(lists[0]).to_numpy()
    start = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    x = (1 + np.log(c)) * idf[w]
    x /= np.sqrt(np.add.reduceat(x * x, start))[row]
    top = np.maximum.reduceat(x, start)
    best = np.flatnonzero(x == top[row])
    best = best[np.unique(row[best], return_index=True)[1]]
    ids_ = sample["doc_id"].to_numpy()
    # the word used most often tells languages and subjects apart: like examples share blocks
    most = c * (n1 + n0 + 1) + (a + held["clean"].to_numpy()[by])[w]
    used = np.flatnonzero(most == np.maximum.reduceat(most, start)[row])
    used = used[np.unique(row[used], return_index=True)[1]]
    order = np.lexsort((ids_, -top, w[best], w[used]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    index.ids, index.toxic, index.n_blocks = ids_[order], sample["toxic"].to_numpy()[order].astype(float), -(-len(order) // BLOCK)
    shown = index.toxic.sum()
    index.share = np.where(index.toxic > 0, n1 / max(1, shown), n0 / max(1, len(order) - shown))
    index.share /= max(1e-9, index.share.mean())
    index.build(w, place[row], x)
    shared = spark.sparkContext.broadcast(index)
    again = marked.where("example = 1").select("doc_id", "text")
    votes = {r["doc_id"]: r["score"] for r in again.mapInArrow(_scorer(shared, None), OUT).select("doc_id", "score").collect()}  # at most max_examples rows
    return shared, _monotone(np.array([votes[int(i)] for i in index.ids]), index.toxic, index.share)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels_broadcast: int = 2_000_000, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours, words`` for every document.

    score: 0 to 1, the calibrated share of toxic neighbours; predicted: score >= 0.5;
    neighbours: up to five nearest examples; words: those of the document's that toxic
    examples hold more often than others (z of 2 or more).
    Labels are broadcast up to ``max_labels_broadcast`` rows (counted), else joined
    by shuffle.

    Defined cases: null, empty or unknown texts get the share of toxic rows among
    labelled documents; without labels every score is 0; null labels are ignored, several labels of one id count as toxic
    if one does; a null id counts as held out; repeated rows are scored each;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("long").alias("toxic"))
    labelled = rows.join(bounded_broadcast(known, max_labels_broadcast), "doc_id")
    index, curve = build_index(labelled, **options)
    scored = rows.mapInArrow(_scorer(index, curve or (np.array([0.0, 1.0]),) * 2), OUT)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "words")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query 6 over all documents."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
