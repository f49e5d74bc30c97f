"""MinHash near-duplicates with sequential Bayesian verification.

1. Documents with one shingle set are one vertex; exact copies go no further.
2. MinHash signatures are cut into bands.  Their number follows from the miss
   probability at the threshold; all members of a band value are tied to its first.
3. Tied pairs compare their signatures a batch at a time.  After each batch the
   posterior (uniform prior) of a similarity at the threshold is known exactly from
   the binomial; below ``prune_miss`` the pair is dropped.  Survivors are verified on
   their full sets.
4. Links make components.  Band values that still hold members of two components
   are swept: members meet in chunks, signatures of pairs across components are
   compared by the same rule, survivors are verified on the spot, and only links
   that join two components leave the task.  So no pair of a band value goes
   untested unless its two ends are already in one component, and no pairs are
   made as rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import components
from .shared import bounded_broadcast, cut, slices

LAST_ID = 2**63 - 1
#: Members and shingles that a task of the sweep holds of one chunk.
CHUNK, CHUNK_SHINGLES = 2048, 2_000_000


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """So many bands of ``rows`` that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches of ``n`` with posterior P(similarity >= threshold) of ``miss`` or more.

    With a uniform prior that posterior after m matches is P(Binomial(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _sets(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, joined, and the offsets of the rows."""
    codes, at, vocabulary = B.word_codes(column, lower=True)
    h = B.word_hashes(vocabulary)[codes] if len(codes) else np.empty(0, B.U64)
    n = np.diff(at)
    each = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    where, row = B.spread(at[:-1], each)
    value = np.empty(len(where), B.U64)
    for length in range(1, size + 1):
        own = np.minimum(n, size)[row] == length
        if own.any():
            value[own] = B.rolling(h, length)[0][where[own]] + B.U64(length)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def _signatures(value: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """``count`` 32-bit minima for each row; rows without shingles get zeros."""
    out = np.zeros((len(at) - 1, count), np.int32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    seeds = B.mix(np.arange(1, 2 * count + 1, dtype=B.U64) * B.MULTIPLIERS[6])
    for j in range(count):
        hashed = value * (seeds[2 * j] | B.U64(1)) + seeds[2 * j + 1]
        hashed ^= hashed >> B.U64(29)
        hashed *= B.MULTIPLIERS[5]
        out[full, j] = (np.minimum.reduceat(hashed, at[:-1][full]) >> B.U64(32)).astype(np.uint32).view(np.int32)
    return out


def _digest(value: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(value.tobytes())


def _described(rows: DataFrame, size: int, count: int) -> DataFrame:
    """``doc_id, n_shingles, set_id, signature``; a set_id is the digest of the sorted set."""

    def make(batches):
        for part in slices(batches):
            value, at = _sets(part["text"], size)
            s = _signatures(value, at, count)
            ids = [_digest(value[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * count), pa.array(s.reshape(-1)))
            yield pa.record_batch([part["doc_id"].combine_chunks(), pa.array(np.diff(at)), pa.array(ids, pa.binary()), flat], names=["doc_id", "n_shingles", "set_id", "signature"])

    return rows.mapInArrow(make, "doc_id long, n_shingles long, set_id binary, signature array<int>")


def _full_sets(rows: DataFrame, size: int) -> DataFrame:
    def make(batches):
        for part in slices(batches):
            value, at = _sets(part["text"], size)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.record_batch([pa.array([_digest(value[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), lists], names=["set_id", "shingles"])

    return rows.mapInArrow(make, "set_id binary, shingles array<long>")


def _batches_pass(count: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    ends = [*range(batch, count, batch), count]
    return [(n, least_matches(n, threshold, miss)) for n in ends]


def _sequential(a: str, b: str, rule: list[tuple[int, int]]):
    """The rule as a condition: later batches are compared only if earlier ones pass."""
    same = lambda n: F.size(F.filter(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), lambda z: z))
    out = F.lit(True)
    for n, least in rule:
        out = F.when(out, same(n) >= least).otherwise(False)
    return out


def _sets_of(ids: DataFrame, vertices: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """``set_id, shingles`` of the wanted set ids, made again from one text of each."""
    wanted = cut(ids.select("set_id").distinct().join(vertices.select("set_id", "first_id"), "set_id"))
    texts = rows.join(bounded_broadcast(wanted.select(F.col("first_id").alias("doc_id")).distinct(), 1_000_000), "doc_id", "left_semi")
    return cut(_full_sets(texts, size).join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of set ids whose full sets reach the threshold: 100 * both >= percent * union."""
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    joined = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return joined.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


class _Joined:
    """Union-find over the labels of one task's members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, a: int, b: int) -> None:
        self.root[self.root == self.root[b]] = self.root[a]


def _sweep(members: DataFrame, rule: list[tuple[int, int]], percent: int) -> DataFrame:
    """Links ``a, b`` that join components of ``(key, set_id, label, n, signature, shingles)``.

    Members of a band value meet in chunks of bounded size, each pair of chunks in
    a task of its own.  Members of its largest component (part 0) don't meet each
    other, only the rest (part 1): they are copied once for each chunk of the rest.
    Pairs of one component, or of two that the task has joined, are passed over;
    signatures go by the sequential rule, survivors by their full sets, one member
    against all at once.  Only links that join are returned, fewer than members.
    """
    per = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    sizes = per.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("major"), F.sum("m").alias("all_m"), F.sum("total").alias("all_total"), F.max_by("m", F.struct("m", "label")).alias("m0"), F.max_by("total", F.struct("m", "label")).alias("total0"))
    chunks = lambda m, total: F.greatest(F.lit(1), F.ceil(F.greatest(m / CHUNK, total / CHUNK_SHINGLES))).cast("int")
    sizes = sizes.select("key", "major", chunks(F.col("m0"), F.col("total0")).alias("c0"), chunks(F.col("all_m") - F.col("m0"), F.col("all_total") - F.col("total0")).alias("c1"))
    placed = members.drop("n").join(sizes, "key").withColumn("major", F.col("label") == F.col("major"))
    placed = placed.withColumn("at", F.when(F.col("major"), F.pmod(F.xxhash64("set_id"), F.col("c0"))).otherwise(F.pmod(F.xxhash64("set_id"), F.col("c1")) + F.col("c0")).cast("int"))
    rest = F.sequence(F.col("c0"), F.col("c0") + F.col("c1") - 1)
    placed = placed.withColumn("other", F.explode(F.when(F.col("major"), rest).otherwise(F.concat(F.sequence(F.lit(0), F.col("c0") - 1), rest))))
    placed = placed.select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.col("at").alias("own"), "set_id", "label", "signature", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        ids, own = table["set_id"].to_pylist(), table["own"].to_numpy()
        lists = table["shingles"].combine_chunks()
        signature = table["signature"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        vocabulary, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
        n = np.diff(at)
        labels, label = np.unique(np.array(table["label"].to_pylist(), "S16"), return_inverse=True)
        joined, marks = _Joined(len(labels)), np.zeros(len(vocabulary), bool)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found: tuple[list[bytes], list[bytes]] = ([], [])
        for x in left:
            ys = right[right > x] if i == j else right
            ys = ys[(joined.root[label[ys]] != joined.root[label[x]]) & (100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x]))]
            seen, matches = 0, np.zeros(len(ys), int)
            for upto, least in rule:
                matches += (signature[ys, seen:upto] == signature[x, seen:upto]).sum(axis=1)
                ys, matches, seen = ys[matches >= least], matches[matches >= least], upto
            if not len(ys):
                continue
            own_codes = codes[at[x] : at[x + 1]]
            marks[own_codes] = True
            where, which = B.spread(at[ys], n[ys])
            both = np.bincount(which, weights=marks[codes[where]], minlength=len(ys)).astype(np.int64)
            marks[own_codes] = False
            for y in ys[100 * both >= percent * (n[ys] + n[x] - both)]:
                if joined.root[label[y]] != joined.root[label[x]]:
                    joined.merge(label[x], label[y])
                    found[0].append(min(ids[x], ids[y]))
                    found[1].append(max(ids[x], ids[y]))
        return pa.table([pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary())], names=["a", "b"])

    return placed.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, band_rows: int = 3, miss: float = 1e-6, prune_miss: float = 1e-8, batch: int = 15) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents link if 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles (A-Z lower-cased; fewer words make one shingle).
    component_id is the smallest id reachable; kept marks it.  ``miss``: the chance
    that banding overlooks a pair exactly at the threshold; ``prune_miss``: the
    posterior below which a pair is dropped before its sets are compared.

    Defined cases: null, empty and blank texts have no shingles and link with
    nothing; a null id sorts last, and its component is null if all its members are
    null; equal texts always share a component; repeated rows with one id are
    documents of their own under that id; an empty table gives an empty result;
    other columns are ignored.
    """
    threshold = percent / 100
    bands = bands_for(threshold, band_rows, miss)
    rule = _batches_pass(bands * band_rows, batch, threshold, prune_miss)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = cut(_described(rows, size, bands * band_rows))
    vertices = cut(described.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.any_value("signature").alias("signature")))
    key = lambda b: F.xxhash64(F.lit(b), *[F.col("signature")[band_rows * b + i] for i in range(band_rows)])
    members = vertices.select("set_id", F.explode(F.array(*[key(b) for b in range(bands)])).alias("key"))
    firsts = members.groupBy("key").agg(F.min("set_id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    tied = cut(members.join(firsts, "key").withColumnRenamed("set_id", "b"))  # band values with two members or more
    signature = vertices.select("set_id", "signature")
    stars = tied.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    stars = stars.join(signature.toDF("a", "ga"), "a").join(signature.toDF("b", "gb"), "b").where(_sequential("ga", "gb", rule)).select("a", "b")
    stars = cut(stars)
    links = cut(_verified(stars, _sets_of(stars.select(F.explode(F.array("a", "b")).alias("set_id")), vertices, rows, size), percent))
    labels = components(links)
    held = tied.select("key", F.col("b").alias("set_id")).join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    # with two members the only pair was a star's
    apart = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high and m > 2").select("key")
    open_ = cut(held.join(apart, "key", "left_semi"))
    if open_.limit(1).count():
        sets = _sets_of(open_, vertices, rows, size)
        swept = open_.join(signature, "set_id").join(sets, "set_id").select("key", "set_id", "label", F.size("shingles").alias("n"), "signature", "shingles")
        labels = components(cut(links.unionByName(_sweep(swept, rule, percent))))
    named = vertices.select("set_id", "first_id").join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(smallest, "label").select("set_id", "component_id")
    out = described.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    null = lambda c: F.when(F.col(c) != LAST_ID, F.col(c)).alias(c)
    return out.select(null("doc_id"), "n_shingles", null("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Contract query 5 over all documents: three-word shingles, 85 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)
