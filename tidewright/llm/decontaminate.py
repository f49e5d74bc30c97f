"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so a question that was asked
again with other parameters has the same template.  A window starts at any token and
ends when it holds five tokens and three literals, so stretches that are dense in
placeholders get longer windows.  Template windows are hash-joined with those of the
benchmark, and slots are checked: along one alignment a benchmark value stands for
one document value (the one in most slots); windows with a slot that disagrees don't
count.  A document is contaminated if the windows left cover 0.8 of an item's.

Items with one template and one pattern of equal values are one class, joined once.
A class that is found has one of its rarest fifth of windows in the document (rounded
up, and one more), so only those make candidates, and a window that a third of all
items share joins nothing but candidates.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import blocks as B
from .shared import bounded_broadcast, cut, slices

#: Units of measure that count as such after a number (fixed values).
UNITS = "mm cm m km g kg mg t l ml s ms min h hours hour day days weeks week month months year years kb mb gb tb w kw v a hz khz mhz ghz percent % dollars euros usd eur gbp meters metres miles feet inches pounds".split()
#: One-letter words that are no names (fixed values).
NO_NAMES = ["A", "I"]
NUMBER, NAME, UNIT = 1, 2, 3
_EDGES = r"^[^\pL\pN]+|[^\pL\pN]+$"
_SYMBOL = r"^[-+*/=<>^%×÷]+$"
_NUMBER = r"(?i)^\d[\d.,:/-]*(?:st|nd|rd|th|[a-z%]{0,3})$"
_CAPITAL = r"\p{Lu}"
ITEM = "item binary, hash long, pos int, at array<int>, code array<long>, n_windows int, length int"
FOUND = "doc_id long, hash long, pos int, value array<long>"


def canonical(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word: the hash of its bare lower-case form (0 if nothing is left) and its kind.

    Kinds: 0 literal, NUMBER, NAME (any capital letter), UNIT (only after a number).
    Arithmetic signs that stand alone are literals.
    """
    if not len(vocabulary):
        return np.empty(0, B.U64), np.empty(0, np.int64)
    bare = pc.replace_substring_regex(vocabulary, _EDGES, "")
    bare = pc.if_else(pc.and_(pc.equal(bare, ""), pc.match_substring_regex(vocabulary, _SYMBOL)), vocabulary, bare)
    low = pc.utf8_lower(bare)
    kind = np.zeros(len(bare), np.int64)
    of = lambda x: x.to_numpy(zero_copy_only=False)
    kind[of(pc.and_(pc.match_substring_regex(bare, _CAPITAL), pc.invert(pc.is_in(bare, pa.array(NO_NAMES, bare.type)))))] = NAME
    kind[of(pc.is_in(low, pa.array(UNITS, low.type)))] = UNIT
    kind[of(pc.match_substring_regex(bare, _NUMBER))] = NUMBER
    names = B.word_hashes(low)
    names[of(pc.equal(bare, ""))] = 0
    return names, kind


def template(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with placeholders, kinds, values, and the offsets of the rows; neighbouring names are one token."""
    codes, at, vocabulary = B.word_codes(column)
    names, kinds = canonical(vocabulary)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    value, k = (names[codes], kinds[codes]) if len(codes) else (np.empty(0, B.U64), np.empty(0, np.int64))
    full = value != 0
    value, k, row = value[full], k[full], row[full]
    follows = np.zeros(len(k), bool)
    follows[1:] = row[1:] == row[:-1]
    before = np.concatenate([[0], k[:-1]]) * follows
    k = np.where((k == UNIT) & (before != NUMBER), 0, k)
    starts = np.flatnonzero(~((k == NAME) & (before == NAME)))
    if len(starts) < len(k):
        place = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
        value = np.add.reduceat(B.mix(value + place.astype(B.U64) * B.MULTIPLIERS[1]), starts)
    elif len(k):
        value = B.mix(value)
    k, row = k[starts], row[starts]
    return np.where(k > 0, B.MULTIPLIERS[:4][k], value), k, value, np.searchsorted(row, np.arange(len(at)))


def windows(k: np.ndarray, at: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, end and row of every window that ends inside its row."""
    literal = np.flatnonzero(k == 0)
    start = np.arange(len(k))
    nth = np.searchsorted(literal, start) + least - 1
    end = np.where(nth < len(literal), literal[np.minimum(nth, len(literal) - 1)] + 1, len(k) + 1) if len(literal) else np.full(len(k), len(k) + 1)
    end = np.maximum(end, start + size)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = end <= at[1:][row]
    return start[ok], end[ok], row[ok]


def _exact(sums: B.Stretches, start, end, whole: bool) -> np.ndarray:
    """Hashes of token values, apart from those of templates; for whole texts apart again."""
    return B.mix(sums.hashes(start, end) ^ B.MULTIPLIERS[6 + whole])


def _items(size: int, least: int):
    """Rows of ITEM.  ``length``: 0 for template windows; the tokens of an item that has none; -1 for one below ``size`` tokens."""

    def make(batches):
        for part in slices(batches):
            shape, k, value, at = template(part["text"])
            s, e, row = windows(k, at, size, least)
            shapes, values = B.Stretches(shape), B.Stretches(value)
            out = {c: [] for c in ("item", "hash", "pos", "at", "code", "n_windows", "length", "id")}
            hashes = shapes.hashes(s, e).view(np.int64)
            ends = np.searchsorted(row, np.arange(len(at)))
            for i, item_id in enumerate(part["id"].to_pylist()):
                a, b = int(at[i]), int(at[i + 1])
                if a == b:
                    continue
                # a slot's code is the place where its value comes first
                _, first, again = np.unique(value[a:b], return_index=True, return_inverse=True)
                code = first[again]
                own = slice(ends[i], ends[i + 1])
                found = [(int(h), int(x) - a, int(y) - a, 0) for h, x, y in zip(hashes[own], s[own], e[own], strict=True)]
                pattern = np.where(k[a:b] > 0, code, -1).astype("<i8").tobytes() + shape[a:b].tobytes()
                if not found:
                    short = b - a < size
                    pattern = value[a:b].tobytes()
                    found = [(int(_exact(values, np.array([a]), np.array([b]), short).view(np.int64)[0]), 0, 0, -1 if short else b - a)]
                digest = xxhash.xxh3_128_digest(pattern)
                for h, x, y, length in found:
                    slots = [j for j in range(x, y) if k[a + j] > 0]
                    for c, v in zip(out, (digest, h, x, slots, [int(code[j]) for j in slots], len(found), length, item_id), strict=True):
                        out[c].append(v)
            yield from B.rows(f"{ITEM}, id long", **out).to_batches()

    return make


def _document_windows(part: pa.Table, size: int, least: int, lengths: list[int]):
    """Hash, first token, end and row of all windows of a slice of documents, whatever their length, and its kinds, values and offsets."""
    shape, k, value, at = template(part["text"])
    s, e, row = windows(k, at, size, least)
    found = [(B.Stretches(shape).hashes(s, e), s, e, row)]
    values, n = B.Stretches(value), np.diff(at)
    for length in lengths:
        if length < 0:
            rows = np.flatnonzero((n > 0) & (n < size))
            found.append((_exact(values, at[rows], at[rows + 1], True), at[rows], at[rows], rows))
        else:
            x, rows = B.spread(at[:-1], np.maximum(0, n - length + 1))
            found.append((_exact(values, x, x + length, False), x, x, rows))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), k, value, at


def _hashes(size: int, least: int, lengths: list[int]):
    """``(doc_id, hash)`` of every window, without values."""

    def make(batches):
        for part in slices(batches, 2048):
            h, _, _, row, *_ = _document_windows(part, size, least, lengths)
            yield pa.record_batch([part["id"].combine_chunks().take(pa.array(row)), pa.array(h.view(np.int64))], names=["doc_id", "hash"])

    return make


def _documents(size: int, least: int, wanted, lengths: list[int]):
    """Rows of FOUND: a document's windows of the wanted hashes, which are broadcast or, without that, come with the rows."""

    def make(batches):
        for part in slices(batches, 2048):
            h, s, e, row, k, value, at = _document_windows(part, size, least, lengths)
            names = wanted.value if wanted is not None else np.unique(np.asarray(part["wanted"].combine_chunks().flatten()).astype(np.int64)).view(B.U64)
            names = np.sort(names)
            hit = names[np.minimum(np.searchsorted(names, h), len(names) - 1)] == h if len(names) else np.zeros(len(h), bool)
            h, s, e, row = h[hit], s[hit], e[hit], row[hit]
            if not len(h):
                continue
            inside, which = B.spread(s, e - s)
            slot = k[inside] > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(which[slot], minlength=len(h)))]).astype(np.int32)), pa.array(value[inside[slot]].view(np.int64)))
            ids = part["id"].combine_chunks().take(pa.array(row))
            yield pa.record_batch([ids, pa.array(h.view(np.int64)), pa.array((s - at[row]).astype(np.int32)), lists], names=["doc_id", "hash", "pos", "value"])

    return make


def consistent(windows_of_line: list[dict]) -> list[int]:
    """Places of the windows whose slots agree with the value that stands for theirs in most slots (ties: the least)."""
    slots = {a: (c, v) for w in windows_of_line for a, c, v in zip(w["at"], w["code"], w["value"], strict=True)}
    chosen: dict[int, int] = {}
    for (c, v), _ in sorted(Counter(slots.values()).items(), key=lambda x: (-x[1], x[0])):
        chosen.setdefault(c, v)
    return [w["item_pos"] for w in windows_of_line if all(chosen[c] == v for c, v in zip(w["code"], w["value"], strict=True))]


def _agreeing(batches):
    for batch in batches:
        places = [consistent(x) for x in batch.column("windows").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("item"), batch.column("n_windows"), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "item", "n_windows", "places"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, similarity: float = 0.8, least: int = 3, broadcast_hashes: int = 1_000_000) -> DataFrame:
    """Pairs ``doc_id, item_id, containment, aligned`` at ``similarity`` or more.

    containment: the item's windows that are found and agree, over all of its windows;
    aligned: the most on one alignment.  An item stands for all items of its template
    and pattern of equal values: item_id is the least of them.  The benchmark's hashes
    filter the documents where they are read if there are at most ``broadcast_hashes``
    of them (counted; 8 bytes each); beyond that the hashes of document windows meet them
    by a shuffle first.  Windows have no greatest length: one that begins in a long row
    of numbers ends at the third literal after it.

    Defined cases: null or empty texts match nothing; an item without ``least``
    literals has no template and is found word for word only, an item below ``size``
    tokens only as a whole document; rows with a null id are not matched; repeated
    items are one; repeated documents with one id count as one document; empty tables
    give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    all_items = cut(texts.mapInArrow(_items(size, least), f"{ITEM}, id long"))
    classes = all_items.groupBy("item").agg(F.min("id").alias("item_id"))
    items = cut(all_items.drop("id").dropDuplicates(["item", "hash", "pos"]))
    lengths = [r[0] for r in items.where("length <> 0").select("length").distinct().collect()]  # as many as there are lengths
    distinct = items.select("hash").distinct()
    wanted = None
    if distinct.limit(broadcast_hashes + 1).count() <= broadcast_hashes:
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in distinct.toLocalIterator()], np.int64).view(np.uint64)))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if wanted is None:  # documents meet the hashes first, then those that hold some give their windows
        hits = rows.mapInArrow(_hashes(size, least, lengths), "doc_id long, hash long").distinct().join(distinct, "hash")
        rows = rows.join(hits.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("hash").alias("wanted")), "id")
    found = cut(rows.mapInArrow(_documents(size, least, wanted, lengths), FOUND))
    held = items.groupBy("hash").agg(F.countDistinct("item").alias("held"))
    order = W.partitionBy("item").orderBy("held", "hash", "pos")
    needed = F.col("n_windows") - F.ceil(F.col("n_windows") * F.lit(similarity) - 1e-9) + 1
    rare = items.join(held, "hash").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= needed).select("item", "hash").distinct()
    candidates = found.select("doc_id", "hash").distinct().join(bounded_broadcast(rare, broadcast_hashes // 4), "hash").select("doc_id", "item").distinct()
    of = items.select("item", "hash", F.col("pos").alias("item_pos"), "at", "code", "n_windows")
    pairs = found.join(candidates, "doc_id").join(bounded_broadcast(of, broadcast_hashes // 4), ["item", "hash"])
    lines = pairs.groupBy("doc_id", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.first("n_windows").alias("n_windows"), F.collect_set(F.struct("item_pos", "at", "code", "value")).alias("windows")
    )  # as many windows as the item has
    agreeing = lines.mapInArrow(_agreeing, "doc_id long, item binary, n_windows int, places array<int>")
    return (
        agreeing.groupBy("doc_id", "item")
        .agg((F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.first("n_windows")).alias("containment"), F.max(F.size("places")).cast("long").alias("aligned"))
        .where(F.col("containment") >= similarity - 1e-9)
        .join(classes, "item")
        .select("doc_id", "item_id", "containment", "aligned")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, contaminated, containment, items``.

    ``items``: ids of the benchmark items found (the least of each class), ascending;
    ``containment``: the largest, 0 if none.  Cases as in ``contaminated``; a row with
    a null id is returned as clean, repeated rows once for each row.
    """
    found = contaminated(docs, benchmark, **options).groupBy("doc_id").agg(F.max("containment").alias("containment"), F.sort_array(F.collect_set("item_id")).alias("items"))
    found = bounded_broadcast(cut(found), 100_000).withColumnRenamed("doc_id", "_found")
    ids = docs.select(F.col(options.get("id_col", "doc_id")).alias("doc_id"))
    return ids.join(found, F.col("doc_id") == F.col("_found"), "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("containment", F.lit(0.0)).alias("containment"), F.coalesce("items", F.array().cast("array<long>")).alias("items")
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
