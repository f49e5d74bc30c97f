"""Column mapping when headers drift (MAP-*)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..plans.paths import written
from ..plans.spec import FileTypeSpec

#: Groups of keywords that say what a column is about, English and Thai (fixed values).
KEYWORDS = {
    "order": ["order", "คำสั่ง", "ออเดอร์", "สั่งซื้อ", "หมายเลข"],
    "product": ["product", "สินค้า", "ผลิตภัณฑ์", "ชื่อ", "รหัส"],
    "price": ["price", "ราคา", "ยอด", "เงิน", "cost"],
    "date": ["date", "time", "วันที่", "เวลา", "created", "updated"],
    "user": ["user", "buyer", "customer", "ผู้ใช้", "ผู้ซื้อ", "บัญชี", "ลูกค้า"],
}
#: Words of a name that a model should read with more context, and what is added (fixed values).
MEANINGS = [
    (["id", "รหัส", "หมายเลข"], " identifier number"),
    (["name", "ชื่อ"], " name title"),
    (["date", "time", "วันที่", "เวลา"], " date time"),
    (["price", "ราคา", "ยอด"], " price amount money"),
]
#: File types with a bonus: part of the type's name, word in the names, whether both must have it, bonus (fixed values).
TYPE_BONUS = [("jst", "หมายเลข", True, 0.3), ("shopee", "shopee", False, 0.2)]
#: Words for names that identify, and names that name (fixed values).
IDENTIFIERS, NAMES = ["หมายเลข", "number", "id"], ["ชื่อ", "name"]
SEMANTIC, STRING, CONTEXT = 0.5, 0.3, 0.2
#: Letters from common to rare in English text (fixed value).
COMMON_FIRST = "etaoinshrdlcumwfgypbvkjxqz"
#: Distinct pairs of names up to this number are broadcast (counted first), more are joined by shuffle.
BROADCAST_PAIRS = 100_000
LEAST_SCORE, AUTO, ALIKE, SURE_TYPE = 0.2, 70.0, 0.6, 80.0


def plain_name(c: Column) -> Column:
    """Lower case, without anything but letters, numbers, _ and spaces, runs of white space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def name_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the words of two plain names, 0 if either has none."""
    x, y = (F.filter(F.split(plain_name(c), " "), lambda w: w != "") for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0))).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matching characters over all characters of two short names."""
    from difflib import SequenceMatcher

    for a, b in parts:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def string_similarity(a: Column, b: Column) -> Column:
    return 0.7 * sequence_ratio(plain_name(a), plain_name(b)) + 0.3 * name_jaccard(a, b)


def _has(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(F.lower(c), F.lit(w)) for w in words])


def context_similarity(a: Column, b: Column, file_type: str = "") -> Column:
    """0.5 if both names hit one keyword group, plus the first bonus of the file type that applies, at most 1."""
    both = reduce(Column.__or__, [_has(a, w) & _has(b, w) for w in KEYWORDS.values()])
    score = F.when(both, F.lit(0.5)).otherwise(F.lit(0.0))
    for part, word, all_, bonus in TYPE_BONUS:
        if part in file_type.lower():
            met = _has(a, [word]) & _has(b, [word]) if all_ else _has(a, [word]) | _has(b, [word])
            score = score + F.when(met, F.lit(bonus)).otherwise(F.lit(0.0))
            break
    return F.least(F.lit(1.0), score)


def semantic_text(c: Column) -> Column:
    """What an embedding model should be given for a name."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return F.concat(bare, *[F.when(_has(c, words), F.lit(added)).otherwise(F.lit("")) for words, added in MEANINGS])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, not below 0; 0 without a vector or with a null one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.greatest(F.lit(0.0), dot(a, b) / F.nullif(norm, F.lit(0.0))), F.lit(0.0))


#: Width of a ring of vectors around a pivot, in radians.
RING = 0.05


def _unit_rows(rows: DataFrame) -> DataFrame:
    """``id, unit, width``: vectors of length one; NULL and width 0 for a row without a vector or with a zero one."""
    v = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    known = rows.select("id", v.alias("v"), norm.alias("norm")).select("id", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).alias("unit"))
    return known.withColumn("width", F.when(F.col("unit").isNull(), 0).otherwise(F.size("unit")))


def _placed_by(pivots: dict[int, np.ndarray], ring: float = RING):
    """Adds each vector's nearest pivot and its ring around it, with the angle."""

    def place(batches):
        for batch in batches:
            cell, angle = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for width, part in batch.groupby("width"):
                score = np.clip(np.stack(list(part["unit"])) @ pivots[width].T, -1.0, 1.0)
                at = batch.index.get_indexer(part.index)
                cell[at], angle[at] = score.argmax(1), np.arccos(score.max(1))
            yield batch.assign(cell=cell, ring=np.floor(angle / ring).astype(np.int32), angle=angle)

    return place


def _rings_for(pivots: dict[int, np.ndarray], rings: dict[int, list[tuple[int, int, float, float]]]):
    """For each query the rings, other than its own, that can hold a vector of at least its ``least`` score.

    The angle of two vectors is at least the difference of their angles to a pivot.
    """

    def choose(batches):
        for batch in batches:
            found = []
            for width, part in batch.groupby("width"):
                to_pivot = np.arccos(np.clip(np.stack(list(part["unit"])) @ pivots[width].T, -1.0, 1.0))
                cell, ring, lo, hi = (np.array(x) for x in zip(*rings[width], strict=True))
                gap = np.maximum(0.0, np.maximum(to_pivot[:, cell] - hi, lo - to_pivot[:, cell]) - 1e-6)
                can = np.maximum(0.0, np.cos(np.minimum(gap, np.pi))) >= part["least"].to_numpy()[:, None] - 1e-6
                can &= ~((cell == part["cell"].to_numpy()[:, None]) & (ring == part["ring"].to_numpy()[:, None]))
                q, r = np.nonzero(can)
                found.append(part.iloc[q][["id", "unit", "width"]].assign(cell=cell[r], ring=ring[r]))
            if found:
                yield pd.concat(found)

    return choose


def _best_of(score: np.ndarray, own: np.ndarray, other: np.ndarray, k: int) -> pd.DataFrame:
    """The best k columns of each row, ties by id, a row's own id left out."""
    score = np.round(np.maximum(0.0, score), 6)
    score[own[:, None] == other[None, :]] = -1.0
    order = np.lexsort((np.broadcast_to(other, score.shape), -score), axis=1)[:, :k]
    rank = np.take_along_axis(score, order, axis=1)
    keep = rank >= 0
    return pd.DataFrame({"query_id": np.repeat(own, order.shape[1])[keep.ravel()], "id": other[order][keep], "score": rank[keep]})


def _few_queries(queries: pd.DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score``: the best k of each batch of rows for each of a few queries, which are broadcast; one scan."""
    asked = {int(w): (p.index.to_numpy(), np.stack(list(p["unit"]))) for w, p in queries.groupby("width") if w}
    shared = rows.sparkSession.sparkContext.broadcast((queries["id"].to_numpy(), asked))

    def best(batches):
        own, asked = shared.value
        for batch in batches:
            if len(batch) and len(own):
                score = np.zeros((len(own), len(batch)))
                for width, part in batch.groupby("width"):
                    if width in asked:
                        at, vectors = asked[width]
                        score[np.ix_(at, batch.index.get_indexer(part.index))] = vectors @ np.stack(list(part["unit"])).T
                yield _best_of(score, own, batch["id"].to_numpy(), k)

    return rows.mapInPandas(best, "query_id long, id long, score double")


def _met(queries: DataFrame, rows: DataFrame, sizes: DataFrame, k: int, chunk: int) -> DataFrame:
    """``query_id, id, score``: of each block of rows the best k for each query that meets its ring.

    Blocks of rows (``salt``) and of at most about ``chunk`` queries (``part``) meet by a
    shuffle; a task holds one of each.
    """
    ring = ["width", "cell", "ring"]
    asked = queries.groupBy(*ring).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    plan = F.broadcast(written(asked.join(sizes.select(*ring, "salts"), ring), "vector-blocks"))  # one row for each ring
    q = queries.join(plan, ring).select("id", "unit", *ring, F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    r = rows.join(plan.drop("salts"), ring).select("id", "unit", *ring, "salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    key = [*ring, "salt", "part"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        return _best_of(np.stack(list(left["unit"])) @ np.stack(list(right["unit"])).T, left["id"].to_numpy(), right["id"].to_numpy(), k)

    return q.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(best, "query_id long, id long, score double")


def nearest_vectors(queries: DataFrame, rows: DataFrame, k: int = 5, chunk: int = 2_000, block: int = 20_000, pivots: int = 32, cell_rows: int = 2_000, few: int = 2_000) -> DataFrame:
    """``query_id, id, score``: the k rows of largest cosine for each query, itself left out; scores have six digits.

    ``queries`` and ``rows``: ``id, vector`` with ids that say who is who.  Up to ``few``
    queries (counted) are broadcast and meet all rows in one scan.  Beyond that rows lie in
    rings of equal angle around the nearest of a few pivots (the rows of least hash of
    their id, at most ``pivots`` for each length and one for ``cell_rows`` rows), large
    rings in blocks of about ``block``; cells below a block are one ring.  A
    query meets its own ring first; its k-th score there and the triangle inequality
    leave out rings that can't hold a better row, exactly.  Blocks of queries meet blocks
    of rows by a shuffle; only pivots and the bounds of rings pass the driver.  Null and
    zero vectors, and those of another length, have score 0; ties go to the smaller id.
    """
    ring = ["width", "cell", "ring"]
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda found: found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")
    units, asked = _unit_rows(rows), _unit_rows(queries)
    shown = asked.limit(few + 1).toPandas()
    if len(shown) <= few:
        return best(_few_queries(shown, units, k))
    units, asked = written(units, "unit-rows"), written(asked, "unit-queries")
    total = units.where("width > 0").count()
    pivots = min(pivots, max(1, total // cell_rows))
    width_of_ring = RING if total > block * pivots else 4.0
    first = W.partitionBy("width").orderBy(F.xxhash64("id"), "id")
    chosen: dict[int, list] = {}
    # as a sketch of least hashes: at most ``pivots`` for each length
    for r in units.where("width > 0").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= pivots).select("width", "unit").collect():
        chosen.setdefault(r["width"], []).append(r["unit"])
    matrices = {w: np.array(v) for w, v in chosen.items()}
    # the k + 1 smallest ids of each length stand in where fewer than k rows have a score
    small = W.partitionBy("width").orderBy("id")
    others = F.broadcast(written(units.select(F.col("width").alias("other"), "id").withColumnRenamed("other", "width").withColumn("_n", F.row_number().over(small)).where(F.col("_n") <= k + 1).select(F.col("width").alias("other"), "id"), "smallest-ids"))
    zeros = asked.select(F.col("id").alias("query_id"), "width").join(others, (F.col("width") != F.col("other")) | (F.col("width") == 0)).where(F.col("query_id") != F.col("id")).select("query_id", "id", F.lit(0.0).alias("score"))
    asked = asked.where(F.col("width").isin(list(matrices)))
    if not matrices:
        return best(zeros)
    with_place = "id long, unit array<double>, width int, cell int, ring int, angle double"
    placed = written(units.where("width > 0").mapInPandas(_placed_by(matrices, width_of_ring), with_place), "placed-rows")
    sizes = written(placed.groupBy(*ring).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"), F.min("angle").alias("lo"), F.max("angle").alias("hi")), "rings")
    bounds: dict[int, list] = {}
    for r in sizes.collect():  # pivots times rings of a half circle, for each length
        bounds.setdefault(r["width"], []).append((r["cell"], r["ring"], r["lo"], r["hi"]))
    placed = placed.join(F.broadcast(sizes.select(*ring, "salts")), ring).select("id", "unit", *ring, F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"))
    asked = written(asked.mapInPandas(_placed_by(matrices, width_of_ring), with_place), "placed-queries")
    if pivots == 1 and width_of_ring > np.pi:  # every query has met all rows of its length
        return best(_met(asked.select("id", "unit", *ring), placed, sizes, k, chunk).unionByName(zeros))
    near = written(best(_met(asked.select("id", "unit", *ring), placed, sizes, k, chunk)), "nearest-so-far")
    least = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    open_ = asked.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    rest = open_.mapInPandas(_rings_for(matrices, bounds), "id long, unit array<double>, width int, cell int, ring int")
    return best(near.unionByName(_met(written(rest, "open-rings"), placed, sizes, k, chunk)).unionByName(zeros))


def _letters(plain: Column) -> Column:
    """Each letter of a name with its how-manieth it is: as many tokens as letters; an empty name has one token."""
    n, upto = F.length(plain), lambda i: F.substr(plain, F.lit(1), i)
    letter = lambda i: F.substr(plain, i, F.lit(1))
    token = lambda i: F.concat(letter(i), (F.length(upto(i)) - F.length(F.replace(upto(i), letter(i), F.lit("")))).cast("string"))
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), token))


def _bag_ratio() -> Column:
    """The most that ``sequence_ratio`` can be by the letters that two names share; needs ``_la, _lb``."""
    return 2 * F.size(F.array_intersect("_la", "_lb")) / (F.size("_la") + F.size("_lb"))


def alike_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``a, b``: pairs of plain names whose ratio can reach ``least``, out of ``left`` (``a``) and ``right`` (``b``).

    A ratio of t needs t / (2 - t) of a name's letters in the other one, so each name
    is indexed by a few of its letters only, one more than it can do without: all names
    in the same order, which begins with letters that are rare in most languages and
    with those that a name has several times.  Names meet by an equi-join on those, and
    what they share of all letters and their lengths bound the ratio of the pairs that
    met.  No pair that reaches ``least`` is left out.
    """
    letter = lambda t: F.coalesce(F.nullif(F.instr(F.lit(COMMON_FIRST), F.left(t, F.lit(1))), F.lit(0)), F.lit(99))
    rank = lambda t: F.struct((-100 * F.substr(t, F.lit(2)).try_cast("int") - letter(t)).alias("rank"), t.alias("token"))

    def index(names: DataFrame, c: str) -> DataFrame:
        own = names.select(c).distinct().withColumn("_l", _letters(F.col(c)))
        keep = F.size("_l") - F.ceil(F.size("_l") * (least / (2 - least)) - 1e-9) + 1
        tokens = F.slice(F.array_sort(F.transform("_l", rank)), F.lit(1), F.least(F.size("_l"), F.greatest(keep, F.lit(1))).cast("int"))
        return own.select(c, F.col("_l").alias(f"_l{c}"), F.explode(F.transform(tokens, lambda x: x["token"])).alias("token"))

    met = index(left, "a").join(index(right, "b"), "token")
    return met.where(_bag_ratio() >= least - 1e-9).select("a", "b").distinct()


def spelling_candidates(sources: DataFrame, targets: DataFrame, above: float) -> DataFrame:
    """``source_column, target_column`` whose ``string_similarity`` can be above ``above``: names that share a word, and those alike enough without one."""
    own = sources.select("source_column", plain_name(F.col("source_column")).alias("a")).distinct()
    other = targets.select("target_column", plain_name(F.col("target_column")).alias("b")).distinct()
    words = lambda c: F.explode(F.filter(F.split(c, " "), lambda w: w != ""))
    shared = own.select("a", words(F.col("a")).alias("word")).distinct().join(other.select("b", words(F.col("b")).alias("word")).distinct(), "word").select("a", "b").distinct()
    shared = shared.withColumns({"_la": _letters(F.col("a")), "_lb": _letters(F.col("b"))}).where(0.7 * _bag_ratio() + 0.3 * name_jaccard(F.col("a"), F.col("b")) > above - 1e-9).select("a", "b")
    pairs = shared if above >= 0.7 else shared.union(alike_pairs(own, other, above / 0.7))
    return pairs.distinct().join(own, "a").join(other, "b").select("source_column", "target_column")


def _group_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of names that hit one keyword group."""
    groups = lambda c: F.explode(F.array_compact(F.array(*[F.when(_has(F.col(c), words), F.lit(g)) for g, words in KEYWORDS.items()])))
    return sources.select("source_column", groups("source_column").alias("group")).join(targets.select("target_column", groups("target_column").alias("group")), "group").select("source_column", "target_column").distinct()


def score_pairs(pairs: DataFrame, file_type: str = "", vectors: DataFrame | None = None, renormalize: bool = False) -> DataFrame:
    """Scores for rows with ``source_column, target_column``; each distinct pair is scored once.

    ``vectors``: ``name, vector``.  Without them the semantic score is 0 and
    confidence at most 50; ``renormalize`` spreads its weight over the others.
    """
    names = pairs.select("source_column", "target_column").distinct()
    semantic = F.lit(0.0)
    if vectors is not None:
        names = names.join(vectors.toDF("source_column", "_a"), "source_column", "left").join(vectors.toDF("target_column", "_b"), "target_column", "left")
        semantic = cosine(F.col("_a"), F.col("_b"))
    scored = names.select("source_column", "target_column", semantic.alias("semantic_score"), string_similarity(F.col("source_column"), F.col("target_column")).alias("string_score"), context_similarity(F.col("source_column"), F.col("target_column"), file_type).alias("context_score"))
    total = SEMANTIC * F.col("semantic_score") + STRING * F.col("string_score") + CONTEXT * F.col("context_score")
    if renormalize and vectors is None:
        total = total / (STRING + CONTEXT)
    return pairs.join(scored.withColumn("score", total), ["source_column", "target_column"])


def reason(s: str = "semantic_score", t: str = "string_score") -> Column:
    band = lambda c, name: F.when(F.col(c) > 0.7, F.lit(f"high {name} similarity")).when(F.col(c) > 0.4, F.lit(f"some {name} similarity"))
    a, b = F.col("source_column"), F.col("target_column")
    labels = F.concat_ws("; ", band(s, "meaning"), band(t, "spelling"), F.when(_has(a, IDENTIFIERS) & _has(b, IDENTIFIERS), "both identifiers"), F.when(_has(a, NAMES) & _has(b, NAMES), "both names"))
    return F.when(labels == "", "pattern").otherwise(labels)


def suggest_mappings(sources: DataFrame, targets: DataFrame, file_type: str = "", top: int = 5, vectors: DataFrame | None = None, renormalize: bool = False) -> DataFrame:
    """The best ``top`` targets of each source: scores, confidence in percent, reason, rank.

    ``sources`` (``source_column``) and ``targets`` (``target_column``) are lists of
    names.  Only pairs that can reach the least score are compared: those of one keyword
    group and those whose spelling can make up for another one.  With ``vectors`` any
    pair can, so all are; keep such lists short.
    """
    own, other = sources.select("source_column").distinct(), targets.select("target_column").distinct()
    if vectors is not None:
        pairs = own.join(other, F.lit(True))
    else:
        whole = STRING + CONTEXT if renormalize else 1.0
        bonus = next((x for part, _, _, x in TYPE_BONUS if part in file_type.lower()), 0.0)
        pairs = spelling_candidates(own, other, (LEAST_SCORE - CONTEXT / whole * bonus) / (STRING / whole)).unionByName(_group_pairs(own, other)).distinct()
    scored = score_pairs(pairs, file_type, vectors, renormalize).where(F.col("score") > LEAST_SCORE)
    order = W.partitionBy("source_column").orderBy(F.desc("confidence"), "target_column")
    return scored.withColumn("confidence", F.round(F.col("score") * 100, 1)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("source_column", "target_column", "confidence", "semantic_score", "string_score", "context_score", reason().alias("reasoning"), "rank")


def auto_map(suggestions: DataFrame, least: float = AUTO) -> DataFrame:
    return suggestions.where((F.col("rank") == 1) & (F.col("confidence") >= least))


def confidence_bands(suggestions: DataFrame) -> DataFrame:
    band = F.when(F.col("confidence") > 70, "HIGH").when(F.col("confidence") > 50, "MED").otherwise("LOW")
    return suggestions.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def suggest_file_type(columns: DataFrame, specs: DataFrame, top: int = 3) -> DataFrame:
    """``file_type, confidence, rank`` for one file's ``column`` names.

    Direct matches with sources, plus unmatched columns for which some source is
    spelled alike (above 0.6), over the longer of the two lists.
    """
    own, known = columns.select("column").distinct(), specs.select("file_type", "source").distinct()
    direct = known.join(own, F.col("source") == F.col("column")).select("file_type", "column").withColumn("hit", F.lit(1))
    near = spelling_candidates(own.toDF("source_column"), known.select(F.col("source").alias("target_column")), ALIKE).toDF("column", "source")
    near = near.where(string_similarity(F.col("column"), F.col("source")) > ALIKE)
    near = near.join(known, "source").select("file_type", "column").distinct().join(direct, ["file_type", "column"], "left_anti").withColumn("hit", F.lit(1))
    hits = direct.distinct().unionByName(near).groupBy("file_type").agg(F.sum("hit").alias("hits"))
    sizes = known.groupBy("file_type").agg(F.count(F.lit(1)).alias("n_source"))
    n = own.agg(F.count(F.lit(1)).alias("n_own"))
    out = hits.join(sizes, "file_type").join(n, F.lit(True)).withColumn("confidence", F.round(F.col("hits") / F.greatest("n_source", "n_own") * 100, 1)).where("confidence > 20")
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("confidence"), "file_type"))).where(F.col("rank") <= top).select("file_type", "confidence", "rank")


def rename_existing(columns: DataFrame, specs: DataFrame, file_type: str, least: float = AUTO, renormalize: bool = False) -> DataFrame:
    """``column, new_name, how``: an exact source gives its target; else the best suggestion above ``least``; else unmapped."""
    known = specs.where(F.col("file_type") == file_type).select("source", "target")
    own = columns.select("column").distinct()
    exact = own.join(known, F.col("column") == F.col("source"))
    left = own.join(exact.select("column"), "column", "left_anti")
    best = suggest_mappings(left.select(F.col("column").alias("source_column")), known.select(F.col("source").alias("target_column")), file_type, 1, None, renormalize).where(F.col("confidence") > least)
    near = left.join(best.select(F.col("source_column").alias("column"), F.col("target_column").alias("source")), "column", "left").join(known, "source", "left")
    return exact.select("column", F.col("target").alias("new_name"), F.lit("exact").alias("how")).unionByName(near.select("column", F.col("target").alias("new_name"), F.when(F.col("target").isNull(), "unmapped").otherwise("suggested").alias("how")))


def rename_plan(columns: DataFrame, specs: DataFrame, file_type: str | None = None, least: float = AUTO, renormalize: bool = False, review: int = 3) -> DataFrame:
    """``column, new_name, how, suggestions`` for one file's ``column`` names.

    A type that the specs have, or else the one whose sources fit best (above
    SURE_TYPE), renames by its mapping (``rename_existing``).  Without such a type every
    target of every type is a candidate: the best one at or above ``least`` is taken
    (``suggested``), columns with weaker ones are for review (``review``, the best
    ``review`` of them in ``suggestions``), the others are ``unmapped``.
    """
    known = file_type is not None and not specs.where(F.col("file_type") == file_type).isEmpty()
    if not known:
        best = suggest_file_type(columns, specs, 1).where(F.col("confidence") > SURE_TYPE).first()
        if best is not None:
            known, file_type = True, best["file_type"]
    nothing = F.array().cast("array<struct<target:string,confidence:double>>")
    if known:
        return rename_existing(columns, specs, file_type, least, renormalize).withColumn("suggestions", nothing)
    own = columns.select("column").distinct()
    found = suggest_mappings(own.toDF("source_column"), specs.select(F.col("target").alias("target_column")), file_type or "", review, None, renormalize)
    per = found.groupBy(F.col("source_column").alias("column")).agg(F.sort_array(F.collect_list(F.struct("rank", "target_column", "confidence"))).alias("_found"))
    first = F.get("_found", F.lit(0))
    how = F.when(F.col("_found").isNull(), "unmapped").when(first["confidence"] >= least, "suggested").otherwise("review")
    shown = F.when(how == "review", F.transform("_found", lambda x: F.struct(x["target_column"].alias("target"), x["confidence"].alias("confidence")))).otherwise(nothing)
    return own.join(per, "column", "left").select("column", F.when(how == "suggested", first["target_column"]).alias("new_name"), how.alias("how"), shown.alias("suggestions"))


def auto_rename(df: DataFrame, specs: DataFrame, file_type: str | None = None, least: float = AUTO, renormalize: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table with new names, and the plan (``rename_plan``), which has one row per column and is read by the driver."""
    columns = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    plan = rename_plan(columns, specs, file_type, least, renormalize)
    return df.withColumnsRenamed({r["column"]: r["new_name"] for r in plan.where("new_name is not null").collect()}), plan


def drift_report(problems: DataFrame, file_type: str = "", renormalize: bool = False) -> DataFrame:
    """For each file the missing columns with the best extra column: ``path, missing, extra, confidence``.

    ``problems``: rows of ``missing_extra_columns``, written once; pairs are made within a
    file, and each distinct pair is scored and ranked once.
    """
    problems = written(problems, "problems")
    missing = problems.where("problem = 'missing'").select("path", F.col("column").alias("target_column"))
    extra = problems.where("problem = 'extra'").select("path", F.col("column").alias("source_column"))
    # written: else the filter on scores, and with it the scoring, is moved below the distinct to every pair of every file
    names = written(missing.join(extra, "path").select("source_column", "target_column").distinct(), "pairs-of-names")
    order = W.partitionBy("target_column").orderBy(F.desc("score"), "source_column")
    scored = score_pairs(names, file_type, None, renormalize).where(F.col("score") > LEAST_SCORE)
    scored = written(scored.select("target_column", "source_column", "score", F.row_number().over(order).alias("rank")), "scored-names")
    ranks = F.broadcast(scored) if scored.count() <= BROADCAST_PAIRS else scored
    # a pair's place among all pairs of its target is its place within a file, too: files pass numbers, not names and scores
    pairs = missing.join(extra, "path", "left").join(ranks.select("target_column", "source_column", "rank"), ["target_column", "source_column"], "left")
    best = pairs.groupBy("path", "target_column").agg(F.min("rank").alias("rank")).join(ranks, ["target_column", "rank"], "left")
    return best.select("path", F.col("target_column").alias("missing"), F.col("source_column").alias("extra"), F.round(F.col("score") * 100, 1).alias("confidence"))


def apply_mapping_update(specs: DataFrame, updates: DataFrame, least: float = AUTO) -> DataFrame:
    """Specs with old source names replaced by new ones (``file_type, old_source, new_source, confidence`` above ``least``)."""
    new = updates.where(F.col("confidence") > least).select("file_type", F.col("old_source").alias("source"), "new_source")
    return specs.join(new, ["file_type", "source"], "left").select("file_type", F.coalesce("new_source", "source").alias("source"), "target")


def mapped_spec(spec: FileTypeSpec, updates: dict[str, str]) -> FileTypeSpec:
    """A spec re-keyed on the driver, targets and types unchanged."""
    from dataclasses import replace

    return replace(spec, columns={updates.get(k, k): v for k, v in spec.columns.items()})
