"""Document fingerprints by SpotSigs.

A signature is an anchor with the chain of the next two content words, or of as many as
the text still has.  Anchors are the common words of the language and the beginning of
the text, so every text with words has signatures, whatever its length.  A fingerprint is
the whole sorted set, and likeness is the exact Jaccard of two sets.

``near_copies`` joins documents: sets are partitioned by length so that a pair can
only meet in equal or neighbouring partitions, prefixes of the sets make the
candidates, and lengths prune a pair before its Jaccard is taken.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import blocks as B
from .shared import slices

#: Common words of English, German, French and Spanish (fixed values).
COMMON = """a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they
this to was were which will with you der die das den dem des ein eine einen einer und oder ist sind war in im mit von zu
auf für nicht es sich auch als an bei nach aus wie le la les un une des du de et ou est sont dans que qui sur pour pas par
plus avec au aux ce il elle en ne se el los las una y o es son en que no con por para del al lo su como más pero sus""".split()
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The sorted set of 32-bit signature hashes of each text."""
    codes, at, vocabulary = B.word_codes(pa.chunked_array([pa.array(texts, pa.large_string())]), lower=True)
    n, names = len(codes), B.word_hashes(vocabulary)
    if not n:
        return [np.empty(0, B.U64)] * len(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    h, common = names[codes], np.isin(names, B.word_hashes(pa.array(COMMON)))[codes]
    content = np.append(np.flatnonzero(~common), [n, n])
    starts = at[:-1][np.diff(at) > 0]
    anchors = np.concatenate([np.flatnonzero(common), starts])
    anchor = np.concatenate([h[common], np.zeros(len(starts), B.U64)])
    own = row[anchors]
    after = np.searchsorted(content, np.concatenate([np.flatnonzero(common) + 1, starts]))
    chain = anchor * B.MULTIPLIERS[0]
    for k, place in enumerate((content[after], content[after + 1])):
        inside = place < at[own + 1]
        chain += np.where(inside, h[np.minimum(place, n - 1)], B.U64(k)) * B.MULTIPLIERS[k + 1]
    spots = B.mix(chain) >> B.U64(32)
    order = np.argsort(own, kind="stable")
    return [np.unique(x) for x in np.split(spots[order], np.searchsorted(own[order], np.arange(1, len(texts))))]


def fingerprint(signature: np.ndarray) -> str:
    """The set in order, eight hexadecimal digits each."""
    return signature.astype(">u4").tobytes().hex()


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 if their lengths rule ``threshold`` out, without a comparison.

    Two empty sets are alike (1.0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt to ranges of ids; each range also gets, as ``tail``, the first row of the next one."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(B.NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("at")).first()["at"] or []
    splits = [-math.inf, *sorted({float(x) for x in at} or {0.0}), math.inf]
    split = Bucketizer(splits=splits, inputCol="_id", outputCol="range")
    rows = split.transform(rows.withColumn("_id", F.col("doc_id").cast("double"))).drop("_id").withColumn("range", F.col("range").cast("int"))
    firsts = rows.groupBy("range").agg(F.min("doc_id").alias("doc_id"))  # at most n rows
    order, every = W.orderBy("range"), W.partitionBy()
    firsts = firsts.select("doc_id", F.coalesce(F.lag("range").over(order), F.max("range").over(every)).alias("to"))
    tails = rows.drop("range").join(F.broadcast(firsts), "doc_id").select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("tail"))
    return rows.select("doc_id", "text", "range", F.lit(False).alias("tail")).unionByName(tails)


def _fingerprints(table: pa.Table) -> pa.Table:
    table = table.take(pa.compute.sort_indices(table, [("tail", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]))
    n = pa.compute.sum(pa.compute.invert(table["tail"])).as_py() or 0
    out = {c.split(" ")[0]: [] for c in OUT.split(", ")}
    for at in range(0, n, 64):
        texts = table["text"].slice(at, 65).to_pylist()
        ids = table["doc_id"].slice(at, min(64, n - at)).to_pylist()
        if len(texts) == len(ids):  # no tail: never, but for a range that stands alone
            texts.append(texts[0])
        edited = [edited_text(a, b) for a, b in zip(texts[: len(ids)], texts[1:], strict=False)]
        own, other = signatures(texts[: len(ids) + 1]), signatures(edited)
        out["doc_id"] += [None if i == B.NULL_ID else i for i in ids]
        out["n_chars"] += [len(t) for t in texts[: len(ids)]]
        out["edited_sha256"] += [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        out["fingerprint"] += [fingerprint(s) for s in own[: len(ids)]]
        out["edited_fingerprint"] += [fingerprint(s) for s in other]
        out["near_edited"] += [pruned_jaccard(a, b) for a, b in zip(own, other, strict=False)]
        out["near_next"] += [pruned_jaccard(a, b) for a, b in zip(own, own[1:], strict=False)]
    return B.rows(OUT, **out)


def spot_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The next document is the next id, after the last the first.  Returns OUT.

    Defined cases: a null text counts as empty; empty texts have an empty set,
    alike to each other (1.0) and to nothing else; a null id sorts first and stays
    null; rows with one id follow each other by text; a single document is its own
    next; an empty table gives an empty result; other columns are ignored.
    """
    return _with_next(docs, id_col, text_col).groupBy("range").applyInArrow(_fingerprints, OUT)


def near_copies(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of different signature sets ``a, b, jaccard`` at ``threshold`` or more, by their smallest ids.

    Documents with equal sets are one class (its smallest id); empty sets match
    nothing.  Sets of a length between t^-(p) and t^-(p+1) make partition p.
    """
    def make(batches):
        for part in slices(batches):
            sets = signatures([t or "" for t in part["text"].to_pylist()])
            yield pa.record_batch([part["doc_id"].combine_chunks(), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "spots"])

    sets = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, "doc_id long, spots array<long>")
    sets = sets.where(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("doc_id"))
    n = F.size("spots")
    sets = sets.withColumn("part", F.floor(F.log(n) / F.lit(-math.log(threshold)) + 1e-9))
    prefix = sets.select("doc_id", "part", n.alias("n"), F.explode(F.slice("spots", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias("spot"))
    a = prefix.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "spot", "part")
    b = prefix.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "spot", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    pruned = (F.col("a") != F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    pairs = a.join(b, ["spot", "part"]).where(pruned).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = sets.select(F.col("doc_id"), F.col("spots"))
    pairs = pairs.join(of.toDF("a", "sa"), "a").join(of.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def op4_spot_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Contract query 4 over all documents."""
    return spot_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
