"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an
insert adds, a delete subtracts, a revision does both.  Deltas are aggregated
before they are written, one folder for each batch id; a batch that is already
committed is not written again, so a replay or a retried job changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, bounded_broadcast, cut, n_words, shared_path, slices

KEYS = ("source", "lang", "tokenizer")
BPE_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Versions that SQL functions count.
BUILT_IN: dict[str, Callable[[Column], Column]] = {
    "words@1": n_words,
    "bytes@1": lambda text: F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
}


def built_in_counts(rows: DataFrame, versions: dict[str, Callable[[Column], Column]] = BUILT_IN) -> DataFrame:
    """``(source, lang, sign, tokenizer, tokens)`` of ``(source, lang, text, sign)`` by functions of Spark."""
    counts = F.array(*[F.struct(F.lit(v).alias("tokenizer"), f(F.col("text")).alias("tokens")) for v, f in versions.items()])
    return rows.select("source", "lang", "sign", F.inline(counts))


def bpe_counts(rows: DataFrame, path: str = BPE_FILE, version: str = "byte_bpe_50k@1") -> DataFrame:
    """The same by a public byte-level BPE vocabulary, read once on the driver (50,256 ranks) and sent along."""
    with open(path, "rb") as file:
        ranks = rows.sparkSession.sparkContext.broadcast(file.read())

    def count(batches):
        import base64

        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        for part in slices(batches):
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in part["text"].to_pylist()]
            for batch in part.select(["source", "lang", "sign"]).append_column("tokenizer", pa.array([version] * len(n), pa.string())).append_column("tokens", pa.array(n, pa.int64())).to_batches():
                yield batch

    return rows.select("source", "lang", "text", "sign").mapInArrow(count, "source string, lang string, sign long, tokenizer string, tokens long")


def signed(docs: DataFrame, sign: int, source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows that enter (+1) or leave (-1) the corpus."""
    return docs.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.lit(sign).cast("long").alias("sign"))


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One batch of signed rows: inserts, deletes, and revisions as (old, new) rows."""
    parts = [signed(d, s) for d, s in ((inserted, 1), (deleted, -1), *(((revised[0], -1), (revised[1], 1)) if revised else ())) if d is not None]
    return reduce(DataFrame.unionByName, parts)


class Rollup:
    """Additive totals under ``path``, a folder that all executors share.

    Defined cases: a null source, language or text is a group or a text of its own
    (a null text has 0 tokens but counts as a document); repeated rows count each
    time; a batch without rows commits nothing that shows in the totals; totals of
    an empty store are an empty table; groups whose documents all left stay with
    zeros until ``compact``.
    """

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def batches(self) -> set[str]:
        """Committed batch ids, one short row each; a folder without its row doesn't count."""
        try:
            return {r["batch_id"] for r in self.spark.read.schema("batch_id string").parquet(f"{self.path}/commits").collect()}
        except AnalysisException:
            return set()

    def committed(self, batch_id: str) -> bool:
        return batch_id in self.batches()

    def commit(self, batch_id: str, counts: DataFrame) -> bool:
        """Aggregate ``(source, lang, sign, tokenizer, tokens)`` and add it as ``batch_id``; False if it is there.

        The delta is written first and its id then; a job that dies between the two
        writes the same folder again.
        """
        if self.committed(batch_id):
            return False
        delta = counts.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self.spark.createDataFrame([(batch_id,)], "batch_id string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self, of: set[str] | None = None) -> DataFrame:
        """Sums over the batches committed by now, or over those named."""
        own = sorted(self.batches() if of is None else of)
        deltas = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/batch={b}" for b in own]) if own else self.spark.createDataFrame([], self.SCHEMA)
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self, path: str) -> Rollup:
        """A new store with one folder for all batches so far, without groups that are empty.

        The batches are read once: one that is committed meanwhile is in the old store
        only and can be sent to the new one.  Commits are written last: until then the new
        store is empty, and compacting again writes it anew.
        """
        so_far = self.batches()
        self.totals(so_far).where("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(f"{path}/batch=compacted")
        for batch in so_far:  # their counts are in the compacted folder
            self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        self.spark.createDataFrame([("compacted",), *((b,) for b in sorted(so_far))], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits")
        return Rollup(self.spark, path)


def later_copies(docs: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows whose exact text an earlier document has.

    Per digest one row with its smallest id is made before the shuffle; rows meet the
    repeated digests in a join, broadcast up to ``broadcast_rows`` of them (counted).
    Beyond that a digest that very many rows share relies on adaptive execution's
    skew split.  A row without an id is no later copy.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    first = docs.select("doc_id", digest.alias("_digest")).groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = cut(first.where("_n > 1").drop("_n"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), digest.alias("_digest"))
    return rows.join(bounded_broadcast(repeated, broadcast_rows), "_digest").where(F.col("_row.doc_id") > F.col("_first")).select("_row.*")


def tidied(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def _maintained(spark: SparkSession, sf_dir: str, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All documents enter; later exact copies leave; texts with untidy white space, copies included, are revised before that.  Every batch is sent twice, as after a failure."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    store = Rollup(spark, shared_path(spark, "token-counts"))
    untidy = docs.where(tidied(F.col("text")) != F.col("text"))
    tidy = docs.withColumn("text", tidied(F.col("text")))
    batches = {
        "0001-load": changes(inserted=docs),
        "0002-tidied": changes(revised=(untidy, untidy.withColumn("text", tidied(F.col("text"))))),
        "0003-copies": changes(deleted=later_copies(tidy)),
    }
    for batch, rows in [*batches.items(), *batches.items()]:
        store.commit(batch, count(rows))
    return store.totals()


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after a load, revisions and the removal of later copies."""
    return _maintained(spark, sf_dir, built_in_counts)


def op3_token_counts_bpe(spark, sf_dir: str) -> DataFrame:
    """The same with a public byte-level BPE tokenizer."""
    return _maintained(spark, sf_dir, bpe_counts)


OP3_SQL = f"""
with n as (
  select doc_id, source, lang, trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text from documents
), f as (
  select source, lang, text, row_number() over () as k, doc_id > min(doc_id) over (partition by coalesce(text, '')) as copy from n
), c as (
  select source, lang, copy, unnest([
    {{'tokenizer': 'words@1', 'tokens': coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint}},
    {{'tokenizer': 'bytes@1', 'tokens': coalesce(octet_length(encode(text)), 0)::bigint}}]) as t from f
)
select source, lang, t.tokenizer as tokenizer,
  sum(case when copy then 0 else 1 end)::bigint as n_docs, sum(case when copy then 0 else t.tokens end)::bigint as n_tokens
from c group by all
"""
