"""From raw documents to a training mix: five stages, each written as Parquet and read again.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame with the columns of
documents; the last one adds ``copies`` and ``taken``.  ``doc_id`` is the key: rows
that repeat an id share its decision, and rows with a null id are never dropped.
Texts that a stage doesn't change stay as they are, white space included.
"""

from pyspark.sql import functions as F

from tidewright.llm.decontaminate import contaminated
from tidewright.llm.minhash import near_duplicates
from tidewright.llm.mixing import mix_sources
from tidewright.llm.shared import bounded_broadcast, cut, shared_path
from tidewright.llm.substring_dedup import substring_dedup
from tidewright.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Sets of ids up to this size are broadcast (counted first), larger ones joined by shuffle.
BROADCAST_IDS = 1_000_000

# No SQL: shingle components, automata and nearest neighbours have none that ends in useful time.
ORACLE_SQL = None


def _without(docs, ids):
    """Documents whose id isn't among ``ids``."""
    ids = cut(ids.where(F.col("doc_id").isNotNull()).distinct())
    return docs.select(*COLUMNS).join(bounded_broadcast(ids, BROADCAST_IDS), "doc_id", "left_anti").select(*COLUMNS)


def toxicity(spark, docs, sf_dir):
    """Documents scored toxic by their nearest labelled examples go."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1").select("doc_id"))


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: five words, 0.8."""
    return _without(docs, near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id"))


def repeated_passages(spark, docs, sf_dir):
    """Words of passages of 35 words or more that recur anywhere go; untouched texts stay as they are."""
    changed = substring_dedup(docs).where("n_removed > 0").select("doc_id", "kept").dropDuplicates(["doc_id"])
    text = F.coalesce("kept", "text")
    n_chars = F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return docs.select(*COLUMNS).join(changed, "doc_id", "left").select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def mixing(spark, docs, sf_dir):
    """Documents that the mix takes, with their whole copies."""
    mix = mix_sources(docs).where("copies > 0").select("doc_id", "copies", "taken").dropDuplicates(["doc_id"])
    return docs.select(*COLUMNS).join(mix, "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``; tables between stages lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
