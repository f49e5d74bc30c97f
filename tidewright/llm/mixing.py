"""Mixing sources to target weights by Pareto order sampling.

Each source gets a word target by its weight, at most ``max_repeats`` times its
size; what is above is shared again by weight (a water level over the sources).  A
source whose target is ``e`` times its size gives every document floor(e) whole
copies; the rest of the target is a sample of fixed size in words.  A document's
inclusion probability p is proportional to its size; where that reaches 1 the document
is taken for certain, and the others' factor is raised until the expected words are the
rest.  Documents are ranked by odds(u) / odds(p), u a hash of the id, and taken in that
order until the rest is met.

The cut in the order is found from a histogram of ranks, so that a source with a
third of all rows is never sorted in one task: whole bins below the cut are taken,
and only the bin with the cut is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import WORD, bounded_broadcast, cut, n_words

BINS = 4096
MAX_REPEATS = 3
#: Below so many sources their table is broadcast.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, size)``; one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", 1 + (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    ).withColumn("at", F.row_number().over(order))
    per = per.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("at"))).over(every))
    return per.select("source", "source_size", "weight", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def inclusion_factors(rows: DataFrame) -> DataFrame:
    """``(source, factor)`` from ``(source, size, rest)``: sum(size * min(1, factor * size)) is ``rest``; by distinct sizes, not by documents."""
    per = rows.where((F.col("size") > 0) & (F.col("rest") > 0)).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
    down, up = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("source").orderBy("size")
    certain = F.coalesce(F.sum(F.col("n") * F.col("size")).over(down), F.lit(0))
    squares = F.sum(F.col("n") * F.col("size") * F.col("size")).over(up)
    per = per.select("source", "size", ((F.col("rest") - certain) / squares).alias("factor"))
    return per.where(F.col("factor") * F.col("size") <= 1).groupBy("source").agg(F.max_by("factor", "size").alias("factor"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """How many whole copies of each document the mix takes.

    Returns ``doc_id, source, size, source_size, target, copies, taken``; size is
    the number of words, taken = copies * size.  The same rows always give the same
    mix.  Sources by code point, null last, weigh 1, 2, 3, repeating.

    Defined cases: a null or empty text has size 0 and takes 0 words; a null source
    is a source of its own; a null id is hashed as the empty string; equal ranks
    are ordered by id, then size; an empty table gives an empty result; other
    columns are ignored.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), u.alias("u")))
    targets = bounded_broadcast(cut(source_targets(sizes, max_repeats)), BROADCAST_SOURCES)
    rows = sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rows = rows.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    factors = bounded_broadcast(cut(inclusion_factors(rows)), BROADCAST_SOURCES).withColumnRenamed("source", "of")
    rows = rows.join(factors, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rows = rows.withColumn("p", F.coalesce(F.least(F.lit(1.0), F.col("factor") * F.col("size")), F.lit(0.0))).drop("factor")
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, rank))
    rows = rows.withColumn("bin", F.when(F.col("rank").isNotNull(), F.floor(F.col("rank") / (1 + F.col("rank")) * BINS)).otherwise(F.lit(BINS)).cast("int"))
    bins = rows.where(F.col("rank").isNotNull()).groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    bins = bins.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("bin")))
    cuts = bins.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min("bin").alias("cut"), F.min_by(F.col("upto") - F.col("n"), "bin").alias("before"))
    cuts = bounded_broadcast(cut(cuts), BROADCAST_SOURCES).withColumnRenamed("source", "of")
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    on_cut = F.col("rank").isNotNull() & (F.col("bin") == F.coalesce(F.col("cut"), F.lit(BINS)))
    whole = rows.where(~on_cut).withColumn("extra", (F.col("rank").isNotNull() & (F.col("bin") < F.coalesce(F.col("cut"), F.lit(BINS)))).cast("long"))
    order = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ordered = rows.where(on_cut).withColumn("earlier", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    ordered = ordered.withColumn("extra", (F.col("earlier") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("earlier")
    return whole.unionByName(ordered).select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("extra")).alias("copies"), ((F.col("base") + F.col("extra")) * F.col("size")).alias("taken"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Contract query 10 over all documents."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_sql(table: str = "documents") -> str:
    """The same mix in DuckDB, by plain ordering of each source."""
    return f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix-1'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from {table}
), s as (
  select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from d group by source
), l as (
  select *, source_size * {MAX_REPEATS} as cap, row_number() over o as pos,
    (sum(source_size) over () - coalesce(sum(source_size * {MAX_REPEATS}) over (o rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0))::double as level
  from s window o as (order by (source_size * {MAX_REPEATS})::double / weight, source nulls last)
), t as (
  select source, source_size, least((select arg_min(level, pos) from l where level <= cap::double / weight) * weight, cap::double) as target from l
), r as (
  select d.*, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as base
  from d join t on d.source is not distinct from t.source
), q as (
  select *, target - base * source_size as rest from r
), f as (
  select source, arg_max(factor, size) as factor from (
    select source, size, (rest - coalesce(sum(n * size) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0)::double)
      / (sum(n * size * size) over (partition by source order by size))::double as factor
    from (select source, size, count(*) as n, first(rest) as rest from q where size > 0 and rest > 0 group by source, size)
  ) where factor * size <= 1 group by source
), p as (
  select q.*, coalesce(least(1.0::double, factor * size), 0.0::double) as p from q left join f on q.source is not distinct from f.source
), k as (
  select *, case when p >= 1 then 0.0::double when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as rank from p
), c as (
  select *, coalesce(sum(size) over (partition by source order by rank, doc_id, size rows between unbounded preceding and 1 preceding), 0) as earlier
  from k where rank is not null
), x as (
  select doc_id, source, size, source_size, target, base + case when earlier + size / 2.0 <= rest then 1 else 0 end as copies from c
  union all select doc_id, source, size, source_size, target, base from k where rank is null
)
select doc_id, source, size, source_size, target, copies, (copies * size)::bigint as taken from x
"""
