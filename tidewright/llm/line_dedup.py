"""Line dedup against levelled sorted runs of line hashes.

A line's key is hashed to 128 bits.  The keys seen so far lie in runs: tables that are
bucketed and sorted by hash, a key in one run only.  A batch of documents is handled in
three steps, all by functions of Spark:

1. its keys are aggregated before the shuffle (smallest document, number of lines) and
   merge-joined with each run; the runs are read bucket by bucket, neither shuffled nor
   sorted again.  The result, with the holder of each key, is written in the same
   buckets: its rows without an earlier holder are the batch's own run;
2. lines whose key has another holder are dropped: keys that more than one in
   ``HOT`` lines have (so at most ``HOT`` keys) are broadcast, the rest meet their lines
   by a shuffle in which no key has more than one in ``HOT`` of the rows;
3. a level holds one run.  When a second one comes, the two are merged by a full outer
   merge join, bucket by bucket without a shuffle, into a run of the next level: a key
   is rewritten once for each doubling of the store.

The store's log has one short row for each version and is written last, so that a batch
that died is done again, and one that is in the store is judged as it was.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path

#: Stripped at both ends of a line; letters that are lower-cased (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 10
#: Keys of more than one in so many lines are hot; there can't be more of them than this.
HOT = 10_000
#: The two halves of a hash.
KEY = ["h1", "h2"]
#: Where a line is; rows that share an id are told apart by the hash of their text.
PLACE = ["doc_id", "text_hash", "pos"]


def lines_of(text: Column) -> Column:
    """The lines of a text; a null one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(doc_id, text_hash, pos, h1, h2)`` of the lines that can be dropped: where the line is, and its hash."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER)
    return lines.select(*PLACE, key.alias("key")).where(F.char_length("key") >= least_chars).select(*PLACE, F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Spark takes buckets of one file as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The keys of all batches so far under ``path``, a folder that all executors share.

    ``buckets`` is fixed by the first batch (as many as the session's shuffle
    partitions).  Of two documents in different batches the one in the earlier batch
    holds a key, in one batch the one with the smaller id; sending batches in order of
    their ids gives every key to its smallest document.  One writer at a time.
    """

    LOG = "version long, batches array<string>, runs array<struct<level:int,name:string>>, buckets int"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: set[str] = set()
        self._known: tuple[int, list[str], list[tuple[int, str]]] | None = None

    def state(self) -> tuple[int, list[str], list[tuple[int, str]]]:
        """Version, names of its batches, and its runs with their levels, lowest first; the log is read once, as there is one writer."""
        if self._known:
            return self._known
        try:
            last = self.spark.read.schema(self.LOG).parquet(f"{self.path}/log").orderBy(F.desc("version")).first()
        except AnalysisException:
            last = None
        if last is None:
            self._known = -1, [], []
        else:
            self.buckets = last["buckets"]
            self._known = last["version"], list(last["batches"]), [(r["level"], r["name"]) for r in last["runs"]]
        return self._known

    def _commit(self, version: int, batches: list[str], runs: list[tuple[int, str]]) -> None:
        self._known = version, batches, sorted(runs)
        self.spark.createDataFrame([(*self._known, self.buckets)], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").mode("overwrite").saveAsTable(name)
        self.tables.add(name)

    def table(self, name: str) -> DataFrame:
        """A run's rows; a store opened by another session makes its tables known first."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"create table {name} (h1 long, h2 long, first long, n long, holder long) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self.path}/{name}'")
            self.tables.add(name)
        return self.spark.table(name)

    def run(self, name: str) -> DataFrame:
        """``(h1, h2, first)``: the keys that came with this run and their documents."""
        return self.table(name).where("holder is null").select(*KEY, "first")

    def keys(self) -> DataFrame:
        """All keys with their documents."""
        empty = self.spark.createDataFrame([], "h1 long, h2 long, first long")
        return reduce(DataFrame.unionByName, [self.run(name) for _, name in self.state()[2]], empty)

    def judge(self, lines: DataFrame, batch: str) -> DataFrame:
        """The places of the batch's lines whose key another document holds; the batch's own keys enter the store.

        ``lines``: rows of ``keyed_lines``, read twice.  A batch that is in the store adds nothing and gets the same answer.
        """
        version, batches, runs = self.state()
        name = f"run_{uuid.uuid4().hex}"
        with _sorted_buckets(self.spark):
            judged = lines.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
            for i, (_, run) in enumerate(runs):
                judged = judged.join(self.run(run).withColumnRenamed("first", f"in_{i}"), KEY, "left")
            holder = F.coalesce(*[F.col(f"in_{i}") for i in range(len(runs))], F.lit(None).cast("long"))
            # a key that only its own document has, and no earlier one, drops nothing: shown by n = 0
            n = F.when(holder.isNull() & (F.col("first") == F.col("last")), F.lit(0).cast("long")).otherwise(F.col("n"))
            self._write(judged.select(*KEY, "first", n.alias("n"), holder.alias("holder")), name)
            known = self.table(name).where("n > 0").select(*KEY, "n", F.coalesce("holder", "first").alias("holder"))
            total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            hot = F.broadcast(known.where(F.col("n") * HOT > total))
            cold = known.where(F.col("n") * HOT <= total)
            meets = lines.join(hot.drop("n"), KEY).unionByName(lines.join(hot.select(*KEY), KEY, "left_anti").join(cold.drop("n"), KEY))
            path = shared_path(self.spark, "dropped-lines")
            meets.where(F.col("doc_id") != F.col("holder")).select(*PLACE).write.parquet(path)
            if batch not in batches:
                self._commit(version + 1, [*batches, batch], [*runs, (0, name)])
                self._merge()
        return self.spark.read.schema("doc_id long, text_hash long, pos int").parquet(path)

    def _merge(self) -> None:
        """Two runs of a level become one of the next, until each level has one."""
        version, batches, runs = self.state()
        levels = [level for level, _ in runs]
        twice = next((level for level in levels if levels.count(level) > 1), None)
        if twice is None:
            return
        a, b = [name for level, name in runs if level == twice][:2]
        name = f"run_{uuid.uuid4().hex}"
        both = self.run(a).join(self.run(b).withColumnRenamed("first", "other"), KEY, "full")
        self._write(both.select(*KEY, F.coalesce("first", "other").alias("first"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("holder")), name)
        self._commit(version + 1, batches, [r for r in runs if r[1] not in (a, b)] + [(twice + 1, name)])
        self._merge()

    def close(self) -> None:
        """The session forgets the tables; their files stay."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        self.tables.clear()


def without_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every document; ``dropped``: rows of ``judge``."""
    per = dropped.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("pos").alias("_gone"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_own"))
    rows = rows.join(per, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    lines, n = lines_of(F.col("_text")), F.size(lines_of(F.col("_text")))
    places = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col("_lines"), i)), "\n"))
    rows = rows.withColumn("_lines", lines)
    return rows.select("doc_id", n.cast("long").alias("n_lines"), (n - F.when(F.col("_gone").isNull(), n).otherwise(F.size(places))).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_dedup(docs: DataFrame, path: str | None = None, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: documents without the lines whose key a smaller id holds.

    Documents are sent in ``batches`` by ascending id (parts of about one size); ids are
    whole numbers.

    Defined cases: a null or empty text is one empty line; rows that repeat an id are one
    document, none of which loses a line to another; rows without an id keep all lines
    and hold none; a line that a document holds twice stays or goes twice; keys shorter than ``least_chars`` code points stay; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    store = LineRuns(spark, path or shared_path(spark, "line-runs"))
    shares = [i / batches for i in range(1, batches)]
    ends = docs.agg(F.percentile_approx(id_col, F.array(*map(F.lit, shares)), 10_000)).first()[0] or []
    place = reduce(lambda a, b: a + b, [(F.col("doc_id") > F.lit(e)).cast("int") for e in sorted(set(ends))], F.lit(0))
    staged = shared_path(spark, "line-keys")
    keyed_lines(docs, id_col, text_col, least_chars).withColumn("batch", place).write.partitionBy("batch").parquet(staged)
    lines = spark.read.schema("doc_id long, text_hash long, pos int, h1 long, h2 long, batch int").parquet(staged)
    dropped = [store.judge(lines.where(F.col("batch") == b).drop("batch"), f"{b:06d}") for b in range(len(set(ends)) + 1)]
    store.close()
    return without_lines(docs, reduce(DataFrame.unionByName, dropped), id_col, text_col)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 11 over all documents."""
    rows = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), k as (
  select *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') as key from l
), m as (
  select *, length(key) >= {LEAST_CHARS} and doc_id > min(doc_id) over (partition by key) as gone from k
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
