"""Line dedup against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideloom.llm.common import BLANKS, key128, new_path, shuffle_partitions, stage, table

MIN_CHARS = 10
#: Batches at least, and documents of a batch about.
BATCHES, BATCH_DOCS = 4, 20_000_000
FANOUT = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Where each bucket of a table is one sorted file, a merge join may read it as it lies.
ORDERED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """Runs (h1, h2, owner), sorted by hash and disjoint: level k holds fewer than ``fanout`` runs of some fanout^k batches.

    A run is a table in the shared folder, bucketed and sorted by hash: merge joins of runs and of a batch need
    neither a shuffle nor a sort. When a level is full its runs merge into one of the next level, so each hash is
    rewritten once for each level, a logarithm of the number of batches.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.names = spark, fanout, [], []
        self.buckets = shuffle_partitions(spark)

    def written(self, df: DataFrame) -> DataFrame:
        """df in buckets by h1 and h2, each one sorted file, as df is partitioned by them."""
        name = f"strideloom_run_{uuid.uuid4().hex}"
        write = df.write.format("parquet").option("compression", "zstd").option("path", new_path(self.spark, "run"))
        write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def looked_up(self, keys: DataFrame) -> DataFrame:
        """keys (h1, h2, ...), one row each, with the ``owner`` that a run has for them, written; those of no run stay as a run of their own."""
        owners = []
        for i, run in enumerate(r for level in self.levels for r in level):
            owners.append(f"_owner{i}")
            keys = keys.join(run.withColumnRenamed("owner", owners[-1]).withColumn(f"_in{i}", F.lit(True)).hint("merge"), ["h1", "h2"], "left")
        cols = [c for c in keys.columns if not c.startswith(("_owner", "_in"))]
        known = reduce(lambda a, b: a | b, [F.coalesce(f"_in{i}", F.lit(False)) for i in range(len(owners))], F.lit(False))
        return self.written(keys.select(*cols, F.coalesce(*owners, F.lit(None).cast("long")).alias("owner"), known.alias("known")))

    def add(self, run: DataFrame) -> None:
        """``run``: h1, h2, owner of a written table; none of its keys in a run yet."""
        self._put(0, run.select("h1", "h2", "owner"))

    def _put(self, k: int, run: DataFrame) -> None:
        if k == len(self.levels):
            self.levels.append([])
        self.levels[k].append(run)
        if len(self.levels[k]) >= self.fanout:
            full, self.levels[k] = self.levels[k], []
            self._put(k + 1, self.written(reduce(DataFrame.unionByName, full).repartition(self.buckets, "h1", "h2")))

    def forget(self) -> None:
        """Drop the tables' names; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos (from 0), h1, h2 of each line whose key has MIN_CHARS code points."""
    t = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    t = t.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.char_length("line") >= MIN_CHARS)
    return t.select("doc_id", "th", "pos", *(k.alias(n) for k, n in zip(key128(F.translate("line", UPPER, UPPER.lower())), ("h1", "h2"))))


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, th, drop: the sorted positions of the lines that each text loses.

    Batches, ``batches`` or more and of BATCH_DOCS documents or so, are ranges of doc_id in ascending order, so a key's first
    batch holds its smallest document. Each batch's keys are made distinct and looked up in the runs; those not found
    are the next run.
    """
    spark = docs.sparkSession
    rows = docs.agg(F.count(F.lit(1))).first()[0]
    batches = max(batches, -(-rows // BATCH_DOCS))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    batch = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    batch = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(batch).cast("int")  # a null doc_id comes last
    path = new_path(spark, "lines")
    lines = line_keys(docs).withColumn("batch", batch)
    lines.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    index, decided = LineRuns(spark), []
    before = spark.conf.get(ORDERED_SCAN)
    spark.conf.set(ORDERED_SCAN, "true")
    try:
        for b in range(len(cuts) + 1):
            keys = lines.filter(F.col("batch") == b).groupBy("h1", "h2").agg(
                F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"))
            several = (F.col("least") != F.col("most")) | ((F.col("ids") > 0) & (F.col("ids") < F.col("n")))
            looked = index.looked_up(keys.select("h1", "h2", "least", F.coalesce(several, F.lit(False)).alias("several")))
            owner = F.when(F.col("known"), F.col("owner")).otherwise(F.col("least"))
            decided.append(looked.filter("known or several").select("h1", "h2", owner.alias("owner"), F.lit(b).alias("batch")))
            if b < len(cuts):
                index.add(looked.filter("not known").select("h1", "h2", F.col("least").alias("owner")))
        decided = stage(reduce(DataFrame.unionByName, decided), "decided")
    finally:
        spark.conf.set(ORDERED_SCAN, before)
    index.forget()
    hits = lines.join(decided, ["h1", "h2", "batch"]).filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    return hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with ``text`` less its repeated lines, and n_lines, n_dropped, which replace columns of these names.

    A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased. Keys of MIN_CHARS code points
    or more that several documents hold lose all their lines but those of the smallest doc_id; null ids come
    last and count as one document. Keys are compared by 128-bit hash. Null or empty text: one empty line.
    Repeated rows of a document fare alike; columns of any other name stay as they are. An empty table gives no rows.
    """
    drop = dropped_lines(docs.select("doc_id", "text"), batches).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    t = docs.select(F.struct(*others).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), F.coalesce("text", F.lit("")).alias("_text"))
    t = t.join(drop.hint("merge"), t["_id"].eqNullSafe(drop["_d"]) & (t["_h"] == drop["_t"]), "left").select("row", F.split("_text", "\n", -1).alias("lines"), "_text", "drop")
    # time in proportion to the lines
    less = F.array_join(F.expr("transform(array_except(sequence(0, size(lines) - 1), drop), i -> lines[i])"), "\n")
    text = F.when(F.col("drop").isNull(), F.col("_text")).otherwise(less)
    return t.select(
        *(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by line dedup."""
    t = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return t.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
d as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
m as (select k.*, d.owner is not null and k.doc_id <> d.owner as gone from k left join d using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""
