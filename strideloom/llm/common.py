"""Shared folder, staged tables, distributed ranks and skew-proof lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE such keys.
HOT_SHARE = 512
#: Rows of a table of short values that is broadcast (under 2 MB).
BROADCAST_ROWS = 10_000
#: Contract white space: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

_own_dir: list[str] = []
#: The folder of this driver's staged tables.
RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="strideloom-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strideloom/{RUN}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Delete what this driver has staged; results that were not written before can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strideloom/{RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives executors.

    Files stay until ``clear``, as the caller's result may still read them.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_range_parts(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df range-partitioned by ``order``, with the number of its range in ``_pid``, staged.

    Range bounds come from a sample, so they may differ between two runs of a plan; staging pins them.
    ``order`` should end in a column that is nearly unique, so that no range holds a hot value alone.
    """
    n = shuffle_partitions(df.sparkSession)
    return stage(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name)


def with_rank(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """df with ``_rank`` from 0 by ``order`` over all rows, and the number of rows.

    One range shuffle, a count for each range, and a window within each range; only the counts, one for
    each range, meet in one task.
    """
    t = with_range_parts(df, order, name)
    ahead = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = t.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    ranked = t.join(F.broadcast(offsets), "_pid").withColumn("_rank", (F.col("_before") + within - 1).cast("long"))
    return ranked.drop("_pid", "_before"), t.count()


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of left with right (one row for each key), whose column ``rows`` counts left's rows of the key.

    Keys with over total/HOT_SHARE rows, fewer than HOT_SHARE of them, are broadcast, so that their rows
    stay where they are; all others go through an ordinary shuffled join.
    """
    hot = F.broadcast(right.filter(F.col(rows) * HOT_SHARE > total))
    cold = right.filter(F.col(rows) * HOT_SHARE <= total)
    kept = left.join(hot.select(*keys), keys, "left_anti")
    return left.join(hot, keys).unionByName(kept.join(cold.hint("merge"), keys))


def broadcast_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has ``rows`` rows at most; df should be staged or cheap, as its rows are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def key128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes: equal keys by chance need about 2^64 distinct ones."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)]
