"""Epochs of batches: rows numbered without a sort of the whole, their order permuted by a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds of the permutation, and the prime of its arithmetic: products of two numbers below it fit a long.
ROUNDS, PRIME = 48, 2147483647


def numbered(df: DataFrame, bucket: Column, keys: list[str]) -> DataFrame:
    """df with ``_row``, 0, 1, 2, ... by ``bucket`` (few values, evenly filled: a hash of the keys modulo some hundreds) and within it by keys.

    A bucket's rows are sorted by themselves; only the buckets' counts meet. The keys must tell rows apart.
    """
    t = df.withColumn("_bucket", bucket)
    n = t.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    n = n.select("_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_before"))
    t = t.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)) - 1)
    return t.join(F.broadcast(n), "_bucket").withColumn("_row", (F.col("_at") + F.col("_before")).cast("long")).drop("_bucket", "_at", "_before")


def permuted(row: Column, n: Column, seed: int, epoch: int) -> Column:
    """The place of each row number below n, less than PRIME, in the order of an epoch: a permutation of 0 .. n - 1.

    In each round a number and its mirror image about a point of the round change places, or not, as a hash of the greater of them says; so
    each round is a permutation of the numbers below n, whatever n is. A row's place depends on no other row.
    """
    start = (seed * 7919 + epoch * 104729) % PRIME

    def turn(x: Column, r: Column) -> Column:
        other = (((r * 48271 + start) * 16807) % PRIME + n - x) % n
        h = (F.greatest(x, other) * 48271 + r * 69621 + start) % PRIME
        h = (h * h + 12345 * (r + 1)) % PRIME
        return F.when(F.floor(h / 1024) % 2 == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), row.cast("long"), turn)


def batches(df: DataFrame, bucket: Column, keys: list[str], size: int, epoch: int = 0, seed: int = 7) -> DataFrame:
    """df with ``batch`` and ``place`` in it (both long, from 0): an epoch's order, the same however df is dealt out; each row is there once."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    t = numbered(df, bucket, keys).crossJoin(F.broadcast(n))  # one row
    at = permuted(F.col("_row"), F.col("_n"), seed, epoch)
    return t.withColumn("_to", at).withColumns({"batch": F.floor(F.col("_to") / size), "place": F.col("_to") % size}).drop("_row", "_n", "_to")
