"""Range joins by equal buckets of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 64


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, how: str = "inner") -> DataFrame:
    """Rows of points with the ranges of equal keys that hold them: low <= at < high.

    A range goes to every bucket of BUCKET frames that it meets, a point to one, so the join is an equi-join on keys
    and bucket: a long series is spread over tasks and not compared with all its ranges. Columns of
    ``ranges`` other than keys must have names of their own. An empty range holds nothing.
    """
    last = F.col(high) - 1
    r = ranges.filter(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / BUCKET), F.floor(last / BUCKET))))
    r = r.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_bucket"]})
    p = points.withColumn("_bucket", F.floor(F.col(at) / BUCKET))
    on: Column = (F.col("_bucket") == F.col("_r__bucket")) & (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    for k in keys:
        on &= F.col(k) == F.col(f"_r_{k}")
    return p.join(r, on, how).drop("_bucket", "_r__bucket", *(f"_r_{k}" for k in keys))
