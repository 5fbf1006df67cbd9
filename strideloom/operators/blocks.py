"""Long series cut into blocks: neighbours by halos, what went before by a scan over blocks.

A window by series holds a recording in one task. These hold a block of it at most, whatever the length of the recording; over the blocks of a
series, one row each, an ordinary window suffices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("video", "side")
#: Frames of a block.
BLOCK = 1 << 14


def window(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    """Over the rows of a block and of its halos."""
    return Window.partitionBy(*keys, "_block").orderBy("_i")


def indexed(df: DataFrame, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("frame",), block: int = BLOCK) -> DataFrame:
    """df with ``_i``, each row's place in its series from 0, and ``_n``, the rows of the series.

    Blocks are of ``block`` values of order's first column; rows alike in ``order`` are in no certain order.
    """
    df = df.withColumn("_b", F.floor(F.col(order[0]) / block))
    series = Window.partitionBy(*keys).orderBy("_b")
    n = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_rows"))
    n = n.select(*keys, "_b", (F.sum("_rows").over(series) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy(*keys)).alias("_n"))
    t = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    return t.join(n, [*keys, "_b"]).withColumn("_i", F.col("_i") + F.col("_before")).drop("_b", "_before")


def haloed(df: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Rows with ``_i`` in their ``_block``, and copies (``_own`` false) in blocks that begin within ``before`` rows or end within ``after``."""
    own = F.floor(F.col("_i") / block)
    first = F.greatest(F.floor((F.col("_i") - after) / block), F.lit(0))
    t = df.withColumn("_block", F.explode(F.sequence(first, F.floor((F.col("_i") + before) / block))))
    return t.withColumn("_own", F.col("_block") == own)


def carried(df: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("frame",), how: str = "max", block: int = BLOCK) -> DataFrame:
    """df with, for each of ``values``, its ``how`` (max or sum) over the rows of the series before this one; null (of a sum: 0) where there is none.

    Within a block by a window; each block's own is carried to those after it by a window over blocks. ``order`` must tell rows apart.
    """
    agg = {"max": F.max, "sum": F.sum}[how]
    df = df.withColumns({"_b": F.floor(F.col(order[0]) / block), **{f"_v_{k}": v for k, v in values.items()}})
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*keys, "_b").agg(*(agg(f"_v_{k}").alias(k) for k in values))
    per = per.select(*keys, "_b", *(agg(k).over(ahead).alias(f"_c_{k}") for k in values))
    t = df.withColumns({f"_w_{k}": agg(f"_v_{k}").over(upto) for k in values}).join(per, [*keys, "_b"])
    zero = F.lit(0).cast("long")
    both = {k: F.greatest(f"_w_{k}", f"_c_{k}") if how == "max" else F.coalesce(f"_w_{k}", zero) + F.coalesce(f"_c_{k}", zero) for k in values}
    return t.withColumns(both).drop("_b", *(f"{p}{k}" for k in values for p in ("_v_", "_w_", "_c_")))
