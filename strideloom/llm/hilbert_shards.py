"""Sharding by Hilbert-curve order of several metadata dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideloom.llm.common import broadcast_small, stage, table, with_range_parts, with_rank

BITS = 4
#: Relative error of the quantiles that bound the cells is 1/ACCURACY.
ACCURACY = 2000


def hilbert_index(cells: str, n: int) -> Column:
    """Position on the Hilbert curve of a point in ``n`` dimensions.

    ``cells``: SQL for the array of its digits, top bit first; bit j of a digit is that of coordinate j.
    The curve is walked from the top bit down. Its state is the entry corner and the direction of the
    present cell, so each step is a few integer operations.
    """
    if n < 2:
        raise ValueError("2 dimensions at least")
    mask, corners = (1 << n) - 1, range(1 << n)
    gray = [i ^ (i >> 1) for i in corners]
    trailing = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  number of trailing ones
    literal = lambda xs: "array(" + ",".join(map(str, xs)) + ")"
    ungray = literal(gray.index(i) for i in corners)
    entry = literal(0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in corners)
    turn = literal(0 if w == 0 else trailing(w if w % 2 else w - 1) % n for w in corners)
    by = f"((a.d + 1) % {n})"
    w = f"{ungray}[(shiftright(c ^ a.e, {by}) | shiftleft(c ^ a.e, {n} - {by})) & {mask}]"
    into = f"{entry}[{w}]"
    step = (
        f"named_struct('e', a.e ^ ((shiftleft({into}, {by}) | shiftright({into}, {n} - {by})) & {mask}),"
        f" 'd', (a.d + {turn}[{w}] + 1) % {n}, 'h', shiftleft(a.h, {n}) | cast({w} as bigint))"
    )
    return F.expr(f"aggregate({cells}, named_struct('e', 0, 'd', 0, 'h', 0L), (a, c) -> {step}, a -> a.h)")


def digits(coords: list[str], bits: int) -> str:
    """SQL for the array that hilbert_index takes."""
    if len(coords) * bits > 62:
        raise ValueError("62 bits in all at most")
    return "array(" + ", ".join(" | ".join(f"shiftleft(shiftright({c}, {b}) & 1, {j})" for j, c in enumerate(coords)) for b in reversed(range(bits))) + ")"


def string_cells(df: DataFrame, col: str, bits: int) -> DataFrame:
    """(value, cell) of each distinct string of df's ``col``: the share of rows with lesser values, in 2^bits steps.

    Distinct values with their counts are range-sorted, and prefix sums are sums of ranges first, so there may be as many
    as rows, and no prefix of a value stands for it.
    """
    each = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    t = with_range_parts(each, [F.col("value")], "values")
    ahead = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy("_pid").agg(F.sum("n").alias("_sum"))
    parts = parts.select("_pid", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_pid").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("_inside", inside).join(F.broadcast(parts), "_pid")  # one row for each range
    return stage(t.select("value", F.expr(f"cast((_before + _inside) * {1 << bits} div _total as int)").alias("cell")), "cells")


def quantised(df: DataFrame, dims: dict[str, Column], bits: int) -> DataFrame:
    """df with the cell of each dimension in ``_c0``, ``_c1``, ...: 0 to 2^bits - 1; null is cell 0.

    Numbers and dates go by approximate quantiles, mergeable sketches of fixed size, taken over all rows in one
    pass; strings by the rank of their distinct values.
    """
    kinds = dict(df.select(*(c.alias(f"k{i}") for i, c in enumerate(dims.values()))).dtypes)
    text = [i for i in range(len(dims)) if kinds[f"k{i}"] == "string"]
    code = lambda i, c: c if i in text else F.when(~F.isnan(c.cast("double")), c.cast("double"))
    df = df.select("*", *(code(i, c).alias(f"_v{i}") for i, c in enumerate(dims.values())))
    numbers = [i for i in range(len(dims)) if i not in text]
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = df.agg(F.count(F.lit(1)), *(F.percentile_approx(f"_v{i}", cuts, ACCURACY).alias(f"b{i}") for i in numbers)).first()

    def cell(i: int) -> Column:
        # equal cuts all count, so that a column of few values spreads over the whole range of cells
        over = [(F.col(f"_v{i}") > F.lit(float(b))).cast("int") for b in bounds[f"b{i}"] or []]
        return F.coalesce(reduce(lambda a, b: a + b, over, F.lit(0)), F.lit(0)).alias(f"_c{i}")

    out = df
    for i in text:
        of = broadcast_small(string_cells(df, f"_v{i}", bits)).withColumnsRenamed({"value": f"_v{i}", "cell": f"_c{i}"})
        out = out.join(of, f"_v{i}", "left").withColumn(f"_c{i}", F.coalesce(f"_c{i}", F.lit(0)))
    return out.select("*", *(cell(i) for i in numbers)).drop(*(f"_v{i}" for i in range(len(dims))))


def hilbert_shards(df: DataFrame, dims: dict[str, Column], shards: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """df with ``hilbert``, ``shard`` and ``slot``: runs of the curve order whose row counts differ by one at most.

    ``dims``: dimensions to quantise; ``ties``: columns that order rows of one cell. Rows alike in all of
    them are interchangeable. Nulls count as the lowest cell. An empty table gives no rows. Columns
    named ``_c*``, ``_v*``, ``_pid``, ``_rank``, ``hilbert``, ``shard`` or ``slot`` may not come in.
    """
    q = quantised(df, dims, bits)
    cells = [f"_c{i}" for i in range(len(dims))]
    q = q.withColumn("hilbert", hilbert_index(digits(cells, bits), len(dims))).drop(*cells)
    ranked, n = with_rank(q, [F.col("hilbert"), *(F.col(t) for t in ties)], "hilbert")
    shard = F.expr(f"cast(_rank * {shards}L div {max(n, 1)}L as int)")
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).drop("_rank")


def zones(sharded: DataFrame, cols: list[str]) -> DataFrame:
    """Least and greatest value of each column by shard: what a reader needs to skip files."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order; a shard is split over files by Spark's own file limits."""
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents' ids in shards by source, language, length and id; equal texts of a cell stay together.

    Shards differ by one row at most, and the curve has the id as a dimension, so a group of equal texts is spread over
    shards as its ids are; ``text_crc32`` shows it.

    Null text: size 1, crc32 0. Null ids, sources or languages go to the lowest cell.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.col("size"), "doc_id": F.col("doc_id")}
    return hilbert_shards(meta, dims, shards, ["text_crc32", "doc_id", "size"])


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``."""
    out = document_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
