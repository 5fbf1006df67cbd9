"""Smoothing and peaks of a series y of (video, side) by frame."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideloom.operators import blocks
from strideloom.sources.scratch import scratched

WIDTH, ORDER, DISTANCE = 9, 2, 14


def savgol_weights(width: int = WIDTH, order: int = ORDER) -> np.ndarray:
    """Row i: weights of the samples of a window for the value at i of its least-squares polynomial."""
    x = np.vander(np.arange(width) - width // 2, order + 1).astype(float)
    return x @ np.linalg.pinv(x)


def savgol(df: DataFrame, col: str, out: str, keys: tuple[str, ...] = ("video", "side"), at: str = "frame", width: int = WIDTH, order: int = ORDER, block: int | None = None) -> DataFrame:
    """df with ``out``: the moving polynomial fit of ``col``; the first and last half window lie on the fit of the first and last window.

    A series shorter than the window is an error. Terms are lags and leads over one window, each with the
    weight that the row's place gives it. With ``block`` a series goes by blocks of so many rows, each with ``width`` - 1 rows of its neighbours.
    """
    h, half = savgol_weights(width, order), width // 2
    if block:
        df, w = blocks.haloed(blocks.indexed(df, keys, (at,), block), width - 1, width - 1, block), blocks.window(keys)
    else:
        w = Window.partitionBy(*keys).orderBy(at)
        df = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    df = df.withColumn("_place", F.when(F.col("_i") < half, F.col("_i")).when(F.col("_i") >= F.col("_n") - half, F.col("_i") - F.col("_n") + width).otherwise(half))
    terms = []
    for d in range(1 - width, width):
        weight = [(p, h[p, p + d]) for p in range(width) if 0 <= p + d < width]
        if not weight:
            continue
        case: Column = reduce(lambda c, x: c.when(F.col("_place") == x[0], F.lit(float(x[1]))), weight[1:], F.when(F.col("_place") == weight[0][0], F.lit(float(weight[0][1]))))
        y = F.col(col) if d == 0 else F.lead(col, d).over(w) if d > 0 else F.lag(col, -d).over(w)
        terms.append(F.coalesce(case * y, F.lit(0.0)))
    value = reduce(lambda a, b: a + b, terms)
    short = F.raise_error(F.concat(F.lit(f"a series has fewer than {width} samples: "), F.col("_n").cast("string"))).cast("double")
    df = df.withColumn(out, F.when(F.col("_n") < width, short).otherwise(value))
    if block:
        df = df.filter("_own").drop("_block", "_own")
    return df.drop("_i", "_n", "_place")


def tops(df: DataFrame, col: str, keys: tuple[str, ...] = ("video", "side"), at: str = "frame", block: int | None = None) -> DataFrame:
    """(keys, _p, _v): the middle and height of strict local maxima of ``col``, plateaus being one, none at the ends.

    A top is a rise and the fall that is the next change of value. With ``block`` changes are found within blocks, and the last change of each passes on,
    so a plateau may be longer than a block.
    """
    if block:
        df, w = blocks.haloed(blocks.indexed(df.select(*keys, at, col), keys, (at,), block), 1, 0, block), blocks.window(keys)
    else:
        w = Window.partitionBy(*keys).orderBy(at)
    before = F.lag(col).over(w)
    t = df.withColumns({"_v": before, "_end": F.lag(at).over(w), "_rise": F.col(col) > before}).filter((F.col(col) != F.col("_v")) & (F.col("_own") if block else F.lit(True)))
    change = F.struct(at, "_rise")
    if block:
        t = blocks.carried(t.drop("_block", "_own", "_i", "_n"), {"_last": change}, keys, (at,), "max", block)
    else:
        t = t.withColumn("_last", F.lag(change).over(w))
    return t.filter("not _rise and _last._rise").select(*keys, F.floor((F.col(f"_last.{at}") + F.col("_end")) / 2).cast("long").alias("_p"), "_v")


def chosen(p: np.ndarray, v: np.ndarray, distance: int, fixed: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """1, -1 or 0 for each candidate of place p and height v: kept, dropped, or not to be known yet.

    Higher ones go first, of equals the later; one that is kept drops those nearer than ``distance``. ``fixed``: kept before. Not ``seen``: there
    may be higher ones near by that are not among these; so nothing is known of it, or of lower ones near it, unless it is dropped.
    """
    out = fixed.astype(np.int8)
    if not len(p):
        return out
    at = p - p.min() + distance
    kept, open_ = np.zeros((2, int(at.max()) + distance + 1), bool)
    kept[at[fixed]] = True
    for i in np.lexsort((p, v))[::-1]:
        if fixed[i]:
            continue
        near = slice(at[i] - distance + 1, at[i] + distance)
        if kept[near].any():
            out[i] = -1
        elif seen[i] and not open_[near].any():
            kept[at[i]], out[i] = True, 1
        else:
            open_[at[i]] = True
    return out


def peaks(df: DataFrame, col: str, keys: tuple[str, ...] = ("video", "side"), at: str = "frame", distance: int = DISTANCE, block: int | None = None) -> DataFrame:
    """keys and ``at`` of the peaks of ``col``: strict local maxima, plateaus at their middle, none at the ends, higher peaks first suppressing those nearer than ``distance``.

    Positions must be dense. Of equal heights the later goes first. Candidates on either side of a gap of ``distance`` or more do not touch each
    other, so they are chosen among within the stretches between gaps, in time that grows as the stretch. With ``block`` see ``peaks_by_block``.
    """
    if block:
        return peaks_by_block(df, col, keys, at, distance, block)
    r = Window.partitionBy(*keys).orderBy("_p")
    t = tops(df, col, keys, at)
    t = t.withColumn("_far", (F.col("_p") - F.lag("_p").over(r) >= distance).cast("int"))
    t = t.withColumn("_stretch", F.sum(F.coalesce("_far", F.lit(0))).over(r)).drop("_far")

    def choose(x: pa.Table) -> pa.Table:
        p = x.column("_p").to_numpy()
        kept = chosen(p, x.column("_v").to_numpy(), distance, np.zeros(len(p), bool), np.ones(len(p), bool))
        return x.filter(pa.array(kept > 0)).select([*keys, "_p"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return t.groupBy(*keys, "_stretch").applyInArrow(choose, f"{schema}, _p long").withColumnRenamed("_p", at)


def peaks_by_block(df: DataFrame, col: str, keys: tuple[str, ...] = ("video", "side"), at: str = "frame", distance: int = DISTANCE, block: int = blocks.BLOCK) -> DataFrame:
    """The same peaks, for series that no task should hold: rounds over blocks of positions.

    In each round a block sees the candidates nearer than ``distance`` beyond its ends and decides those that depend on no others. What is still open
    goes to the next round, whose blocks begin in the middle of these, with the peaks near their ends. Only a run of candidates that depend on each other over
    several blocks takes as many rounds. The number of open ones is all that the driver sees.
    """
    block, reach = max(block, 4 * distance), distance - 1
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _p long, _v double, _state int"
    now = scratched(tops(df, col, keys, at, block).select(*keys, "_p", F.col("_v").cast("double"), F.lit(0).alias("_state")), "tops")
    found, shift = [], 0
    while True:
        start = lambda by: F.floor((F.col("_p") + by + shift) / block)
        t = now.withColumn("_block", F.explode(F.sequence(start(-reach), start(reach)))).withColumn("_at", F.col("_p") + shift - F.col("_block") * block)

        def choose(x: pa.Table) -> pa.Table:
            p, own = x.column("_p").to_numpy(), x.column("_at").to_numpy()
            mine = (own >= 0) & (own < block)
            fixed = x.column("_state").to_numpy() > 0
            state = chosen(p, x.column("_v").to_numpy(), distance, fixed, mine)
            edge = (own < reach) | (own >= block - reach)
            state = np.where((state > 0) & edge, 2, state).astype(np.int32)
            out = x.select([*keys, "_p", "_v"]).append_column("_state", pa.array(state))
            return out.filter(pa.array(mine & ~fixed & (state >= 0)))

        now = scratched(t.groupBy(*keys, "_block").applyInArrow(choose, schema), "round")
        found.append(now.filter("_state > 0").select(*keys, F.col("_p").alias(at)))
        if now.filter("_state = 0").isEmpty():
            return reduce(DataFrame.unionByName, found)
        now, shift = now.filter("_state in (0, 2)"), block // 2 - shift


def peak_pairs(peaks_: DataFrame, keys: tuple[str, ...] = ("video", "side"), at: str = "frame") -> DataFrame:
    """Each peak with the next one as ``next_<at>``; the last has none and is left out."""
    w = Window.partitionBy(*keys).orderBy(at)
    return peaks_.withColumn(f"next_{at}", F.lead(at).over(w)).filter(F.col(f"next_{at}").isNotNull())
