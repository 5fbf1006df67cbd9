"""Foot strikes from annotation keys, gait cycles between them, and contact labels of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strideloom.functions import labels
from strideloom.operators import blocks
from strideloom.operators.ranges import range_join

KEYS = ["video", "side"]
#: Shortest and longest duration of a cycle: quartiles 19 and 27 less and plus 1.5 interquartile ranges.
Q1, Q3 = 19, 27
SHORTEST, LONGEST = max(1, Q1 - 3 * (Q3 - Q1) // 2), Q3 + 3 * (Q3 - Q1) // 2
STEPS = 40


def series(order: tuple[str, ...] = ("frame",)) -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy(*order)


def _before(df: DataFrame, values: dict[str, Column], order: tuple[str, ...], how: str, block: int | None) -> DataFrame:
    """df with the max or sum of each value over the rows of the series before, by a window or by blocks."""
    if block:
        return blocks.carried(df, values, tuple(KEYS), order, how, block)
    upto = series(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return df.withColumns({k: F.max(v).over(upto) if how == "max" else F.coalesce(F.sum(v).over(upto), zero) for k, v in values.items()})


def label_fsm(keys: DataFrame, order: tuple[str, ...] = ("frame",), block: int | None = None) -> DataFrame:
    """label_keys (video, side, frame, key, strike_key, overstride_key) to strikes.

    u notes the toe-off frame, a later one replaces it; d ends the swing and resets it, and makes a strike if its strike
    key is h, m or f; c ends the series. So the last u since the last d counts, over all d, kept or not. ``order`` says which of
    several keys at one frame came first (frame and an ordinal). With ``block`` a series goes by blocks of so many frames, and only the last u, d and c
    of each pass to the next.
    """
    place = F.struct(*order)
    last = {f"_{k}": F.when(F.col("key") == k, place) for k in "udc"}
    t = _before(keys, last, order, "max", block).filter("key = 'd' and _c is null")
    t = t.withColumn("u_frame", F.when(F.col("_d").isNull() | (F.col("_u") > F.col("_d")), F.col("_u.frame")))
    t = t.withColumns({"strike_pattern": labels.strike_pattern(F.col("strike_key")), "overstriding": labels.overstriding(F.col("overstride_key"))})
    return t.filter("strike_pattern is not null").select(*KEYS, "frame", "strike_pattern", "overstriding", "u_frame")


def legacy_cycles(keys: DataFrame, order: tuple[str, ...] = ("frame",), block: int | None = None) -> DataFrame:
    """Cycles (video, side, u_frame, frame) that hold exactly one u before their d; others are left out. ``order`` and ``block`` as in label_fsm."""
    t = _before(keys.filter("key in ('u', 'd')"), {"_g": (F.col("key") == "d").cast("int")}, order, "sum", block)
    t = t.groupBy(*KEYS, "_g").agg(
        F.count_if(F.col("key") == "u").alias("us"), F.max(F.when(F.col("key") == "u", F.col("frame"))).alias("u_frame"),
        F.max(F.when(F.col("key") == "d", F.col("frame"))).alias("frame"))
    return t.filter("us = 1 and frame is not null").select(*KEYS, "u_frame", "frame")


def prev_strike(strikes: DataFrame, block: int | None = None) -> DataFrame:
    """strikes with ``prev_frame``, the last strike of a strictly smaller frame: equal frames do not precede each other.

    With ``block`` the distinct frames of a series go by blocks, and the last one of each passes to the next.
    """
    if not block:
        return strikes.withColumn("prev_frame", F.max("frame").over(series().rangeBetween(Window.unboundedPreceding, -1)))
    frames = blocks.carried(strikes.select(*KEYS, "frame").distinct(), {"prev_frame": F.col("frame")}, tuple(KEYS), block=block)
    return strikes.join(frames, [*KEYS, "frame"])


def labelled(strikes: DataFrame) -> DataFrame:
    """Strikes without nulls: those with a toe-off frame."""
    return strikes.na.drop("any")


def gait_cycles(strikes: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, block: int | None = None) -> DataFrame:
    """(video, side, start_frame, u_frame, end_frame) from each strike's predecessor to the frame before it, of usual duration."""
    t = prev_strike(labelled(strikes), block).filter("prev_frame is not null")
    t = t.select(*KEYS, F.col("prev_frame").alias("start_frame"), "u_frame", (F.col("frame") - 1).alias("end_frame"))
    return t.filter(F.col("end_frame") >= F.col("start_frame")).filter((F.col("end_frame") - F.col("start_frame")).between(shortest, longest))


def durations(strikes: DataFrame) -> DataFrame:
    """(video, side, duration) of all cycles, usual or not: frames from a strike to the frame before the next."""
    t = prev_strike(labelled(strikes)).filter("prev_frame is not null")
    return t.select(*KEYS, (F.col("frame") - 1 - F.col("prev_frame")).alias("duration"))


def duration_limits(cycles: DataFrame, by: list[str], k: int = 4096) -> DataFrame:
    """by, cycles, q1, q3, shortest, longest: fences of 1.5 interquartile ranges about the quartiles of ``duration``, at least 1, in one pass.

    Quartiles come from a mergeable sketch of ``k``: values of rank within about 1/k of a quarter, and exact for up to k cycles of a group. So a group of any size
    is a sketch to whoever merges it.
    """
    t = cycles.groupBy(*by).agg(F.count(F.lit(1)).alias("cycles"), F.kll_sketch_agg_bigint(F.col("duration").cast("long"), k).alias("sketch"))
    t = t.withColumns({q: F.kll_sketch_get_quantile_bigint("sketch", F.lit(x)) for q, x in (("q1", 0.25), ("q3", 0.75))})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return t.select(*by, "cycles", "q1", "q3", F.greatest(F.lit(1.0), F.col("q1") - reach).alias("shortest"), (F.col("q3") + reach).alias("longest"))


def contact_intervals(strikes: DataFrame, block: int | None = None) -> DataFrame:
    """(video, side, lo, hi, label, seq): 0 from toe-off to strike, 1 from the strike before to toe-off; a later seq, the strike's frame and the label, overwrites."""
    t = prev_strike(labelled(strikes), block)
    span = lambda lo, hi, label: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit(label).alias("label"), F.struct(F.col("frame"), F.lit(label)).alias("seq"))
    both = F.array(span("u_frame", "frame", 0), span("prev_frame", "u_frame", 1))
    return t.select(*KEYS, F.explode(both).alias("i")).select(*KEYS, "i.*").filter("lo is not null")


def contact_labels(frames: DataFrame, strikes: DataFrame, block: int | None = None) -> DataFrame:
    """(video, side, frame, label) of each distinct frame: 1 in contact, 0 not, null where no interval reaches; the last writer wins."""
    points = frames.select(*KEYS, "frame").distinct()
    t = range_join(points, contact_intervals(strikes, block), KEYS, "frame", "lo", "hi", "left")
    return t.groupBy(*KEYS, "frame").agg(F.max_by("label", "seq").cast("int").alias("label"))


def cycle_frames(frames: DataFrame, cycles: DataFrame) -> DataFrame:
    """Frames of each cycle, both ends included; frames with start_frame, u_frame, end_frame."""
    return range_join(frames, cycles.withColumn("_after", F.col("end_frame") + 1), KEYS, "frame", "start_frame", "_after").drop("_after")


def padded(frames: DataFrame, features: list[str], steps: int = STEPS) -> DataFrame:
    """Cycle frames (with ``label``) to ``steps`` rows a cycle (video, side, start_frame, t, features, label, mask), padded in front with zeros, -1 and false.

    Duplicate frames of a cycle count once, the one of least features; a cycle of more frames is an error.
    """
    one = frames.groupBy(*KEYS, "start_frame", "frame").agg(F.min(F.struct(*features, "label")).alias("r"))
    rows = one.groupBy(*KEYS, "start_frame").agg(F.array_sort(F.collect_list(F.struct("frame", F.col("r.*")))).alias("rows"))
    rows = rows.withColumn("_n", F.when(F.size("rows") <= steps, F.size("rows")).otherwise(F.raise_error(F.lit(f"a cycle has more than {steps} frames")).cast("int")))
    t = rows.select(*KEYS, "start_frame", "_n", "rows", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"))
    row = F.get("rows", F.col("t") - steps + F.col("_n"))
    real = F.col("t") >= steps - F.col("_n")
    values = [F.when(real, row.getField(f)).otherwise(F.lit(0.0)).alias(f) for f in features]
    return t.select(*KEYS, "start_frame", "t", *values, F.when(real, row.getField("label")).otherwise(-1).cast("int").alias("label"), real.alias("mask"))


def relabelled(strikes: DataFrame, relabels: DataFrame) -> DataFrame:
    """strikes with ``overstriding`` replaced by the last relabel of their (video, frame): relabels(video, frame, label, ord)."""
    new = relabels.groupBy("video", "frame").agg(F.max_by("label", "ord").alias("_key"))
    t = strikes.join(new, ["video", "frame"], "left")
    return t.withColumn("overstriding", F.when(F.col("_key").isNull(), F.col("overstriding")).otherwise(labels.overstriding(F.col("_key")))).drop("_key")


def legacy_store(frames: DataFrame, cycles: DataFrame, metrics: list[str]) -> DataFrame:
    """Frames at which a cycle strikes, with their metrics as name and value pairs; L wins where both sides do."""
    at = cycles.select("video", "frame", "side")
    one = at.groupBy("video", "frame").agg(F.min("side").alias("side"))
    pairs = F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).alias("value")) for m in metrics))
    return frames.join(one, ["video", "side", "frame"]).select("video", "frame", "side", F.explode(pairs).alias("p")).select("video", "frame", "side", "p.*")
