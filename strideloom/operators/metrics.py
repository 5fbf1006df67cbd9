"""Run metrics: cadence, vertical oscillation, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["video", "side"]
# Usual ranges as published. Cadence has none that holds for all runners: 180 a minute is what elite runners were seen at, no target.
REFERENCES = {"vertical_oscillation_cm": (6.0, 13.0), "steps_per_min": (None, None)}


def duration(videos: DataFrame) -> DataFrame:
    return videos.withColumn("duration", F.col("frame_count") / F.col("fps"))


def cadence(peaks: DataFrame, videos: DataFrame) -> DataFrame:
    """(video, steps, steps_per_sec, steps_per_min) of the peaks of both sides; 0 for a video without peaks."""
    n = peaks.groupBy("video").agg(F.count(F.lit(1)).alias("steps"))
    t = videos.join(n, "video", "left").withColumn("steps", F.coalesce("steps", F.lit(0)))
    per = F.col("steps") / F.col("duration")
    return t.select("video", "steps", per.alias("steps_per_sec"), (per * 60).alias("steps_per_min"))


def vertical_oscillation(frames: DataFrame, peaks: DataFrame, col: str) -> DataFrame:
    """(video, side, peaks, vo, vo_per_pair): greatest less least ``col`` between successive peaks, both included.

    ``vo`` is their sum over the number of peaks, 0 for one peak; ``vo_per_pair`` over the number of pairs, null for one.
    A frame belongs to the interval that its last peak opens, a peak also to the one that it closes, so no range
    join is needed.
    """
    w = Window.partitionBy(*KEYS).orderBy("frame")
    t = frames.select(*KEYS, "frame", F.col(col).alias("y")).join(peaks.select(*KEYS, "frame", F.lit(True).alias("top")), [*KEYS, "frame"], "left")
    last = lambda to: F.max(F.when(F.col("top"), F.col("frame"))).over(w.rowsBetween(Window.unboundedPreceding, to))
    t = t.withColumns({"opened": last(0), "closed": last(-1)})
    starts = F.when(F.col("top"), F.array("opened", "closed")).otherwise(F.array("opened"))
    t = t.select(*KEYS, "y", F.coalesce("top", F.lit(False)).alias("top"), F.explode(starts).alias("start"), "frame").filter("start is not null")
    ranges = t.groupBy(*KEYS, "start").agg((F.max("y") - F.min("y")).alias("span"), F.count_if("top").alias("ends"))
    pair = F.col("ends") == 2
    out = ranges.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("peaks"), F.sum(F.when(pair, F.col("span")).otherwise(0.0)).alias("total"), F.count_if(pair).alias("pairs"))
    return out.select(*KEYS, "peaks", (F.col("total") / F.col("peaks")).alias("vo"), F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).alias("vo_per_pair"))


def mean_oscillation(vo: DataFrame) -> DataFrame:
    """(video, vo): the mean of both sides; null if one has no peak."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("vo")))
    return vo.groupBy("video").agg(((side("L") + side("R")) / 2).alias("vo"))


def centimetres(px, body_px, height_cm):
    """Pixels to centimetres by the runner's height: a scale of our own, as none is given."""
    return px * height_cm / body_px


def referenced(wide: DataFrame, references: dict[str, tuple[float | None, float | None]] = REFERENCES) -> DataFrame:
    """(video, metric, value, low, high, standing): a row for each video and metric, a column of ``wide``, beside its usual range.

    ``standing`` is below, within (both ends included) or above; null where there is no value (NaN counts as none) or no range. A range may have one end.
    """
    number = lambda x: F.lit(x).cast("double")
    one = lambda m, low, high: F.struct(F.lit(m).alias("metric"), F.nanvl(F.col(m).cast("double"), number(None)).alias("value"), number(low).alias("low"), number(high).alias("high"))
    t = wide.select("video", F.explode(F.array(*(one(m, low, high) for m, (low, high) in references.items()))).alias("m")).select("video", "m.*")
    known = F.col("value").isNotNull() & F.coalesce("low", "high").isNotNull()
    standing = F.when(F.col("value") < F.col("low"), "below").when(F.col("value") > F.col("high"), "above").when(known, "within")
    return t.withColumn("standing", standing)


def run_summary(strikes: DataFrame) -> DataFrame:
    """(video, strikes, heel, midfoot, forefoot, overstriding_rate); skipped judgements are not in the rate's denominator."""
    judged = F.when(F.col("overstriding") != "skip", (F.col("overstriding") == "overstriding").cast("double"))
    return strikes.groupBy("video").agg(
        F.count(F.lit(1)).alias("strikes"), *(F.count_if(F.col("strike_pattern") == p).alias(p) for p in ("heel", "midfoot", "forefoot")),
        F.avg(judged).alias("overstriding_rate"))


def frames_by_video(strikes: DataFrame, position: str) -> DataFrame:
    """(video, frames): each video's strike frames in order of ``position``, their place in the store."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), "frame")))
    return strikes.groupBy("video").agg(F.transform(rows, lambda r: r["frame"]).alias("frames"))


def sorted_frames(strikes: DataFrame) -> DataFrame:
    """(video, frames): the union of both sides' strike frames, each once, ascending."""
    return strikes.groupBy("video").agg(F.array_sort(F.collect_set("frame")).alias("frames"))


def counts(frames: DataFrame, strikes: DataFrame) -> DataFrame:
    """(video, frames, strikes): detected frames of both sides and labelled strikes."""
    f = frames.groupBy("video").agg(F.count(F.lit(1)).alias("frames"))
    s = strikes.groupBy("video").agg(F.count(F.lit(1)).alias("strikes"))
    return f.join(s, "video", "left").withColumn("strikes", F.coalesce("strikes", F.lit(0)))


def resampled(window: DataFrame, cols: list[str], steps: int = 12) -> DataFrame:
    """strike_window's rows to ``steps`` of each strike: (video, side, strike_frame, t, cols), linear between the frames that are there.

    The method is ours, as only the length is given.
    """
    keys = [*KEYS, "strike_frame"]
    t = window.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", *cols))).alias("w"))
    t = t.select(*keys, "w", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"))
    t = t.withColumn("x", F.col("t") * (F.size("w") - 1) / (steps - 1)).withColumn("lo", F.floor("x").cast("int"))
    at = lambda i, c: F.get("w", i).getField(c)
    hi = F.least(F.col("lo") + 1, F.size("w") - 1)
    return t.select(*keys, "t", *((at(F.col("lo"), c) + (F.col("x") - F.col("lo")) * (at(hi, c) - at(F.col("lo"), c))).alias(c) for c in cols))


def strike_window(frames: DataFrame, strikes: DataFrame, cols: list[str], before: int = 8, after: int = 4) -> DataFrame:
    """The ``before`` frames up to each strike and ``after`` from it on, as far as there are: (video, side, strike_frame, step, cols)."""
    at = strikes.select(*KEYS, F.col("frame").alias("strike_frame"))
    steps = at.withColumn("step", F.explode(F.sequence(F.lit(-before), F.lit(after - 1)))).withColumn("frame", F.col("strike_frame") + F.col("step"))
    return steps.join(frames.select(*KEYS, "frame", *cols), [*KEYS, "frame"]).drop("frame")
