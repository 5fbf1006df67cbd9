"""Per-frame kinematics and the features of a foot strike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strideloom.functions import angles
from strideloom.operators import blocks
from strideloom.schemas import JOINTS, SIDES, STRIKE_METRICS


def series() -> WindowSpec:
    return Window.partitionBy("video", "side").orderBy("frame")


def by_side(pose: DataFrame) -> DataFrame:
    """Pose frames (left_hip.x, ...) to one row a side: shoulder_x, shoulder_y, hip_x, ..."""
    def points(name: str) -> list[Column]:
        return [F.col(f"{name}_{j}.{c}").alias(f"{j}_{c}") for j in JOINTS for c in "xy"]

    sides = F.array(*(F.struct(F.lit(s).alias("side"), *points(name)) for s, name in SIDES.items()))
    return pose.select("video", "frame", F.explode(sides).alias("s")).select("video", "frame", "s.*")


def gradient(x: Column, w: WindowSpec | None = None) -> Column:
    """Slope with unit spacing: central inside, one-sided at the ends; null for a single sample."""
    w = w or series()
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def clamped_lag(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """The value n rows before, or the first."""
    w = w or series()
    return F.coalesce(F.lag(x, n).over(w), F.first(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def approach_angle(w: WindowSpec | None = None) -> Column:
    """Direction of the ankle from three rows before to one row before, clamped at the first row."""
    move = lambda c: clamped_lag(F.col(c), 1, w) - clamped_lag(F.col(c), 3, w)
    return F.atan2(move("ankle_y"), move("ankle_x"))


def frame_kinematics(pose: DataFrame, block: int | None = None) -> DataFrame:
    """All metrics of STRIKE_METRICS at every frame and side, and n, the number of detected frames.

    One shuffle by (video, side) serves all windows; the frames of one recording then meet in a task. With ``block`` they go by blocks of so many
    frames, each with the three frames before and the one after that its metrics reach for.
    """
    xy = [F.col(f"{j}_{c}") for j in ("knee", "ankle") for c in "xy"]
    t = by_side(pose)
    if block:
        t, w = blocks.haloed(blocks.indexed(t, block=block), 3, 1, block), blocks.window()
        place = {"idx": F.col("_i"), "n": F.col("_n")}
    else:
        w = series()
        place = {"idx": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("video", "side"))}
    t = t.withColumns({
        "ankle_x_vel": gradient(F.col("ankle_x"), w), "ankle_y_vel": gradient(F.col("ankle_y"), w),
        "shin_velocity": gradient(F.col("knee_x") - F.col("ankle_x"), w),
        "ankle_approach_angle": approach_angle(w), **place})
    t = t.withColumn("ankle_velocity_pre_strike", clamped_lag(F.col("ankle_y_vel"), 2, w))
    if block:
        t = t.filter("_own").drop("_i", "_n", "_block", "_own")
    return t.withColumns({
        "tibial_angle": angles.tibial_up(*xy),
        "tibial_angle_down": angles.tibial_down(*xy),
        "knee_flexion_angle": angles.knee_flexion(F.col("hip_x"), F.col("hip_y"), *xy),
        "ankle_hip_horizontal_offset": F.abs(F.col("ankle_x") - F.col("hip_x")),
        "trunk_angle": angles.trunk(F.col("shoulder_x"), F.col("shoulder_y"), F.col("hip_x"), F.col("hip_y"))})


def strike_features(strikes: DataFrame, kinematics: DataFrame, clamp: bool = False) -> DataFrame:
    """Strikes with the metrics of their frame.

    Joined on the video's own frame number. ``clamp`` takes the frame as an index into the detected frames instead, bounded by
    the last, and keeps the strike's own side and frame.
    """
    if not clamp:
        return strikes.join(kinematics.select("video", "side", "frame", *STRIKE_METRICS), ["video", "side", "frame"])
    last = kinematics.groupBy("video", "side").agg((F.max("idx")).alias("_last"))
    at = strikes.join(last, ["video", "side"]).withColumn("frame_idx", F.least(F.col("frame"), F.col("_last"))).drop("_last")
    return at.join(kinematics.select("video", "side", F.col("idx").alias("frame_idx"), *STRIKE_METRICS), ["video", "side", "frame_idx"])


def legacy_strike_features(peaks: DataFrame, kinematics: DataFrame, smooth: str = "ankle_y") -> DataFrame:
    """Features at peaks (video, side, frame): the downward tibial angle, and what precedes the strike only from the fourth row on.

    The velocity before the strike is that of ``smooth``, the smoothed ankle height, two rows earlier.
    """
    before = F.lag("_vel", 2).over(series())
    t = kinematics.withColumn("_vel", gradient(F.col(smooth))).withColumn("ankle_velocity_pre_strike", before).select(
        "video", "side", "frame", F.col("tibial_angle_down").alias("tibial_angle"), "knee_flexion_angle", "ankle_hip_horizontal_offset", "trunk_angle",
        *(F.when(F.col("idx") >= 3, F.col(c)).alias(c) for c in ("ankle_velocity_pre_strike", "ankle_approach_angle")))
    return peaks.join(t, ["video", "side", "frame"])
