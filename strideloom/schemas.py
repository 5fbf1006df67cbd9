"""Declared schemas of the stores; JSON inference depends on the data and reorders fields."""

from __future__ import annotations

from pyspark.sql import types as T

JOINTS = ("shoulder", "hip", "knee", "ankle")
SIDES = {"L": "left", "R": "right"}
STRIKE_METRICS = (
    "ankle_x_vel", "ankle_y_vel", "shin_velocity", "tibial_angle", "knee_flexion_angle",
    "ankle_hip_horizontal_offset", "trunk_angle", "ankle_velocity_pre_strike", "ankle_approach_angle")
FRAME_METRICS = ("ankle_x_vel", "tibial_angle", "shin_velocity", "ankle_y_vel")

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PERSONS = T.StructType([
    T.StructField("video", T.StringType()), T.StructField("frame", T.IntegerType()),
    T.StructField("persons", T.ArrayType(T.ArrayType(POINT)))])
STRIKES = T.StructType([
    T.StructField("frame", T.IntegerType()), T.StructField("side", T.StringType()), T.StructField("strike_pattern", T.StringType()),
    T.StructField("overstriding", T.StringType()), T.StructField("u_frame", T.IntegerType()), T.StructField("video", T.StringType()),
    *(T.StructField(m, T.DoubleType()) for m in STRIKE_METRICS)])
FRAMES = T.StructType([
    T.StructField("video", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("side", T.StringType()),
    *(T.StructField(m, T.DoubleType()) for m in FRAME_METRICS)])
RELABELS = T.StructType([T.StructField("video", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("label", T.StringType())])
VIDEO_META = T.StructType([T.StructField("Video", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("Width", "Height", "FPS"))])
