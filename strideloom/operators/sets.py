"""Unions, distinct values, and the split by video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strike_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides' strikes as a bag; order by frame and side where order is shown."""
    return left.unionByName(right)


def strike_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (video, frame) of either side."""
    return left.select("video", "frame").union(right.select("video", "frame")).distinct()


def videos(df: DataFrame) -> DataFrame:
    return df.select("video").distinct()


def test_split(df: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of the test videos."""
    return df.join(test.select("video").distinct(), "video", "left_semi")


def train_split(df: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of all other videos."""
    return df.join(test.select("video").distinct(), "video", "left_anti")


def with_video_order(df: DataFrame, position: str) -> DataFrame:
    """df with ``video_ord``: the first position at which its video appears; sort by it, side and frame."""
    first = df.groupBy("video").agg(F.min(position).alias("video_ord"))
    return df.join(first, "video")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))
