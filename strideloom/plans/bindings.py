"""Gait inputs derived from general tables: the same views in SQL are in sql.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideloom.operators.labelling import contact_labels, label_fsm
from strideloom.functions.angles import sigmoid_over
from strideloom.schemas import JOINTS
from strideloom.sources.scratch import scratched

#: Held-out videos.
TEST_VIDEOS = (3, 9, 13, 15)
#: Those of the older flattener.
LEGACY_TEST_VIDEOS = (4, 18, 20, 26, 27)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pose_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight joints from the first 16 components of a vector; a label is a video."""
    order = Window.partitionBy("label").orderBy("vec_id")
    names = [f"{s}_{j}" for j in JOINTS for s in ("left", "right")]
    at = lambda i: F.col("embedding")[i].cast("double")
    points = [F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")).alias(n) for i, n in enumerate(names)]
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video"), (F.row_number().over(order) - 1).cast("long").alias("frame"), *points)


def signal_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series for each side; two users are the sides of a video."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 2).cast("long").alias("video"), F.when(F.col("user_id") % 2 == 0, "L").otherwise("R").alias("side"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("value").alias("ankle_y"),
        ((F.col("event_id") * 37) % 101).cast("double").alias("hip_y"), "event_id", "event_type")


def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys_of(signal_frames(spark, sf_dir))


def keys_of(frames: DataFrame) -> DataFrame:
    key = F.when(F.col("event_type") == "view", "u").when(F.col("event_type") == "purchase", "d")
    strike, over = F.col("event_id") % 5, F.col("event_id") % 3
    return frames.select(
        "video", "side", "frame", key.alias("key"),
        F.when(strike.isin(0, 3), "h").when(strike == 1, "m").when(strike == 2, "f").otherwise("s").alias("strike_key"),
        F.when(over == 0, "o").when(over == 1, "n").otherwise("s").alias("overstride_key"), "event_id")


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strikes_of(label_keys(spark, sf_dir))


def strikes_of(keys: DataFrame) -> DataFrame:
    return label_fsm(keys, ("frame", "event_id"))


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """signal_frames and strikes, worked out once and written: for queries that need them more than once."""
    frames = scratched(signal_frames(spark, sf_dir), "frames")
    return frames, scratched(strikes_of(keys_of(frames)), "strikes")


def contact_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, side, frame, logit, pred, label, mask): a logit for each frame and the truth from contact labelling."""
    frames, found = prepared(spark, sf_dir)
    logit = (F.col("ankle_y") - 50) / 25
    t = frames.select("video", "side", "frame", logit.alias("logit")).join(contact_labels(frames, found), ["video", "side", "frame"])
    return t.withColumns({"pred": sigmoid_over(F.col("logit")), "mask": F.col("label").isNotNull()})


def video_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = signal_frames(spark, sf_dir).groupBy("video").agg((F.max("frame") + 1).alias("frame_count"))
    return frames.select("video", F.lit(30).alias("fps"), "frame_count")


def test_videos(spark: SparkSession, videos: tuple[int, ...] = TEST_VIDEOS) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(v).cast("long") for v in videos))).alias("video"))
