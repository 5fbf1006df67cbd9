"""Readers and writers of the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from strideloom.functions.labels import side
from strideloom.schemas import FRAMES, RELABELS, STRIKES
from strideloom.sources.split_json import json_entries

#: Indices of the joints in a person's 17 keypoints.
KEYPOINTS = {"shoulder": (5, 6), "hip": (11, 12), "knee": (13, 14), "ankle": (15, 16)}
EXTENSIONS = (".mp4", ".MOV")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """JSON arrays of records, or with ``lines`` a record a line; no rows if nothing is there."""
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def strikes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Strikes with side as L or R."""
    return read_or_empty(spark, path, STRIKES, lines).withColumn("side", side(F.col("side")))


def frame_tables(spark: SparkSession, path: str, lines: bool = False, range_bytes: int | None = None) -> DataFrame:
    """JSON objects of video to table, each file one or with ``lines`` each line: the union of the tables, rows with nulls or NaN dropped, side as L or R.

    With ``range_bytes`` objects of any length, one or more a file, are read by a task for each range of so many bytes.
    """
    if range_bytes:
        rows = json_entries(spark, path, 2, range_bytes).select(F.from_json("value", FRAMES).alias("r")).select("r.*")
    else:
        kind = T.MapType(T.StringType(), T.ArrayType(FRAMES))
        whole = spark.read.text(path, wholetext=not lines).select(F.from_json("value", kind).alias("m"))
        rows = whole.select(F.explode("m").alias("k", "rows")).select(F.inline("rows"))
    return rows.na.drop("any").withColumn("side", side(F.col("side")))


def legacy_frames(spark: SparkSession, path: str, lines: bool = False, range_bytes: int | None = None) -> DataFrame:
    """Objects of video to frame to [[name, value], ..., side], each file one or with ``lines`` each line: (video, frame, side, features: map of name to value).

    Lists of pairs and a name are read as variants. A value may be null; of a name that a frame has twice the later counts. ``range_bytes`` as in frame_tables:
    no task then needs all frames of a video.
    """
    if range_bytes:
        t = json_entries(spark, path, 2, range_bytes).select(F.col("keys")[0].alias("video"), F.col("keys")[1].alias("key"), F.parse_json("value").alias("value"))
    else:
        rows = spark.read.text(path, wholetext=not lines).select(F.parse_json("value").alias("v"))
        videos = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("key").alias("video"), F.col("value").alias("frames"))
        t = videos.lateralJoin(spark.tvf.variant_explode(F.col("frames").outer())).select("video", "key", "value")
    frames = t.select("video", F.col("key").cast("int").alias("frame"), F.col("value").cast("array<variant>").alias("entry"))
    read = lambda v: F.struct(F.variant_get(v, "$[0]", "string").alias("name"), F.variant_get(v, "$[1]", "double").alias("value"))
    pairs = F.transform(F.slice("entry", 1, F.size("entry") - 1), read)
    later = lambda i: F.slice("pairs", i + 2, F.size("pairs"))
    last = F.filter("pairs", lambda p, i: ~F.exists(later(i), lambda q: q["name"] == p["name"]))
    t = frames.select("video", "frame", F.variant_get(F.element_at("entry", -1), "$", "string").alias("side"), pairs.alias("pairs"))
    return t.select("video", "frame", "side", F.map_from_entries(last).alias("features"))


def pose_frames(detections: DataFrame) -> DataFrame:
    """(video, frame, persons) to the eight joints of the first person, frames without one left out; ``idx`` numbers those kept."""
    person = F.element_at("persons", 1)
    joints = [F.get(person, F.lit(i)).alias(f"{s}_{j}") for j, pair in KEYPOINTS.items() for s, i in zip(("left", "right"), pair)]
    t = detections.filter(F.size("persons") > 0).select("video", "frame", *joints)
    return t.withColumn("idx", (F.row_number().over(Window.partitionBy("video").orderBy("frame")) - 1).cast("int"))


def video_paths(videos: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """videos with ``path``: folder/name and the first of EXTENSIONS that files(path) has, else null. One row for each distinct video."""
    wanted = videos.select("video").distinct().select("video", F.posexplode(F.array(*map(F.lit, EXTENSIONS))).alias("pos", "extension"))
    wanted = wanted.withColumn("path", F.concat(F.lit(folder + "/"), "video", "extension"))
    found = wanted.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    return found.groupBy("video").agg(F.min_by(F.when(F.col("there"), F.col("path")), F.when(F.col("there"), F.col("pos"))).alias("path"))


def append(df: DataFrame, path: str, by: str = "video") -> None:
    """Add rows; a rerun adds them again."""
    df.write.mode("append").partitionBy(by).json(path)


def replace_videos(df: DataFrame, path: str, by: str = "video") -> None:
    """Write df's videos anew and leave others: a rerun changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, so that the result of several runs is still readable."""
    df.write.mode("append").json(path)


def write_legacy(rows: DataFrame, path: str) -> None:
    """Rows (video, frame, side, name, value) in the nested form that legacy_frames reads, a video a line.

    Null values, repeated rows and names of any characters are kept. The form has one side for each frame: where rows have two, the lesser, as in ``legacy_store``.
    A line holds a video's frames, as the form asks.
    """
    pairs = rows.groupBy("video", "frame", "side").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("pairs"))
    frames = pairs.groupBy("video", "frame").agg(F.min(F.struct("side", "pairs")).alias("one"))
    variant = lambda c: c.cast("variant")
    pair = F.transform("one.pairs", lambda p: variant(F.array(variant(p["name"]), variant(p["value"]))))
    entry = F.struct(F.col("frame").cast("string"), F.array_append(pair, variant(F.col("one.side"))))
    videos = frames.groupBy("video").agg(F.map_from_entries(F.collect_list(entry)).alias("frames"))
    videos.select(F.to_json(F.create_map(F.col("video").cast("string"), "frames"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append_relabels(df: DataFrame, path: str, run: int) -> None:
    """Add one session's relabels (video, frame, label); a later run's label counts before an earlier one's."""
    df.select("video", "frame", "label").withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(path)


def relabels(spark: SparkSession, path: str) -> DataFrame:
    """All sessions' relabels with their ``run``; no rows if nothing is there."""
    return read_or_empty(spark, path, T.StructType([*RELABELS.fields, T.StructField("run", T.IntegerType())]), lines=True)


def report(df: DataFrame, key: str) -> DataFrame:
    """key and ``json``: each row as one JSON document."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))
