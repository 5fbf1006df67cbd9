"""Queries of readers, writers and the stream: each writes a store to the scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideloom.functions.labels import side
from strideloom.ml import contact_lstm, forward
from strideloom.operators import labelling, metrics
from strideloom.plans import bindings as b
from strideloom.plans.learned import fixed_network
from strideloom.plans.queries import FEATURES, ID, QUERIES, features, rounded
from strideloom.schemas import FRAMES, STRIKES
from strideloom.sources import stores
from strideloom.sources.scratch import scratch, scratched
from strideloom.streaming.event_time import contact_events, cycle_events, label_events, state_store
from strideloom.streaming.labels import label_stream

STRIKE = [*ID, "strike_pattern", "overstriding", "u_frame"]


def _named(spark, d) -> DataFrame:
    """Strikes as the annotation tool stores them: left and right, video names, int frames; metrics not yet there."""
    name = F.when(F.col("side") == "L", "left").otherwise("right")
    t = b.strikes(spark, d).withColumns({"side": name, "video": F.col("video").cast("string")})
    return t.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in t.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STRIKES.fields))


def read_strikes(spark, d):
    path = scratch(spark, "strikes")
    _named(spark, d).write.json(path)
    return stores.strikes(spark, path, lines=True).select(*STRIKE)


def side_names(spark, d):
    """Frames by side, as stored and recoded."""
    t = _named(spark, d).select(F.col("side").alias("stored"))
    return t.groupBy("stored", side(F.col("stored")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


def read_missing(spark, d):
    """Rows of a store that is not there, and of one that is."""
    path = scratch(spark, "strikes")
    count = lambda: F.lit(stores.read_or_empty(spark, path, STRIKES, lines=True).count()).cast("long")
    none = count()
    _named(spark, d).write.json(path)
    return spark.range(1).select(none.alias("before"), count().alias("after"))


#: Bytes of a range in the queries that split files: the stores at hand are short.
SHORT_RANGE = 1 << 18


def read_frame_tables(spark, d, range_bytes=None):
    """Tables by video, some of whose rows lack a value."""
    t = features(spark, d).select(F.col("video").cast("string"), F.col("frame").cast("int"), F.when(F.col("side") == "L", "left").otherwise("right").alias("side"),
                                  F.col("ankle_y_vel").alias("ankle_x_vel"), F.col("hip_y").alias("tibial_angle"), F.col("ankle_y").alias("shin_velocity"),
                                  F.when(F.col("frame") % 5 > 0, F.col("hip_y_vel")).alias("ankle_y_vel"))
    path = scratch(spark, "tables")
    rows = t.groupBy("video").agg(F.collect_list(F.struct(*(f.name for f in FRAMES.fields))).alias("rows"))
    rows.select(F.to_json(F.create_map("video", "rows"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return rounded(stores.frame_tables(spark, path, True, range_bytes), "ankle_x_vel", "tibial_angle", "shin_velocity", "ankle_y_vel")


def split_frame_tables(spark, d):
    """read_frame_tables, each file read by ranges of bytes."""
    return read_frame_tables(spark, d, SHORT_RANGE)


def read_legacy_frames(spark, d, range_bytes=None):
    """The nested store, written and flattened again."""
    path = scratch(spark, "legacy")
    stores.write_legacy(labelling.legacy_store(features(spark, d), labelling.legacy_cycles(b.label_keys(spark, d)), FEATURES), path)
    t = stores.legacy_frames(spark, path, True, range_bytes).select(F.col("video").cast("long").alias("video"), "frame", "side", F.explode("features").alias("name", "value"))
    return rounded(t, "value")


def split_legacy_frames(spark, d):
    """read_legacy_frames, each file read by ranges of bytes."""
    return read_legacy_frames(spark, d, SHORT_RANGE)


def legacy_round_trip(spark, d):
    """The nested store of awkward rows: names with quotes and backslashes, null values, rows that are there twice."""
    t = b.signal_frames(spark, d).select(
        F.concat(F.lit('q"v\\'), F.col("video").cast("string")).alias("video"), "frame", F.concat(F.lit("s'"), "side").alias("side"),
        F.explode(F.array(F.struct(F.lit('a"b').alias("name"), F.when(F.col("frame") % 5 > 0, F.col("ankle_y")).alias("value")), F.struct(F.lit("é, [n]").alias("name"), F.col("hip_y").alias("value")))).alias("p"))
    t = t.select("video", "frame", "side", "p.*")
    path = scratch(spark, "awkward")
    stores.write_legacy(t.unionByName(t.filter("frame % 3 = 0")), path)
    return stores.legacy_frames(spark, path, lines=True).select("video", "frame", "side", F.explode("features").alias("name", "value"))


def pose_ingest(spark, d):
    """Detections of 17 keypoints, none in every seventh frame and two persons in others, to eight joints and a dense index."""
    x = lambda start: F.transform(F.sequence(F.lit(start), F.lit(start + 16)), lambda i: F.struct(
        F.get("embedding", i).cast("double").alias("x"), F.get("embedding", i + 17).cast("double").alias("y")))
    persons = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(F.array(x(0), x(20)))
    t = b.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("video"), F.col("vec_id").cast("int").alias("frame"), persons.alias("persons"))
    path = scratch(spark, "detections")
    t.write.parquet(path)
    out = stores.pose_frames(spark.read.parquet(path))
    joints = [f"{s}_{j}" for j in stores.KEYPOINTS for s in ("left", "right")]
    return rounded(out.select("video", "frame", "idx", *(F.col(f"{j}.{c}").alias(f"{j}_{c}") for j in joints for c in "xy")), *(f"{j}_{c}" for j in joints for c in "xy"))


def video_paths(spark, d):
    """Files by extension: .MOV for videos 0, 3, ..., both for 1, 4, ..., none for the others."""
    v = b.video_meta(spark, d).select(F.col("video").cast("string").alias("video"))
    kind = F.col("video").cast("long") % 3
    named = lambda e: F.concat(F.lit("runs/"), F.col("video"), F.lit(e))
    files = v.filter(kind < 2).select(named(".MOV").alias("path")).unionByName(v.filter(kind == 1).select(named(".mp4").alias("path")))
    return stores.video_paths(v, files, "runs")


def _counted(t: DataFrame) -> DataFrame:
    return t.groupBy(F.col("video").cast("long").alias("video")).agg(F.count(F.lit(1)).alias("n"))


def append_twice(spark, d):
    """Strikes by video after two appends: each is there twice."""
    path = scratch(spark, "appended")
    for _ in range(2):
        stores.append(_named(spark, d), path)
    return _counted(spark.read.json(path))


def replace_twice(spark, d):
    """Strikes by video after a rerun and a run of some videos: each is there once."""
    path, t = scratch(spark, "replaced"), _named(spark, d)
    for part in (t, t, t.filter(F.col("video").cast("long") % 2 == 0)):
        stores.replace_videos(part, path)
    return _counted(spark.read.parquet(path))


def overwrite_meta(spark, d):
    """Video metadata, overwritten."""
    path, t = scratch(spark, "meta"), b.video_meta(spark, d)
    stores.overwrite(t, path)
    stores.overwrite(t.filter("video % 2 = 0"), path)
    return spark.read.schema("video long, fps int, frame_count long").json(path)


def relabel_store(spark, d):
    """Two sessions' relabels, and the label that counts for each frame."""
    path, t = scratch(spark, "relabels"), b.label_keys(spark, d).filter(F.col("event_id") % 7 == 0)
    t = t.select(F.col("video").cast("string"), F.col("frame").cast("int"), F.when(F.col("side") == "L", "o").otherwise("n").alias("label"), (F.col("event_id") % 2).alias("run"))
    for run in (0, 1):
        stores.append_relabels(t.filter(F.col("run") == run), path, run)
    got = stores.relabels(spark, path)
    return got.groupBy(F.col("video").cast("long").alias("video"), "frame").agg(F.max_by("label", F.struct("run", "label")).alias("label"), F.count(F.lit(1)).alias("n"))


def lines_of_two_runs(spark, d):
    """Cadence results appended by two runs as JSON lines."""
    path, t = scratch(spark, "lines"), QUERIES["cadence"](spark, d)
    for _ in range(2):
        stores.append_lines(t, path)
    return spark.read.schema(t.schema).json(path)


def report_store(spark, d):
    """Each video's report as a JSON document, read back."""
    parts = QUERIES["run_summary"](spark, d).join(QUERIES["cadence"](spark, d), "video").join(QUERIES["mean_oscillation"](spark, d), "video", "left")
    path = scratch(spark, "reports")
    stores.report(parts, "video").select("json").write.text(path)
    return spark.read.text(path).select(F.from_json("value", parts.schema).alias("r")).select("r.*")


def video_store(spark, d):
    """Duration from stored metadata of width, height and rate."""
    t = b.video_meta(spark, d).select(F.col("video").cast("string").alias("Video"), F.lit(1280.0).alias("Width"), F.lit(720.0).alias("Height"), F.col("fps").cast("double").alias("FPS"), "frame_count")
    path = scratch(spark, "videos")
    stores.overwrite(t, path)
    back = spark.read.schema(t.schema).json(path)
    return rounded(metrics.duration(back.select(F.col("Video").cast("long").alias("video"), F.col("FPS").alias("fps"), "frame_count")), "duration")


def weights_store(spark, d):
    """Logits of all cycles by a network whose weights were saved and loaded."""
    path = scratch(spark, "weights")
    contact_lstm.save(spark, fixed_network(), path)
    return rounded(forward.logits(QUERIES["cycle_tensor"](spark, d), contact_lstm.load(spark, path), FEATURES), "logit").drop("mask")


def streamed_labels(spark, d):
    """Strikes by the state machine over a stream of the keys."""
    source, sink, place = (scratch(spark, x) for x in ("keys", "strikes", "progress"))
    keys = b.label_keys(spark, d).select(*ID, "key", "strike_key", "overstride_key")
    keys.write.parquet(source)
    stream = label_stream(spark.readStream.schema(keys.schema).parquet(source))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


#: Batches of keys in the event-time queries.
BATCHES = 4


def _event_time_strikes(spark, d) -> DataFrame:
    """Strikes of a stream whose keys come up to a quarter of the log's time after they were pressed."""
    source, sink, place = (scratch(spark, x) for x in ("arrivals", "strikes", "progress"))
    times = b.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    keys = b.label_keys(spark, d).join(times, "event_id").withColumnRenamed("event_id", "ord")
    us = F.unix_micros("at")
    start, end = times.agg(F.min(us), F.max(us)).first()
    if start is None:
        start = end = 0
    delay = (end - start) // BATCHES + 1
    step = (end - start + delay) // BATCHES + 1
    arrival = F.floor((us - F.lit(start) + F.pmod(F.xxhash64("ord"), F.lit(delay))) / step)
    columns = [*ID, "ord", "at", "key", "strike_key", "overstride_key"]
    keys = scratched(keys.withColumn("batch", arrival).select(*columns, "batch"), "batches")
    # a last row, of no series, moves the watermark past all keys
    closing = F.timestamp_micros(F.lit(end + 2 * delay))
    last = spark.range(1).select(*(closing.alias(c) if c == "at" else F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in columns))
    place_of = lambda i: f"{source}/{i:03}"
    out = None
    with state_store(spark):
        for i in range(BATCHES + 1):
            (keys.filter(F.col("batch") == i).select(*columns) if i < BATCHES else last).write.parquet(place_of(i))
            arrived = spark.readStream.schema(keys.select(*columns).schema).parquet(f"{source}/*")
            out = label_events(arrived, f"{delay} microseconds")
            out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def event_time_strikes(spark, d):
    """Strikes with the strike before, from keys out of order."""
    return _event_time_strikes(spark, d).filter("u_frame is not null")


def event_time_cycles(spark, d):
    """gait_cycles of that stream."""
    return cycle_events(_event_time_strikes(spark, d), labelling.SHORTEST, labelling.LONGEST)


def event_time_contacts(spark, d):
    """Intervals of contact and swing of that stream."""
    return contact_events(_event_time_strikes(spark, d))


STORE_QUERIES = {f.__name__: f for f in (
    read_strikes, side_names, read_missing, read_frame_tables, read_legacy_frames, split_frame_tables, split_legacy_frames, legacy_round_trip, pose_ingest, video_paths, append_twice, replace_twice, overwrite_meta,
    relabel_store, lines_of_two_runs, report_store, video_store, weights_store, streamed_labels, event_time_strikes, event_time_cycles, event_time_contacts)}
