"""One query for each operator, over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideloom.operators import evaluation, kinematics, labelling, loader, metrics, normalize, sets, signal
from strideloom.plans import bindings as b
from strideloom.schemas import STRIKE_METRICS

DIGITS = 6
FEATURES = ["ankle_y", "hip_y", "ankle_y_vel", "hip_y_vel"]
ID = ["video", "side", "frame"]


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


def features(spark: SparkSession, d: str, frames: DataFrame | None = None) -> DataFrame:
    """Signal frames with their velocities."""
    frames = b.signal_frames(spark, d) if frames is None else frames
    return frames.select(*ID, "ankle_y", "hip_y", kinematics.gradient(F.col("ankle_y")).alias("ankle_y_vel"), kinematics.gradient(F.col("hip_y")).alias("hip_y_vel"))


def label_fsm(spark, d):
    return b.strikes(spark, d)


def legacy_cycles(spark, d):
    return labelling.legacy_cycles(b.label_keys(spark, d))


def prev_strike(spark, d):
    return labelling.prev_strike(labelling.labelled(b.strikes(spark, d))).select(*ID, "u_frame", "prev_frame")


def gait_cycles(spark, d):
    return labelling.gait_cycles(b.strikes(spark, d))


def contact_labels(spark, d):
    return labelling.contact_labels(b.signal_frames(spark, d), b.strikes(spark, d))


def cycle_slices(spark, d):
    return labelling.cycle_frames(b.signal_frames(spark, d).select(*ID, "ankle_y", "hip_y"), labelling.gait_cycles(b.strikes(spark, d)))


def zscore_frames(spark, d):
    return rounded(normalize.zscore(features(spark, d), FEATURES), *FEATURES)


def cycle_tensor(spark, d):
    """The whole preparation: keys to strikes to cycles, labelled standardised frames, padded to 40 steps."""
    signals, strikes = b.prepared(spark, d)
    frames = normalize.zscore(features(spark, d, signals), FEATURES).join(labelling.contact_labels(signals, strikes), ID)
    cut = labelling.cycle_frames(frames, labelling.gait_cycles(strikes))
    return rounded(labelling.padded(cut, FEATURES), *FEATURES)


def relabel_apply(spark, d):
    keys = b.label_keys(spark, d)
    new = keys.filter(F.col("event_id") % 7 == 0).select("video", "frame", F.when(F.col("event_id") % 2 == 0, "o").otherwise("n").alias("label"), F.col("event_id").alias("ord"))
    return labelling.relabelled(b.strikes(spark, d), new)


def legacy_store(spark, d):
    frames = features(spark, d)
    return rounded(labelling.legacy_store(frames, labelling.legacy_cycles(b.label_keys(spark, d)), FEATURES), "value")


def frame_kinematics(spark, d):
    cols = [*STRIKE_METRICS, "tibial_angle_down"]
    return rounded(kinematics.frame_kinematics(b.pose_frames(spark, d)).select(*ID, *cols), *cols)


def _metric(name):
    def query(spark, d):
        return rounded(kinematics.frame_kinematics(b.pose_frames(spark, d)).select(*ID, name), name)
    return query


def gradient(spark, d):
    return features(spark, d).select(*ID, "ankle_y_vel", "hip_y_vel")


def strike_features(spark, d):
    t = kinematics.strike_features(b.strikes(spark, d), kinematics.frame_kinematics(b.pose_frames(spark, d)))
    return rounded(t.select(*ID, "strike_pattern", "overstriding", "u_frame", *STRIKE_METRICS), *STRIKE_METRICS)


def strike_features_clamped(spark, d):
    t = kinematics.strike_features(b.strikes(spark, d), kinematics.frame_kinematics(b.pose_frames(spark, d)), clamp=True)
    return rounded(t.select(*ID, "frame_idx", *STRIKE_METRICS), *STRIKE_METRICS)


def legacy_strike_features(spark, d):
    frames = signal.savgol(kinematics.frame_kinematics(b.pose_frames(spark, d)), "ankle_y", "smooth")
    found = signal.peaks(rounded(frames.select(*ID, "smooth"), "smooth"), "smooth")
    t = kinematics.legacy_strike_features(found, frames, "smooth")
    return rounded(t, *(c for c in t.columns if c not in ID))


def smooth(spark, d):
    return signal.savgol(b.signal_frames(spark, d).select(*ID, "ankle_y", "hip_y"), "ankle_y", "smooth")


def savgol_smooth(spark, d):
    return rounded(smooth(spark, d).select(*ID, "smooth"), "smooth")


def peaks(spark, d):
    """Foot strikes: peaks of the smoothed ankle height, to the digits that are compared."""
    return signal.peaks(savgol_smooth(spark, d), "smooth")


def ankle_peaks(spark, d):
    return peaks(spark, d)


def peak_pairs(spark, d):
    return signal.peak_pairs(peaks(spark, d))


def video_meta(spark, d):
    return rounded(metrics.duration(b.video_meta(spark, d)), "duration")


def cadence(spark, d):
    t = metrics.cadence(peaks(spark, d), metrics.duration(b.video_meta(spark, d)))
    return rounded(t, "steps_per_sec", "steps_per_min")


def _oscillation(spark, d):
    hips = signal.savgol(b.signal_frames(spark, d).select(*ID, "hip_y"), "hip_y", "smooth_hip")
    return metrics.vertical_oscillation(hips, peaks(spark, d), "smooth_hip")


def vertical_oscillation(spark, d):
    return rounded(_oscillation(spark, d), "vo", "vo_per_pair")


def mean_oscillation(spark, d):
    return rounded(metrics.mean_oscillation(_oscillation(spark, d)), "vo")


def mean_oscillation_cm(spark, d):
    """For runners of 170 cm who are 101 px high."""
    t = metrics.mean_oscillation(_oscillation(spark, d))
    return rounded(t.select("video", metrics.centimetres(F.col("vo"), F.lit(101.0), F.lit(170.0)).alias("vo_cm")), "vo_cm")


def referenced_metrics(spark, d):
    """Cadence and oscillation of each video beside their usual ranges."""
    t = cadence(spark, d).select("video", "steps_per_min").join(mean_oscillation_cm(spark, d).withColumnRenamed("vo_cm", "vertical_oscillation_cm"), "video", "left")
    return metrics.referenced(t)


def _placed(spark, d):
    """Strikes with their place in the log of keys."""
    return b.strikes(spark, d).join(b.label_keys(spark, d).select(*ID, "event_id"), ID)


def _joined(t):
    return t.select("video", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


def run_summary(spark, d):
    return rounded(metrics.run_summary(b.strikes(spark, d)), "overstriding_rate")


def frames_by_video(spark, d):
    return _joined(metrics.frames_by_video(_placed(spark, d), "event_id"))


def sorted_frames(spark, d):
    return _joined(metrics.sorted_frames(b.strikes(spark, d)))


def video_counts(spark, d):
    return metrics.counts(b.signal_frames(spark, d), b.strikes(spark, d))


def strike_window(spark, d):
    return metrics.strike_window(b.signal_frames(spark, d), b.strikes(spark, d), ["ankle_y", "hip_y"])


def strike_window_resampled(spark, d):
    return rounded(metrics.resampled(strike_window(spark, d), ["ankle_y", "hip_y"]), "ankle_y", "hip_y")


def _side(df, s):
    return df.filter(F.col("side") == s)


def strike_union(spark, d):
    t = b.strikes(spark, d)
    return sets.strike_union(_side(t, "L"), _side(t, "R")).orderBy("frame", "side", "video")


def strike_frames(spark, d):
    t = b.strikes(spark, d)
    return sets.strike_frames(_side(t, "L"), _side(t, "R"))


def strike_order(spark, d):
    """Strikes with the place of their video by first appearance, in order of video, side and frame."""
    return sets.with_video_order(_placed(spark, d), "event_id").select(*ID, "video_ord").orderBy("video_ord", "side", "frame")


def distinct_videos(spark, d):
    return sets.videos(b.strikes(spark, d))


def train_split(spark, d):
    return sets.train_split(b.strikes(spark, d), b.test_videos(spark))


def test_split(spark, d):
    return sets.test_split(b.strikes(spark, d), b.test_videos(spark))


def legacy_train_split(spark, d):
    return sets.train_split(b.strikes(spark, d), b.test_videos(spark, b.LEGACY_TEST_VIDEOS))


def legacy_test_split(spark, d):
    return sets.test_split(b.strikes(spark, d), b.test_videos(spark, b.LEGACY_TEST_VIDEOS))


def shuffled_strikes(spark, d):
    """All strikes in random order."""
    return sets.shuffled(b.strikes(spark, d), seed=7)


def strikes_head(spark, d):
    """The first five, as a display shows them."""
    return b.strikes(spark, d).orderBy(*ID).limit(5)


def contact_predictions(spark, d):
    t = b.contact_logits(spark, d)
    return rounded(t.select(*ID, (1 / (1 + F.exp(-F.col("logit")))).alias("probability"), "pred"), "probability")


def class_balance(spark, d):
    return rounded(evaluation.class_balance(b.contact_logits(spark, d)), "pos_weight")


def masked_bce(spark, d):
    return rounded(evaluation.masked_bce(b.contact_logits(spark, d), ["video"]), "loss")


def classification_report(spark, d):
    return rounded(evaluation.classification_report(b.contact_logits(spark, d)), "precision", "recall", "f1")


def duration_limits(spark, d):
    """Limits of a cycle's duration from the data, by side."""
    return labelling.duration_limits(labelling.durations(b.strikes(spark, d)), ["side"])


def epoch_batches(spark, d):
    """All cycles in the order of an epoch, 32 to a batch."""
    return loader.batches(labelling.gait_cycles(b.strikes(spark, d)), (F.col("video") * 31 + F.col("start_frame")) % 16, ["video", "side", "start_frame"], 32, epoch=3)


#: Frames of a block in the queries by block: the series at hand are short.
SHORT = 24


def blocked_kinematics(spark, d):
    """frame_kinematics with each recording cut into blocks."""
    cols = [*STRIKE_METRICS, "tibial_angle_down"]
    return rounded(kinematics.frame_kinematics(b.pose_frames(spark, d), block=SHORT).select(*ID, *cols), *cols)


def blocked_smooth(spark, d):
    """savgol_smooth by blocks."""
    return rounded(signal.savgol(b.signal_frames(spark, d).select(*ID, "ankle_y"), "ankle_y", "smooth", block=SHORT).select(*ID, "smooth"), "smooth")


def blocked_peaks(spark, d):
    """ankle_peaks in rounds over blocks."""
    return signal.peaks(blocked_smooth(spark, d), "smooth", block=SHORT)


def blocked_strikes(spark, d):
    """Strikes with the strike before, both from state that passes from block to block."""
    t = labelling.label_fsm(b.label_keys(spark, d), ("frame", "event_id"), SHORT)
    return labelling.prev_strike(labelling.labelled(t), SHORT).select(*ID, "strike_pattern", "overstriding", "u_frame", "prev_frame")


def blocked_legacy_cycles(spark, d):
    """legacy_cycles by blocks."""
    return labelling.legacy_cycles(b.label_keys(spark, d), ("frame", "event_id"), SHORT)


def blocked_contact_labels(spark, d):
    """contact_labels by blocks."""
    return labelling.contact_labels(b.signal_frames(spark, d), labelling.label_fsm(b.label_keys(spark, d), ("frame", "event_id"), SHORT), SHORT)


QUERIES = {f.__name__: f for f in (
    duration_limits, epoch_batches,
    blocked_kinematics, blocked_smooth, blocked_peaks, blocked_strikes, blocked_legacy_cycles, blocked_contact_labels,
    label_fsm, legacy_cycles, prev_strike, gait_cycles, contact_labels, cycle_slices, zscore_frames, cycle_tensor, relabel_apply, legacy_store,
    frame_kinematics, gradient, strike_features, strike_features_clamped, legacy_strike_features, savgol_smooth, ankle_peaks, peak_pairs, video_meta, cadence,
    vertical_oscillation, mean_oscillation, run_summary, frames_by_video, video_counts, strike_window, strike_union, strike_frames, strike_order,
    distinct_videos, train_split, test_split, contact_predictions, class_balance, masked_bce, classification_report,
    mean_oscillation_cm, referenced_metrics, sorted_frames, strike_window_resampled, legacy_train_split, legacy_test_split, shuffled_strikes, strikes_head)}
QUERIES |= {
    "tibial_a": _metric("tibial_angle"), "tibial_b": _metric("tibial_angle_down"), "knee_flexion": _metric("knee_flexion_angle"), "trunk_angle": _metric("trunk_angle"),
    "approach_angle": _metric("ankle_approach_angle"), "ankle_hip_offset": _metric("ankle_hip_horizontal_offset"), "pre_strike_velocity": _metric("ankle_velocity_pre_strike")}
