"""Queries that train a model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strideloom.ml import contact_lstm, forward, strike_type, training
from strideloom.operators import evaluation, kinematics, metrics, normalize, sets
from strideloom.plans import bindings as b
from strideloom.plans.queries import FEATURES, ID, QUERIES, rounded, cycle_tensor, strike_window
from strideloom.schemas import STRIKE_METRICS
from strideloom.sources.scratch import scratched


def _contact(spark, d):
    """Trained on all cycles of the training videos, for all epochs; cycles are prepared once."""
    cycles, test = scratched(cycle_tensor(spark, d), "cycles"), b.test_videos(spark)
    model = contact_lstm.ContactLstm(len(FEATURES))
    training.train(training.sequences(sets.train_split(cycles, test), contact_lstm.CYCLE, FEATURES), model, FEATURES)
    return contact_lstm.predict(sets.test_split(cycles, test), model, FEATURES)


def contact_lstm_infer(spark, d):
    return rounded(_contact(spark, d), "logit")


def contact_lstm_report(spark, d):
    return rounded(evaluation.classification_report(_contact(spark, d)), "precision", "recall", "f1")


def _strikes(spark, d):
    return kinematics.strike_features(b.strikes(spark, d), kinematics.frame_kinematics(b.pose_frames(spark, d)))


def _strike_type(kind):
    def query(spark, d):
        t, test = _strikes(spark, d), b.test_videos(spark)
        model = strike_type.fit(sets.train_split(t, test), list(STRIKE_METRICS), "strike_pattern", kind)
        return strike_type.predict(model, sets.test_split(t, test), list(STRIKE_METRICS), ID)
    return query


def strike_type_report(spark, d):
    """Both classifiers of the strike pattern on the same held-out strikes."""
    lines = [evaluation.classification_report(_strike_type(k)(spark, d).withColumn("mask", F.lit(True))).select(F.lit(k).alias("model"), "*") for k in ("lr", "rf")]
    return rounded(lines[0].unionByName(lines[1]), "precision", "recall", "f1")


WINDOW, STRIKE = ["ankle_y", "hip_y"], ["video", "side", "strike_frame"]


def _judged(spark, d):
    """Strikes that were judged, with overstriding as 1 or 0."""
    t = b.strikes(spark, d).filter(F.col("overstriding") != "skip")
    return t.select("video", "side", F.col("frame").alias("strike_frame"), "overstriding", (F.col("overstriding") == "overstriding").cast("int").alias("target"))


def overstride_window(spark, d):
    """Overstriding from the flattened window around each strike."""
    return _overstride_flat(spark, d, "lr")


def _overstride_flat(spark, d, kind):
    flat = strike_type.flattened(strike_window(spark, d), WINDOW, range(-8, 4))
    t, test = flat.join(_judged(spark, d).drop("target"), STRIKE), b.test_videos(spark)
    cols = [c for c in flat.columns if c not in STRIKE]
    model = strike_type.fit(sets.train_split(t, test), cols, "overstriding", kind)
    return strike_type.predict(model, sets.test_split(t, test), cols, STRIKE)


def overstride_steps(spark, d):
    """Judged strikes' windows, resampled to 12 steps and standardised; the label counts at the last step, where the whole window has been seen."""
    t = normalize.zscore(metrics.resampled(strike_window(spark, d), WINDOW), WINDOW).join(_judged(spark, d), STRIKE)
    last = F.col("t") == 11
    return t.select(*STRIKE, "t", *WINDOW, F.when(last, F.col("target")).otherwise(-1).alias("label"), last.alias("mask"))


def overstride_lstm(spark, d):
    """Overstriding by a recurrent network that reads a window and answers at its end."""
    t, test = scratched(overstride_steps(spark, d), "windows"), b.test_videos(spark)
    model = contact_lstm.ContactLstm(len(WINDOW))
    training.train(training.sequences(sets.train_split(t, test), STRIKE, WINDOW), model, WINDOW)
    out = contact_lstm.predict(sets.test_split(t, test), model, WINDOW, 0.5, STRIKE).filter("mask")
    return rounded(out.select(*STRIKE, "label", "logit", "pred"), "logit")


def overstride_report(spark, d):
    """The recurrent network beside logistic regression and a random forest, on the same held-out strikes: label 1 is overstriding."""
    over = lambda c: (F.col(c) == 1).cast("int").alias(c)
    # the indexer has labels in order of the alphabet: neutral 0, overstriding 1
    every = {"lstm": overstride_lstm(spark, d), "lr": _overstride_flat(spark, d, "lr"), "rf": _overstride_flat(spark, d, "rf")}
    lines = [evaluation.classification_report(t.select(over("label"), over("pred"), F.lit(True).alias("mask"))).select(F.lit(k).alias("model"), "*") for k, t in every.items()]
    return rounded(lines[0].unionByName(lines[1]).unionByName(lines[2]), "precision", "recall", "f1")


def run_report(spark, d):
    """One JSON document for each video: strikes, cadence and oscillation."""
    parts = QUERIES["run_summary"](spark, d).join(QUERIES["cadence"](spark, d), "video").join(QUERIES["mean_oscillation"](spark, d), "video", "left")
    return parts.select("video", F.to_json(F.struct(*(c for c in parts.columns if c != "video"))).alias("report"))


def lstm_forward(spark, d):
    """Logits of a small network of fixed weights, all cycles, as column expressions."""
    t = forward.logits(cycle_tensor(spark, d), fixed_network(), FEATURES)
    odds = float(np.log(contact_lstm.THRESHOLD / (1 - contact_lstm.THRESHOLD)))
    return rounded(t, "logit").withColumn("pred", (F.col("logit") > odds).cast("long"))


def lstm_forward_report(spark, d):
    return rounded(evaluation.classification_report(lstm_forward(spark, d)), "precision", "recall", "f1")


def fixed_network(hidden: int = 3) -> contact_lstm.ContactLstm:
    """Weights of a rule, the same in the SQL."""
    model = contact_lstm.ContactLstm(len(FEATURES), hidden)
    for n, k in enumerate(sorted(model.weights)):
        w = model.weights[k]
        model.weights[k] = (((np.arange(w.size) + 11 * n) * 37 % 101 - 50) / 50).reshape(w.shape)
    return model


LEARNED = {
    "lstm_forward": lstm_forward, "lstm_forward_report": lstm_forward_report,
    "contact_lstm_infer": contact_lstm_infer, "contact_lstm_report": contact_lstm_report, "strike_type_lr": _strike_type("lr"), "strike_type_rf": _strike_type("rf"),
    "overstride_window": overstride_window, "overstride_lstm": overstride_lstm, "overstride_report": overstride_report, "strike_type_report": strike_type_report, "run_report": run_report}
