"""Hand-computed cases of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideloom.functions import angles
from strideloom.operators import evaluation, kinematics, labelling, metrics, normalize, sets, signal
from strideloom.operators.ranges import range_join


def series(spark, values, col="y"):
    return spark.createDataFrame([(1, "L", i, float(v)) for i, v in enumerate(values)], f"video long, side string, frame long, {col} double")


def values(df, col):
    return [r[col] for r in df.orderBy("frame").collect()]


def keys(spark, text):
    """'u@3 d@9(h,o)' to key rows."""
    rows = []
    for word in text.split():
        key, rest = word.split("@")
        frame, _, args = rest.partition("(")
        s, o = (args.rstrip(")").split(",") + [None])[:2] if args else (None, None)
        rows.append((1, "L", int(frame), key, s, o))
    return spark.createDataFrame(rows, "video long, side string, frame long, key string, strike_key string, overstride_key string")


def test_gradient(spark):
    assert values(series(spark, [1, 2, 4, 7]).withColumn("g", kinematics.gradient(F.col("y"))), "g") == [1, 1.5, 2.5, 3]


@pytest.mark.parametrize("ankle, want", [((100, 400), 180), ((0, 300), 270), ((200, 300), 90)])
def test_knee_flexion(spark, ankle, want):
    c = angles.knee_flexion(*map(F.lit, (100.0, 200.0, 100.0, 300.0, float(ankle[0]), float(ankle[1]))))
    assert spark.range(1).select(c.alias("a")).first().a in (pytest.approx(want), pytest.approx(want - 360))


def test_tibial_and_trunk(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    r = spark.range(1).select(
        angles.tibial_up(*lit(0, 0, 0, 100)).alias("a"), angles.tibial_down(*lit(0, 0, 0, 100)).alias("b"),
        *(angles.trunk(*lit(x, y, 0, 0)).alias(f"t{i}") for i, (x, y) in enumerate([(0, -100), (100, -100), (-100, -100)]))).first()
    assert (r.a, r.b, r.t0, r.t1, r.t2) == pytest.approx((math.pi, 0, 180, 135, 225))


def test_savgol(spark):
    got = values(signal.savgol(series(spark, [0] * 5 + [231] + [0] * 5), "y", "s"), "s")
    assert got == pytest.approx([-29.4, 4.2, 29.3, 45.9, 54, 59, 54, 45.9, 29.3, 4.2, -29.4])
    assert values(signal.savgol(series(spark, [i * i for i in range(11)]), "y", "s"), "s") == pytest.approx([i * i for i in range(11)])


def test_savgol_of_a_short_series_fails(spark):
    with pytest.raises(Exception, match="fewer than 9"):
        signal.savgol(series(spark, range(8)), "y", "s").collect()


def slow_peaks(y, distance=14):
    found, i = [], 1
    while i < len(y) - 1:
        j = i
        while j + 1 < len(y) and y[j + 1] == y[i]:
            j += 1
        if j + 1 < len(y) and y[i - 1] < y[i] > y[j + 1]:
            found.append((y[i], (i + j) // 2))
        i = j + 1
    kept = []
    for _, p in sorted(found, reverse=True):
        if all(abs(p - k) >= distance for k in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("y, want", [([0, 1, 0, 2, 0], [3]), ([0, 1, 1, 0], [1]), ([5, 1, 2], []), ([0, 3] + [0] * 13 + [3, 0], [1, 15]), ([0, 3] + [0] * 12 + [3, 0], [14])])
def test_peaks(spark, y, want):
    assert values(signal.peaks(series(spark, y), "y"), "frame") == want


def test_peaks_like_a_loop(spark):
    rng = random.Random(3)
    lines = {v: [rng.randrange(5) for _ in range(80)] for v in range(20)}
    df = spark.createDataFrame([(v, "L", i, float(x)) for v, y in lines.items() for i, x in enumerate(y)], "video long, side string, frame long, y double")
    got = {}
    for r in signal.peaks(df, "y").collect():
        got.setdefault(r.video, []).append(r.frame)
    assert {v: sorted(p) for v, p in got.items()} == {v: slow_peaks(y) for v, y in lines.items()}


def test_label_fsm(spark):
    t = labelling.label_fsm(keys(spark, "u@3 u@5 d@9(h,o) d@14(m,n) u@16 d@20(s) d@25(f,x) u@30 c@31 d@40(h,o)"))
    got = [tuple(r)[2:] for r in t.orderBy("frame").collect()]
    assert got == [(9, "heel", "overstriding", 5), (14, "midfoot", "neutral", None), (25, "forefoot", "skip", None)]


def test_label_fsm_stream(spark, tmp_path):
    from strideloom.streaming.labels import label_stream

    df = keys(spark, "u@3 u@5 d@9(h,o) d@14(m,n) u@16 d@20(s) d@25(f,x) u@30 c@31 d@40(h,o)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = label_stream(stream).writeStream.format("memory").queryName("strikes_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    order = ["video", "side", "frame", "strike_pattern", "overstriding", "u_frame"]
    assert sorted(map(str, spark.table("strikes_out").select(order).collect())) == sorted(map(str, labelling.label_fsm(df).select(order).collect()))


def test_legacy_cycles(spark):
    t = labelling.legacy_cycles(keys(spark, "u@3 u@5 d@9 u@12 d@15 d@18"))
    assert [(r.u_frame, r.frame) for r in t.collect()] == [(12, 15)]


def strikes(spark, rows):
    return spark.createDataFrame([(1, "L", f, "heel", "skip", u) for f, u in rows], "video long, side string, frame long, strike_pattern string, overstriding string, u_frame long")


def test_prev_strike_is_strictly_earlier(spark):
    assert [r.prev_frame for r in labelling.prev_strike(strikes(spark, [(10, 1), (10, 2), (30, 3)])).orderBy("frame").collect()] == [None, None, 10]


def test_cycle_labels_and_padding(spark):
    s = strikes(spark, [(10, 4), (34, 20)])
    cycles = labelling.gait_cycles(s)
    assert [(r.start_frame, r.u_frame, r.end_frame) for r in cycles.collect()] == [(10, 20, 33)]
    frames = series(spark, range(50), "f")
    frames = frames.union(frames)  # duplicate frames count once
    want = {f: 0 for f in range(4, 10)} | {f: 1 for f in range(10, 20)} | {f: 0 for f in range(20, 34)}
    got = {r.frame: r.label for r in labelling.contact_labels(frames, s).collect()}
    assert got == {f: want.get(f) for f in range(50)}
    cut = labelling.cycle_frames(frames.join(labelling.contact_labels(frames, s), ["video", "side", "frame"]), cycles)
    rows = labelling.padded(cut, ["f"]).orderBy("t").collect()
    assert [(r.t, r.f, r.label, r["mask"]) for r in rows] == [(t, 0.0, -1, False) if t < 16 else (t, t - 6.0, want[t - 6], True) for t in range(40)]


@pytest.mark.parametrize("gap, kept", [(6, 0), (7, 1), (39, 1), (40, 0)])
def test_cycle_duration(spark, gap, kept):
    assert labelling.gait_cycles(strikes(spark, [(10, 1), (11 + gap, 12)])).count() == kept


def test_range_join_like_a_loop(spark):
    rng = random.Random(5)
    points, ranges = [rng.randrange(400) for _ in range(60)], [(i, rng.randrange(400), rng.randrange(200)) for i in range(30)]
    p = spark.createDataFrame([("a", x) for x in points], "k string, at long")
    r = spark.createDataFrame([("a", i, lo, lo + n) for i, lo, n in ranges], "k string, i long, lo long, hi long")
    got = sorted((x.at, x.i) for x in range_join(p, r, ["k"], "at", "lo", "hi").collect())
    assert got == sorted((x, i) for x in points for i, lo, n in ranges if lo <= x < lo + n)


def test_oscillation(spark):
    frames = series(spark, [9, 0, 4, 1, 6, 0, 0], "hip")
    peaks = spark.createDataFrame([(1, "L", f) for f in (1, 2, 5)], "video long, side string, frame long")
    r = metrics.vertical_oscillation(frames, peaks, "hip").first()
    assert (r.peaks, r.vo, r.vo_per_pair) == (3, pytest.approx(10 / 3), 5)


def test_weighted_loss(spark):
    got = [spark.range(1).select(angles.bce_with_logits(F.lit(z), F.lit(y), F.lit(3.0)).alias("l")).first().l for z, y in [(0.0, 1.0), (0.0, 0.0), (2.0, 1.0), (-1.0, 0.0)]]
    assert got == pytest.approx([2.079442, 0.693147, 0.380784, 0.313262], abs=1e-6)


def test_threshold(spark):
    assert tuple(spark.range(1).select(angles.sigmoid_over(F.lit(-0.61)), angles.sigmoid_over(F.lit(-0.62))).first()) == (1, 0)


def test_zscore_with_given_statistics(spark):
    df = series(spark, [1, 2, 3, 6])
    stats = normalize.fit(df.filter("frame < 3"), ["y"])
    assert values(normalize.zscore(df, ["y"], stats), "y") == [-1, 0, 1, 4]
    assert values(normalize.zscore(series(spark, [5, 5]), ["y"]), "y") == [0, 0]


def test_report_of_an_absent_class(spark):
    df = spark.createDataFrame([(0, 1, True), (0, 0, True), (1, 1, False)], "label int, pred long, mask boolean")
    r = {x["class"]: x for x in evaluation.classification_report(df).collect()}
    assert (r["1"].recall, r["1"].precision, r["0"].recall, r["accuracy"].f1) == (0, 0, 0.5, 0.5)


def test_sets(spark):
    a, b = strikes(spark, [(1, 0), (2, 0)]), strikes(spark, [(2, 1), (2, 1)])
    assert sets.strike_union(a, b).count() == 4 and sets.strike_frames(a, b).count() == 2
    test = spark.createDataFrame([(1,), (1,)], "video long")
    assert sets.test_split(a, test).count() == 2 and sets.train_split(a, test).count() == 0


def test_lstm_gradient_and_training():
    from strideloom.ml.contact_lstm import ContactLstm

    rng = np.random.default_rng(1)
    x, y, mask = rng.normal(size=(3, 5, 2)), rng.integers(0, 2, (3, 5)).astype(float), rng.random((3, 5)) < 0.7
    net = ContactLstm(2, 3)
    _, grad = net.loss(x, y, mask, 2.0)
    for k, w in net.weights.items():
        i = tuple(int(n) // 2 for n in w.shape)
        w[i] += 1e-6
        up = net.loss(x, y, mask, 2.0)[0]
        w[i] -= 2e-6
        down = net.loss(x, y, mask, 2.0)[0]
        w[i] += 1e-6
        assert grad[k][i] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    x = rng.normal(size=(64, 6, 2))
    losses = ContactLstm(2, 8).fit(x, (x[:, :, 0] > 0).astype(float), np.ones((64, 6), bool), epochs=40, rate=0.02)
    assert losses[-1] < 0.5 * losses[0]


def test_lstm_weights_round_trip(spark, tmp_path):
    from strideloom.ml.contact_lstm import ContactLstm, load, save

    net = ContactLstm(4, 5)
    save(spark, net, str(tmp_path / "w"))
    x = np.ones((1, 3, 4))
    assert load(spark, str(tmp_path / "w")).logits(x) == pytest.approx(net.logits(x))


def test_values_beside_their_usual_ranges(spark):
    rows = [(1, 5.9, 180.0), (2, 6.0, 1.0), (3, 13.0, None), (4, 13.1, None), (5, None, 2.0), (6, float("nan"), 3.0)]
    t = spark.createDataFrame(rows, "video long, vertical_oscillation_cm double, steps_per_min double")
    got = {(r.video, r.metric): r.standing for r in metrics.referenced(t).collect()}
    assert [got[v, "vertical_oscillation_cm"] for v in range(1, 7)] == ["below", "within", "within", "above", None, None]
    assert len(got) == 12 and {s for (_, m), s in got.items() if m == "steps_per_min"} == {None}
    one = metrics.referenced(t, {"steps_per_min": (None, 2.0)})
    assert {r.video: r.standing for r in one.collect()} == {1: "above", 2: "within", 3: None, 4: None, 5: "within", 6: "above"}
    assert metrics.referenced(t.limit(0)).count() == 0
