"""Series by blocks give what whole series give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideloom.operators import blocks, kinematics, labelling, signal
from strideloom.schemas import JOINTS

FRAMES, BLOCK = 3000, 128


def noise(seed, top):
    return F.pmod(F.xxhash64("video", "side", "frame", F.lit(seed)), F.lit(top))


@pytest.fixture(scope="module")
def frames(spark):
    """A long series, a short one, and one with frames that lack."""
    t = spark.range(FRAMES).select(F.explode(F.array(*(F.struct(F.lit(v).cast("long").alias("video"), F.lit(s).alias("side")) for v, s in ((1, "L"), (1, "R"), (2, "L"))))).alias("k"), F.col("id").alias("frame"))
    t = t.select("k.*", "frame").filter("side = 'L' or frame < 40").filter((F.col("video") == 1) | (F.col("frame") % 7 > 1))
    return t.withColumn("y", noise(0, 5).cast("double"))


def table(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_indexed(frames):
    got = blocks.indexed(frames, block=50).select("video", "side", "frame", "_i", "_n").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.video, r.side, r.frame)):
        by.setdefault((r.video, r.side), []).append((r["_i"], r["_n"]))
    assert by and all(x == [(i, len(x)) for i in range(len(x))] for x in by.values())


def test_smoothing(frames):
    whole, cut = (signal.savgol(frames, "y", "s", block=n) for n in (None, BLOCK))
    assert sorted(whole.columns) == sorted(cut.columns) and table(whole) == table(cut)


def test_kinematics(spark, frames):
    names = [f"{s}_{j}" for j in JOINTS for s in ("left", "right")]
    pose = frames.filter("side = 'L'").select("video", "frame", *(F.struct(noise(2 * i, 1000).cast("double").alias("x"), noise(2 * i + 1, 1000).cast("double").alias("y")).alias(n) for i, n in enumerate(names)))
    whole, cut = (kinematics.frame_kinematics(pose, n) for n in (None, BLOCK))
    assert sorted(whole.columns) == sorted(cut.columns) and table(whole) == table(cut)


def test_labels_of_long_series(frames):
    """Rare keys, so that state must pass over many blocks; several keys at one frame; an end of the series."""
    key = F.when(noise(1, 301) == 0, "u").when(noise(1, 301) == 1, "d").when((noise(1, 301) == 2) & (F.col("frame") > 2500), "c")
    keys = frames.withColumns({"key": key, "strike_key": F.lit("h"), "overstride_key": F.lit("n"), "event_id": F.lit(0)})
    keys = keys.unionByName(keys.filter("key = 'd' and frame % 2 = 0").withColumns({"key": F.lit("u"), "event_id": F.col("frame") % 4 - 1}))
    order = ("frame", "event_id")
    whole, cut = (labelling.label_fsm(keys, order, n) for n in (None, 64))
    assert table(whole) == table(cut) and whole.filter("u_frame is not null").count() > 3
    assert table(labelling.legacy_cycles(keys, order)) == table(labelling.legacy_cycles(keys, order, 64))
    assert table(labelling.prev_strike(whole)) == table(labelling.prev_strike(whole, 64))
    assert table(labelling.contact_labels(frames, whole)) == table(labelling.contact_labels(frames, whole, 64))


def test_keys_at_one_frame_go_by_their_ordinal(spark):
    kind = "video long, side string, frame long, key string, strike_key string, overstride_key string, n long"
    for first, want in (("d", 5), ("u", None)):
        rows = [(1, "L", 5, first, "h", "n", 1), (1, "L", 5, "u" if first == "d" else "d", "h", "n", 2), (1, "L", 9, "d", "m", "o", 3)]
        keys = spark.createDataFrame(rows, kind)
        for block in (None, 2):
            got = {r.frame: r.u_frame for r in labelling.label_fsm(keys, ("frame", "n"), block).collect()}
            assert got == ({5: None, 9: 5} if first == "d" else {5: 5, 9: None}), want


def greedy(y, distance):
    """Peaks of one series by the plain rule."""
    tops, i = [], 1
    while i < len(y):
        j = i
        while j + 1 < len(y) and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j + 1 < len(y) and y[j + 1] < y[i]:
            tops.append(((i + j) // 2, y[i]))
        i = j + 1
    kept = []
    for p, _ in sorted(tops, key=lambda t: (t[1], t[0]), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("kind", ["ties", "ramp", "plateaus", "one gap"])
def test_peaks(spark, kind):
    rng = np.random.default_rng(4)
    n = 2500
    y = {"ties": rng.integers(0, 4, n), "ramp": np.arange(n) + 5 * (np.arange(n) % 2), "plateaus": np.repeat(rng.integers(0, 3, 20), 125),
         "one gap": np.where((np.arange(n) > 900) & (np.arange(n) < 1000), 0, rng.integers(0, 50, n))}[kind].astype(float)
    df = spark.createDataFrame([(1, "L", i, v) for i, v in enumerate(y.tolist())], "video long, side string, frame long, y double")
    want = greedy(y, 14)
    assert len(want) > 3
    for block in (None, 500):
        assert sorted(r.frame for r in signal.peaks(df, "y", block=block).collect()) == want
