"""Epochs of batches, and limits from sketches."""

import numpy as np
from pyspark.sql import functions as F

from strideloom.operators import labelling, loader


def order(df, parts, epoch, n=1000):
    t = loader.batches(df.repartition(parts), F.pmod(F.xxhash64("id"), F.lit(13)), ["id"], 32, epoch)
    got = {r.id: (r.batch, r.place) for r in t.collect()}
    assert sorted(got.values()) == [(i // 32, i % 32) for i in range(n)]
    return got


def test_epochs(spark):
    """Each row once, the same places however rows are dealt out, another order each epoch, neighbours apart."""
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    first = order(df, 1, 0)
    assert first == order(df, 7, 0)
    second = order(df, 3, 1)
    assert sum(first[i] == second[i] for i in first) < 20
    place = np.array([32 * first[i][0] + first[i][1] for i in range(1000)])
    assert abs(np.corrcoef(place, np.arange(1000))[0, 1]) < 0.1 and np.mean(np.abs(np.diff(place)) < 5) < 0.05
    assert order(df.limit(1), 1, 0, 1) == {0: (0, 0)} and loader.batches(df.limit(0), F.col("id") % 3, ["id"], 4).count() == 0


def test_limits_within_the_sketchs_error(spark):
    df = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("duration"), (F.col("id") % 2).alias("side"))
    for r in labelling.duration_limits(df, ["side"], 512).collect():
        values = np.sort([x.duration for x in df.filter(F.col("side") == r.side).collect()])
        for q, x in ((0.25, r.q1), (0.75, r.q3)):
            assert abs(np.searchsorted(values, x) / len(values) - q) < 0.01
        assert (r.shortest, r.longest) == (max(1.0, r.q1 - 1.5 * (r.q3 - r.q1)), r.q3 + 1.5 * (r.q3 - r.q1))
