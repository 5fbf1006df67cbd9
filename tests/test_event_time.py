"""Labels from streams of keys out of order."""

import datetime as dt
import random

from pyspark.sql import functions as F

from strideloom.operators import labelling
from strideloom.streaming.event_time import contact_events, cycle_events, label_events, late_keys, state_store

SCHEMA = "video long, side string, frame long, ord long, at timestamp, key string, strike_key string, overstride_key string"
START = dt.datetime(2024, 1, 1)


def _key(video, side, frame, ord, key, strike="h", over="o"):
    return (video, side, frame, ord, START + dt.timedelta(seconds=frame), key, strike, over)


def _end(frame):
    """A row that only moves the watermark."""
    return (-1, "L", frame, 0, START + dt.timedelta(seconds=frame), None, None, None)


def _run(spark, path, batches, delay):
    """Strikes and late keys of a stream with these batches, each a file."""
    import os
    import time

    for i, rows in enumerate(batches):
        one = f"{path}/w{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(one)
        os.makedirs(f"{path}/in", exist_ok=True)
        part = next(f for f in os.listdir(one) if f.startswith("part-"))
        os.rename(f"{one}/{part}", f"{path}/in/{i:03}.parquet")
        os.utime(f"{path}/in/{i:03}.parquet", (time.time() - 1000 + i,) * 2)
    with state_store(spark):
        out = label_events(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), delay)
        q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out"), late_keys(q)


def test_shuffled_batches_give_the_rows_of_a_table(spark, tmp_path):
    rng = random.Random(5)
    keys = [_key(v, s, f, o, rng.choice("uuddx") if rng.random() < 0.999 else "c", rng.choice("hmfs"), rng.choice("ons"))
            for v in range(2) for s in "LR" for f in range(0, 240, 4) for o in range(rng.choice([1, 1, 2, 3]))]
    # each comes up to 60 s after it was pressed
    arrival = sorted((k[2] + rng.randrange(60), rng.random(), k) for k in keys)
    batches = [[k for at, _, k in arrival if lo <= at < lo + 75] for lo in range(0, 300, 75)] + [[_end(1000)]]
    got, late = _run(spark, str(tmp_path), batches, "60 seconds")
    table = labelling.label_fsm(spark.createDataFrame(keys, SCHEMA), ("frame", "ord"))
    row = lambda df: sorted(df.collect(), key=str)
    assert late == 0 and row(got.drop("prev_frame")) == row(table)
    # several keys of one frame: equal frames do not precede each other
    want = labelling.prev_strike(labelling.labelled(table))
    assert row(got.filter("u_frame is not null").select(*want.columns)) == row(want) and want.count() > 20
    assert row(cycle_events(got, 7, 39)) == row(labelling.gait_cycles(table))
    assert row(contact_events(got)) == row(labelling.contact_intervals(table).drop("seq"))


def test_late_keys_are_counted_and_strikes_wait_for_the_watermark(spark, tmp_path):
    batches = [[_key(0, "L", 10, 0, "d"), _key(0, "L", 5, 0, "u")], [_end(100)], [_key(0, "L", 95, 0, "d", "m")], [_key(0, "L", 93, 0, "u"), _key(0, "L", 7, 0, "u")]]
    got, late = _run(spark, str(tmp_path), batches, "10 seconds")
    # the batch before has passed 100 - 10, and with it frame 7; the keys of 93 and 95 still wait
    assert late == 1 and [(r.frame, r.u_frame, r.prev_frame) for r in got.collect()] == [(10, 5, None)]


def test_no_keys(spark, tmp_path):
    got, late = _run(spark, str(tmp_path), [[_end(0)], [_key(0, "L", 5, 0, None), _end(50)]], "0 seconds")
    assert late == 0 and got.count() == 0 and contact_events(got).count() == 0


def test_nulls(spark, tmp_path):
    """No time, no frame, no ord, null strike and overstride keys, a key without meaning."""
    timeless = (0, "L", 6, 0, None, "u", None, None)
    frameless = (0, "L", None, 0, START + dt.timedelta(seconds=6), "u", None, None)
    rows = [_key(0, "L", 5, None, "u"), timeless, frameless, _key(0, "L", 7, 0, "q"), _key(0, "L", 8, 0, "d", None), _key(0, "L", 9, 0, "d", "m", None)]
    got, late = _run(spark, str(tmp_path), [rows, [_end(100)]], "0 seconds")
    assert late == 0 and [(r.frame, r.strike_pattern, r.overstriding, r.u_frame) for r in got.collect()] == [(9, "midfoot", "skip", None)]
