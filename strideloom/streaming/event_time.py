"""Strikes, cycles and contact intervals from a stream of keys in any order, by event time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strideloom.functions.labels import OVERSTRIDE_KEYS, STRIKE_KEYS

OUT = "video long, side string, frame long, strike_pattern string, overstriding string, u_frame long, prev_frame long"
#: A key that waits: its time in microseconds, frame, place among the keys of its frame, and what was pressed.
WAITING = "at long, frame long, ord long, key string, strike_key string, overstride_key string"
#: Toe-off frame since the last d, the last two frames with a labelled strike, whether the series has ended.
MACHINE = "u long, last long, before long, ended boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Labeller(StatefulProcessor):
    """Keeps a series' keys until the watermark has passed them, then takes them in order of frame and ord."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.machine = handle.getValueState("machine", MACHINE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            # no key of an unmarked frame changes the machine
            part = part[part["key"].isin(["u", "d", "c"])]
            if len(part):
                new = [(int(r.at_us), int(r.frame), int(r.ord), r.key, r.strike_key, r.overstride_key) for r in part.itertuples()]
                self.waiting.appendList(new)
                least = min(t[0] for t in new)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(t) for t in self.waiting.get()]
        ready, rest = sorted((t for t in held if t[0] <= upto), key=lambda t: t[1:3]), [t for t in held if t[0] > upto]
        if not ready:
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-min(t[0] for t in rest) // 1000))
        else:
            self.waiting.clear()
        u, last, before, ended = self.machine.get() if self.machine.exists() else (None, None, None, False)
        out = []
        for _, frame, _, name, strike_key, overstride_key in ready:
            if ended:
                break
            if name == "u":
                u = frame
            elif name == "c":
                ended = True
            else:
                if strike_key in STRIKE_KEYS:
                    previous = before if last == frame else last
                    out.append((*key, frame, STRIKE_KEYS[strike_key], OVERSTRIDE_KEYS.get(overstride_key, "skip"), u, previous))
                    if u is not None and last != frame:
                        last, before = frame, last
                u = None
        self.machine.update((u, last, before, ended))
        t = pd.DataFrame(out, columns=["video", "side", "frame", "strike_pattern", "overstriding", "u_frame", "prev_frame"])
        yield t.astype({"u_frame": "Int64", "prev_frame": "Int64"})

    def close(self) -> None:
        pass


def label_events(keys: DataFrame, delay: str) -> DataFrame:
    """Strikes with ``prev_frame`` from a stream of (video, side, frame, ord, at, key, strike_key, overstride_key): the same rows as over a table.

    ``at`` is the event's time, which does not fall as frames rise in a series; keys may come in any order. A key counts if it comes within ``delay`` of the latest key of
    all series in the batches before, or before a batch has taken the keys up to its time; others are left out, and late_keys counts them. A strike comes out when the watermark has passed its key. ``ord`` orders keys of one
    frame. Rows whose key is null or without meaning only move the watermark; those without a time, and keys without a frame,
    are left out; a null ord counts as 0. Needs ``state_store``.
    """
    t = keys.filter("at is not null and (key is null or frame is not null)").withColumn("ord", F.coalesce("ord", F.lit(0).cast("long")))
    t = t.select("video", "side", "frame", "ord", "at", "key", "strike_key", "overstride_key", F.unix_micros("at").alias("at_us")).withWatermark("at", delay)
    return t.groupBy("video", "side").transformWithStateInPandas(_Labeller(), OUT, "Append", "EventTime")


def cycle_events(strikes: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Gait cycles (video, side, start_frame, u_frame, end_frame) as their last strikes come out of label_events."""
    t = strikes.filter("u_frame is not null and prev_frame is not null")
    t = t.select("video", "side", F.col("prev_frame").alias("start_frame"), "u_frame", (F.col("frame") - 1).alias("end_frame"))
    return t.filter((F.col("end_frame") - F.col("start_frame")).between(max(shortest, 0), longest))


def contact_events(strikes: DataFrame) -> DataFrame:
    """Intervals of frames (video, side, lo, hi, label), hi left out: 1 from the strike before to toe-off, 0 from there to the strike."""
    span = lambda lo, hi, label: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit(label).alias("label"))
    t = strikes.filter("u_frame is not null").select("video", "side", F.explode(F.array(span("u_frame", "frame", 0), span("prev_frame", "u_frame", 1))).alias("i"))
    return t.select("video", "side", "i.*").filter("lo is not null")


def late_keys(query: StreamingQuery) -> int:
    """Keys that came too late, over the progress reports that the query still has."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


@contextmanager
def state_store(spark: SparkSession):
    """The session with a state store that has lists and timers; a stream keeps the one it was started with."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, old)
