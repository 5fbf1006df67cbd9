"""The strike state machine over a stream of annotation keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strideloom.functions.labels import OVERSTRIDE_KEYS, STRIKE_KEYS

OUT = "video long, side string, frame long, strike_pattern string, overstriding string, u_frame long"
STATE = "u_frame long, ended boolean"


def label_stream(keys: DataFrame) -> DataFrame:
    """Strikes from a stream of (video, side, frame, key, strike_key, overstride_key): the same rows as over a table.

    Keys of a (video, side) must arrive in the order of frames across batches, as a person presses them; within a batch they are
    sorted. The state is the last toe-off frame and whether the series has ended.
    """

    def step(key, batches, state: GroupState):
        u, ended = state.get if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        out = []
        for r in rows.itertuples():
            if ended:
                break
            if r.key == "u":
                u = int(r.frame)
            elif r.key == "c":
                ended = True
            elif r.key == "d":
                if r.strike_key in STRIKE_KEYS:
                    out.append((*key, int(r.frame), STRIKE_KEYS[r.strike_key], OVERSTRIDE_KEYS.get(r.overstride_key, "skip"), u))
                u = None
        state.update((u, ended))
        found = pd.DataFrame(out, columns=["video", "side", "frame", "strike_pattern", "overstriding", "u_frame"])
        yield found.astype({"u_frame": "Int64"})

    return keys.groupBy("video", "side").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
