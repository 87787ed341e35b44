"""Frames and run states as streams: the folds of operators.folds and the latest state of runs, carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import KEEP_GAP


def keep_stream(frames: DataFrame, keep: Callable[[float, float], bool], gap: float = KEEP_GAP) -> DataFrame:
    """Frames (run_id, timestamp, value) of a stream with `kept`: the first frame of a run, then each one that differs from the last kept one or comes `gap` later.

    The state of a run is its last kept frame alone, so it doesn't grow with
    the recording. Frames of a run must come in the order of their time from
    batch to batch; within a batch they are sorted.
    """
    kind = dict(frames.dtypes)["run_id"]

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("timestamp")
        flags = []
        for time, value in zip(rows["timestamp"], rows["value"]):
            k = last is None or time - last[0] >= gap or keep(last[1], value)
            if k:
                last = (float(time), float(value))
            flags.append(bool(k))
        state.update(last)
        yield rows.assign(run_id=key[0], kept=flags)[["run_id", "timestamp", "value", "kept"]]

    return frames.select("run_id", "timestamp", "value").groupBy("run_id").applyInPandasWithState(
        fold, f"run_id {kind}, timestamp double, value double, kept boolean", "time double, value double", "append", GroupStateTimeout.NoTimeout)


def latest_states(changes: DataFrame) -> DataFrame:
    """The latest status of each run of a stream of changes (run_id, seq, status); for the update or complete mode."""
    return changes.groupBy("run_id").agg(F.max(F.struct("seq", "status"))["status"].alias("status"), F.count(F.lit(1)).alias("changes"))
