"""Folds over ordered rows whose state is the last row kept; lag() can't express them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.signatures import BINS, BIN_WIDTH, CHANGED

# Fixed values.
KEEP_CORRELATION, KEEP_DIFFERENCE, KEEP_GAP = 0.85, 0.05, 5.0
SKIP_SIMILARITY, SKIP_CHANGE = 0.88, 0.003
SKIPPED = "skipped_similar_frame (sim=%.3f, change=%.4f)"

#: What keep() compares: the columns of `state` of one row, lists as arrays, nulls as None.
Row = dict


def keep_fold(rows: DataFrame, order: list[str], state: list[str], keep: Callable[[Row, Row], bool | tuple], by: str = "run_id", more: str = "") -> DataFrame:
    """rows with a column `kept`: the first row of a run is kept, then each one for which keep(last kept row, row) holds.

    The rows of a run pass once, in the order of `order`, and the fold holds
    the last kept row alone; a run of any length takes the same memory.
    keep() gives a flag, or a tuple of the flag and values for the columns that
    `more` (as DDL) names; for first rows these are null.
    """
    names = [f.split()[0] for f in more.split(",")] if more else []
    fields = [c for c in dict.fromkeys([*order, *state])]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            columns = {c: _values(batch.column(c)) for c in fields}
            out = [[] for _ in range(len(names) + 1)]
            for i in range(batch.num_rows):
                row = {c: v[i] for c, v in columns.items()}
                got = (True,) + (None,) * len(names) if last is None else keep(last, row)
                got = got if isinstance(got, tuple) else (got,)
                if got[0]:
                    last = row
                for values, x in zip(out, got):
                    values.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(out, kinds))], [*batch.schema.names, "kept", *names])

    extra = T._parse_datatype_string("kept boolean" + (f", {more}" if more else ""))
    kinds = [to_arrow_type(f.dataType) for f in extra.fields]
    return rows.repartition(by).sortWithinPartitions(by, *order).groupBy(by).applyInArrow(fold, T.StructType([*rows.schema.fields, *extra.fields]))


def _values(column: pa.Array) -> list:
    """The values of a column; lists of numbers as NumPy arrays without a copy."""
    if pa.types.is_list(column.type) and not pa.types.is_nested(column.type.value_type):
        flat, at, valid = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid()
        return [flat[a:b] if ok.as_py() else None for a, b, ok in zip(at[:-1], at[1:], valid)]
    return column.to_pylist()


# the same measures as in functions.signatures, for one pair of rows

def _correlation(a, b) -> float:
    if a is None or b is None or not len(a) or len(a) != len(b):
        return 0.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = len(a)
    va, vb = (a @ a) / n - a.mean() ** 2, (b @ b) / n - b.mean() ** 2
    if va <= 1e-12 or vb <= 1e-12:
        return 1.0 if va <= 1e-12 and vb <= 1e-12 else 0.0
    return float(((a @ b) / n - a.mean() * b.mean()) / np.sqrt(va * vb))


def _difference(a, b) -> float:
    if a is None or b is None or not len(a) or len(a) != len(b):
        return 1.0
    return float(np.abs(np.asarray(a, float) - b).mean() / 255)


def _similarity(a, b) -> float:
    if not a or not b or len(a) != len(b):
        return 0.0
    return min(1.0, max(0.0, (float(np.mean([_correlation(x, y) for x, y in zip(a, b)])) + 1) / 2))


def _changed(a, b) -> float:
    if a is None or b is None or not len(a) or len(a) != len(b):
        return 1.0
    return float((np.abs(np.asarray(a, np.int64) - b) > CHANGED).mean())


def keep_frames(frames: DataFrame) -> DataFrame:
    """frames (run_id, timestamp, hist, thumb, ...): kept if both measures changed since the last kept frame, or after a gap."""
    def keep(last: Row, row: Row) -> bool:
        changed = _correlation(last["hist"], row["hist"]) < KEEP_CORRELATION and _difference(last["thumb"], row["thumb"]) > KEEP_DIFFERENCE
        return changed or row["timestamp"] - last["timestamp"] >= KEEP_GAP

    return keep_fold(frames, ["timestamp"], ["hist", "thumb"], keep)


def skip_frames(frames: DataFrame, similar: float = SKIP_SIMILARITY, change: float = SKIP_CHANGE) -> DataFrame:
    """frames (run_id, timestamp, hist_rgb, thumb, ...) with `kept`, `similarity` and `change_ratio`.

    `kept` is false where recognition can be skipped, since the last recognised
    frame looks the same; skipped frames stay in the result. The two measures
    are null for the first frame of a run.
    """
    def keep(last: Row, row: Row) -> tuple:
        s, c = _similarity(last["hist_rgb"], row["hist_rgb"]), _changed(last["thumb"], row["thumb"])
        return not (s >= similar and c < change), s, c

    return keep_fold(frames, ["timestamp"], ["hist_rgb", "thumb"], keep, more="similarity double, change_ratio double")


def skip_method(kept: Column, similarity: Column, change: Column, model: str = "vision") -> Column:
    """How a frame's text came about: the model's name, or that it was skipped and why, with both measures."""
    why = F.format_string(SKIPPED, similarity, change)
    return F.when(kept, F.lit(model)).otherwise(why)
