"""Model replies in JSON of many shapes, repaired to rows; requests as JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .latex import latex_to_text

# The keys under which lists of items and their texts are looked for, in this order.
LIST_KEYS = ["results", "fused_segments", "segments", "items"]
TEXT_KEYS = ["text", "sentence", "content", "result"]


def _items(value) -> list | None:
    """The list of items in a parsed reply."""
    if isinstance(value, list):
        return value
    if not isinstance(value, dict):
        return None
    named = [value[k] for k in LIST_KEYS if isinstance(value.get(k), list)]
    if named:
        return named[0]
    if {"id", "fused"} <= value.keys():
        return [value]
    return next((v for v in value.values() if isinstance(v, list) and v), [value])


def _as_text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def repaired(replies: DataFrame, batch_size: int = 4) -> DataFrame:
    """(run_id, batch_id, pos, id, fused, error) of replies (run_id, batch_id, content).

    Items that aren't objects are left out. An item without an id takes its
    place in the reply, counted from the start of its batch; one without a
    text under any known key, and a reply that isn't JSON, give an empty text
    and an error.
    """
    def parse(frames):
        for f in frames:
            out = []
            for run, batch, content in f.itertuples(index=False):
                try:
                    items = _items(json.loads(content if isinstance(content, str) else ""))
                except ValueError:
                    items = None
                if items is None:
                    out.append((run, batch, 0, None, None, "unreadable reply"))
                    continue
                for pos, item in enumerate(items):
                    if isinstance(item, dict):
                        keys = [k for k in ("fused", *TEXT_KEYS) if k in item]
                        number = item.get("id", batch * batch_size + pos)
                        number = int(number) if isinstance(number, (int, float)) or str(number).strip().lstrip("-").isdigit() else None
                        out.append((run, batch, pos, number, _as_text(item[keys[0]]) if keys else None, None if keys else "no text"))
            yield pd.DataFrame(out, columns=["run_id", "batch_id", "pos", "id", "fused", "error"]).astype({"id": "Int64"})

    kinds = dict(replies.dtypes)
    rows = replies.select("run_id", "batch_id", "content").mapInPandas(parse, f"run_id {kinds['run_id']}, batch_id {kinds['batch_id']}, pos int, id long, fused string, error string")
    return rows.withColumn("fused", latex_to_text(F.col("fused")))


def request(items: Column) -> Column:
    """The JSON of a batch, as a model is asked."""
    return F.to_json(items)


def shown(fused: Column, error: Column, id: Column) -> Column:
    """The text to show: errors are texts only here."""
    return F.when(error.isNull(), fused).otherwise(F.concat(F.lit("[Error: "), error, F.lit(" for segment "), F.coalesce(id.cast("string"), F.lit("?")), F.lit("]")))
