"""Keyed folds that run alike over a table and over a stream.

A fold takes a key's state, or None, and its new rows in order, and gives the new state, None to forget it, and output
rows. State is kept as JSON, so that it survives in a checkpoint whatever its form. Over a table, a key's rows come in
order and batch by batch, so a key of very many rows is never held whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Fold = Callable[[tuple, dict | None, list[dict]], tuple[dict | None, list[dict]]]
#: What a silent key's state becomes, and output rows, given the key, its state and the time in milliseconds.
Timer = Callable[[tuple, dict, int], tuple[dict | None, list[dict]]]


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _plain(value: Any) -> Any:
    """A key's value such that equal ones compare equal, missing ones too."""
    return None if value is None or value is pd.NaT or isinstance(value, float) and value != value else value


def fold_batch(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, schema: str) -> DataFrame:
    """The output of a fold over all rows of a table: one shuffle by key, and rows in order within it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        held: dict | None = None
        for frame in frames:
            out: list[dict] = []
            for key, rows in groupby(frame.to_dict("records"), lambda r: tuple(_plain(r[k]) for k in keys)):
                if key != now:
                    now, held = key, None
                held, more = fold(key, held, list(rows))
                out += more
            yield _frame(out, schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, schema: str, every_s: float = 0.0, timer: Timer | None = None) -> DataFrame:
    """The output of a fold over a stream; within a micro-batch rows are taken in ``order``.

    With a ``timer``, a key with state that has no rows for ``every_s`` seconds of processing time is handed to it, and
    again after as long.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            held, out = timer(key, held, state.getCurrentProcessingTimeMs()) if timer and held is not None else (held, [])
        else:
            rows = [r for f in frames for r in f.to_dict("records")]
            rows.sort(key=lambda r: tuple(r[c] for c in order))
            held, out = fold(key, held, rows)
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            if timer:
                state.setTimeoutDuration(max(1, int(every_s * 1000)))
        yield _frame(out, schema)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", timeout)
