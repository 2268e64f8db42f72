"""Rolling buffers over streams: the last rows of each key as state, and statistics over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows that a component's buffer holds.
ROWS = 1000
STATISTICS = "n long, total long, least long, most long, first_id long, last_id long"


def _last(rows: np.ndarray, size: int) -> np.ndarray:
    """The last rows (ts, id, value) in order of time, then id, then value; a repeated row counts once."""
    rows = np.unique(rows, axis=0)
    return rows[-size:]


def _trimmed(key: str, size: int):
    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(["ts", "id", "value"]).drop_duplicates().groupby(key, sort=False).tail(size)

    return trim


def rolling(stream: DataFrame, key: str, size: int = ROWS) -> DataFrame:
    """key and STATISTICS of its last ``size`` rows, anew whenever rows of the key arrive.

    ``stream``: key (string), ts (timestamp), id (long, the row's own), value (long). Rows count by their
    time, then id, wherever they stand in the stream: a late row takes its place in the buffer if it is
    among the last ones, else it changes nothing. A row that comes twice counts once. Before the
    shuffle each batch is cut down to a buffer for each key, so a hot key costs a task few rows."""
    rows = stream.select(F.col(key).cast("string").alias(key), F.unix_micros("ts").alias("ts"), "id", "value").where(f"{key} is not null and ts is not null and id is not null and value is not null")
    schema = f"{key} string, ts long, id long, value long"

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], np.int64).reshape(-1, 3) if state.exists else np.zeros((0, 3), np.int64)
        for batch in batches:
            held = _last(np.concatenate((held, batch[["ts", "id", "value"]].to_numpy(np.int64))), size)
        state.update((held.tobytes(),))
        value = held[:, 2]
        yield pd.DataFrame({key: [name[0]], "n": [len(held)], "total": [int(value.sum())], "least": [int(value.min())], "most": [int(value.max())], "first_id": [int(held[0, 1])], "last_id": [int(held[-1, 1])]})

    cut = rows.mapInPandas(_trimmed(key, size), schema)
    return cut.groupBy(key).applyInPandasWithState(step, f"{key} string, {STATISTICS}", "held binary", "update", GroupStateTimeout.NoTimeout)
