"""The keyed store over a stream of operations.

Beyond parity: the reference has no streams.  State is a row per live key in Spark's state store;
the operation with the largest sequence number decides, whatever the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, live, value = state.get if state.exists else (-1, False, None)
    for f in frames:
        last = f.loc[f.seq.idxmax()]
        if int(last.seq) > seq:
            seq, live = int(last.seq), last.op == "set"
            value = float(last.v) if live and last.v is not None else None
    state.update((seq, live, value))
    yield pd.DataFrame({"k": [key[0]], "v": [value], "live": [live], "seq": [seq]})


def upserts(log: DataFrame) -> DataFrame:
    """Changes ``(k, v, live, seq)`` of a streaming ``log(seq long, op string, k long, v double)``."""
    return log.groupBy("k").applyInPandasWithState(
        _apply, "k long, v double, live boolean, seq long", "seq long, live boolean, v double", "update", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per key and window; rows later than the watermark are dropped."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
