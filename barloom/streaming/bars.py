"""Bars and features on streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sources.bars import bars

FEATURES = "key string, ts timestamp, close double, ma double, change double, streak int, n long"
STATE = "closes array<double>, streak int, n long"


def stream_bars(events: DataFrame, every: str = "4 hours", late: str = "1 hour", *, key: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Finished bars in append mode; events later than the watermark are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return bars(timed, every, key=key, ts=ts, value=value, tie=tie)


def stream_features(finished: DataFrame, n: int = 20) -> DataFrame:
    """Trailing mean of n closes, change and run of rising closes of each finished bar; state holds n closes for each key."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closes, streak, count = state.get if state.exists else ([], 0, 0)
        closes = list(closes)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts")
        for t, x in zip(rows["ts"], rows["close"]):
            change = x / closes[-1] - 1 if closes and closes[-1] else None
            streak = streak + 1 if closes and x > closes[-1] else 0
            closes, count = [*closes, float(x)][-n:], count + 1
            out.append((key[0], t, x, sum(closes) / n if len(closes) == n else None, change, streak, count))
        state.update((closes, streak, count))
        yield pd.DataFrame(out, columns=["key", "ts", "close", "ma", "change", "streak", "n"])

    return finished.select("key", "ts", "close").groupBy("key").applyInPandasWithState(update, FEATURES, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
