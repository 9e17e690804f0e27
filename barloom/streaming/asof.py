"""As-of join of a slow and a fast stream of bars: each fast bar with the last slow bar of an earlier day.

Both streams come as one, told apart by `side`. For each key the state holds the slow bars that a bar to come may need (the last one that is
usable, and later ones), the fast bars that wait for the watermark, and the last closes. A fast bar is given out when the
watermark has passed it, by an event-time timer, as no slow bar of an earlier day can come any more; rows later than the watermark are
dropped by Spark before they get here. A key that stays silent for `silent` after its last bar loses its state.

Bars of equal time and key: the slow bar with the higher close wins, fast bars are given out in order of close.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FAST, SLOW, CLOCK = 1, 0, 2
BAR = "key string, side int, ts timestamp, close double, volume long"
JOINED = "key string, ts timestamp, close double, d1_ts timestamp, d1_close double, d1_volume long, ma double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000)


class PreviousDay(StatefulProcessor):
    """The state of a key: slow bars, waiting fast bars and the last n closes, and when the key was last heard of."""

    def __init__(self, n: int, silent: timedelta) -> None:
        self.n, self.silent = n, int(silent.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slow = handle.getListState("slow", "ts timestamp, close double, volume long")
        self.fast = handle.getListState("fast", "ts timestamp, close double")
        self.closes = handle.getListState("closes", "close double")
        self.heard = handle.getValueState("heard", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        own = own[own["side"] != CLOCK].sort_values(["ts", "close"])
        if len(own):
            slow, fast = own[own["side"] == SLOW], own[own["side"] == FAST]
            for state, part, names in ((self.slow, slow, ["ts", "close", "volume"]), (self.fast, fast, ["ts", "close"])):
                if len(part):
                    state.appendList([tuple(x) for x in part[names].astype(object).itertuples(index=False)])
            for t in {_ms(t) for t in fast["ts"]}:
                self.handle.registerTimer(t)
            last = max(_ms(own["ts"].max()), self.heard.get()[0] if self.heard.exists() else 0)
            self.heard.update((last,))
            self.handle.registerTimer(last + self.silent)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.fast.get()) if self.fast.exists() else []
        due, rest = [x for x in waiting if _ms(pd.Timestamp(x[0])) <= now], [x for x in waiting if _ms(pd.Timestamp(x[0])) > now]
        if due:
            yield self._joined(key[0], due, rest, pd.Timestamp(now, unit="ms"))
        if not rest and self.heard.exists() and self.heard.get()[0] + self.silent <= now:
            for state in (self.slow, self.fast, self.closes, self.heard):
                state.clear()

    def _joined(self, key: str, due: list[tuple], rest: list[tuple], now: pd.Timestamp) -> pd.DataFrame:
        slow = sorted(self.slow.get()) if self.slow.exists() else []
        closes = [x[0] for x in self.closes.get()] if self.closes.exists() else []
        out, at, last = [], 0, (None, None, None)
        for t, x in due:
            while at < len(slow) and pd.Timestamp(slow[at][0]).normalize() < pd.Timestamp(t).normalize():
                last, at = slow[at], at + 1
            closes = [*closes, x][-self.n :]
            out.append((key, t, x, *last, sum(closes) / self.n if len(closes) == self.n else None))
        kept = slow[max(0, at - 1) :]  # the last usable one, and those of later days
        for state, rows in ((self.slow, kept), (self.fast, rest), (self.closes, [(x,) for x in closes])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        return pd.DataFrame(out, columns=["key", "ts", "close", "d1_ts", "d1_close", "d1_volume", "ma"]).astype({"d1_volume": "Int64"})

    def close(self) -> None:
        pass


def united(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Bars of both sides as rows of BAR."""
    of = lambda df, side: df.select("key", F.lit(side).alias("side"), F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close"), F.col("volume").cast("long").alias("volume"))
    return of(fast, FAST).unionByName(of(slow, SLOW))


def clock(spark: SparkSession, at) -> DataFrame:
    """A row that only moves the watermark on, for the end of a bounded stream."""
    return spark.createDataFrame([(None, CLOCK, at, None, None)], BAR)


def stream_previous_day(bars: DataFrame, *, late: str = "1 hour", n: int = 20, silent: timedelta = timedelta(days=30)) -> DataFrame:
    """Rows of JOINED, in append mode, of a stream of united() bars. ma: mean of the last n closes. Needs the RocksDB state store."""
    timed = bars.withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(PreviousDay(n, silent), JOINED, "Append", "EventTime")
