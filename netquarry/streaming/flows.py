"""Flows from a stream of packets, with state by key.

A key's state is the open flow: its first and last time, its packets' count and sums. A gap, an
active limit and a size limit close it as in the batch operator; when the watermark has passed the
last packet by the idle time, a timeout closes it without waiting for another packet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FLOW = "key string, first_us bigint, last_us bigint, packets bigint, bytes double, closure string"
STATE = "first_us bigint, last_us bigint, packets bigint, bytes double"


def sessions(stream: DataFrame, key: str, time: str, length: str, idle_us: int, active_us: int, size: int, lateness: str = "0 seconds") -> DataFrame:
    """Closed flows of a stream with a timestamp column time, as FLOW; append mode. Packets older than the watermark are dropped by
    Spark before they come here; within a batch they are taken in order of time."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        close = lambda s, why: out.append((k[0], *s, why))
        current = state.get if state.exists else None
        if state.hasTimedOut:
            close(current, "IDLE_TIMEOUT")
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("us", kind="stable")
            for us, n in zip(rows["us"].tolist(), rows["bytes"].tolist(), strict=True):
                if current is not None:
                    first, last, count, _ = current
                    why = "IDLE_TIMEOUT" if us - last >= idle_us else "PACKET_LIMIT" if count >= size else "ACTIVE_TIMEOUT" if us - first >= active_us else None
                    if why:
                        close(current, why)
                        current = None
                current = (us, us, 1, n) if current is None else (current[0], max(us, current[1]), current[2] + 1, current[3] + n)
            state.update(current)
            state.setTimeoutTimestamp(max(current[1] + idle_us, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000)
        yield pd.DataFrame(out, columns=["key", "first_us", "last_us", "packets", "bytes", "closure"])

    rows = stream.withWatermark(time, lateness).select(
        F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(time).alias("us"), F.col(length).cast("double").alias("bytes")
    )
    return rows.groupBy("key").applyInPandasWithState(update, FLOW, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def idle_windows(stream: DataFrame, key: str, time: str, length: str, idle: str, lateness: str = "0 seconds") -> DataFrame:
    """Sessions by idle gap alone, in built-in operators: key, first, last (the window's end), packets, bytes."""
    w = F.session_window(time, idle)
    out = stream.withWatermark(time, lateness).groupBy(key, w.alias("w")).agg(F.count("*").alias("packets"), F.sum(length).alias("bytes"))
    return out.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "packets", "bytes")


def running_confusion(stream: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The confusion matrix so far: complete mode."""
    return stream.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
