"""The time-window operators over unbounded event streams, with watermarks.

The batch operators over the same rows give the same windows; a stream adds when
a window is final and when its state may go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_activity(events: DataFrame, key: str, ts: str, active: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """key, start, n and active_share of each window, final once the watermark has passed it.

    Rows later than ``late`` behind the newest are left out, as a closed window is
    never changed. ``slide`` gives overlapping windows.
    """
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg(F.col(active).cast("double")).alias("active_share"))
    return out.select(key, F.col("w.start").alias("start"), "n", "active_share")


def first_of_each(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The stream without repeated keys; a key is remembered until the watermark has passed it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def activity_runs(events: DataFrame, key: str, ts: str, active: str, late: str = "10 minutes") -> DataFrame:
    """key, active, start, n of each longest run of one state, put out when the run ends.

    State a key: the open run's state, start and length, so its size does not grow.
    A key without rows for ``late`` past its newest gives its open run. Rows of a
    key within a batch are put in order of time; later batches only extend.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            a, start, n = state.get
            state.remove()
            yield pd.DataFrame([(k[0], a, pd.Timestamp(start, unit="us"), n)], columns=["k", "active", "start", "n"])
            return
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        current = state.getOption
        done = []
        for t, a in zip(rows["t"], rows["a"], strict=True):
            if current is not None and bool(current[0]) == bool(a):
                current = (current[0], current[1], current[2] + 1)
            else:
                if current is not None:
                    done.append((k[0], bool(current[0]), pd.Timestamp(current[1], unit="us"), current[2]))
                current = (bool(a), int(t.value // 1000), 1)
        state.update(current)
        wait = pd.Timedelta(late)
        state.setTimeoutTimestamp(max(int(rows["t"].max().value // 10**6 + wait.value // 10**6), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["k", "active", "start", "n"])

    kind = dict(events.dtypes)[key]
    narrow = events.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(active).alias("a")).withWatermark("t", late)
    out = narrow.groupBy("k").applyInPandasWithState(run, f"k {kind}, active boolean, start timestamp, n long", "active boolean, start long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("k", key)
