"""Keyed state over streams of job states: changes, expiry, and activity of an append-only log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_CHANGE = "job_id string, old_state string, new_state string, at timestamp"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows where a job's state differs from the last one seen."""
    old = state.get[0] if state.exists else None
    out = []
    for rows in batches:
        for new, at in rows.sort_values("at", kind="stable")[["state", "at"]].itertuples(index=False):
            if new != old:
                out.append((key[0], old, new, at))
                old = new
    state.update((old,))
    yield pd.DataFrame(out, columns=["job_id", "old_state", "new_state", "at"])


def changes(stream: DataFrame) -> DataFrame:
    """(job_id, old_state, new_state, at) of a stream of polls (job_id, state, at); unchanged polls give nothing."""
    return stream.groupBy("job_id").applyInPandasWithState(_changes, _CHANGE, "state string", "append", GroupStateTimeout.NoTimeout)


def _expiring(seconds: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]]})
            return
        last = max((int(rows["at"].max().timestamp() * 1000) for rows in batches if len(rows)), default=None)
        if last is not None:
            last = max(last, state.get[0]) if state.exists else last  # an older batch doesn't shorten the time
            state.update((last,))
            state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": pd.Series([], dtype="object")})

    return run


def expired(stream: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """Ids of jobs of which nothing was heard for `seconds` of event time."""
    source = stream.withWatermark("at", late)
    return source.groupBy("job_id").applyInPandasWithState(_expiring(seconds), "job_id string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def activity(log: DataFrame, late: str | None = None) -> DataFrame:
    """Running activity per notebook of an append-only log."""
    source = log.withWatermark("timestamp", late) if late and log.isStreaming else log
    return source.where("notebook is not null").groupBy("notebook").agg(F.max("timestamp").alias("last_seen"), F.count_if(F.col("op") == "write").alias("writes"), F.count_if(F.col("op") == "read").alias("reads"))


def watched(stream: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "5 minutes"):
    """A running query that hands each batch of changes to on_change; it resumes from its checkpoint."""
    return changes(stream).writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
