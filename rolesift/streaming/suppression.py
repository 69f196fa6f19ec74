"""Suppression over an unbounded stream: who is notified, and who was lately."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def notify_stream(
    postings: DataFrame, days: int, key: str = "vacancy_key", at: str = "seen_at", late: str = "1 day"
) -> DataFrame:
    """Rows of the stream that are sent: ``key`` and ``at``.

    Per key the state is one number, the end of the running notice, and a timer removes
    it once the watermark has passed that end: no row that still counts can be held back
    by it, so the state holds the keys notified in the last ``days`` and ``late`` only.
    Rows of a micro-batch are taken in time order; a row earlier than the notice's end is
    suppressed, and one more than ``late`` behind the newest is not read. Only the times of a key reach Python, in
    Arrow batches: one number per row of the micro-batch, whose size the source bounds
    (for files, ``maxFilesPerTrigger``).
    """
    gap = timedelta(days=days)
    schema = f"{key} string, {at} timestamp"
    zone = postings.sparkSession.conf.get("spark.sql.session.timeZone")

    def send(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = pd.Timestamp(state.get[0]) if state.exists else None
        times = pd.concat([b[at].drop_duplicates() for b in batches]).drop_duplicates().sort_values()
        sent = []
        while len(times):
            if until is not None:
                times = times[times.searchsorted(until) :]
                if not len(times):
                    break
            sent.append(times.iloc[0])
            until = times.iloc[0] + gap
        if until is not None:
            end = int(until.tz_localize(zone, ambiguous=False, nonexistent="shift_forward").timestamp() * 1000)
            if end > state.getCurrentWatermarkMs():
                state.update((until.to_pydatetime(),))
                state.setTimeoutTimestamp(end)
            elif state.exists:
                state.remove()
        yield pd.DataFrame({key: [group[0]] * len(sent), at: pd.Series(sent, dtype="datetime64[ns]")})

    return (
        postings.select(key, at)
        .withWatermark(at, late)
        .groupBy(key)
        .applyInPandasWithState(send, schema, "until timestamp", "append", GroupStateTimeout.EventTimeTimeout)
    )
