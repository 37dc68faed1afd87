"""The sliding limiter as a stateful stream: requests decided in time order behind a watermark."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def decide(rows: Iterable[tuple], accepted: deque, limit: int, window_us: int) -> Iterator[tuple]:
    """The refused ones of (time, id) rows in order; ``accepted`` holds the accepted times and is brought up to date.

    At most ``limit`` times are held, as a refused request does not count later on.
    """
    for row in rows:
        now = row[0]
        while accepted and now - accepted[0] >= window_us:
            accepted.popleft()
        if len(accepted) >= limit:
            yield row
        else:
            accepted.append(now)


class SlidingLimiter(StatefulProcessor):
    """Refused requests of one client of one bucket.

    A request waits in the state until the watermark has passed its time, as only
    then no earlier one can arrive; those that are due are decided by time, then id.
    A timer at the first waiting request, or else at the moment the last accepted
    one leaves the window, wakes the client up without new requests; a client with
    neither leaves the state.
    """

    def __init__(self, limits: dict[str, int], window_us: int, id_type: str):
        self.limits, self.window_us, self.id_type = limits, window_us, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "times array<long>")
        self.waiting = handle.getListState("waiting", f"us long, request_id {self.id_type}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList(list(zip(batch["us"].tolist(), batch["request_id"].tolist())))
        yield self._due(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._due(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _due(self, key: tuple, watermark_us: int) -> pd.DataFrame:
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        accepted = deque(self.accepted.get()[0] if self.accepted.exists() else ())
        due = [r for r in rows if r[0] <= watermark_us]
        later = rows[len(due):]
        refused = list(decide(due, accepted, self.limits[key[0]], self.window_us))
        # every request still to come is later than the watermark
        while accepted and watermark_us - accepted[0] >= self.window_us:
            accepted.popleft()
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if accepted:
            self.accepted.update((list(accepted),))
        else:
            self.accepted.clear()
        if later or accepted:
            wake_us = later[0][0] if later else accepted[-1] + self.window_us
            self.handle.registerTimer(-(-wake_us // 1000))
        return pd.DataFrame(
            {"request_id": [r[1] for r in refused], "bucket": key[0], "client": key[1], "us": [r[0] for r in refused]},
            columns=["request_id", "bucket", "client", "us"])
