"""Account lockout as stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lattica.operators.accounts import attempt

_OUT = "user_id string, at timestamp, outcome string, failed_attempts int, locked_until timestamp"
_STATE = "failed_attempts int, locked_until timestamp"


def lockouts(attempts: DataFrame, timeout_days: int = 30, late: str = "1 hour") -> DataFrame:
    """Every login attempt with its outcome.

    `attempts` is a stream of (user_id string, at timestamp, success boolean).
    The state of a user is two values; users without attempts for
    `timeout_days` of event time are forgotten, attempts later than `late` are dropped.  Attempts of one user are judged in time
    order within a micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failed, until = state.get if state.exists else (0, None)
        until = None if pd.isna(until) else pd.Timestamp(until).value // 1000
        out = []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for at, success in zip(rows["at"], rows["success"]):
            outcome, failed, until = attempt(failed, until, at.value // 1000, bool(success))
            out.append((key[0], at, outcome, failed, None if until is None else pd.Timestamp(until, unit="us")))
        state.update((failed, None if until is None else pd.Timestamp(until, unit="us")))
        newest = int(rows["at"].iloc[-1].timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + timeout_days * 86_400_000)
        frame = pd.DataFrame(out, columns=["user_id", "at", "outcome", "failed_attempts", "locked_until"])
        frame["locked_until"] = pd.to_datetime(frame["locked_until"])
        yield frame

    # Event-time timeouts let a stream that is run to its end stop; processing-time ones never do.
    timed = attempts.withWatermark("at", late)
    return timed.groupBy("user_id").applyInPandasWithState(run, _OUT, _STATE, "append", "EventTimeTimeout")
