"""Sessions as state of a stream: requests are folded as they come, with timers for their order, leases and expiry.

A request waits in its session's state until the watermark has passed its time, and is then applied in the order of its
number; so the result does not depend on how files and batches cut the stream.  A request that comes twice (same number)
counts once.  One that comes later than the watermark allows is dropped, as everywhere in the engine.  Requests of one
session must not go back in time as their numbers rise.

State of a session: status, revision, lease and the last number applied; the requests that wait; nothing else, so it
does not grow with the session's past.  Outcomes go out row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import ANALYZING, FAILED, FINALIZED, FINALIZING, REVIEW

#: The session setting that this needs: state in a store that holds several variables with timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

OUTCOMES = "session_id long, n long, result string, status string, revision long, lease double"
EXPIRED, LAPSED = "expired", "lease_lapsed"


@contextmanager
def provider(spark: SparkSession) -> Iterator[None]:
    """The session with PROVIDER set while a query is started and runs."""
    name, value = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Session(NamedTuple):
    status: str | None = None
    revision: int | None = None
    lease: float | None = None
    last: int = -1
    ends: float | None = None
    told: float | None = None  # the lease whose end has been told


class Request(NamedTuple):
    at: float
    request: str | None
    expected: int | None
    decision: str | None


def result_of(s: Session, r: Request) -> str:
    """What becomes of a request in a state."""
    match r.request:
        case "create":
            return "ok" if s.status is None else "invalid_state"
        case _ if s.status is None:
            return "not_found"
        case "claim":
            free = s.lease is None or s.lease < r.at
            return "ok" if s.status == FAILED or s.status == ANALYZING and free else "busy"
        case "complete":
            return "ok" if s.status == ANALYZING else "invalid_state"
        case "fail":
            return "ok" if s.status == ANALYZING else "ignored"
        case "decide":
            if s.status not in (REVIEW, FINALIZED):
                return "invalid_state"
            return "ok" if s.revision == r.expected else "stale_review"
        case "begin":
            if s.revision != r.expected:
                return "stale_review"
            if s.status == FINALIZING and (s.lease or 0) > r.at:
                return "busy"
            return "ok" if s.status in (REVIEW, FINALIZED, FINALIZING) else "invalid_state"
        case "finish":
            return "ok"
        case "abort":
            return "ok" if s.status == FINALIZING else "ignored"
    return "invalid_state"


def applied(s: Session, n: int, r: Request, lease: float) -> tuple[Session, str]:
    """The state after a request, and what became of it."""
    result = result_of(s, r)
    s = s._replace(last=n)
    if result != "ok":
        return s, result
    if r.request in ("create", "claim"):
        status = ANALYZING
    elif r.request == "fail":
        status = FAILED
    elif r.request == "begin":
        status = FINALIZING
    elif r.request == "finish" and r.decision != "FAIL":
        status = FINALIZED
    else:
        status = REVIEW
    revision = 0 if r.request == "create" else s.revision
    if r.request in ("complete", "decide"):
        revision += 1
    if r.request in ("claim", "begin"):
        until = r.at + lease
    else:
        until = s.lease if r.request == "decide" else None
    return s._replace(status=status, revision=revision, lease=until), result


def _plain(value: Any) -> Any:
    return None if value is None or value != value else value  # NaN stands for null in pandas


def _millis(seconds: float) -> int:
    return int(seconds * 1000)


def _ends(s: Session) -> list[tuple[int, str]]:
    """When, in milliseconds, a session's lease and the session itself will have ended, in that order of times."""
    out = []
    if s.lease is not None and s.lease != s.told and s.status in (ANALYZING, FINALIZING):
        out.append((_millis(s.lease) + 1, LAPSED))
    if s.ends is not None:
        out.append((_millis(s.ends) + 1, EXPIRED))
    return sorted(out)


class Fold(StatefulProcessor):
    """lease: seconds that a claim or a finalization holds.  keep: seconds from its creation after which a session goes, never if None."""

    def __init__(self, lease: float, keep: float | None):
        self.lease, self.keep = lease, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "status string, revision long, lease double, last long, ends double, told double")
        self.waiting = handle.getListState("waiting", "n long, at double, request string, expected long, decision string")

    def _session(self) -> Session:
        held = self.session.get()
        return Session() if held is None else Session(*held)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Keeps a batch's requests by one call, with one timer for the first that falls due: a call takes longer than a request's fold."""
        last, first = self._session().last, None
        for batch in rows:
            new = []
            for n, at, request, expected, decision in zip(*(batch[c].tolist() for c in ("n", "at", "request", "expected", "decision"))):
                if n > last:
                    expected = _plain(expected)
                    new.append((int(n), float(at), _plain(request), expected if expected is None else int(expected), _plain(decision)))
            if new:
                self.waiting.appendList(new)
                first = min([r[1] for r in new] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(_millis(first))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """All that is due by the watermark, in the order of its times; the batch's other timers of the session then find nothing to do."""
        now, state, out = timerValues.getCurrentWatermarkInMs(), self._session(), []

        def told(n: int | None, result: str) -> None:
            out.append((key[0], n, result, state.status, state.revision, state.lease))

        def due(until: int) -> None:
            """Leases and sessions that end by then."""
            nonlocal state
            for at, what in _ends(state):
                if at <= until and what == LAPSED:
                    told(None, LAPSED)
                    state = state._replace(told=state.lease)
                elif at <= until:
                    told(None, EXPIRED)
                    state = Session(last=state.last)

        waiting = {n: Request(*r) for n, *r in self.waiting.get()}  # of a number that came twice the last one
        rest = {n: r for n, r in waiting.items() if _millis(r.at) > now}
        for n, r in sorted((n, r) for n, r in waiting.items() if n not in rest):
            due(_millis(r.at))
            fresh = state.status is None
            state, result = applied(state, n, r, self.lease)
            if fresh and result == "ok" and self.keep is not None:
                state = state._replace(ends=r.at + self.keep)
            told(n, result)
        if rest and len(rest) < len(waiting):
            self.waiting.put([(n, *r) for n, r in rest.items()])
        elif not rest and waiting:
            self.waiting.clear()
        if rest:
            self.handle.registerTimer(_millis(min(r.at for r in rest.values())))
        due(now)
        if out:
            self.session.update(tuple(state))
            for at, _ in _ends(state):
                self.handle.registerTimer(at)
            yield pd.DataFrame(out, columns=["session_id", "n", "result", "status", "revision", "lease"])

    def close(self) -> None:
        pass


def outcomes(requests: DataFrame, lease: float = 300.0, keep: float | None = None, delay: str = "1 hour") -> DataFrame:
    """session_id, n, result, status, revision and lease: what became of each request, and the state after it.

    requests: a stream of session_id, n, ts (a timestamp), request, expected, decision, as sessions.folded() has them.  A lease that
    lapses and a session that ends, keep seconds after its creation, are rows with null n.  Rows that come more than delay
    after later ones may be dropped.  The session must have PROVIDER set.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # times in seconds of the clock that the stream shows, whatever the session's zone
    rows = timed.select("session_id", "ts", F.col("n").cast("long").alias("n"), (F.unix_micros("ts") / 1e6).alias("at"), "request", F.col("expected").cast("long").alias("expected"), "decision")
    fold = Fold(lease, keep)
    return rows.groupBy("session_id").transformWithStateInPandas(fold, OUTCOMES, "append", "eventTime")
