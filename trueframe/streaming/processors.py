"""Per-key stateful processors.

State is a few numbers per key, whatever the key's traffic. Rows of one key
arrive in any order inside a micro-batch, so each batch is ordered by time
first; the source's batch limit bounds it. A row older than what an earlier
batch has settled for its key is late: it comes out marked, changes nothing,
and can be counted or replayed. No processing-time timer is set:
with one, a run-until-used-up trigger would never end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Ordered(StatefulProcessor):
    """Common part: one value state, batch ordering, and the newest row settled so far."""

    schema = ""
    order = ("at_us", "event_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", f"{self.schema}, newest_at bigint, newest_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(list(self.order), kind="stable")
        known = tuple(self.state.get()) if self.state.exists() else None
        if known:
            newest_at, newest_id = known[-2:]
            old = (batch["at_us"] < newest_at) | ((batch["at_us"] == newest_at) & (batch["event_id"] < newest_id))
            if old.any():
                yield self.late(key, batch[old]).assign(late=True)
                batch = batch[~old]
        if len(batch):
            out, new = self.advance(key, batch, known[:-2] if known else None)
            last = batch.iloc[-1]
            self.state.update((*new, int(last["at_us"]), int(last["event_id"])))
            yield out.assign(late=False)

    def late(self, key, rows) -> pd.DataFrame:
        """Output rows of late input."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Admission(Ordered):
    """At most ``limit`` admitted rows in the last ``window_us``; refused rows do
    not count. Rows older than the newest seen by more than ``late_us`` are
    reported as late and change nothing."""

    schema = "times array<bigint>, seen bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(list(self.order), kind="stable")
        out, new = self.advance(key, batch, self.state.get() if self.state.exists() else None)
        self.state.update(new)
        yield out

    output = "key bigint, event_id bigint, at_us bigint, outcome string, retry_after bigint"

    def __init__(self, limit: int, window_us: int, late_us: int | None = None):
        self.limit, self.window_us = limit, window_us
        self.late_us = window_us if late_us is None else late_us

    def advance(self, key, batch, known):
        times, seen = (list(known[0]), known[1]) if known else ([], None)
        outcome, retry = [], []
        for at in batch["at_us"]:
            at = int(at)
            if seen is not None and at < seen - self.late_us:
                outcome.append("late")
                retry.append(None)
                continue
            seen = at if seen is None else max(seen, at)
            times = [x for x in times if x > at - self.window_us]
            if len(times) >= self.limit:
                wait = times[0] + self.window_us - at
                outcome.append("refused")
                retry.append(max(1, -(-wait // 1_000_000)))
            else:
                times.append(at)
                outcome.append("admitted")
                retry.append(None)
        out = pd.DataFrame({"key": int(key[0]), "event_id": batch["event_id"].astype("int64"), "at_us": batch["at_us"].astype("int64"),
                            "outcome": outcome, "retry_after": pd.array(retry, dtype="Int64")})
        return out, (times, seen if seen is not None else 0)


class Coalesce(Ordered):
    """Rows of a key join the flight its first row opened until it has landed."""

    schema = "leader bigint, opened bigint"
    output = "key bigint, event_id bigint, leader bigint, opened_flight boolean, late boolean"

    def late(self, key, rows):
        return pd.DataFrame({"key": int(key[0]), "event_id": rows["event_id"].astype("int64"),
                             "leader": pd.array([None] * len(rows), dtype="Int64"), "opened_flight": pd.array([None] * len(rows), dtype="boolean")})

    def __init__(self, flight_us: int):
        self.flight_us = flight_us

    def advance(self, key, batch, known):
        leader, opened = known if known else (None, None)
        leaders, first = [], []
        for at, event in zip(batch["at_us"], batch["event_id"]):
            fresh = opened is None or int(at) >= opened + self.flight_us
            if fresh:
                leader, opened = int(event), int(at)
            leaders.append(leader)
            first.append(fresh)
        return pd.DataFrame({"key": int(key[0]), "event_id": batch["event_id"].astype("int64"), "leader": leaders,
                             "opened_flight": first}), (leader, opened)


class Runs(Ordered):
    """Runs of positive samples. A run is emitted when it closes, and the one
    still open after a batch is emitted as open, to be replaced later."""

    schema = "first bigint, n bigint, start bigint, last bigint, top double"
    output = "case_id bigint, first_event_id bigint, n bigint, first_nano bigint, last_nano bigint, max_score double, open boolean, late boolean"

    def late(self, key, rows):
        """A late sample as a run of no samples at its own position."""
        return pd.DataFrame({"case_id": int(key[0]), "first_event_id": rows["event_id"].astype("int64"), "n": 0, "first_nano": rows["nano"].astype("int64"),
                             "last_nano": rows["nano"].astype("int64"), "max_score": rows["score"].astype(float), "open": False})

    def __init__(self, max_gap_nano: int, threshold: float = 0.5):
        self.max_gap, self.threshold = max_gap_nano, threshold

    def advance(self, key, batch, known):
        run = list(known) if known and known[1] > 0 else None
        out = []
        for event, nano, score, valid in zip(batch["event_id"], batch["nano"], batch["score"], batch["valid"]):
            positive = bool(valid) and score >= self.threshold
            gap = int(nano) - run[3] if run else 0
            if run and not (positive and 0 < gap <= self.max_gap):
                out.append((*run, False))
                run = None
            if positive:
                if run:
                    run[1], run[3], run[4] = run[1] + 1, int(nano), max(run[4], float(score))
                else:
                    run = [int(event), 1, int(nano), int(nano), float(score)]
        if run:
            out.append((*run, True))
        frame = pd.DataFrame(out, columns=["first_event_id", "n", "first_nano", "last_nano", "max_score", "open"])
        frame.insert(0, "case_id", int(key[0]))
        return frame, tuple(run) if run else (0, 0, 0, 0, 0.0)


class ErrorStop(Ordered):
    """Emits a key once, at its ``length``-th identical consecutive error."""

    schema = "error string, streak int, stopped boolean"
    output = "case_id bigint, at_us bigint, event_id bigint, error string, late boolean"

    def late(self, key, rows):
        return pd.DataFrame({"case_id": int(key[0]), "at_us": rows["at_us"].astype("int64"), "event_id": rows["event_id"].astype("int64"), "error": rows["error"]})

    def __init__(self, length: int = 3):
        self.length = length

    def advance(self, key, batch, known):
        error, streak, stopped = known if known else (None, 0, False)
        out = []
        for at, event, now in zip(batch["at_us"], batch["event_id"], batch["error"]):
            if stopped:
                break
            streak = 0 if now is None or now != now else streak + 1 if now == error else 1
            error = None if streak == 0 else now
            if streak >= self.length:
                stopped = True
                out.append((int(key[0]), int(at), int(event), now))
        return pd.DataFrame(out, columns=["case_id", "at_us", "event_id", "error"]), (error, streak, stopped)
