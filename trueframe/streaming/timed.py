"""Stateful processors that go by event time.

Rows of a key wait in a list until the watermark has passed them; then they are
worked off in time order, so the result does not depend on which micro-batch or
file brought them. A row that comes when the watermark has passed its time is
late: it leaves at once, marked, and changes nothing. One timer per key stands
at its earliest waiting row, or, if none waits, where its state stops mattering;
there the key is closed and its state removed. The watermark belongs to a copy
of the time column that the processors do not see, so Spark drops no late row.

A key's due rows are arrays; the rules jump from one decision to the next by
binary search, so a rule costs its decisions (admitted rows, opened flights)
and not its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_folder
from .jobs import ROCKSDB, to_files

MILLI = 1000


class Timed(StatefulProcessor):
    """Waiting rows, one state, one timer.

    A rule gives ``waits`` (the columns that wait), ``schema`` (its state),
    ``output``, and ``settle``; ``idle_us`` after the last settled row its state
    cannot matter any more.
    """

    waits = "at_us bigint, event_id bigint"
    schema = ""
    output = ""
    idle_us = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.state = handle.getValueState("state", f"{self.schema}, newest_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        columns = [c.split()[0] for c in self.waits.split(", ")]
        first = None
        for batch in rows:
            late = -(-batch["at_us"] // MILLI) <= passed
            if late.any():
                yield self.late(key, batch[late]).assign(late=True)
            batch = batch.loc[~late, columns]
            if len(batch):
                self.waiting.appendList([tuple(None if pd.isna(v) else v for v in r) for r in batch.astype(object).itertuples(index=False)])
                soonest = int(-(-batch["at_us"].min() // MILLI))
                first = soonest if first is None else min(first, soonest)
        if first is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        columns = [c.split()[0] for c in self.waits.split(", ")]
        rows = pd.DataFrame([tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [], columns=columns)
        due = -(-rows["at_us"].astype("int64") // MILLI) <= passed
        known = tuple(self.state.get()) if self.state.exists() else None
        if due.any():
            ready = rows[due].sort_values(["at_us", "event_id"], kind="stable")
            out, new = self.settle(key, ready, known[:-1] if known else None)
            known = (*new, int(ready["at_us"].iloc[-1]))
            yield out.assign(late=False)
        rest = rows[~due]
        ends = -(-(known[-1] + self.idle_us) // MILLI) if known else None
        if not len(rest) and known and ends <= passed:
            yield from self.closed(key, known[:-1])
            self.state.clear()
            self.waiting.clear()
            return
        if due.any():
            self.state.update(known)
            if len(rest):
                self.waiting.put([tuple(None if pd.isna(v) else v for v in r) for r in rest.astype(object).itertuples(index=False)])
            else:
                self.waiting.clear()
        if len(rest):
            self.handle.registerTimer(int(-(-int(rest["at_us"].min()) // MILLI)))
        elif known:
            self.handle.registerTimer(int(ends))

    def settle(self, key, rows: pd.DataFrame, known: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """Output of rows in time order, and the new state."""
        raise NotImplementedError

    def late(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        """Output of late rows."""
        raise NotImplementedError

    def closed(self, key, known: tuple) -> Iterator[pd.DataFrame]:
        """Output of a key whose state goes."""
        return iter(())

    def close(self) -> None:
        pass


class TimedAdmission(Timed):
    """At most ``limit`` admitted rows in any ``window_us``; refused rows do not count.

    Between two admissions nothing is decided but waiting times: a full window
    opens again at its oldest admission plus ``window_us``, found by binary search.
    """

    schema = "times array<bigint>"
    output = "key bigint, event_id bigint, at_us bigint, outcome string, retry_after bigint, late boolean"

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us, self.idle_us = limit, window_us, window_us

    def settle(self, key, rows, known):
        at = rows["at_us"].to_numpy(np.int64)
        times = list(known[0]) if known else []
        opens = np.full(len(at), -1, np.int64)  # when the window of a refused row opens
        i = 0
        while i < len(at):
            times = [t for t in times if t > at[i] - self.window_us]
            if len(times) < self.limit:
                times.append(int(at[i]))
                i += 1
                continue
            until = times[0] + self.window_us
            j = int(np.searchsorted(at, until, side="left"))
            opens[i:j] = until
            i = j
        refused = opens >= 0
        retry = np.maximum(1, -(-(opens - at) // 1_000_000))
        return self._out(key, rows, np.where(refused, "refused", "admitted"), pd.array(np.where(refused, retry, 0), "Int64").copy(), ~refused), (times,)

    def late(self, key, rows):
        return self._out(key, rows, "late", pd.array(np.zeros(len(rows)), "Int64"), np.ones(len(rows), bool))

    @staticmethod
    def _out(key, rows, outcome, retry, without):
        retry[without] = pd.NA
        return pd.DataFrame({"key": int(key[0]), "event_id": rows["event_id"].astype("int64"), "at_us": rows["at_us"].astype("int64"),
                             "outcome": outcome, "retry_after": retry})


class TimedCoalesce(Timed):
    """Rows join the flight that the first of them opened until it has landed."""

    schema = "leader bigint, opened bigint"
    output = "key bigint, event_id bigint, leader bigint, opened_flight boolean, late boolean"

    def __init__(self, flight_us: int):
        self.flight_us = self.idle_us = flight_us

    def settle(self, key, rows, known):
        at, event = rows["at_us"].to_numpy(np.int64), rows["event_id"].to_numpy(np.int64)
        leader, opened = known if known else (None, None)
        leaders, first = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        i = 0
        while i < len(at):
            j = int(np.searchsorted(at, opened + self.flight_us, side="left")) if opened is not None else i
            leaders[i:j] = leader if leader is not None else 0
            if j < len(at):
                leader, opened, first[j], leaders[j] = int(event[j]), int(at[j]), True, event[j]
                j += 1
            i = j
        return pd.DataFrame({"key": int(key[0]), "event_id": event, "leader": leaders, "opened_flight": first}), (leader, opened)

    def late(self, key, rows):
        nothing = [None] * len(rows)
        return pd.DataFrame({"key": int(key[0]), "event_id": rows["event_id"].astype("int64"),
                             "leader": pd.array(nothing, "Int64"), "opened_flight": pd.array(nothing, "boolean")})


class TimedRuns(Timed):
    """Runs of positive samples, each emitted once, when a row or silence ends it.

    A run ends by the next sample in time that is not positive or lies too far
    from it, and otherwise when the case has been silent for ``idle_us``.
    """

    waits = "at_us bigint, event_id bigint, nano bigint, score double, valid boolean"
    schema = "first bigint, n bigint, start bigint, last bigint, top double"
    output = "case_id bigint, first_event_id bigint, n bigint, first_nano bigint, last_nano bigint, max_score double, late boolean"
    columns = ["first_event_id", "n", "first_nano", "last_nano", "max_score"]

    def __init__(self, max_gap_nano: int, idle_us: int, threshold: float = 0.5):
        self.max_gap, self.idle_us, self.threshold = max_gap_nano, idle_us, threshold

    def settle(self, key, rows, known):
        nano, score = rows["nano"].to_numpy(np.int64), rows["score"].to_numpy(float)
        event = rows["event_id"].to_numpy(np.int64)
        good = rows["valid"].to_numpy(bool) & (score >= self.threshold)
        was_good = np.concatenate([[bool(known and known[1])], good[:-1]])
        before = np.concatenate([[known[3] if known else 0], nano[:-1]])
        gap = nano - before
        linked = good & was_good & (gap > 0) & (gap <= self.max_gap)
        number = np.cumsum(good & ~linked)  # 0: the run that was open before
        no, event, t, top = number[good], event[good], nano[good], score[good]
        begin = np.flatnonzero(np.diff(no, prepend=-1))
        ends = np.append(begin[1:], len(no))[:len(begin)] - 1
        tops = np.maximum.reduceat(top, begin) if len(begin) else top
        runs = list(zip(no[begin].tolist(), event[begin].tolist(), (ends - begin + 1).tolist(), t[begin].tolist(), t[ends].tolist(), tops.tolist()))
        if known and known[1]:
            if runs and runs[0][0] == 0:
                _, _, n, _, last, top = runs[0]
                runs[0] = (0, known[0], known[1] + n, known[2], last, max(known[4], top))
            else:
                runs.insert(0, (0, *known))
        still = bool(good[-1])
        done = [r[1:] for r in (runs[:-1] if still else runs)]
        state = tuple(runs[-1][1:]) if still else (0, 0, 0, 0, 0.0)
        return self._frame(key, done), state

    def closed(self, key, known):
        if known[1]:
            yield self._frame(key, [known]).assign(late=False)

    def _frame(self, key, runs):
        out = pd.DataFrame(runs, columns=self.columns).astype({c: "int64" for c in self.columns[:4]} | {"max_score": float})
        out.insert(0, "case_id", int(key[0]))
        return out

    def late(self, key, rows):
        """A late sample as a run of no samples at its own position."""
        return pd.DataFrame({"case_id": int(key[0]), "first_event_id": rows["event_id"].astype("int64"), "n": 0, "first_nano": rows["nano"].astype("int64"),
                             "last_nano": rows["nano"].astype("int64"), "max_score": rows["score"].astype(float)})


class TimedErrorStop(Timed):
    """A case once, at its ``length``-th identical error in a row; a case silent for ``idle_us`` starts anew."""

    waits = "at_us bigint, event_id bigint, error string"
    schema = "error string, streak int, stopped boolean"
    output = "case_id bigint, at_us bigint, event_id bigint, error string, late boolean"

    def __init__(self, length: int, idle_us: int):
        self.length, self.idle_us = length, idle_us

    def settle(self, key, rows, known):
        error, streak, stopped = known if known else (None, 0, False)
        now = rows["error"].astype(object).where(rows["error"].notna(), None)
        same = (now == now.shift(fill_value=error)) & now.notna()
        block = (~same).cumsum()
        place = same.astype(int).groupby(block).cumsum() + now.notna().astype(int)
        # rows that go on from the state count on from its streak
        place = place.where(block > 0, place - 1 + streak)
        hits = np.flatnonzero((place >= self.length).to_numpy() & now.notna().to_numpy())
        hits = hits[:0 if stopped else 1]
        out = rows.iloc[hits][["at_us", "event_id", "error"]].astype({"at_us": "int64", "event_id": "int64"})
        out.insert(0, "case_id", int(key[0]))
        last = now.iloc[-1]
        return out, (last, int(place.iloc[-1]) if last is not None else 0, bool(stopped or len(hits)))

    def late(self, key, rows):
        return pd.DataFrame({"case_id": int(key[0]), "at_us": rows["at_us"].astype("int64"), "event_id": rows["event_id"].astype("int64"), "error": rows["error"]})


def by_time(stream: DataFrame, key: str, processor: Timed, delay: str = "0 seconds") -> DataFrame:
    """Rows of a stream through a processor; ``delay`` is how far rows may be out of order.

    A row without a key moves the watermark and does nothing else.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    columns = [c.split()[0] for c in processor.waits.split(", ")]
    marked = stream.withColumn("_time", F.timestamp_micros("at_us")).withWatermark("_time", delay)
    # the condition names the time, so that it stays behind the watermark
    keyed = marked.filter(F.when(F.col("_time").isNotNull(), F.col(key).isNotNull()).otherwise(True))
    return keyed.select(key, *columns).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="EventTime")


def finished(stream: DataFrame, through, name: str, tick_us: int = 1 << 52) -> DataFrame:
    """Output of a stream that has come to its end.

    What has come is worked off first; then one row in the far future, which no
    result keeps, moves the watermark, and every waiting row and open key is
    settled. ``through`` makes the query from the stream with that row's source.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    spark.createDataFrame([], shape).write.parquet(f"{folder}/ticks/0")
    ticks = spark.readStream.schema(shape).parquet(f"{folder}/ticks/*")
    out = through(stream.unionByName(ticks))
    to_files(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    tick = {f.name: None for f in shape} | {"at_us": tick_us, "event_id": -1}
    spark.createDataFrame([tuple(tick[f.name] for f in shape)], shape).write.parquet(f"{folder}/ticks/1")
    to_files(through(stream.unionByName(ticks)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
