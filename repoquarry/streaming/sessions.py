"""Session assembly as a Structured Streaming query with per-session state."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from repoquarry import rules
from repoquarry.operators.grouping import CHUNK
from repoquarry.operators.sessions import TERMINATORS, assemble_sessions

OUTPUT_SCHEMA = "session_id string, status string, text string"
EVENT_SCHEMA = "seq bigint, ms bigint, type string, text string"
# first event's time; the end known so far and its time; closed: the result went out, what is left is a mark
CLOCK_SCHEMA = "first bigint, end_seq bigint, end_ms bigint, closed boolean"
RETENTION_SECONDS = 3600
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(mode: str, milliseconds: int, retention: int) -> StatefulProcessor:
    """The processor; nested and fed with plain values so executors get it by value.

    Events are a list that only grows by appending; those whose text does not count are held without it.  A session that is
    finished by the events of one call leaves none.  The clock is
    one small value.  A session is finished when all numbers from 0 to its end are there, or when the watermark has passed
    the one timer, set at the end known so far or else at the deadline: nothing earlier can come any more.  The
    result is made from all events in the session's order, by the same rules as in batch.
    """
    terminators = TERMINATORS[mode]
    delta_type, message_type, error_type = rules.EVENT_DELTA, rules.EVENT_MESSAGE, rules.EVENT_ERROR
    remote = mode == "remote"
    held_at_most = CHUNK

    class Sessions(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.events = handle.getListState("events", EVENT_SCHEMA)
            self.clock = handle.getValueState("clock", CLOCK_SCHEMA)

        def _set_timer(self, at: int, known: bool = True) -> None:
            # a session that is new here has no timer
            for old in list(self.handle.listTimers()) if known else ():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

        # every call of the state is a round trip to the JVM: what a session needs not leave for later calls is not put there
        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            before = self.clock.get()
            known, new = before is not None, []
            first, end_seq, end_ms, closed = before if known else (None, None, None, False)
            stored = known
            for frame in rows:
                if closed:
                    continue
                earliest = int(frame["ms"].min())
                first = earliest if first is None else min(first, earliest)
                for seq, ms, kind, content, delta in zip(*(frame[name].tolist() for name in ("seq", "ms", "type", "content", "delta"))):
                    if not ms < first + milliseconds:
                        continue
                    text = content if kind == message_type else delta if remote else ""
                    new.append((seq, ms, kind, text if isinstance(text, str) else ""))
                    if kind in terminators and (end_seq is None or seq < end_seq):
                        end_seq, end_ms = seq, ms
                if len(new) >= held_at_most:
                    self.events.appendList(new)
                    stored, new = True, []
            if closed:
                return
            if end_ms is not None and end_ms >= first + milliseconds:
                end_seq = end_ms = None  # an earlier first event took the end out of time; at the deadline all are looked at
            if end_seq is not None:
                held = [*self.events.get(), *new] if stored else new
                events = sorted(e for e in held if e[1] < first + milliseconds)
                if len({e[0] for e in events if 0 <= e[0] <= end_seq}) == end_seq + 1:
                    yield self._finish(key, first, events, timerValues, known, stored)
                    return
            if new:
                self.events.appendList(new)
            self.clock.update((first, end_seq, end_ms, False))
            self._set_timer(first + milliseconds if end_ms is None else end_ms, known)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            first, _, _, closed = self.clock.get()
            if closed:
                self.clock.clear()
                return
            held = self.events.get() if self.events.exists() else ()
            yield self._finish(key, first, sorted(e for e in held if e[1] < first + milliseconds), timerValues)

        def _finish(self, key, first: int, events: list, timerValues, known: bool = True, stored: bool = True) -> pd.DataFrame:
            end = next((e for e in events if e[2] in terminators), None)
            inside = events if end is None else [e for e in events if e[0] < end[0]]
            status = "timeout" if end is None else "error" if end[2] == error_type else "ok"
            if remote:
                message = end[3] if end is not None and end[2] == message_type else ""
                text = message or "".join(e[3] for e in inside if e[2] == delta_type)
            else:
                text = next((e[3] for e in reversed(inside) if e[2] == message_type), "")
            if stored:
                self.events.clear()
            self.clock.update((first, None, None, True))
            self._set_timer(max(first + milliseconds, timerValues.getCurrentWatermarkInMs()) + retention, known)
            return pd.DataFrame({"session_id": [key[0]], "status": [status], "text": [text]})

        def close(self) -> None:
            pass

    return Sessions()


def stream_sessions(
    events: DataFrame,
    mode: str = "remote",
    seconds: int = rules.SESSION_SECONDS,
    lateness: str = "10 seconds",
    retention: int = RETENTION_SECONDS,
) -> DataFrame:
    """Streaming counterpart of `assemble_sessions`: append one row per session as sessions end.

    A session goes out as soon as all events numbered from 0 to its end are there, else when the watermark (the latest
    time seen, less `lateness`) has passed its end, or its deadline `seconds` after its first event.  Until then events may come in any order and any cut into micro-batches; the
    result is that of the batch form as long as, within a session, an event with a smaller `seq` is not younger and none is
    later than the watermark.  A session that went out leaves a mark for `retention` seconds, so events that arrive
    until then cannot start it anew.

    State is kept in RocksDB, which lists and timers need: set `spark.sql.streaming.stateStore.providerClass` to
    `STATE_STORE` in the session that starts the query (`run_available` does).
    """
    timed = events.withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts"))
    columns = timed.select("session_id", "seq", "ts", "ms", "type", "content", "delta")
    return columns.groupBy("session_id").transformWithStateInPandas(
        _processor(mode, seconds * 1000, retention * 1000),
        OUTPUT_SCHEMA,
        "append",
        "eventTime",
    )


def with_unfinished(results: DataFrame, events: DataFrame, mode: str = "remote", seconds: int = rules.SESSION_SECONDS) -> DataFrame:
    """What a stream has put out, and the sessions still open in it, assembled from the same events in batch.

    For a closed input: its last sessions end when no later event moves the watermark past their end.
    """
    opened = events.join(results.select("session_id"), "session_id", "left_anti")
    return results.unionByName(assemble_sessions(opened, mode, seconds))


def run_available(results: DataFrame, output: str, checkpoint: str) -> None:
    """Process everything available now into Parquet at `output`, then stop.

    Both paths belong on shared storage: progress survives the loss of any
    executor, and of the driver.  The session's state store setting is put back afterwards.
    """
    conf, name = results.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STATE_STORE)
    try:
        query = (
            results.writeStream.format("parquet")
            .option("path", output)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
