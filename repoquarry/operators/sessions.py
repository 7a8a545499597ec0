"""Model sessions: assemble event logs into one text and status per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.operators.grouping import concat_slices, ordered_concat, slice_of, spread_join

STATUS_OK = "ok"
STATUS_ERROR = "error"
STATUS_TIMEOUT = "timeout"

TERMINATORS = {
    "remote": (rules.EVENT_MESSAGE, rules.EVENT_IDLE, rules.EVENT_ERROR),
    "local": (rules.EVENT_IDLE, rules.EVENT_ERROR),
}


def _deadline(seconds: int):
    return F.col("started") + F.make_dt_interval(secs=F.lit(seconds))


def _slice_starts(events: DataFrame) -> DataFrame:
    """(session_id, slice, started): earliest time per slice of CHUNK positions; reads no text."""
    return events.groupBy("session_id", slice_of("seq").alias("slice")).agg(F.min("ts").alias("started"))


def events_in_time(events: DataFrame, seconds: int = rules.SESSION_SECONDS) -> DataFrame:
    """Events before the absolute deadline: `seconds` after the first event of their session."""
    starts = events.groupBy("session_id").agg(F.min("ts").alias("started"))
    return spread_join(events, starts, ["session_id"], "seq").where(F.col("ts") < _deadline(seconds)).drop("started")


def session_bounds(
    events: DataFrame, mode: str = "remote", seconds: int = rules.SESSION_SECONDS, with_content: bool = False
) -> DataFrame:
    """(session_id, deadline, end_seq, end_type, end_content): where each session stops.

    The end is the first closing event before the deadline; its columns are
    NULL for a session without one, and its text is only read when asked for.
    """
    starts = _slice_starts(events).groupBy("session_id").agg(F.min("started").alias("started"))
    starts = starts.select("session_id", _deadline(seconds).alias("deadline"))
    closing = events.where(F.col("type").isin(*TERMINATORS[mode])).select(
        "session_id", "seq", "ts", "type", (F.col("content") if with_content else F.lit(None).cast("string")).alias("content")
    )
    timed = spread_join(closing, starts, ["session_id"], "seq").where(F.col("ts") < F.col("deadline"))
    first = timed.groupBy("session_id").agg(F.min(F.struct("seq", "type", "content")).alias("e"))
    return starts.join(first, "session_id", "left").select(
        "session_id",
        "deadline",
        F.col("e.seq").alias("end_seq"),
        F.col("e.type").alias("end_type"),
        F.col("e.content").alias("end_content"),
    )


def _inside(rows: DataFrame, events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows before the end and the deadline of their session, partitioned by (session_id, slice).

    The bounds are repeated for every slice a session has, so a long session is
    spread over many tasks, and the join leaves rows where the concatenation of
    their slice needs them: the text is shuffled once.
    """
    slices = _slice_starts(events).select("session_id", "slice").join(
        bounds.select("session_id", "deadline", "end_seq"), "session_id"
    )
    joined = rows.withColumn("slice", slice_of("seq")).join(slices, ["session_id", "slice"])
    before_end = F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq"))
    return joined.where((F.col("ts") < F.col("deadline")) & before_end).drop("deadline", "end_seq")


def _streamed(events: DataFrame, bounds: DataFrame) -> DataFrame:
    deltas = events.where(F.col("type") == rules.EVENT_DELTA)
    return _inside(deltas.select("session_id", "seq", "ts", F.coalesce("delta", F.lit("")).alias("text")), events, bounds)


def assemble_sessions(
    events: DataFrame, mode: str = "remote", seconds: int = rules.SESSION_SECONDS
) -> DataFrame:
    """(session_id, status, text) per session.

    `remote`: a message, idle or error event ends the session; the text is the
    message or, when that is empty or missing, everything streamed before it.
    `local`: idle or error ends it; the text is the last message, streamed
    parts never count, and only status `ok` is usable.  A session without an
    end before its deadline has status `timeout`.
    """
    bounds = session_bounds(events, mode, seconds)
    ends = session_bounds(events, mode, seconds, with_content=mode == "remote")
    if mode == "remote":
        body = ordered_concat(_streamed(events, bounds), ["session_id"], "seq", "text", sliced=True)
        message = F.when(F.col("end_type") == rules.EVENT_MESSAGE, F.nullif("end_content", F.lit("")))
        text = F.coalesce(message, F.col("text"), F.lit(""))
    else:
        messages = events.where(F.col("type") == rules.EVENT_MESSAGE).select("session_id", "seq", "ts", "content")
        last = _inside(messages, events, bounds).groupBy("session_id").agg(F.max(F.struct("seq", "content")).alias("m"))
        body = last.select("session_id", F.col("m.content").alias("text"))
        text = F.coalesce("text", F.lit(""))
    status = (
        F.when(F.col("end_type").isNull(), STATUS_TIMEOUT)
        .when(F.col("end_type") == rules.EVENT_ERROR, STATUS_ERROR)
        .otherwise(STATUS_OK)
    )
    joined = ends.join(body, "session_id", "left")
    return joined.select("session_id", status.alias("status"), text.alias("text"))


def session_slices(events: DataFrame, seconds: int = rules.SESSION_SECONDS) -> DataFrame:
    """(session_id, slice, text): streamed text in bounded slices, for sessions too long for one value."""
    bounds = session_bounds(events, "remote", seconds)
    return concat_slices(_streamed(events, bounds), ["session_id"], "seq", "text", sliced=True)
