"""Queries over session events, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoquarry.operators import sessions
from repoquarry.plans.storage import working_dir
from repoquarry.sources.session_events import read_events, stream_events
from repoquarry.streaming.sessions import run_available, stream_sessions, with_unfinished
from workload import views
from workload.sql_views import with_views


def _events(spark, sf_dir):
    return views.session_events(views.table(spark, sf_dir, "conversations"))


def session_assemble(spark, sf_dir):
    return sessions.assemble_sessions(_events(spark, sf_dir), "remote")


def session_assemble_local(spark, sf_dir):
    return sessions.assemble_sessions(_events(spark, sf_dir), "local")


def session_slices(spark, sf_dir):
    return sessions.session_slices(_events(spark, sf_dir))


def session_timeouts(spark, sf_dir):
    """Events at or past the deadline of their session."""
    events = _events(spark, sf_dir)
    late = events.join(sessions.events_in_time(events).select("session_id", "seq"), ["session_id", "seq"], "left_anti")
    return late.select("session_id", "seq", "type")


def _streamed(spark, sf_dir, mode):
    """The assembly as a streaming query over the conversations table, run until nothing is left."""
    table = views.table(spark, sf_dir, "conversations")
    # a pattern, because the table may be one file or a folder of files
    source = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/conversations.parque[t]")
    work = working_dir(spark, "sessions")
    run_available(stream_sessions(views.session_events(source), mode), f"{work}/output", f"{work}/checkpoint")
    results = spark.read.schema("session_id string, status string, text string").parquet(f"{work}/output")
    return with_unfinished(results, views.session_events(table), mode)


def _stored_events(spark, sf_dir):
    path = working_dir(spark, "events")
    _events(spark, sf_dir).write.json(path)
    return path


def session_events_read(spark, sf_dir):
    """Sessions of an event log of JSON lines, read in batch."""
    return sessions.assemble_sessions(read_events(spark, _stored_events(spark, sf_dir)), "remote")


def session_events_streamed(spark, sf_dir):
    """Sessions of the same log, read as a stream of one file per micro-batch."""
    path, work = _stored_events(spark, sf_dir), working_dir(spark, "sessions")
    run_available(stream_sessions(stream_events(spark, path, files_per_batch=1), "remote", lateness="10 days"), f"{work}/output", f"{work}/checkpoint")
    results = spark.read.schema("session_id string, status string, text string").parquet(f"{work}/output")
    return with_unfinished(results, read_events(spark, path), "remote")


def session_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, "remote")


def session_stream_local(spark, sf_dir):
    return _streamed(spark, sf_dir, "local")


_ASSEMBLE = """WITH ends AS (SELECT session_id, min(seq) AS end_seq, arg_min(type, seq) AS end_type, arg_min(content, seq) AS end_content
  FROM timed_events WHERE type IN ({types}) GROUP BY session_id),
ids AS (SELECT session_id, min(secs) + 120 AS deadline FROM session_events GROUP BY session_id),
body AS (SELECT e.session_id, {text} AS text FROM timed_events e LEFT JOIN ends n USING (session_id)
  WHERE e.type = '{kind}' AND (n.end_seq IS NULL OR e.seq < n.end_seq) GROUP BY e.session_id),
result AS (SELECT i.session_id, i.deadline, CASE WHEN end_type IS NULL THEN 'timeout' WHEN end_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  coalesce({first}, b.text, '') AS text FROM ids i LEFT JOIN ends n USING (session_id) LEFT JOIN body b USING (session_id))"""
_REMOTE = _ASSEMBLE.format(
    types="'assistant.message', 'session.idle', 'error'", kind="assistant.message_delta",
    text="string_agg(delta, '' ORDER BY seq)", first="CASE WHEN end_type = 'assistant.message' THEN nullif(end_content, '') END",
)
_LOCAL = _ASSEMBLE.format(types="'session.idle', 'error'", kind="assistant.message", text="arg_max(content, seq)", first="NULL")

SQL = {
    "session_assemble": with_views(_REMOTE + " SELECT session_id, status, text FROM result", "timed_events"),
    "session_assemble_local": with_views(_LOCAL + " SELECT session_id, status, text FROM result", "timed_events"),
    "session_slices": with_views(_REMOTE + " SELECT session_id, 0 AS slice, text FROM body", "timed_events"),
    "session_timeouts": with_views("""SELECT session_id, seq, type FROM (SELECT *, min(secs) OVER (PARTITION BY session_id) AS started FROM session_events)
WHERE secs >= started + 120""", "session_events"),
    "session_events_read": with_views(_REMOTE + " SELECT session_id, status, text FROM result", "timed_events"),
    "session_events_streamed": with_views(_REMOTE + " SELECT session_id, status, text FROM result", "timed_events"),
    "session_stream": with_views(_REMOTE + " SELECT session_id, status, text FROM result", "timed_events"),
    "session_stream_local": with_views(_LOCAL + " SELECT session_id, status, text FROM result", "timed_events"),
}

QUERIES = {
    f.__name__: f for f in (session_assemble, session_assemble_local, session_slices, session_timeouts, session_events_read, session_events_streamed, session_stream, session_stream_local)
}
