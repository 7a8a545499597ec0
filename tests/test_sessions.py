"""Session assembly: batch rules, slices, and the streaming form against the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from repoquarry.operators import sessions
from repoquarry.operators.grouping import CHUNK
from repoquarry.plans.storage import settle, working_dir
from repoquarry.sources import session_events
from repoquarry.streaming.sessions import run_available, stream_sessions, with_unfinished

START = dt.datetime(2024, 1, 1)
DELTA, MESSAGE, IDLE, ERROR = "assistant.message_delta", "assistant.message", "session.idle", "error"
# session -> [(second, type, text)]
LOG = {
    "idle": [(0, DELTA, "he"), (1, DELTA, "llo"), (2, IDLE, None)],
    "message": [(0, DELTA, "x"), (1, MESSAGE, "full"), (2, IDLE, None)],
    "error": [(0, DELTA, "x"), (1, ERROR, None)],
    "silent": [(0, DELTA, "x")],
    "late_end": [(0, DELTA, "x"), (60, DELTA, "y"), (120, MESSAGE, "too late")],
    "busy_timeout": [(i * 15, DELTA, str(i)) for i in range(12)],
    "empty_message": [(0, DELTA, "x"), (1, MESSAGE, ""), (2, IDLE, None)],
    "two_messages": [(0, MESSAGE, "first"), (1, MESSAGE, "second"), (2, IDLE, None)],
    "after_end": [(0, IDLE, None), (1, DELTA, "ignored")],
    "clock": [(4000, DELTA, "z"), (4001, IDLE, None)],
}


def _rows(log):
    rows = []
    for session, events in log.items():
        for seq, (second, kind, text) in enumerate(events):
            rows.append((session, seq, START + dt.timedelta(seconds=second), kind, text if kind == MESSAGE else None, text if kind == DELTA else None))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(_rows(LOG), session_events.EVENTS_SCHEMA).cache()


def _by_session(df):
    return {r["session_id"]: (r["status"], r["text"]) for r in df.collect()}


REMOTE = {
    "idle": ("ok", "hello"), "message": ("ok", "full"), "error": ("error", "x"), "silent": ("timeout", "x"), "late_end": ("timeout", "xy"),
    "busy_timeout": ("timeout", "01234567"), "empty_message": ("ok", "x"), "two_messages": ("ok", "first"), "after_end": ("ok", ""), "clock": ("ok", "z"),
}


def test_remote(events):
    assert _by_session(sessions.assemble_sessions(events, "remote")) == REMOTE


def test_local(events):
    got = _by_session(sessions.assemble_sessions(events, "local"))
    assert got["idle"] == ("ok", "") and got["message"] == ("ok", "full") and got["two_messages"] == ("ok", "second")
    assert got["error"] == ("error", "") and got["silent"] == ("timeout", "") and got["late_end"] == ("timeout", "")


def test_partitioning_changes_nothing(events):
    for n in (1, 7):
        shuffled = events.repartition(n, F.rand(n))
        assert _by_session(sessions.assemble_sessions(shuffled, "remote")) == REMOTE


def test_slices_make_up_the_text(spark):
    n = CHUNK * 2 + 5
    rows = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"), F.lit(START).alias("ts"), F.lit(DELTA).alias("type"),
                                 F.lit(None).cast("string").alias("content"), (F.col("id") % 10).cast("string").alias("delta"))
    slices = sessions.session_slices(rows).orderBy("slice").collect()
    assert len(slices) == 3
    expected = "".join(str(i % 10) for i in range(n))
    assert "".join(r["text"] for r in slices) == expected
    assert _by_session(sessions.assemble_sessions(rows))["s"] == ("timeout", expected)


@pytest.mark.parametrize("mode", ["remote", "local"])
def test_stream_equals_batch(spark, events, tmp_path, mode):
    # one file per quarter of the timeline, so sessions cross micro-batches
    ordered = events.orderBy("ts", "seq").collect()
    parts = [ordered[i::1][:0] for i in range(4)]
    size = -(-len(ordered) // 4)
    for i in range(4):
        parts[i] = ordered[i * size : (i + 1) * size]
        path = str(tmp_path / "in" / f"part-{i}.json")
        spark.createDataFrame(parts[i], session_events.EVENTS_SCHEMA).coalesce(1).write.mode("append").json(path.replace(f"/part-{i}.json", f"/{i}"))
    source = session_events.stream_events(spark, str(tmp_path / "in" / "*"), files_per_batch=1)
    run_available(stream_sessions(source, mode), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = _by_session(spark.read.schema("session_id string, status string, text string").parquet(str(tmp_path / "out")))
    assert got == _by_session(sessions.assemble_sessions(events, mode))


def test_shared_storage(spark):
    folder = working_dir(spark, "x")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = settle(spark.range(5))
    assert kept.count() == 5 and "parquet" in kept._jdf.queryExecution().toString().lower()


def test_text_is_shuffled_once(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.write.parquet(path)
    stored = spark.read.schema(session_events.EVENTS_SCHEMA).parquet(path)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = sessions.session_slices(stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    # the join leaves rows where the concatenation of their slice needs them
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]


def test_a_session_goes_out_once(spark, tmp_path):
    """Events of a session that come after its result, in a later micro-batch, do not start it again."""
    batches = [
        [("a", 0, 0, DELTA, "x"), ("a", 1, 10, MESSAGE, "done"), ("m", 0, 5, DELTA, "late start")],
        [("b", 0, 310, DELTA, "y"), ("m", 1, 1, DELTA, "early ")],
        [("a", 2, 320, DELTA, "late"), ("c", 0, 400, DELTA, "z")],
    ]
    for i, rows in enumerate(batches):
        made = [(s, q, START + dt.timedelta(seconds=t), k, x if k == MESSAGE else None, x if k == DELTA else None) for s, q, t, k, x in rows]
        spark.createDataFrame(made, session_events.EVENTS_SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    source = session_events.stream_events(spark, str(tmp_path / "in" / "*"), files_per_batch=1)
    run_available(stream_sessions(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    stored = spark.read.schema("session_id string, status string, text string").parquet(str(tmp_path / "out"))
    rows = sorted(map(tuple, stored.collect()))
    assert [r for r in rows if r[0] == "a"] == [("a", "ok", "done")]
    every = session_events.read_events(spark, str(tmp_path / "in" / "*"))
    assert sorted(r["session_id"] for r in with_unfinished(stored, every).collect()) == ["a", "b", "c", "m"]


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        working_dir(Session, "x")


# session -> [(seq, second, type, text)]; events with a smaller seq are not younger
DISORDER = {
    "held_beyond_end": [(1, 1, DELTA, "one "), (3, 3, DELTA, "three "), (2, 2, IDLE, None)],
    "gap": [(0, 5, DELTA, "a"), (4, 9, MESSAGE, ""), (2, 7, DELTA, "b"), (6, 11, DELTA, "c")],
    "two_ends": [(5, 50, IDLE, None), (3, 30, ERROR, None), (4, 40, MESSAGE, "late"), (1, 10, DELTA, "x"), (2, 20, MESSAGE, "first")],
    "deadline_moves": [(2, 130, IDLE, None), (1, 100, DELTA, "in"), (0, 5, DELTA, "start "), (3, 131, DELTA, "out")],
    "only_end": [(0, 7, IDLE, None)],
    "clock": [(0, 9000, DELTA, "z"), (1, 9001, IDLE, None)],
}


@pytest.mark.parametrize("mode", ["remote", "local"])
@pytest.mark.parametrize("cut", [1, 2, 3])
def test_stream_equals_batch_for_any_order_and_cut(spark, tmp_path, mode, cut):
    rows = [(s, q, START + dt.timedelta(seconds=t), k, x if k == MESSAGE else None, x if k == DELTA else None) for s, events in DISORDER.items() for q, t, k, x in events]
    last = [r for r in rows if r[0] == "clock"]
    rows = [r for r in rows if r[0] != "clock"]
    random.Random(cut).shuffle(rows)
    size = max(1, -(-len(rows) // (cut * 3)))
    for i, at in enumerate(range(0, len(rows), size)):
        spark.createDataFrame(rows[at : at + size], session_events.EVENTS_SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"{i:03}"))
    spark.createDataFrame(last, session_events.EVENTS_SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / "900"))
    source = session_events.stream_events(spark, str(tmp_path / "in" / "*"), files_per_batch=1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run_available(stream_sessions(source, mode, lateness="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = sorted(map(tuple, spark.read.schema("session_id string, status string, text string").parquet(str(tmp_path / "out")).collect()))
    every = session_events.read_events(spark, str(tmp_path / "in" / "*"))
    want = sorted(map(tuple, sessions.assemble_sessions(every, mode).collect()))
    assert got == want
    if mode == "remote":
        assert dict((r[0], r[1:]) for r in got)["held_beyond_end"] == ("ok", "one ")


def test_a_session_of_one_call_leaves_no_events_in_the_state():
    """Every call of the state is a round trip: a session that is whole at once needs three."""
    from unittest.mock import MagicMock

    import pandas as pd

    from repoquarry.streaming import sessions as streaming

    handle = MagicMock()
    handle.getListState.return_value, handle.getValueState.return_value = events, clock = MagicMock(), MagicMock()
    clock.get.return_value = None
    clock.exists.return_value = False
    made = streaming._processor("remote", 120_000, 3_600_000)
    made.init(handle)
    timer = MagicMock()
    timer.getCurrentWatermarkInMs.return_value = 0
    frame = pd.DataFrame({"seq": [1, 0, 2], "ms": [2000, 1000, 3000], "type": [DELTA, DELTA, IDLE], "content": [None] * 3, "delta": ["lo", "hel", None]})
    got = [tuple(row) for out in made.handleInputRows(("s",), iter([frame]), timer) for row in out.itertuples(index=False)]
    assert got == [("s", "ok", "hello")]
    assert not events.method_calls and len(clock.method_calls) == 2
    assert [c[0] for c in handle.method_calls if "Timer" in c[0]] == ["registerTimer"]
    clock.update.assert_called_once_with((1000, None, None, True))
