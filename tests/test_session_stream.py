"""Sessions as state of a stream against the fold over a table; the event store when batches are run again or break."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from scrivano.operators import sessions
from scrivano.sources import event_store
from scrivano.streaming import session_state

SCHEMA = "session_id long, n long, ts timestamp, request string, expected long, decision string"
BEGIN = datetime.datetime(2024, 5, 1)
KINDS = ["create", *["claim", "complete", "fail", "decide", "begin", "finish", "abort"] * 2, None, "what"]


def requests(seed, count=160, many=6):
    rng = random.Random(seed)
    at, rows = 0, []
    for n in range(count):
        at += rng.choice([0, 1, 40, 900])
        kind = rng.choice(KINDS) if n >= many else "create"
        rows.append((n % many if n < many else rng.randrange(many + 1), n, BEGIN + datetime.timedelta(seconds=at), kind, rng.choice([None, 0, 1, 2]), rng.choice(["PASS", "FAIL", None])))
    # long after all others: the watermark passes them
    return rows, (99, count, BEGIN + datetime.timedelta(seconds=at + 90_000), "create", None, None)


@pytest.fixture
def folder(spark, tmp_path):
    number = [0]

    def put(rows):
        """Each call a file of its own, later ones younger."""
        number[0] += 1
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.write.parquet(f"{tmp_path}/in/{number[0]:03d}")

    put.path = f"{tmp_path}/in/*"
    put.out = f"{tmp_path}/out"
    return put


def run(spark, folder, lease=300.0, keep=None, files=1):
    """One query to the end of its input; called again it goes on from its checkpoint."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder.path)
    out = session_state.outcomes(stream, lease, keep)
    with session_state.provider(spark):
        event_store.appended(out, folder.out).awaitTermination()
    return event_store.stored(spark, folder.out, out.schema)


def batch(spark, rows, lease=300.0):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.unix_micros("ts") / 1e6).drop_duplicates(["n"])
    return {(r.session_id, r.n): r.result for r in sessions.outcomes(sessions.folded(df, lease)).collect()}


def outcomes(df):
    rows = [r for r in df.collect() if r.n is not None]
    got = {(r.session_id, r.n): r.result for r in rows}
    assert len(got) == len(rows)  # each request once
    return got


@pytest.mark.parametrize("files", [1, 3, 50])
def test_batches_make_no_difference(spark, folder, files):
    """Files out of order within the delay, some twice: as the fold over all, wherever batches begin."""
    rows, last = requests(files)
    parts = [rows[i : i + 23] for i in range(0, len(rows), 23)]
    for i in range(0, len(parts) - 1, 2):  # neighbours change places, as long as the watermark allows
        if parts[i + 1][-1][2] - parts[i][0][2] < datetime.timedelta(minutes=59):
            parts[i], parts[i + 1] = parts[i + 1], parts[i]
    for p in [parts[0], *parts, parts[-1]]:
        folder(p)
    folder([last])
    assert outcomes(run(spark, folder, files=files)) == batch(spark, rows)


def test_restart(spark, folder):
    """State is carried over in the checkpoint: a second query goes on where the first one ended, and sees old files no more."""
    rows, last = requests(7)
    half = len(rows) // 2
    folder(rows[:half])
    first = outcomes(run(spark, folder))
    assert 0 < len(first) < half
    folder(rows[half:])
    folder([last])
    assert outcomes(run(spark, folder)) == batch(spark, rows)


def test_state_after_each_request(spark, folder):
    rows, last = requests(11)
    folder([*rows, last])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.unix_micros("ts") / 1e6)
    want = {r.session_id: (r.status, r.revision, r.lease) for r in sessions.folded(df).collect()}
    ends = {}
    for r in sorted((r for r in run(spark, folder).collect() if r.n is not None), key=lambda r: r.n):
        ends[r.session_id] = r.status, r.revision, r.lease
    assert ends == want


@pytest.mark.parametrize("files", [1, 9])
def test_lapses_and_ends(spark, folder, files):
    at = lambda s: BEGIN + datetime.timedelta(seconds=s)
    rows = [
        (1, 0, at(0), "create", None, None), (1, 1, at(10), "claim", None, None), (1, 2, at(500), "claim", None, None), (1, 3, at(510), "complete", None, None),
        (1, 4, at(5000), "decide", 1, None), (1, 5, at(5001), "create", None, None), (2, 6, at(0), "create", None, None), (3, 7, at(200_000), "create", None, None),
    ]
    folder(rows[:3])
    folder(rows[3:])
    got = sorted((r.session_id, r.n is None, r.n or 0, r.result) for r in run(spark, folder, lease=300.0, keep=4000.0, files=files).collect())
    assert got == [
        (1, False, 0, "ok"), (1, False, 1, "ok"), (1, False, 2, "ok"), (1, False, 3, "ok"), (1, False, 4, "not_found"), (1, False, 5, "ok"),
        (1, True, 0, "expired"), (1, True, 0, "expired"), (1, True, 0, "lease_lapsed"), (2, False, 6, "ok"), (2, True, 0, "expired"),
    ]


KV = "k long, v long"


def test_store(spark, tmp_path):
    by_key = event_store.View(("k",), (F.count("*").alias("n"), F.max("v").alias("top")), {"n": F.sum, "top": F.max})
    folder, rows = f"{tmp_path}/store", [(i % 3, i) for i in range(30)]
    df = lambda a, b: spark.createDataFrame(rows[a:b], KV)
    schema = df(0, 1).schema
    view = lambda: sorted(map(tuple, event_store.folded(spark, folder, by_key, schema).collect()))
    whole = lambda n: sorted(map(tuple, by_key.over(spark.createDataFrame(rows[:n], KV)).collect()))
    assert view() == [] and event_store.snapshot(spark, folder, by_key, schema) == -1
    event_store.append(df(0, 10), folder, 0)
    event_store.append(df(0, 10), folder, 0)
    assert view() == whole(10)
    event_store.append(df(10, 20), folder, 1)
    assert event_store.snapshot(spark, folder, by_key, schema) == 1
    assert event_store.snapshot(spark, folder, by_key, schema) == 1
    event_store.append(df(20, 30), folder, 2)
    event_store.append(df(20, 30), folder, 2)
    assert view() == whole(30)
    # the snapshot is what is read of the first two batches
    plan = event_store.folded(spark, folder, by_key, schema)
    assert {p.split("/")[-2] for p in plan.inputFiles()} == {"view=000000000001", "batch=000000000002"}
    assert event_store.stored(spark, folder, schema).count() == 30 and event_store.latest(spark, folder, schema).count() == 10


def test_a_batch_that_breaks_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/store"
    rows = spark.range(10).select(F.col("id").alias("k"), F.expr("CASE WHEN id = 7 THEN raise_error('broken') ELSE id END").cast("long").alias("v"))
    with pytest.raises(Exception, match="broken"):
        event_store.append(rows, folder, 0)
    assert event_store.stored(spark, folder, rows.schema).count() == 0
    event_store.append(rows.where("k <> 7"), folder, 0)
    assert event_store.stored(spark, folder, rows.schema).count() == 9


def test_a_session_of_ten_thousand_requests(spark):
    """The fold over a table keeps a log of a session's requests, which it copies with each: still seconds at this length, and the same as one by one."""
    import time

    rng = random.Random(9)
    rows = [(1, n, BEGIN + datetime.timedelta(seconds=40 * n), rng.choice(KINDS) if n else "create", rng.randrange(4), rng.choice(["PASS", "FAIL"])) for n in range(10_000)]
    began = time.time()
    got = batch(spark, rows)
    assert time.time() - began < 60
    state, want = session_state.Session(), {}
    for _, n, ts, kind, expected, decision in rows:
        r = session_state.Request((ts - datetime.datetime(1970, 1, 1)).total_seconds(), kind, expected, decision)
        state, want[1, n] = session_state.applied(state, n, r, 300.0)
    assert got == want


def test_a_batch_of_a_session_takes_few_calls():
    """Each call to the state goes to another process, so their number must not grow with a session's requests."""
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    import pandas as pd

    def calls(count):
        fold, handle = session_state.Fold(300.0, None), MagicMock()
        fold.init(handle)
        session, waiting = handle.getValueState.return_value, handle.getListState.return_value
        session.get.return_value, kept = None, []
        waiting.appendList.side_effect = kept.extend
        rows = pd.DataFrame([(n, 10.0 * n, "claim" if n else "create", None, None) for n in range(count)], columns=["n", "at", "request", "expected", "decision"])
        assert list(fold.handleInputRows((1,), iter([rows]), None)) == []
        waiting.get.side_effect = lambda: iter(list(kept))
        late = 5_000 * count  # half of the requests are due
        out = list(fold.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: late), None))
        assert out[0].n.dropna().tolist() == list(range(count // 2 + 1))
        assert [r[0] for r in waiting.put.call_args.args[0]] == list(range(count // 2 + 1, count))
        return len(handle.registerTimer.call_args_list) + len(session.method_calls) + len(waiting.method_calls)

    assert calls(1000) == calls(10) <= 10
