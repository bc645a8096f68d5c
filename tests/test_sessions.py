import random

import pytest
from pyspark.sql import functions as F

from gemflow.operators.sessions import SessionTable, sessionize
from gemflow.session import scratch_path

SCHEMA = "id long, user_id string, created_at timestamp, extra string"


def brute(rows, gap=1800):
    seen, by = set(), {}
    for i, u, t, _ in rows:
        if i is None or u is None or t is None or i in seen:
            continue
        seen.add(i)
        by.setdefault(u, []).append(t)
    out = []
    for u, ts in by.items():
        ts.sort()
        start = last = ts[0]
        n = 0
        for t in ts:
            if t - last > gap:
                out.append((u, start * 10**6, last * 10**6, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((u, start * 10**6, last * 10**6, n))
    return sorted(out)


def frame(spark, rows):
    raw = spark.createDataFrame(rows, "id long, user_id string, t long, extra string")
    return raw.select("id", "user_id", F.timestamp_seconds("t").alias("created_at"), "extra")


def result(df):
    return sorted(tuple(r) for r in df.select("user_id", "start_us", "end_us", "n_events").collect())


def rows(n, seed):
    r = random.Random(seed)
    out = [(i, None if r.random() < 0.03 else "hot" if r.random() < 0.4 else f"u{r.randrange(5)}", None if r.random() < 0.05 else r.randrange(0, 200_000), "x") for i in range(n)]
    return out + out[:20]  # delivered twice


def test_gap_is_inclusive_and_equal_times_share_a_session(spark):
    df = frame(spark, [(1, "a", 0, ""), (2, "a", 1800, ""), (3, "a", 3601, ""), (4, "a", 3601, "")])
    assert result(sessionize(df)) == [("a", 0, 1800 * 10**6, 2), ("a", 3601 * 10**6, 3601 * 10**6, 2)]


def test_incremental_table_equals_brute_force_in_any_batch_order(spark):
    data = rows(400, 1)
    table = SessionTable(spark, scratch_path(spark, "t"))
    shuffled = data[:]
    random.Random(2).shuffle(shuffled)
    for part in (shuffled[:150], shuffled[150:300], shuffled[300:], shuffled[:50]):  # the last batch repeats the first
        table.ingest(frame(spark, part))
    assert result(table.read()) == brute(data)


def test_a_late_event_bridges_two_stored_sessions(spark):
    table = SessionTable(spark, scratch_path(spark, "t"))
    table.ingest(frame(spark, [(1, "a", 0, ""), (2, "a", 3000, "")]))
    assert len(result(table.read())) == 2
    table.ingest(frame(spark, [(3, "a", 1500, "")]))
    assert result(table.read()) == [("a", 0, 3000 * 10**6, 3)]


def test_empty_batches_and_tables(spark):
    table = SessionTable(spark, scratch_path(spark, "t"))
    assert result(table.read()) == []
    table.ingest(frame(spark, []))
    table.ingest(frame(spark, [(1, None, 5, ""), (None, "a", 5, ""), (2, "a", None, "")]))
    assert result(table.read()) == []
    assert result(sessionize(frame(spark, []))) == []


def test_two_writers_cannot_publish_one_version(spark):
    table = SessionTable(spark, scratch_path(spark, "t"))
    table.ingest(frame(spark, [(1, "a", 0, "")]))
    with pytest.raises(RuntimeError):
        table._publish(1, {"buckets": {}, "keys": []})


def test_buckets_grow_and_key_files_merge(spark, monkeypatch):
    monkeypatch.setattr(SessionTable, "KEY_FILES", 3)
    data = rows(240, 5)
    table = SessionTable(spark, scratch_path(spark, "t"), rows_per_bucket=30)
    for at in range(0, 240, 40):
        table.ingest(frame(spark, data[at : at + 40]))
    table.ingest(frame(spark, data[100:130]))  # all stored before
    _, state = table._state()
    assert state["n"] >= 4 and len(state["buckets"]) == state["n"] and len(state["keys"]) <= 4
    assert sum(k["rows"] for k in state["keys"]) == state["rows"] and result(table.read()) == brute(data)
