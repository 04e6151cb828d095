"""Streaming operators against hand-worked histories."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from effectloom.streaming import events as st
from effectloom.streaming import keyed
from effectloom.streaming.upsert import UpsertTable, upsert_sink

D0 = dt.datetime(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def source(spark, tmp_path, batches, schema):
    src = str(tmp_path / "src")

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    feed(batches[0])
    return src, feed, lambda: spark.readStream.schema(schema.replace("timestamp", "timestamp")).parquet(src)


def test_policy_states_over_batches(spark, tmp_path):
    schema = "policy_id long, event_id long, event string, ts timestamp"
    batches = [
        [(1, 1, "activate", day(0)), (2, 2, "activate", day(0)), (3, 3, "renew", day(1)), (1, 4, "miss_payment", day(10))],
        [(2, 5, "miss_payment", day(20)), (2, 6, "pay", day(40)), (9, 7, "activate", day(80))],
        [(1, 8, "reinstate", day(90)), (9, 9, "activate", day(91)), (9, 10, "activate", day(200))]]
    src, feed, stream = source(spark, tmp_path, batches, schema)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run = lambda: st.run_to_table(keyed.policy_state_stream(stream(), "ts"), out, ckpt)
    run()
    for b in batches[1:]:
        feed(b)
        got = run()
    hist = {}
    for r in got.orderBy("policy_id", "at_ms").collect():
        hist.setdefault(r["policy_id"], []).append((r["state"], r["event"]))
    assert hist[1] == [("active", "activate"), ("grace", "miss_payment"), ("lapsed", "grace_expired"), ("active", "reinstate")]
    assert hist[2] == [("active", "activate"), ("grace", "miss_payment"), ("active", "pay")]
    assert hist[3] == [("pending", "rejected:renew")]
    assert hist[9][1] == ("active", "rejected:activate")


def test_contact_cap_over_batches(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    src, feed, stream = source(spark, tmp_path, [[(1, 1, day(0)), (1, 2, day(5)), (2, 3, day(3))]], schema)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run = lambda: st.run_to_table(keyed.contact_cap(stream(), "ts", 30), out, ckpt)
    run()
    feed([(1, 4, day(29)), (1, 5, day(30)), (2, 6, day(32)), (2, 7, day(34))])
    assert sorted(r["event_id"] for r in run().collect()) == [1, 3, 5, 7]


def test_state_goes_with_termination_and_cap(spark, tmp_path):
    """Entries leave the store when a policy has been terminated for long enough, and when a cap has passed."""
    schema = "policy_id long, user_id long, event_id long, event string, ts timestamp"
    first = [(p, p, p * 10, "activate", day(0)) for p in range(400)] + [(p, p, p * 10 + 1, "surrender", day(1)) for p in range(300)]
    src, feed, stream = source(spark, tmp_path, [first], schema)
    run = lambda kind, name: st.run_measured(kind(stream()), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ckpt"))
    policies = lambda s: keyed.policy_state_stream(s, "ts", buckets=2, forget_days=20)
    capped = lambda s: keyed.contact_cap(s.select("user_id", "event_id", "ts"), "ts", 30, buckets=2)
    entries = lambda name: spark.read.format("statestore").option("stateVarName", "entries").load(str(tmp_path / f"{name}-ckpt")).count()
    run(policies, "p"), run(capped, "c")
    assert entries("p") == entries("c") == 400
    feed([(3, 3, 33, "activate", day(10))])
    run(policies, "p")
    feed([(999, 999, 9999, "activate", day(60)), (4, 4, 44, "activate", day(60))])
    out, metrics = run(policies, "p")
    run(capped, "c")
    assert metrics.count() > 0 and entries("p") <= 240 and entries("c") <= 40  # a hundred policies live; a log holds twice what lives, and 16
    hist = {p: [r["event"] for r in out.filter(F.col("policy_id") == p).orderBy("at_ms").collect()] for p in (3, 4)}
    assert hist[3] == ["activate", "surrender", "rejected:activate"]  # terminated, and still known
    assert hist[4][:2] == ["activate", "surrender"]


def test_late_rows_are_counted(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    src, feed, stream = source(spark, tmp_path, [[(1, i, day(i)) for i in range(20)]], schema)
    run = lambda: st.run_measured(st.dedup_events(stream(), "event_id", "ts"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert run()[1].agg(F.sum("rows_late")).first()[0] == 0
    feed([(1, 100 + i, day(i)) for i in range(20)])
    got, metrics = run()
    late = metrics.agg(F.sum("rows_late")).first()[0]
    assert late == 19 and got.count() == 40 - late  # only day 19 is less than a day before the latest


def upserted(spark, path):
    return {r["user_id"]: (r["event_id"], r["v"]) for r in UpsertTable(spark, path, "user_id", "event_id").read().collect()}


def test_upsert_keeps_latest(spark, tmp_path):
    schema = "user_id long, event_id long, v string"
    src, feed, stream = source(spark, tmp_path, [[(1, 1, "a"), (2, 2, "b"), (None, 3, "n")]], schema)
    path, ckpt = str(tmp_path / "snap"), str(tmp_path / "ckpt")
    upsert_sink(stream(), path, ckpt, "user_id", "event_id", "append", 4).awaitTermination()
    feed([(1, 9, "c"), (3, 4, None), (2, 1, "old")])
    upsert_sink(stream(), path, ckpt, "user_id", "event_id", "append", 4).awaitTermination()
    assert upserted(spark, path) == {1: (9, "c"), 2: (2, "b"), 3: (4, None), None: (3, "n")}


def test_upsert_writes_what_changes(spark, tmp_path):
    """A batch of one key in a hundred writes that many rows; a retried batch changes nothing; compaction touches full buckets only."""
    path = str(tmp_path / "t")
    table = lambda: UpsertTable(spark, path, "user_id", "event_id", 8, 0.5)
    rows = lambda ids, e: spark.createDataFrame([(i, e, f"{i}-{e}") for i in ids], "user_id long, event_id long, v string")
    with pytest.raises(FileNotFoundError):
        table().read()
    table().upsert(rows(range(2000), 1), 0)
    want = {i: (1, f"{i}-1") for i in range(2000)}
    for b in range(1, 4):
        some = range(b, 2000, 100)
        m = table().upsert(rows(some, b + 1), b)
        again = table().upsert(rows(some, b + 1), b)
        assert m == again and sum(n[str(b)] for n in m["deltas"].values() if str(b) in n) == 20 and set(m["base"].values()) == {0}
        want |= {i: (b + 1, f"{i}-{b + 1}") for i in some}
        assert upserted(spark, path) == want
    # one bucket gets most of its keys anew: it alone is compacted
    hot = [r["user_id"] for r in rows(range(2000), 9).filter("pmod(xxhash64(user_id), 8) = 3").select("user_id").collect()]
    m = table().upsert(rows(hot, 9), 4)
    want |= {i: (9, f"{i}-9") for i in hot}
    assert {b for b, n in m["base"].items() if n == 4} == {"3"} and "3" not in m["deltas"]
    assert upserted(spark, path) == want
    table().upsert(rows([], 1), 5)
    assert table().vacuum() > 0 and upserted(spark, path) == want


def test_batch_and_stream_windows_agree(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    rows = [(i % 3, i, D0 + dt.timedelta(hours=5 * i)) for i in range(60)]
    src, feed, stream = source(spark, tmp_path, [rows], schema)
    got = st.run_to_table(st.daily_counts(stream(), "ts", "user_id"), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = st.daily_counts(spark.createDataFrame(rows, schema), "ts", "user_id")
    closed = batch.filter(F.col("day_start") + F.expr("INTERVAL 1 DAY") <= F.lit(max(r[2] for r in rows) - dt.timedelta(days=1)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))
