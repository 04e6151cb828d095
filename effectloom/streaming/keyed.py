"""Keyed streaming state, entered once per hash bucket and trigger.

Keys are dealt into a fixed number of buckets, and a bucket is the grouping key
of the stateful operator: a trigger enters Python once for each bucket with rows,
not once for each policy or user.  A bucket's entries are one list state, written
as a log: a trigger reads it in one go, appends what it changed, and writes the
list anew once half of it is out of date.  A bucket has one event-time timer, at
the earliest moment that something of its keys falls due; all that is due by then
is handled in one call.  Entries that can no longer matter are removed, so state
is bounded by live keys.

The rows of one bucket and trigger, and the bucket's entries, are held in memory:
choose buckets so that both are thousands, not millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
GRACE_DAYS = 60
POLICY_OUT = "policy_id long, state string, event string, at_ms long"
CONTACT_OUT = "user_id long, event_id long, at_ms long"
STORE = "spark.sql.streaming.stateStore.providerClass"
# Legal moves of the policy state machine, by event.
MOVES = {("pending", "activate"): "active", ("active", "renew"): "active", ("active", "expire"): "terminated",
         ("active", "miss_payment"): "grace", ("grace", "pay"): "active", ("lapsed", "reinstate"): "active",
         ("active", "surrender"): "terminated", ("grace", "surrender"): "terminated"}


class BucketProcessor(StatefulProcessor):
    """Shared walk: rows of a bucket by key in time order, what changed appended to the bucket's log."""

    columns: list[str] = []
    #: type of an entry beside its key; null in the first field marks a removed key
    entry = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("entries", f"key long, {self.entry}")
        self.timer = handle.getValueState("timer", "at long")
        self.gone = (None,) * len(self.entry.split(","))

    def load(self) -> tuple[dict[int, tuple], int]:
        """Live entries of the bucket and the length of its log."""
        live, n = {}, 0
        for key, *entry in (self.log.get() if self.log.exists() else ()):
            n += 1
            if entry[0] is None:
                live.pop(key, None)
            else:
                live[key] = tuple(entry)
        return live, n

    def save(self, live: dict[int, tuple], changed: set[int], n: int) -> None:
        if n + len(changed) > 2 * len(live) + 16:
            if live:
                self.log.put([(k, *e) for k, e in live.items()])
            else:
                self.log.clear()
        elif changed:
            self.log.appendList([(k, *live.get(k, self.gone)) for k in sorted(changed)])
        due = min((at for e in live.values() if (at := self.falls_due(e)) is not None), default=None)
        held = self.timer.get()[0] if self.timer.exists() else None
        if due is None or held != due + 1:
            if held is not None:
                self.handle.deleteTimer(held)
                self.timer.clear()
            if due is not None:
                self.handle.registerTimer(due + 1)
                self.timer.update((due + 1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        some = (pd.concat(chunks) if len(chunks) > 1 else chunks[0]).sort_values(["key", "at_ms", "event_id"], kind="stable")
        live, n = self.load()
        out: list[tuple] = []
        changed = set()
        for k, group in self.by_key(some):
            old = live.get(k)
            new = self.advance(k, old, group, out)
            if new != old:
                changed.add(k)
                if new is None:
                    del live[k]
                else:
                    live[k] = new
        self.save(live, changed, n)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        live, n = self.load()
        out: list[tuple] = []
        due = sorted((at, k) for k, e in live.items() if (at := self.falls_due(e)) is not None and at < mark)
        for _, k in due:
            new = self.expire(k, live[k], out)
            if new is None:
                del live[k]
            else:
                live[k] = new
        self.save(live, {k for _, k in due}, n)
        yield pd.DataFrame(out, columns=self.columns)

    @staticmethod
    def by_key(some: pd.DataFrame) -> Iterator[tuple[int, list[tuple]]]:
        keys = some["key"].tolist()
        events = list(zip(some["at_ms"].tolist(), some["event_id"].tolist(), some["event"].tolist()))
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                yield keys[first], events[first:i]
                first = i

    def close(self) -> None:
        pass


class PolicyMachine(BucketProcessor):
    """Legal moves; a policy in grace lapses when its grace ends, a terminated one is forgotten after `forget_ms`."""

    columns = ["policy_id", "state", "event", "at_ms"]
    entry = "state string, until long"

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def falls_due(self, entry: tuple) -> int | None:
        return entry[1] if entry[0] in ("grace", "terminated") else None

    def advance(self, key: int, entry: tuple | None, events: list[tuple], out: list[tuple]) -> tuple | None:
        now, until = entry or ("pending", 0)
        for at, _, event in events:
            if now == "grace" and at > until:
                now = "lapsed"
                out.append((key, now, "grace_expired", until))
            target = MOVES.get((now, event))
            if target is None:
                out.append((key, now, f"rejected:{event}", at))
                continue
            now, until = target, at + {"grace": GRACE_DAYS * DAY_MS, "terminated": self.forget_ms}.get(target, 0)
            out.append((key, now, event, at))
        return None if now == "pending" else (now, until)

    def expire(self, key: int, entry: tuple, out: list[tuple]) -> tuple | None:
        if entry[0] == "terminated":
            return None
        out.append((key, "lapsed", "grace_expired", entry[1]))
        return "lapsed", entry[1]


class ContactCap(BucketProcessor):
    """One contact a key, then none until the cap has passed; the entry goes with the cap."""

    columns = ["user_id", "event_id", "at_ms"]
    entry = "last long"

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def falls_due(self, entry: tuple) -> int | None:
        return entry[0] + self.window_ms

    def advance(self, key: int, entry: tuple | None, events: list[tuple], out: list[tuple]) -> tuple | None:
        last = entry[0] if entry else None
        for at, event, _ in events:
            if last is None or at - last >= self.window_ms:
                last = at
                out.append((key, event, at))
        return (last,)

    def expire(self, key: int, entry: tuple, out: list[tuple]) -> None:
        return None


def bucketed(stream: DataFrame, key: str, event: str, ts: str, delay: str, buckets: int, machine: BucketProcessor, schema: str) -> DataFrame:
    """The machine over a stream of (key, event_id, event, event time); needs the RocksDB state store, which it selects for the session."""
    stream.sparkSession.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.withWatermark(ts, delay).filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.col(key).cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"),
        F.col(event).cast("string").alias("event"), ts, F.unix_millis(ts).alias("at_ms"))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=machine, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def policy_state_stream(stream: DataFrame, ts: str, delay: str = "1 day", buckets: int = 256, forget_days: int = 730) -> DataFrame:
    """Legal moves per policy; illegal ones come out as rejected.

    stream: policy_id, event_id, event, event time.  A policy still in grace 60
    days after it began lapses, once the watermark is past that.  A terminated policy rejects all events for forget_days; then it is
    removed, and its id starts anew.  A policy that was never activated holds no
    state.  Rows without policy or time are left out.
    """
    return bucketed(stream, "policy_id", "event", ts, delay, buckets, PolicyMachine(forget_days * DAY_MS), POLICY_OUT)


def contact_cap(stream: DataFrame, ts: str, days: int = 30, delay: str = "1 day", buckets: int = 256) -> DataFrame:
    """Lets one contact per user through, then none for ``days``; state expires with the cap."""
    return bucketed(stream.withColumn("event", F.lit("")), "user_id", "event", ts, delay, buckets, ContactCap(days * DAY_MS), CONTACT_OUT)
