"""Sequential state: windows anchored at events, group commit, latency guard, budgets, timeouts.

What one event decides depends on all before it, so each key's events are folded in order. Partitions are sorted and stream
through the fold with the state of one key, so no key is ever held in memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

SECOND = 1_000_000_000


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, results: dict[str, str]) -> DataFrame:
    """``df`` with result columns: ``step(state, row)`` gives them for each row of a key in order. ``df`` has plain columns."""
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {k} {v}" for k, v in results.items())

    def run(frames):
        current, state = object(), None
        for f in frames:
            made = []
            for row in zip(*(f[c] for c in names), strict=True):
                r = dict(zip(names, row, strict=True))
                if r[key] != current:
                    current, state = r[key], start()
                made.append(step(state, r))
            cols = list(zip(*made, strict=True)) if made else [[] for _ in results]
            yield f.assign(**dict(zip(results, cols, strict=True)))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, fields)


class Window:
    """A one-second window that opens at the first event after the last one ended. A refusal uses nothing up."""

    def __init__(self):
        self.since, self.used = None, 0

    def take(self, amount: int, limit: int, now: int) -> bool:
        if not limit:
            return True
        if self.since is None or now - self.since >= SECOND:
            self.since, self.used = now, 0
        if amount > limit or self.used > limit - amount:
            return False
        self.used += amount
        return True


def quota_admission(requests: DataFrame, most_requests: int, most_bytes: int) -> DataFrame:
    """Per principal, requests ``(principal, request_id, arrival, bytes)`` in order of arrival: admitted, request_quota or byte_quota.

    A byte refusal gives the request back. Response bytes are not known to a batch and not charged.
    """
    def step(state, r):
        asked, sent = state
        if not asked.take(1, most_requests, int(r["arrival"])):
            return ("request_quota",)
        if not sent.take(int(r["bytes"]), most_bytes, int(r["arrival"])):
            asked.used -= asked.used > 0
            return ("byte_quota",)
        return ("admitted",)

    return fold(requests, "principal", ["arrival", "request_id"], lambda: (Window(), Window()), step, {"status": "string"})


def batch_closes(mutations: DataFrame, most_records: int = 32, most_bytes: int = 65536, wait_ns: int = 10_000_000) -> DataFrame:
    """Group commit per shard over ``(shard, sequence, arrival, bytes)``: the batch of each record and what closed it there, if it closed.

    A batch that has waited long enough closes before the next record and the target shrinks to what it held; a batch that
    reaches its target closes there. The target starts at the most. With a column ``waiting``, the producers admitted as a record
    arrives, more of them than a batch held at its target raise the target to their number, the most at the highest.
    """
    grows = "waiting" in mutations.columns

    def step(s, r):
        closed = None
        if s["n"] and r["arrival"] - s["at"] >= wait_ns:
            s["target"] = max(1, min(most_records, s["n"]))
            s.update(batch=s["batch"] + 1, n=0, bytes=0)
            closed = "deadline"
        if not s["n"]:
            s["at"] = r["arrival"]
        s["n"] += 1
        s["bytes"] += r["bytes"]
        mine = s["batch"]
        now = "records" if s["n"] >= most_records else "bytes" if s["bytes"] >= most_bytes else "target" if s["n"] >= s["target"] else None
        if now == "target" and grows and r["waiting"] > s["n"]:
            s["target"] = min(most_records, int(r["waiting"]))
        if now:
            s.update(batch=s["batch"] + 1, n=0, bytes=0)
        return mine, closed, now

    return fold(mutations, "shard", ["sequence"], lambda: {"n": 0, "bytes": 0, "batch": 0, "at": 0, "target": most_records}, step, {"batch": "long", "closed_before": "string", "closed_by": "string"})


def latency_guard(samples: DataFrame, suspend_ns: int, most_deferral_ns: int, least_samples: int = 32) -> DataFrame:
    """Per shard, looks ``(shard, look, now_ns, p99_ns, samples)`` in order: run, suspended or override.

    The guard arms at the bound and lets go below four fifths of it (1 ms at least); after the longest deferral one run is forced.
    """
    resume = max(1_000_000, suspend_ns - suspend_ns // 5)

    def step(s, r):
        if not suspend_ns or r["samples"] < least_samples:
            s.update(on=False, since=None)
            return ("run",)
        if not s["on"] and r["p99_ns"] >= suspend_ns:
            s.update(on=True, since=r["now_ns"])
        elif s["on"] and r["p99_ns"] < resume:
            s.update(on=False, since=None)
        if not s["on"]:
            return ("run",)
        if most_deferral_ns and r["now_ns"] - s["since"] >= most_deferral_ns:
            s.update(on=False, since=None)
            return ("override",)
        return ("suspended",)

    return fold(samples, "shard", ["look"], lambda: {"on": False, "since": None}, step, {"verdict": "string"})


def rate_budget(copies: DataFrame, most_bytes: int) -> DataFrame:
    """Per shard, copies ``(shard, copy_id, now_ns, bytes)`` against bytes per second: run, or refused for what is left of the window."""
    def step(w, r):
        if w.since is None or r["now_ns"] - w.since >= SECOND:
            w.since, w.used = r["now_ns"], 0
        left = max(0, most_bytes - w.used)
        if left == 0 or r["bytes"] > left:
            return "refused", left
        w.used += r["bytes"]
        return "run", left

    return fold(copies, "shard", ["now_ns", "copy_id"], Window, step, {"verdict": "string", "left_bytes": "long"})


def timeouts(events: DataFrame, idle_ns: int) -> DataFrame:
    """Connections ``(connection, event_id, at_ns)`` idle for too long before an event."""
    gap = F.col("at_ns") - F.lag("at_ns").over(W.Window.partitionBy("connection").orderBy("at_ns", "event_id"))
    return events.withColumn("gap_ns", gap).where(F.col("gap_ns") >= idle_ns).select("connection", "event_id", "gap_ns")


def publication_epochs(mutations: DataFrame, most: int = 32) -> DataFrame:
    """Mutations of a shard become visible in batches of ``most``, one epoch each."""
    n = F.row_number().over(W.Window.partitionBy("shard").orderBy("sequence"))
    return mutations.select("shard", "sequence", (F.floor((n - 1) / most) + 1).cast("long").alias("epoch"))


class History:
    """One key's operations in order of call: the states that some order of single steps allows.

    A state is a value and the pending operations that have taken effect. Only operations that overlap are
    pending, so the states follow the overlap and not the length. An operation takes effect as late as the
    return of it or of one that follows it allows, which loses no order.
    """

    def __init__(self):
        self.n, self.pending, self.returns, self.states = 0, {}, [], {(frozenset(), None)}

    def call(self, kind: str, value, seen, call: int, ret: int) -> None:
        self.until(call)
        if self.states:
            self.pending[self.n] = (kind, value, seen)
            heapq.heappush(self.returns, (ret, self.n))
        self.n += 1

    def until(self, at: int | None) -> None:
        """Operations that returned before ``at`` have taken effect; all of them without it."""
        while self.states and self.returns and (at is None or self.returns[0][0] < at):
            self._end(heapq.heappop(self.returns)[1])

    def _end(self, i: int) -> None:
        stack, met, ended = list(self.states), set(self.states), set()
        while stack:
            done, now = stack.pop()
            if i in done:
                ended.add((done - {i}, now))
                continue
            for j, (kind, value, seen) in self.pending.items():
                if j in done or kind == "get" and seen != now:
                    continue
                state = (done | {j}, now if kind == "get" else value if kind == "put" else None)
                if state not in met:
                    met.add(state)
                    stack.append(state)
        self.states = ended
        del self.pending[i]
        if not ended:
            self.pending, self.returns = {}, []


def history_check(history: DataFrame) -> DataFrame:
    """Keys whose concurrent history ``(key, id, kind, value, seen, call, ret)`` no order of single steps explains.

    ``kind`` is put, erase or get; ``seen`` is what a get answered, null for nothing. All operations of a key stream by in
    order of call through a window of those still pending, so no history is held in memory. An operation that is
    called when another returns overlaps it.
    """
    def text(x):
        return x if isinstance(x, str) else None

    def run(frames):
        key, h = None, None
        for f in frames:
            bad = []
            for k, kind, value, seen, call, ret in zip(*(f[c] for c in ("key", "kind", "value", "seen", "call", "ret")), strict=True):
                if h is None or text(k) != key:
                    if h is not None:
                        h.until(None)
                        if not h.states:
                            bad.append((key, h.n))
                    key, h = text(k), History()
                h.call(kind, text(value), text(seen), int(call), int(ret))
            yield pd.DataFrame(bad, columns=["key", "operations"])
        if h is not None:
            h.until(None)
            if not h.states:
                yield pd.DataFrame([(key, h.n)], columns=["key", "operations"])

    rows = history.select("key", "id", "kind", "value", "seen", "call", "ret")
    return rows.repartition("key").sortWithinPartitions("key", "call", "id").mapInPandas(run, "key string, operations long")
