"""Reservations against an account's budget: a request is reserved before it is sent, and its life follows its events in event time.

    pending --reserve--> sending --answer--> done            (the answer's cost is spent, the reservation is given back)
                         sending --reject--> pending         (given back; it may be reserved again, up to the limit of attempts)
                         sending --error, timeout, answer without a cost--> ambiguous   (the reservation stays)
                         ambiguous --review--> pending       (given back)

A reservation that the budget doesn't hold is a budget_stop, one beyond the attempts an attempt_limit; both leave the request as it is.
ledger_stream() is a keyed state with timers: events wait until the watermark has passed them, so they are applied in the order of
time whatever the order of arrival; repeated ids are applied once and late events not at all. ledger() applies whole tables by the same
rules, account by account in sorted partitions, without holding an account's events.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

KINDS = ("reserve", "answer", "reject", "error", "review")
#: What a change says: at is in microseconds since 1970.
CHANGE = "account long, request long, at long, outcome string, status string, attempts int, reserved double, spent double"
_NAMES = [part.split(" ")[0] for part in CHANGE.split(", ")]


@dataclass
class Limits:
    """An account's budget, what a reservation holds, attempts of a request, and how long an answer may take."""

    budget: float
    reservation: float
    attempts: int
    timeout_us: int


@dataclass
class Ledger:
    """One account: what it has spent, and [status, attempts, reserved, since] of each request."""

    spent: float = 0.0
    requests: dict[str, list] = field(default_factory=dict)

    def _change(self, request: str, at: int, outcome: str) -> tuple:
        status, attempts, reserved, _ = self.requests[request]
        return int(request), at, outcome, status, attempts, reserved, self.spent

    def deadline(self, limits: Limits) -> int | None:
        """When the first answer is overdue."""
        since = [r[3] for r in self.requests.values() if r[0] == "sending"]
        return min(since) + limits.timeout_us if since else None

    def expire(self, upto: int, limits: Limits) -> Iterator[tuple]:
        """Reservations that are overdue at a time become ambiguous, in the order of their deadlines."""
        overdue = sorted((r[3] + limits.timeout_us, request) for request, r in self.requests.items() if r[0] == "sending" and r[3] + limits.timeout_us <= upto)
        for at, request in overdue:
            self.requests[request][0] = "ambiguous"
            yield self._change(request, at, "timeout")

    def apply(self, at: int, request: int, kind: str, cost: float | None, limits: Limits) -> Iterator[tuple]:
        """The changes of an event, those of overdue reservations first; nothing for an event that doesn't fit the request's status."""
        yield from self.expire(at, limits)
        name = str(request)
        state = self.requests.get(name, ["pending", 0, 0.0, 0])
        status, attempts, reserved, since = state
        if kind == "reserve" and status == "pending":
            self.requests[name] = state
            held = sum(r[2] for r in self.requests.values())
            if attempts >= limits.attempts:
                yield self._change(name, at, "attempt_limit")
            elif self.spent + held + limits.reservation > limits.budget + 1e-12:
                yield self._change(name, at, "budget_stop")
            else:
                self.requests[name] = ["sending", attempts + 1, limits.reservation, at]
                yield self._change(name, at, "claimed")
        elif kind == "answer" and status == "sending":
            if cost is None or not cost >= 0:
                self.requests[name] = ["ambiguous", attempts, reserved, since]
                yield self._change(name, at, "unknown_cost")
            else:
                self.spent += cost
                self.requests[name] = ["done", attempts, 0.0, since]
                yield self._change(name, at, "answered")
        elif kind == "reject" and status == "sending":
            self.requests[name] = ["pending", attempts, 0.0, since]
            yield self._change(name, at, "rejected")
        elif kind == "error" and status == "sending":
            self.requests[name] = ["ambiguous", attempts, reserved, since]
            yield self._change(name, at, "error")
        elif kind == "review" and status == "ambiguous":
            self.requests[name] = ["pending", attempts, 0.0, since]
            yield self._change(name, at, "reviewed")


def _events(events: DataFrame) -> DataFrame:
    """(account, at, id, request, kind, cost) of the events whose kind and keys are known."""
    rows = events.where(F.col("kind").isin(*KINDS) & F.col("account").isNotNull() & F.col("request").isNotNull() & F.col("id").isNotNull() & F.col("ts").isNotNull())
    return rows.select(F.col("account").cast("long").alias("account"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"), F.col("request").cast("long").alias("request"), "kind", F.col("cost").cast("double").alias("cost"))


def ledger(events: DataFrame, limits: Limits, until_us: int | None = None) -> DataFrame:
    """Every change (see CHANGE) of a table of events: id, account, request, ts, kind, cost; with a time, none after it.

    An account's events lie in one partition, sorted by time and id, and are read once; what is held is the account's ledger. Repeated
    ids of an account count once, the first by time. Overdue reservations expire up to that time, or up to the account's last event.
    """
    rows = _events(events)
    if until_us is not None:
        rows = rows.where(F.col("at") <= until_us)
    once = rows.groupBy("account", "id").agg(F.min(F.struct("at", "request", "kind", "cost")).alias("e")).select("account", "id", "e.*")

    def run(batches):
        account, own = None, Ledger()

        def ended() -> Iterator[tuple]:
            if account is not None and until_us is not None:
                yield from ((account, *c) for c in own.expire(until_us, limits))

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["account"] != account:
                    out += ended()
                    account, own = r["account"], Ledger()
                out += [(account, *c) for c in own.apply(r["at"], r["request"], r["kind"], r["cost"], limits)]
            if out:
                yield _batch(out)
        last = list(ended())
        if last:
            yield _batch(last)

    return once.repartition("account").sortWithinPartitions("account", "at", "id").mapInArrow(run, CHANGE)


def _batch(changes: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*changes), kinds)], _NAMES)


class LedgerProcessor(StatefulProcessor):
    """An account's ledger as state, the events that wait for the watermark by their ids, and a timer for the next of them or the next deadline."""

    def __init__(self, limits: dict):
        self.limits = Limits(**limits)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ledger", T.StructType().add("said", "string"))
        self.waiting = handle.getMapState("waiting", T.StructType().add("id", "long"), T.StructType().add("at", "long").add("request", "long").add("kind", "string").add("cost", "double"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        soonest = set()
        for frame in rows:
            for at, id_, request, kind, cost in zip(frame["at"], frame["id"], frame["request"], frame["kind"], frame["cost"]):
                if at // 1000 <= passed:
                    continue  # late
                event = (int(at), int(request), str(kind), None if cost is None or cost != cost else float(cost))
                known = self.waiting.getValue((int(id_),)) if self.waiting.containsKey((int(id_),)) else None
                if known is None or event[0] < known[0]:
                    self.waiting.updateValue((int(id_),), event)
                    soonest.add(int(at) // 1000)
        if soonest:
            self.handle.registerTimer(min(soonest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        own = Ledger(**json.loads(self.state.get()[0])) if self.state.exists() else Ledger()
        waiting = sorted((event[0], id_[0], *event[1:]) for id_, event in self.waiting.iterator())
        changes: list[tuple] = []
        for at, id_, request, kind, cost in waiting:
            if at // 1000 <= passed:
                changes += own.apply(at, request, kind, cost, self.limits)
                self.waiting.removeKey((id_,))
        changes += own.expire(passed * 1000, self.limits)
        self.state.update((json.dumps(asdict(own)),))
        deadline = own.deadline(self.limits)
        coming = [at // 1000 for at, *_ in waiting if at // 1000 > passed] + ([] if deadline is None else [-(-deadline // 1000)])
        if coming:
            self.handle.registerTimer(min(coming))
        if changes:
            yield pd.DataFrame([(key[0], *c) for c in changes], columns=_NAMES)

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, limits: Limits, lateness: str = "1 hour") -> DataFrame:
    """ledger() over a stream of events, in append mode; needs the state store of RocksDB (spark.sql.streaming.stateStore.providerClass).

    Events up to lateness behind the newest are applied in their order. Changes come once the watermark has passed them.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    known = timed.where(F.col("kind").isin(*KINDS) & F.col("account").isNotNull() & F.col("request").isNotNull() & F.col("id").isNotNull())
    named = {"account": F.col("account").cast("long"), "at": F.unix_micros("ts"), "id": F.col("id").cast("long"), "request": F.col("request").cast("long"), "kind": F.col("kind"), "cost": F.col("cost").cast("double")}
    rows = known.select("ts", *[c.alias(n) for n, c in named.items()])
    schema = T.StructType.fromDDL(CHANGE)
    return rows.groupBy("account").transformWithStateInPandas(LedgerProcessor(asdict(limits)), schema, "Append", "EventTime")


def final_states(changes: DataFrame) -> DataFrame:
    """(account, request, status, attempts, reserved, outcomes) after all changes: the last one of each request by time."""
    order = F.struct("at", F.when(F.col("outcome") == "timeout", 0).otherwise(1).alias("late"), "attempts", "spent", "status", "reserved")
    last = changes.groupBy("account", "request").agg(F.max(order).alias("l"), F.count(F.lit(1)).alias("outcomes"))
    return last.select("account", "request", "l.status", "l.attempts", "l.reserved", "outcomes")
