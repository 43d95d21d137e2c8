"""The work machine as a keyed state: the same steps on a stream, with timers and a time to live, and on a table of events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mietwerk.operators.state import CLAIMABLE
from mietwerk.operators.work import BULK, CODES, MAX_DEFERRALS, MAX_PARK

#: What an event carries. `load` puts an item as it is; enqueue, claim and the dispositions are those of operators/work.py.
EVENT = (
    "kind string, key long, moment long, seq long, event string, mode string, payload string, fingerprint string, sticky string, outcome string, code string, note string, until long, environmental boolean, "
    "status string, attempts long, lease_until long, next_attempt_at long, deferrals long, created_at long, updated_at long"
)
ITEM = "status string, payload string, attempts long, lease_until long, next_attempt_at long, deferrals long, created_at long, updated_at long, outcome string, code string, note string"
FIELDS = tuple(f.split(" ")[0] for f in ITEM.split(", "))
CHANGE = f"kind string, key long, moment long, seq long, event string, changed boolean, {ITEM}"
#: How long an item that nothing happens to is remembered: 90 days.
TTL = 90 * 86_400_000
#: Events that a task of `replay` sorts, about.
DEALT = 1 << 16
ENDINGS = {"settle": ("done", "completed"), "cancel": ("cancelled", "cancelled"), "abandon": ("dead", "abandoned")}


def _known(value) -> bool:
    return value is not None and value == value


def _text(value) -> str | None:
    return value if _known(value) else None


def _number(value) -> int | None:
    return int(value) if _known(value) else None


def _map(text) -> dict[str, str]:
    return json.loads(text) if _known(text) and text else {}


def _shown(payload: dict[str, str]) -> str:
    return json.dumps(payload, sort_keys=True, ensure_ascii=False)


def _backoff(failures: int, cap: int = 900_000) -> int:
    return min(cap, 60_000 * 2 ** min(failures, 6))


class Machine:
    """One item's steps. An item is a dict of FIELDS; None stands for one that is not known yet."""

    def __init__(self, max_attempts: int = 4, max_deferrals: int = MAX_DEFERRALS, max_park: int = MAX_PARK, lease: int = 300_000):
        self.max_attempts, self.max_deferrals, self.max_park, self.lease = max_attempts, max_deferrals, max_park, lease

    def step(self, item: dict | None, e: dict) -> tuple[dict | None, bool]:
        """The item after the event, and whether it changed. An event that doesn't apply changes nothing; an unknown code is an error."""
        kind, now = e["event"], int(e["moment"])
        if kind == "load":
            return {c: (_number if c in ("attempts", "lease_until", "next_attempt_at", "deferrals", "created_at", "updated_at") else _text)(e.get(c)) for c in FIELDS} | {"payload": _shown(_map(e["payload"]))}, True
        if kind == "enqueue":
            return self._enqueued(item, e, now)
        if item is None:
            return None, False
        if kind == "claim":
            return self._claimed(item, now)
        return self._decided(item, e, now)

    def _enqueued(self, item: dict | None, e: dict, now: int) -> tuple[dict, bool]:
        new, mode, sticky = _map(e["payload"]), _text(e["mode"]) or "reset", _text(e["sticky"])
        old = _map(item["payload"]) if item else {}
        mark = _text(e["fingerprint"])
        same = item is not None and (mode == "ignore" or (mode == "fingerprint" and mark in old and old[mark] == new.get(mark)))
        if same:
            return (item | {"updated_at": now} if mode == "fingerprint" else item), False
        payload = old | new
        if sticky:
            payload[sticky] = "true" if "true" in (old.get(sticky), new.get(sticky)) else "false"
        fresh = {"deferrals": 0, "created_at": now} if item is None else {"deferrals": item["deferrals"], "created_at": item["created_at"]}
        return fresh | {"status": "pending", "payload": _shown(payload), "attempts": 0, "lease_until": None, "next_attempt_at": 0, "updated_at": now, "outcome": None, "code": None, "note": None}, True

    def _claimed(self, item: dict, now: int) -> tuple[dict, bool]:
        held = item["lease_until"] is not None and item["lease_until"] >= now
        if item["status"] not in CLAIMABLE or (item["next_attempt_at"] or 0) > now or held:
            return item, False
        again = item["status"] == "processing"
        note = "Reclaimed after an expired lease" if again else None
        return item | {"status": "processing", "lease_until": now + self.lease, "updated_at": now, "attempts": item["attempts"] + again, "note": note}, True

    def _decided(self, item: dict, e: dict, now: int) -> tuple[dict, bool]:
        how, code, said = e["event"], _text(e["code"]), _text(e["outcome"])
        if code is not None and code not in CODES:
            raise ValueError(f"unknown outcome code {code}")
        open_, gone = item["status"] in CLAIMABLE, item["status"] == "cancelled"
        parks, attempts = item["deferrals"] + 1, item["attempts"] + 1
        environmental = _known(e["environmental"]) and bool(e["environmental"])
        parked_out = how == "park" and ((not environmental and parks > self.max_deferrals) or now - item["created_at"] > self.max_park)
        exhausted = how == "retry" and attempts >= self.max_attempts
        note = (_text(e["note"]) or "")[:2000] or None
        if parked_out or exhausted:
            status, outcome = "dead", "abandoned" if parked_out else "failed"
            code = "parked_out" if parked_out else code or "attempts_exhausted"
        else:
            status, outcome = ENDINGS.get(how, (None, None))
            outcome = said or outcome
        if status is not None and (how == "cancel" or not gone):
            kept = {k: v for k, v in _map(item["payload"]).items() if k not in (*BULK, "completedAt")} | {"completedAt": str(now)}
            return item | {"status": status, "payload": _shown(kept), "lease_until": None, "updated_at": now, "outcome": outcome, "code": code, "note": note}, True
        if not open_ or status is not None:
            return item, False
        if how == "park":
            return item | {"status": "deferred", "deferrals": parks, "lease_until": None, "next_attempt_at": max(_number(e["until"]) or 0, now + 1000), "updated_at": now, "outcome": None, "code": code, "note": note}, True
        return item | {"status": "retry", "attempts": attempts, "lease_until": None, "next_attempt_at": now + _backoff(item["attempts"]), "updated_at": now, "outcome": None, "code": code, "note": note}, True


def _due_at(item: dict | None) -> int | None:
    """When an item can be claimed next; None if never."""
    if item is None or item["status"] not in CLAIMABLE:
        return None
    lease = item["lease_until"] + 1 if item["lease_until"] is not None else 0
    return max(lease, item["next_attempt_at"] or 0)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in CHANGE.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in ("key", "moment", "seq", "attempts", "lease_until", "next_attempt_at", "deferrals", "created_at", "updated_at"):
        out[c] = out[c].astype("Int64")
    return out


def _change(kind: str, key: int, e: dict, item: dict, changed: bool) -> tuple:
    return (kind, key, int(e["moment"]), int(e["seq"]), e["event"], changed, *[item[c] for c in FIELDS])


class WorkProcessor(StatefulProcessor):
    """Keeps an item's state by (kind, key). Each event gives a row; a timer gives a row `due` once a lease, a wait or a pause is over."""

    def __init__(self, machine: Machine, ttl: int = TTL):
        self.machine, self.ttl = machine, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", ITEM, self.ttl)

    def _read(self) -> dict | None:
        return dict(zip(FIELDS, self.item.get(), strict=True)) if self.item.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        events = pd.concat(list(rows)).sort_values(["moment", "seq"], kind="stable").to_dict("records")
        item, out = self._read(), []
        for e in events:
            item, changed = self.machine.step(item, e)
            if item is not None:
                out.append(_change(key[0], int(key[1]), e, item, changed))
        if item is not None:
            self.item.update(tuple(item[c] for c in FIELDS))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            at = _due_at(item)
            if at is not None and at > 0:
                self.handle.registerTimer(max(at, timerValues.getCurrentProcessingTimeInMs()))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        item, now = self._read(), expiredTimerInfo.getExpiryTimeInMs()
        at = _due_at(item)
        if at is not None and at <= now:
            yield _frame([_change(key[0], int(key[1]), {"moment": now, "seq": -1, "event": "due"}, item, False)])

    def close(self) -> None:
        pass


def work_stream(events: DataFrame, machine: Machine | None = None, ttl: int = TTL) -> DataFrame:
    """Changes of work items from a stream of events (EVENT): a row an event with the item afterwards, and rows `due`.

    Items live in the state store by (kind, key); nothing of other keys is read. Events of one key and batch are
    taken by moment and seq, batches as they come. A cancelled item stays cancelled until it is enqueued anew.
    Timers run on processing time, so an idle item is told due without an event of its own. State of an item
    that nothing happens to for `ttl` milliseconds goes. Needs the RocksDB state store.
    """
    return events.groupBy("kind", "key").transformWithStateInPandas(WorkProcessor(machine or Machine(), ttl), CHANGE, "Append", "ProcessingTime")


def replay(events: DataFrame, machine: Machine | None = None, last: bool = False) -> DataFrame:
    """Every change of every item of a table of events, by the same steps: what `work_stream` gives for them, but for rows `due`.

    With `last` only what an item's last event left, a row an item. Keys are dealt and sorted over as many tasks as
    the events, counted first, need at `DEALT` each: fewer, as Spark would make of rows that pack well, would sort far
    more at once. A task holds one item at a time, however many events a key has. A null kind or key is one of its own.
    """
    machine = machine or Machine()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, item, left = None, None, None
        for pdf in batches:
            out = []
            for e in pdf.to_dict("records"):
                own = (_text(e["kind"]), _number(e["key"]))
                if own != at:
                    if left is not None:
                        out.append(left)
                    at, item, left = own, None, None
                item, changed = machine.step(item, e)
                if item is not None:
                    left = _change(*own, e, item, changed)
                    if not last:
                        out.append(left)
                        left = None
            if out:
                yield _frame(out)
        if left is not None:
            yield _frame([left])

    tasks = max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // DEALT))
    ordered = events.repartition(tasks, "kind", "key").sortWithinPartitions("kind", "key", "moment", "seq")
    return ordered.mapInPandas(fold, CHANGE)
