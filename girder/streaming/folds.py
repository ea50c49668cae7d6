"""Sequential folds per key, as batch jobs and as streaming state.

Batch: rows are dealt by key, sorted, and streamed through; a task holds the state of one key at a time. Streaming:
transformWithState keeps it in the state store. Rows with a null key are those of one key. A sequence is one task's, so the
key should be fine enough: a job, a customer's or supplier's session, not a region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


_DDL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], dict], schema: pa.Schema) -> DataFrame:
    """step(state, row) -> the row that comes out; state is made anew for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != owner:
                    owner, state = row[key], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_pylist(out, schema)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, ddl(schema))


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


# ---- import jobs (ST01, ST02, W12) ---------------------------------------------------------------------------

# fixed values: the states of an import job in their order, how it may end, and its two plans
STATES = ("queued", "inspecting", "extracting", "compiling", "verifying", "publishing")
TERMINAL = ("completed", "cancelled", "failed")
PLANS = {"rebuild": STATES, "restore": ("queued", "inspecting", "verifying")}
RANK = {s: i for i, s in enumerate(STATES)}


def job_start() -> dict:
    return {"rank": -1, "ended": False, "elapsed": 0, "sequence": 0, "plan": None, "published": False}


def job_step(state: dict, job_id: Any, event: str, elapsed: int) -> dict:
    """The event with its sequence number, its clamped time and a verdict; refused events change nothing."""
    if state["ended"]:
        verdict = "after-end"
    elif event in TERMINAL:
        verdict = "accepted"
    elif event not in RANK:
        verdict = "unknown"
    elif RANK[event] <= state["rank"]:
        verdict = "repeated" if RANK[event] == state["rank"] else "backwards"
    elif state["plan"] and event not in PLANS[state["plan"]]:
        verdict = "off-plan"
    else:
        verdict = "accepted"
    sequence = None
    if verdict == "accepted":
        sequence, state["sequence"] = state["sequence"], state["sequence"] + 1
        state["elapsed"] = max(state["elapsed"], int(elapsed))
        if event in TERMINAL:
            state["ended"] = True
        else:
            state["rank"] = RANK[event]
            state["published"] |= event == "publishing"
            if state["plan"] is None and RANK[event] > RANK["inspecting"]:  # the first state behind inspecting tells the plan
                state["plan"] = "restore" if event == "verifying" else "rebuild"
    return {
        "job_id": job_id, "event": event, "verdict": verdict, "sequence": sequence, "elapsed": state["elapsed"],
        "total": len(PLANS[state["plan"]]) if state["plan"] else None, "published_before": bool(event == "cancelled" and verdict == "accepted" and state["published"]),
    }


JOB_SCHEMA = pa.schema([("job_id", pa.int64()), ("event", pa.string()), ("verdict", pa.string()), ("sequence", pa.int64()), ("elapsed", pa.int64()), ("total", pa.int64()), ("published_before", pa.bool_())])


def job_lifecycle(events: DataFrame) -> DataFrame:
    """events(job_id, ts, event_id, event, elapsed) checked against the lifecycle, in (ts, event_id) order."""
    rows = events.select("job_id", "ts", "event_id", "event", "elapsed")
    return ordered_fold(rows, "job_id", ["ts", "event_id"], job_start, lambda s, r: job_step(s, r["job_id"], r["event"], r["elapsed"]), JOB_SCHEMA)


class JobProcessor(StatefulProcessor):
    """The same checks over a stream keyed by job_id. Rows of one job in a micro-batch are ordered by (ts, event_id); what comes
    in a later micro-batch counts as later, whatever its time, as what was said of a state can't be taken back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "rank int, ended boolean, elapsed long, sequence long, plan string, published boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = ("rank", "ended", "elapsed", "sequence", "plan", "published")
        state = dict(zip(names, self.state.get())) if self.state.exists() else job_start()
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        job = None if pd.isna(key[0]) else int(key[0])
        out = [job_step(state, job, r.event, r.elapsed) for r in pdf.itertuples(index=False)]
        self.state.update(tuple(state[n] for n in names))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def job_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").transformWithStateInPandas(JobProcessor(), ddl(JOB_SCHEMA), "Append", "None")


# ---- budgeted residency (ST03, ST04) and scheduling (ST05) ----------------------------------------------------


class Residency:
    """What is resident under a decoded and a GPU budget, with pinned groups and a touch order."""

    def __init__(self, decoded: int, gpu: int):
        self.budget, self.used = (decoded, gpu), [0, 0]
        self.held: dict[str, dict] = {}
        self.clock = 0

    def _fits(self, cost: tuple[int, int], freed: tuple[int, int] = (0, 0)) -> bool:
        return all(self.used[k] - freed[k] + cost[k] <= self.budget[k] for k in (0, 1))

    def may_admit(self, cost: tuple[int, int], priority: int) -> bool:
        """An optimistic answer: never what is larger than the budget; else if there is room or anything colder."""
        if any(cost[k] > self.budget[k] for k in (0, 1)):
            return False
        return self._fits(cost) or any(not h["pinned"] and h["priority"] > priority for h in self.held.values())

    def request(self, chunk: str, cost: tuple[int, int], priority: int, pin: bool = False) -> tuple[str, list[str]]:
        """'touched', 'admitted' with what was evicted, or 'rejected', which changes nothing. A lower number is hotter;
        the coldest go first, of equals the one untouched longest, then the lower name. A pin outranks any priority."""
        self.clock += 1
        if chunk in self.held:
            own = self.held[chunk]
            own.update(touched=self.clock, priority=priority, pinned=own["pinned"] or pin)
            return "touched", []
        freed, out = [0, 0], []
        colder = sorted((c for c, h in self.held.items() if not h["pinned"] and (pin or h["priority"] > priority)), key=lambda c: (-self.held[c]["priority"], self.held[c]["touched"], c))
        for c in colder:
            if self._fits(cost, tuple(freed)):
                break
            out.append(c)
            freed = [freed[k] + self.held[c]["cost"][k] for k in (0, 1)]
        if not self._fits(cost, tuple(freed)):
            return "rejected", []
        for c in out:
            del self.held[c]
        self.used = [self.used[k] - freed[k] + cost[k] for k in (0, 1)]
        self.held[chunk] = {"cost": cost, "priority": priority, "touched": self.clock, "pinned": pin}
        return "admitted", out


RESIDENCY_SCHEMA = pa.schema([("session", pa.int64()), ("seq", pa.int64()), ("chunk", pa.string()), ("outcome", pa.string()), ("evicted", pa.string()), ("decoded_used", pa.int64()), ("gpu_used", pa.int64())])


def residency(requests: DataFrame, decoded: int, gpu: int) -> DataFrame:
    """requests(session, seq, chunk, decoded_bytes, gpu_bytes, priority, pin) admitted in order within each session."""

    def step(state: Residency, r: dict) -> dict:
        outcome, out = state.request(r["chunk"], (r["decoded_bytes"], r["gpu_bytes"]), r["priority"], bool(r["pin"]))
        return {"session": r["session"], "seq": r["seq"], "chunk": r["chunk"], "outcome": outcome, "evicted": ",".join(out), "decoded_used": state.used[0], "gpu_used": state.used[1]}

    return ordered_fold(requests.select("session", "seq", "chunk", "decoded_bytes", "gpu_bytes", "priority", "pin"), "session", ["seq"], lambda: Residency(decoded, gpu), step, RESIDENCY_SCHEMA)


class Scheduler:
    """One load at a time; a rejected load is not tried again until the demand changes."""

    def __init__(self, decoded: int, gpu: int):
        self.room, self.signature, self.rejected = Residency(decoded, gpu), None, set()

    def frame(self, wanted: list[tuple[str, int, int]]) -> tuple[str | None, list[str], list[str]]:
        """(what is loaded, skipped as resident, blocked) for chunks in demand order with their costs."""
        names = [w[0] for w in wanted]
        if names != self.signature:
            self.signature, self.rejected = names, set()
            for chunk, held in self.room.held.items():  # what is no longer wanted comes behind all that is
                held["priority"] = names.index(chunk) if chunk in names else len(names)
        skipped, blocked = [], []
        for rank, (chunk, decoded, gpu) in enumerate(wanted):
            if chunk in self.room.held:
                skipped.append(chunk)
            elif chunk in self.rejected or not self.room.may_admit((decoded, gpu), rank):
                self.rejected.add(chunk)
                blocked.append(chunk)
            elif self.room.request(chunk, (decoded, gpu), rank)[0] == "admitted":
                return chunk, skipped, blocked
            else:
                self.rejected.add(chunk)
                blocked.append(chunk)
        return None, skipped, blocked


SCHEDULER_SCHEMA = pa.schema([("session", pa.int64()), ("frame", pa.int64()), ("loaded", pa.string()), ("skipped", pa.string()), ("blocked", pa.string())])


def scheduled(frames: DataFrame, decoded: int, gpu: int) -> DataFrame:
    """frames(session, frame, wanted: array of (chunk, decoded, gpu) in demand order)."""

    def step(state: Scheduler, r: dict) -> dict:
        loaded, skipped, blocked = state.frame([(w["chunk"], w["decoded"], w["gpu"]) for w in r["wanted"]])
        return {"session": r["session"], "frame": r["frame"], "loaded": loaded, "skipped": ",".join(skipped), "blocked": ",".join(blocked)}

    return ordered_fold(frames.select("session", "frame", "wanted"), "session", ["frame"], lambda: Scheduler(decoded, gpu), step, SCHEDULER_SCHEMA)
