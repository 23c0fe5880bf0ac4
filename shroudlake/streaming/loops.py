"""Action loops over a stream of signals, with state for each loop and timers for those that go silent.

A loop's signals are numbered from 0 and may arrive in any order; early ones wait in state. A turn is what the agent proposes together with how its execution went; while a loop waits for its user
only a reply, a dismissal or a stop counts, and else no reply does. A loop that has ended takes no more; of it one small state row is kept.

By event time a loop is timed out at the deadline that its last signal set, whether a timer finds it (the watermark has passed the deadline) or the next signal, which comes later than that; so the result does not
depend on how the stream is cut into micro-batches, as long as nothing is later than the watermark allows. By processing time only timers find it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.wording import search_query
from .state import LIMITS

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MAX_STEPS, LEAST = 5, 0.45
SIGNAL = "seq long, at long, kind string, action_type string, target string, value string, unsure boolean, needs_clarification boolean, exec_success boolean, searches boolean, plays boolean, query string"
STEP = "loop_id {key}, seq long, action_type string, guard_type string, guard_value string, stop_reason string, at long"
_FIELDS = tuple(c.split(" ")[0] for c in SIGNAL.split(", "))


def _ms(at: int | None) -> int:
    return 0 if at is None else at // 1000


class Loop(StatefulProcessor):
    """The state machine of one loop: next signal, turns taken, whether it is over, waits, or has typed something; what it typed and clicked; early signals.

    A signal comes and waits as one JSON text: each cell of a row costs more to read than what is done with it.
    """

    def __init__(self, max_steps: int, running_s: float, waiting_s: float, ask: bool, event_time: bool) -> None:
        self.max_steps, self.limits, self.ask, self.event_time = max_steps, (int(running_s * 1000), int(waiting_s * 1000)), ask, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, turns int, over boolean, waits boolean, typed boolean, deadline long, sent array<string>, clicked array<string>, n_early int")
        self.early = handle.getMapState("early", "seq long", "signal string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        state = list(self.at.get() or (0, 0, False, False, False, None, [], [], 0))
        if state[2]:
            return
        before, fresh = state[5], {}
        for r in rows:
            signal = json.loads(packed := r.signal)
            if (seq := signal.get("seq")) is not None and seq >= state[0] and seq not in fresh:
                fresh[seq] = packed, signal
        held = set()
        if state[8]:
            early = {k[0]: (v[0], json.loads(v[0])) for k, v in self.early.iterator()}
            held, fresh = early.keys(), early | fresh
        took = set()
        while not state[2] and state[0] in fresh:
            signal = tuple(map(fresh.pop(state[0])[1].get, _FIELDS))
            took.add(state[0])
            if self.event_time and state[5] is not None and _ms(signal[1]) > state[5]:
                yield self._ended(key, state, "timed_out")
                break
            if out := self._step(key, state, signal):
                yield out
            state[0] += 1
            base = _ms(signal[1]) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            state[5] = base + self.limits[bool(state[3])]
        if state[2]:
            if held:
                self.early.clear()
            state[6:] = [], [], 0
        else:
            for seq in fresh.keys() - held:
                self.early.updateValue((seq,), (fresh[seq][0],))
            for seq in took & held:
                self.early.removeKey((seq,))
            state[8] = len(fresh)
        if before is not None and (state[2] or state[5] != before):
            self.handle.deleteTimer(before)
        if not state[2] and state[5] is not None and state[5] != before:
            self.handle.registerTimer(state[5])
        self.at.update(tuple(state))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        state = list(self.at.get())
        if not state[2] and state[5] is not None and expiredTimerInfo.getExpiryTimeInMs() >= state[5]:
            yield self._ended(key, state, "timed_out")
            if state[8]:
                self.early.clear()
            state[6:] = [], [], 0
            self.at.update(tuple(state))

    def _ended(self, key: Any, state: list, why: str) -> Row:
        state[2] = True
        return Row(loop_id=key[0], seq=state[0], action_type=None, guard_type=None, guard_value=None, stop_reason=why, at=state[5] * 1000)

    def _step(self, key: Any, state: list, signal: tuple) -> Row | None:
        seq, at, kind, action, target, value, unsure, unclear, worked, searches, plays, query = signal
        guard, text, why = action, value, None
        if kind == "stop":
            why = "cancelled"
        elif state[3] or kind in ("reply", "dismiss"):
            if not state[3] or kind not in ("reply", "dismiss"):
                return None  # a reply that nothing waits for, or a turn while the user is asked
            guard = "wait"
            if kind == "dismiss":
                why = "cancelled"
            else:
                state[1], state[3] = state[1] + 1, False
                why = "max_steps" if state[1] >= self.max_steps else None
        else:
            first = state[1] == 0
            if action is None or action == "done":
                guard = "continue" if searches and not plays and first else "done"
            elif action == "type" and not first and value is not None and value in state[6]:
                guard = "done"
            elif action == "click" and not first and target is not None and target in state[7] and not state[4] and searches and query:
                guard, text = "type", query
            if guard == "done":
                why = "done"
            elif guard == "ask_user" or unclear:
                if self.ask:
                    state[3] = True
                    return Row(loop_id=key[0], seq=seq, action_type=action, guard_type=guard, guard_value=text, stop_reason=None, at=at)
                why = "ask_user" if guard == "ask_user" else "clarification"
            elif guard != "continue":
                ran = worked is None or worked
                if unsure:
                    why = "low_confidence"
                elif not ran:
                    why = "error"
                if why is None and guard == "type":
                    state[4] = state[4] or bool(worked)
                    if worked and text is not None:
                        state[6] = [*state[6], text]
                elif why is None and guard == "click" and target is not None:
                    state[7] = [*state[7], target]
            state[1] += 1
            if why is None and state[1] >= self.max_steps:
                why = "max_steps"
        state[2] = why is not None
        return Row(loop_id=key[0], seq=seq, action_type=action, guard_type=guard, guard_value=text, stop_reason=why, at=at)

    def close(self) -> None:
        pass


def run_loops(
    signals: DataFrame, max_steps: int = MAX_STEPS, least: float = LEAST, running_s: float = LIMITS["server"], waiting_s: float = LIMITS["user"], ask: bool = True, delay: str | None = "10 minutes"
) -> DataFrame:
    """The steps of all loops of a stream, with what their guards make of each and why a loop ends: STEP, with at as a timestamp.

    signals: loop_id, seq, at, kind (turn, reply, dismiss or stop), task, action_type, target, value, confidence, needs_clarification, exec_success. ask: whether a question to the user waits for a
    reply; else it ends the loop. delay: how late signals may be by event time; None takes timers by processing time. Signals without a loop are left out, those without a number too.
    """
    spark = signals.sparkSession
    if spark.conf.get(STORE[0], None) != STORE[1]:
        raise ValueError(f"{STORE[0]} must be {STORE[1]}")
    searches = F.coalesce(F.rlike("task", F.lit(r"(?i)\b(search|find|look\s*up)\b")), F.lit(False))
    rows = signals.where("loop_id is not null").withColumns({
        "searches": searches,
        "plays": F.coalesce(F.rlike("task", F.lit(r"(?i)\b(play|watch|video|song|episode|listen)\b")), F.lit(False)),
        "query": F.when((F.col("action_type") == "click") & searches, search_query(F.col("task"))),  # no other signal asks for it
        "unsure": F.col("confidence") < least,
    })
    made = {"at": F.unix_micros(F.col("at").cast("timestamp"))}
    fields = [made.get(name, F.col(name)).cast(kind).alias(name) for name, kind in (c.split(" ") for c in SIGNAL.split(", "))]
    rows = rows.select("loop_id", "at", F.to_json(F.struct(*fields)).alias("signal"))
    if delay is not None:
        rows = rows.withWatermark("at", delay)
    made = STEP.format(key=signals.schema["loop_id"].dataType.simpleString())
    loop = Loop(max_steps, running_s, waiting_s, ask, delay is not None)
    found = rows.groupBy("loop_id").transformWithState(loop, made, "append", "ProcessingTime" if delay is None else "EventTime")
    return found.withColumn("at", F.timestamp_micros("at"))


class Assembler(StatefulProcessor):
    """Chunks of one text, held by number until the end mark and all before it are there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean, last long")
        self.chunks = handle.getMapState("chunks", "seq long", "chunk string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ARG002, N802, N803
        done, last = self.done.get() if self.done.exists() else (False, None)
        if done:
            return
        for r in rows:
            if r.seq is not None and not self.chunks.containsKey((r.seq,)):
                self.chunks.updateValue((r.seq,), (r.chunk or "",))
            if r.last and r.seq is not None:
                last = r.seq if last is None else min(last, r.seq)
        if last is not None:
            held = {k[0]: v[0] for k, v in self.chunks.iterator()}
            if all(i in held for i in range(last + 1)):
                yield Row(request_id=key[0], text="".join(held[i] for i in range(last + 1)), n_chunks=last + 1)
                self.chunks.clear()
                done = True
        self.done.update((done, last))

    def close(self) -> None:
        pass


def assembled(chunks: DataFrame) -> DataFrame:
    """(request_id, text, n_chunks) of a stream of chunks(request_id, seq, chunk, last), numbered from 0 and in any order, repeats too: a text is given once, when the chunk marked last and all before it have arrived."""
    rows = chunks.where("request_id is not null").select("request_id", F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("string").alias("chunk"), F.coalesce(F.col("last"), F.lit(False)).alias("last"))
    kind = chunks.schema["request_id"].dataType.simpleString()
    return rows.groupBy("request_id").transformWithState(Assembler(), f"request_id {kind}, text string, n_chunks long", "append", "None")


def answered(requests: DataFrame, replies: DataFrame, within: str = "180 seconds", delay: str = "10 minutes") -> DataFrame:
    """requests(request_id, task, asked_at) with the replies(request_id, reply, replied_at) that come in time, and outcome: answered, or timeout for a request that has none.

    Batch or stream. As a stream, both sides are kept until the watermark rules out a partner, and a request without one is given then. A request with several replies in time has a row for each;
    upserts(.., keep="first") keeps the first.
    """
    r = requests.withWatermark("asked_at", delay)
    p = replies.select(F.col("request_id").alias("_r"), "reply", "replied_at").withWatermark("replied_at", delay)
    met = r.join(p, (F.col("request_id") == F.col("_r")) & (F.col("replied_at") >= F.col("asked_at")) & (F.col("replied_at") <= F.col("asked_at") + F.expr(f"interval {within}")), "leftOuter")
    return met.select("request_id", "task", "asked_at", "reply", "replied_at", F.when(F.col("replied_at").isNull(), "timeout").otherwise("answered").alias("outcome"))
