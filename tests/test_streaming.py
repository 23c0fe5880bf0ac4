"""Streams against their batch forms and plain code: any cut into micro-batches, restarts, late and repeated input, silent keys."""

import os
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shroudlake.operators import history
from shroudlake.streaming import loops, sinks

SIGNALS = "loop_id long, seq long, at timestamp, kind string, task string, action_type string, target string, value string, confidence double, needs_clarification boolean, exec_success boolean"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def state(spark):
    own = sinks.with_state(spark)
    own.conf.set("spark.sql.shuffle.partitions", "1")
    return own


def arriving(spark, path, parts, schema, per=1):
    """A stream whose files, one for each of parts, come in order."""
    os.makedirs(path, exist_ok=True)
    for i, rows in enumerate(parts):
        add_file(spark, path, i, rows, schema)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(str(path))


def add_file(spark, path, i, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}-part")
    found = [f for f in os.listdir(f"{path}-part") if f.endswith(".parquet")][0]
    os.utime(f"{path}-part/{found}", (1_700_000_000 + i, 1_700_000_000 + i))
    os.rename(f"{path}-part/{found}", f"{path}/{i:04d}.parquet")


def signals(r, n_loops=45, n=14, gap=20):
    rows = []
    for k in range(n_loops):
        at = T0 + timedelta(seconds=int(r.integers(0, 3000)))
        task = str(r.choice(["search for red shoes", "play a song", "find hats and watch", "write to kim"]))
        for seq in range(int(r.integers(1, n))):
            at += timedelta(seconds=int(r.integers(1, gap)) if r.random() < 0.93 else int(r.choice([100, 400])))
            kind = str(r.choice(["turn"] * 6 + ["reply"] * 2 + ["dismiss", "stop"], p=[0.12] * 6 + [0.11] * 2 + [0.03, 0.03]))
            action = [None, "done", "ask_user", "ask_user", "type", "type", "type", "click", "click", "click", "scroll", "scroll"][int(r.integers(0, 12))]
            rows.append((k, seq, at, kind, task, action, f"t{r.integers(0, 3)}", f"v{r.integers(0, 3)}", float(r.choice([0.3, 0.5, 0.9], p=[0.04, 0.46, 0.5])), bool(r.random() < 0.05), bool(r.random() < 0.95)))
    return rows


def plain(rows, max_steps=5, least=0.45, limits=(45, 180), horizon=None):
    """The loops one by one."""
    by, out = {}, []
    for row in rows:
        by.setdefault(row[0], []).append(row)
    for k, own in by.items():
        turns, waits, typed, over, deadline, sent, clicked = 0, False, False, False, None, set(), set()
        for _, seq, at, kind, task, action, target, value, conf, unclear, ok in sorted(own, key=lambda x: x[1]):
            if deadline is not None and at > deadline:
                out.append((k, seq, None, None, "timed_out", deadline))
                over = True
                break
            guard, why, row = action, None, True
            searches, plays = task.startswith(("search", "find")), "song" in task or "watch" in task
            if kind == "stop":
                why = "cancelled"
            elif waits:
                row = kind in ("reply", "dismiss")
                guard = "wait"
                if kind == "dismiss":
                    why = "cancelled"
                elif kind == "reply":
                    waits, turns = False, turns + 1
                    why = "max_steps" if turns >= max_steps else None
            elif kind in ("reply", "dismiss"):
                row = False
            else:
                if action in (None, "done"):
                    guard = "continue" if searches and not plays and turns == 0 else "done"
                elif action == "type" and turns and value in sent:
                    guard = "done"
                elif action == "click" and turns and target in clicked and not typed and searches:
                    guard, value = "type", "red shoes" if "shoes" in task else "hats"
                if guard == "done":
                    why = "done"
                elif guard == "ask_user" or unclear:
                    waits = True
                elif guard != "continue":
                    why = "low_confidence" if conf < least else None if ok else "error"
                    if why is None and guard == "type":
                        typed = True
                        sent.add(value)
                    if why is None and guard == "click":
                        clicked.add(target)
                if not waits:
                    turns += 1
                    why = why or ("max_steps" if turns >= max_steps else None)
            if row:
                out.append((k, seq, action, guard, why, at))
            if why:
                over = True
                break
            deadline = at + timedelta(seconds=limits[waits])
        if not over and horizon is not None and deadline <= horizon:
            out.append((k, max(x[1] for x in own) + 1, None, None, "timed_out", deadline))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.loop_id, r.seq, r.action_type, r.guard_type, r.stop_reason, r["at"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("shuffled", [False, True])
def test_loops_match_plain_replay(state, tmp_path, shuffled):
    r = np.random.default_rng(4)
    rows = signals(r)
    rows.sort(key=lambda x: x[2])
    order = r.permutation(len(rows)) if shuffled else range(len(rows))
    rows_in = [rows[i] for i in order] + rows[:5]  # some come twice
    parts = [rows_in[i : i + 160] for i in range(0, len(rows_in), 160)]
    stream = loops.run_loops(arriving(state, str(tmp_path / "in"), parts, SIGNALS), delay="30 days")
    found = got(sinks.drained(stream, "loops"))
    assert found == plain(rows) and len({x[4] for x in found}) == 7


def test_loops_go_on_after_a_restart_and_time_out_by_the_watermark(state, tmp_path):
    rows = sorted(signals(np.random.default_rng(11), n_loops=25), key=lambda x: x[2])
    rows.append((999, 0, T0 + timedelta(hours=3), "turn", "write to kim", "scroll", None, None, 0.9, False, True))  # the watermark passes all others
    path, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    cuts = [rows[i : i + 70] for i in range(0, len(rows), 70)]
    arriving(state, path, cuts[:1], SIGNALS)
    for more in (cuts[1:2], cuts[2:]):  # each run ends and the next one starts from the checkpoint
        stream = loops.run_loops(state.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(path), delay="1 minute")
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", check).format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        done = len(os.listdir(path))
        for i, part in enumerate(more):
            add_file(state, path, done + i, part, SIGNALS)
    stream = loops.run_loops(state.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(path), delay="1 minute")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", check).format("parquet").option("path", out).outputMode("append").start().awaitTermination()
    assert got(state.read.schema(stream.schema).parquet(out)) == plain(rows, horizon=T0 + timedelta(hours=3) - timedelta(minutes=1))


def test_turns_alone_match_the_windows(state, tmp_path):
    r = np.random.default_rng(2)
    rows = [x for x in signals(r, n_loops=40, gap=2) if x[3] == "turn"]
    by = {}
    rows = [(k, by.setdefault(k, iter(range(99))).__next__(), T0 + timedelta(seconds=i), kind, task, "click" if a == "click" and False else a or "done", t, v, c, u, ok) for i, (k, _, _, kind, task, a, t, v, c, u, ok) in enumerate(rows)]
    rows = [x for x in rows if not (x[4].startswith(("search", "find")) and x[5] == "click")]  # a click that becomes typing is the stream's alone
    by = {}
    rows = [(x[0], by.setdefault(x[0], iter(range(99))).__next__(), *x[2:]) for x in rows]
    stream = loops.run_loops(arriving(state, str(tmp_path / "in"), [rows[:70], rows[70:]], SIGNALS), ask=False, delay="30 days", running_s=1e6)
    found = sorted((x[0], x[1], x[3], x[4]) for x in got(sinks.drained(stream, "loops")) if x[4] != "timed_out")
    steps = state.createDataFrame(rows, SIGNALS).withColumnRenamed("seq", "step").withColumn("cancelled", F.lit(False))
    batch = history.guarded(steps).withColumn("action_type", F.when(F.col("guard_type") != "continue", F.col("guard_type")).otherwise("continue"))
    batch = history.replay(batch.withColumn("confidence", F.when(F.col("action_type") != "continue", F.col("confidence"))).withColumn("needs_clarification", F.col("needs_clarification") & (F.col("action_type") != "continue")).withColumn("exec_success", F.col("exec_success") | (F.col("action_type") == "continue")))
    assert found == sorted((x.loop_id, x.step, x.guard_type, x.stop_reason) for x in batch.collect())


def test_silent_loops_time_out_by_the_clock(state, tmp_path):
    rows = [(1, 0, T0, "turn", "t", "scroll", None, None, 0.9, False, True), (2, 0, T0, "turn", "t", "ask_user", None, None, 0.9, False, True), (3, 0, T0, "turn", "t", "done", None, None, 0.9, False, True)]
    stream = loops.run_loops(arriving(state, str(tmp_path / "in"), [rows], SIGNALS), delay=None, running_s=0.5, waiting_s=3600)
    q = stream.writeStream.trigger(processingTime="300 milliseconds").format("memory").queryName("silent").outputMode("append").start()
    try:
        for _ in range(100):
            time.sleep(0.3)
            found = {(r.loop_id, r.stop_reason) for r in state.sql("select * from silent").collect()}
            if (1, "timed_out") in found:
                break
    finally:
        q.stop()
    assert found == {(1, None), (1, "timed_out"), (2, None), (3, "done")}


def test_texts_are_assembled_in_any_order(state, tmp_path):
    r = np.random.default_rng(8)
    rows, want = [], set()
    for k in range(20):
        n = int(r.integers(1, 9))
        chunks = [f"{k}.{i} " if i % 3 else None for i in range(n)]
        rows += [(k, i, c, i == n - 1) for i, c in enumerate(chunks)]
        want.add((k, "".join(c or "" for c in chunks), n))
    rows += [(77, 0, "a", None), (77, 2, "c", True), (None, 0, "x", True), (78, None, "x", True)]  # never whole
    rows = [rows[i] for i in r.permutation(len(rows))] + rows[:9]
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    stream = loops.assembled(arriving(state, str(tmp_path / "in"), parts, "request_id long, seq long, chunk string, last boolean"))
    found = [tuple(x) for x in sinks.drained(stream, "texts").collect()]
    assert set(found) == want and len(found) == 20


def test_replies_meet_requests_as_in_batch(state, tmp_path):
    r = np.random.default_rng(6)
    asked = [(k, f"task {k}", T0 + timedelta(seconds=30 * k)) for k in range(60)] + [(None, "none", T0)]
    replies = [(int(k), f"r{i}", T0 + timedelta(seconds=30 * int(k) + int(r.integers(-20, 400)))) for i, k in enumerate(r.integers(0, 55, 80))]
    replies.append((500, "end", T0 + timedelta(days=1)))
    last = [(500, "end", T0 + timedelta(days=1))]
    a, b = "request_id long, task string, asked_at timestamp", "request_id long, reply string, replied_at timestamp"
    replies.sort(key=lambda x: x[2])
    mixed = [replies[i] for i in np.argsort([i + r.integers(0, 8) for i in range(len(replies))], kind="stable")]  # a little late
    req = arriving(state, str(tmp_path / "req"), [asked[:30], asked[30:], last], a)
    rep = arriving(state, str(tmp_path / "rep"), [mixed[:40], mixed[40:], [(501, "x", T0 + timedelta(days=1))]], b)
    found = sinks.drained(loops.answered(req, rep), "answers")
    batch = loops.answered(state.createDataFrame(asked, a), state.createDataFrame(replies, b))
    keep = lambda df: sorted(map(tuple, df.where("request_id is null or request_id < 500").collect()), key=str)
    assert keep(found) == keep(batch) and {x[5] for x in keep(batch)} == {"answered", "timeout"}


@pytest.mark.parametrize("keep", ["last", "first"])
def test_upserts_are_the_same_twice_and_after_failures(state, tmp_path, keep):
    r = np.random.default_rng(1)
    schema = state.createDataFrame([], "k long, ts timestamp, v string").schema
    batches = [[(int(r.integers(0, 40)) if r.random() < 0.95 else None, T0 + timedelta(seconds=int(r.integers(0, 1000))), f"b{b}.{i}") for i in range(30)] for b in range(4)]
    path = str(tmp_path / "table")
    put = sinks.upserts(path, schema, ["k"], "ts", keep, buckets=4)
    frames = [state.createDataFrame(b, schema) for b in batches]
    for b in (0, 1, 1, 2, 1, 3, 3):  # batches come again
        put(frames[b], b)
    put(state.createDataFrame([], schema), 4)
    rows = pd.DataFrame([(k, ts, v, b) for b, own in enumerate(batches) for k, ts, v in own], columns=["k", "ts", "v", "b"])
    found = state.read.parquet(path)
    times = {(x.k, x.ts) for x in found.collect()}
    best = rows.groupby("k", dropna=False)["ts"]
    assert {(None if pd.isna(k) else int(k), t.to_pydatetime()) for k, t in (best.max() if keep == "last" else best.min()).items()} == times
    assert found.count() == len(times) and {(x.ts, x.v) for x in found.collect()} <= set(zip(rows.ts, rows.v))


def test_streams_go_into_upserted_tables(state, tmp_path):
    rows = [(i % 7, T0 + timedelta(seconds=i * 13 % 100), f"s{i}") for i in range(60)]
    schema = "k long, ts timestamp, v string"
    stream = arriving(state, str(tmp_path / "in"), [rows[:20], rows[20:40], rows[40:]], schema)
    path = str(tmp_path / "table")
    sinks.drained(stream, "feed", sinks.upserts(path, stream.schema, ["k"], "ts"), str(tmp_path / "state"))
    want = {k: max((ts, v) for kk, ts, v in rows if kk == k) for k in range(7)}
    assert {r.k: r.ts for r in state.read.parquet(path).collect()} == {k: v[0] for k, v in want.items()}


def test_a_table_is_replayed_in_order(state):
    df = state.range(1000).withColumn("ts", F.timestamp_seconds(F.col("id") * 7 % 1000))
    seen = []
    sinks.drained(sinks.replayed(df, "ts", 4), "replay", lambda b, _: seen.append(b.agg(F.min("ts"), F.max("ts"), F.count("*")).first()))
    assert sum(x[2] for x in seen) == 1000 and len(seen) >= 3
    assert all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))
