"""Streams over several micro-batches give the batch result once drained."""

import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkweave.operators.leads import first_lead
from talkweave.operators.runs import run_summary
from talkweave.operators.sessions import memory_context
from talkweave.operators.tasks import TASK_COLUMNS, apply_task_updates, task_history
from talkweave.plans import mappings as M
from talkweave.streaming import stateful as ST


def in_batches(spark, df, path, order, n=3):
    """The rows written as ``n`` files in order, read back one file per micro-batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_memory_stream(spark, tmp_path):
    data = [(f"s{i % 4 if i % 3 else 0}", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(40)]
    messages = spark.createDataFrame(data, "session_id string, seq long, role string, content string")
    sent = ST.drain(ST.stream_memory(in_batches(spark, messages, tmp_path / "in", "seq"), 2), "t-memory")
    assert sent.select("batch").distinct().count() == 3
    got = {r["session_id"]: r["context"] for r in ST.latest(sent, ["session_id"]).collect()}
    assert got == {r["session_id"]: r["context"] for r in memory_context(messages, 2).collect()}


def test_lead_stream(spark, tmp_path):
    data = [(i, "  " if i % 5 == 0 else f"Co{i % 7}".upper() if i % 2 else f"co{i % 7} ") for i in range(30)]
    leads = spark.createDataFrame(data, "input_seq long, company_name string")
    sent = ST.drain(ST.stream_lead_dedup(in_batches(spark, leads, tmp_path / "in", "input_seq")), "t-leads")
    assert sorted(r["input_seq"] for r in sent.collect()) == sorted(r["input_seq"] for r in first_lead(leads).collect())


@pytest.mark.parametrize("step", [7, 11, 29])
def test_lead_stream_in_any_order(spark, tmp_path, step):
    data = [(i, " " if i % 5 == 0 else f"Co{i % 7}".upper() if i % 2 else f"co{i % 7} ", i * step % 30) for i in range(30)]
    leads = spark.createDataFrame(data, "input_seq long, company_name string, n int")
    sent = ST.drain(ST.stream_lead_dedup(in_batches(spark, leads, tmp_path / "in", "n", 5)), "t-leads")
    assert sent.filter("replaces IS NOT NULL").count() > 0
    got = ST.current_leads(sent).select("input_seq", "company_name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, first_lead(leads).select("input_seq", "company_name").collect()))


def test_run_stream_takes_rows_in_any_order(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    data = [
        (i * 7919 % 60, f"t{i % 7}", i % 5, "agent_final_answer" if i % 11 == 0 else "agent_tool_call",
         (start + dt.timedelta(minutes=i)).isoformat(), f'{{"ok":{"true" if i % 3 else "false"},"latency_ms":2.0}}')
        for i in range(60)
    ]
    steps = spark.createDataFrame(data, "n int, trace_id string, step int, event string, timestamp string, payload string")
    stream = in_batches(spark, steps, tmp_path / "in", "n", 5).withColumn("payload", F.try_parse_json("payload"))
    sent = ST.drain(ST.stream_run_summary(stream), "t-runs")
    assert sent.select("batch").distinct().count() == 5
    runs = {r["trace_id"]: r for r in ST.latest(sent, ["trace_id"]).collect()}
    batch = {r["trace_id"]: r for r in run_summary(steps.withColumn("payload", F.try_parse_json("payload"))).collect()}
    assert runs.keys() == batch.keys()
    for trace, row in batch.items():
        for name in ("tool_calls", "completed", "failed_calls"):
            assert runs[trace][name] == row[name]


def test_idle_runs_leave_the_state_and_lose_nothing(spark, tmp_path):
    # Each file has one of two runs, which rests in the next.
    data = [(i, f"t{i // 10 % 2}", i % 5, "agent_final_answer" if i % 11 == 0 else "agent_tool_call", f"2024-01-01T00:{i:02d}:00", '{"ok":true,"latency_ms":2.0}') for i in range(50)]
    steps = spark.createDataFrame(data, "n int, trace_id string, step int, event string, timestamp string, payload string")
    stream = in_batches(spark, steps, tmp_path / "in", "n", 5).withColumn("payload", F.try_parse_json("payload"))
    # A run is idle after a millisecond, so that each file begins a part.
    folder = str(tmp_path / "out")
    writer = ST.stream_run_summary(stream, idle_ms=1).writeStream.outputMode("append").foreachBatch(
        lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/batch={i}")
    )
    query = writer.option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    until = time.time() + 120
    while sum(p["numInputRows"] for p in query.recentProgress) < 50 and time.time() < until and query.isActive:
        time.sleep(1)
    query.stop()
    sent = spark.read.option("basePath", folder).parquet(folder)
    assert sent.select("trace_id", "part").distinct().count() > 2
    batch = {r["trace_id"]: r for r in run_summary(steps.withColumn("payload", F.try_parse_json("payload"))).collect()}
    runs = {r["trace_id"]: r for r in ST.current_runs(sent).collect()}
    assert runs.keys() == batch.keys()
    for trace, row in batch.items():
        for name in ("tool_calls", "completed", "failed_calls", "tool_latency_ms"):
            assert runs[trace][name] == row[name]


@pytest.mark.parametrize("step", [5, 17])
def test_patch_stream_in_any_order(spark, tmp_path, step):
    base = {c: "" for c in TASK_COLUMNS}
    tasks = spark.createDataFrame(
        [tuple((base | {"task_id": f" T{i}", "status": "done" if i == 2 else "pending", "notes": None if i else "n", "completed_at": None}).values()) for i in range(5)],
        ", ".join(f"{c} string" for c in TASK_COLUMNS),
    )
    kinds = ["status", "completed_at", "notes", "created_at", "nothing"]
    data = [
        (f"T{i % 4 if i % 9 else 9}", i // 2, f"2024-01-{i // 2 + 1:02d}", kinds[i * i % 5], ("Done " if i % 2 else "pending") if i * i % 5 == 0 else "" if i % 3 else f"v{i}", i * step % 48)
        for i in range(48)
    ]
    updates = spark.createDataFrame(data, "task_id string, seq long, at string, field string, value string, n int")
    stream = in_batches(spark, updates, tmp_path / "in", "n", 5)
    sent = ST.drain(ST.stream_patches(stream, tasks), "t-patches")
    assert sent.select("batch").distinct().count() == 5
    history, rejects = task_history(tasks, updates)
    got = ST.patched_history(sent, tasks.columns)
    view = lambda df: sorted((r["task_id"], r["seq"], r["at"], sorted(r["payload"].items()), tuple(r["before"]), tuple(r["after"])) for r in df.collect())
    assert view(got) == view(history)
    merged, _, _ = apply_task_updates(tasks, updates)
    assert sorted(map(repr, ST.patched_tasks(tasks, sent).collect())) == sorted(map(repr, merged.collect()))
    rejected = sent.filter("kind = 'reject'").select("task_id", "seq").distinct()
    assert sorted(map(tuple, rejected.collect())) == sorted(map(tuple, rejects.select("task_id", "seq").collect()))


@pytest.mark.parametrize("step", [5, 41])
def test_patch_pages_against_a_whole_replay(step):
    # A task's log in pages of three: each delivery, early or late, leaves what all its rows leave at once.
    class Kept(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    def fresh():
        keeper = ST._Patches(["task_id", "status", "notes", "completed_at", "updated_at"], page=3)
        keeper.tasks, keeper.pages = Kept(), Kept()
        keeper.handleInitialState((0,), pd.DataFrame({"task_id": ["T", "T"], "_cells": ['{"task_id": "T", "status": "open"}', "{}"]}), None)
        return keeper

    data = [("T", i, f"2024-01-{i % 28 + 1:02d}", ["status", "notes", "completed_at"][i % 3], ["done", f"n{i}", ""][i % 3]) for i in range(48)]
    data += [("T", i, "2024-02-01", "notes", "z") for i in range(0, 48, 7)]
    rows = pd.DataFrame(sorted(data, key=lambda r: r[1] * step % 48), columns=["task_id", "seq", "at", "field", "value"])
    keeper, last = fresh(), {}
    for start in range(0, len(rows), 9):
        sent = pd.concat(keeper.handleInputRows((0,), iter([rows[start:start + 9]]), None))
        last |= {(r["kind"], r["seq"] if r["kind"] == "patch" else 0): repr(dict(r)) for r in sent.to_dict("records")}
        whole = pd.concat(fresh().handleInputRows((0,), iter([rows[:start + 9]]), None)).to_dict("records")
        assert last == {(r["kind"], r["seq"] if r["kind"] == "patch" else 0): repr(dict(r)) for r in whole}
    assert len(keeper.pages) == 15 and len(keeper.tasks) == 1


def test_patch_stream_keys_do_not_grow_with_tasks(spark, tmp_path):
    # One state key, and a frame, for each task took most of the time.
    tasks = spark.range(20_000).select(F.col("id").cast("string").alias("task_id"), *[F.lit("").alias(c) for c in TASK_COLUMNS[1:]])
    updates = tasks.select("task_id", F.lit(1).alias("seq"), F.lit("2024-01-01").alias("at"), F.lit("notes").alias("field"), F.lit("x").alias("value"))
    updates.write.parquet(str(tmp_path / "in"))
    stream = ST.stream_patches(spark.readStream.schema(updates.schema).parquet(str(tmp_path / "in")), tasks)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "_group" in plan.split("TransformWithState")[1].splitlines()[0]
    sent = ST.drain(stream, "t-groups")
    assert sent.groupBy("kind").count().orderBy("kind").collect() == [("patch", 20_000), ("task", 20_000)]


def test_audit_stream(spark, tmp_path):
    base = {c: "" for c in TASK_COLUMNS}
    tasks = spark.createDataFrame(
        [tuple((base | {"task_id": f"T{i}", "status": "pending"}).values()) for i in range(4)], ", ".join(f"{c} string" for c in TASK_COLUMNS)
    )
    data = [(f"T{i % 3}", i, f"2024-01-{i + 1:02d}", "status" if i % 4 else "completed_at", ("done" if i % 2 else "pending") if i % 4 else "") for i in range(24)]
    # Five batches in mixed order.
    rows = [(*row, i * 7 % 24) for i, row in enumerate(data)]
    updates = spark.createDataFrame(rows, "task_id string, seq long, at string, field string, value string, n int")
    folder = str(tmp_path / "out")
    writer = ST.stream_audit(in_batches(spark, updates, tmp_path / "in", "n", 5), tasks, folder)
    writer.option("checkpointLocation", folder + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    merged, audit, _ = apply_task_updates(tasks, updates)
    assert spark.read.parquet(folder + "/tasks").select("v").distinct().count() == 5
    assert sorted(map(tuple, ST.audited_tasks(tasks, folder).collect())) == sorted(map(tuple, merged.collect()))
    assert sorted(map(tuple, ST.audit_trail(spark, folder).collect())) == sorted(map(tuple, audit.collect()))


def test_audit_stream_of_shuffled_lines(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("n", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    tasks = M.tasks(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    folder = str(tmp_path / "out")
    writer = ST.stream_audit(in_batches(spark, lines, tmp_path / "in", "n", 5), tasks, folder, M.task_updates)
    writer.option("checkpointLocation", folder + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    merged, _, _ = apply_task_updates(tasks, M.task_updates(lines))
    assert sorted(map(repr, ST.audited_tasks(tasks, folder).collect())) == sorted(map(repr, merged.collect()))


def test_audit_stream_derives_patches_once(spark, tmp_path):
    tasks = spark.createDataFrame([tuple(f"T{i}" if c == "task_id" else "" for c in TASK_COLUMNS) for i in range(4)], ", ".join(f"{c} string" for c in TASK_COLUMNS))
    updates = spark.createDataFrame([(f"T{i % 4}", i, "2024-01-01", "notes", f"v{i}") for i in range(12)], "task_id string, seq long, at string, field string, value string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    writer = ST.stream_audit(in_batches(spark, updates, tmp_path / "in", "seq", 1), tasks, str(tmp_path / "out"), lambda rows: rows.mapInPandas(counted, rows.schema))
    writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert seen.value == 12
    assert ST.audit_trail(spark, str(tmp_path / "out")).count() == 12
