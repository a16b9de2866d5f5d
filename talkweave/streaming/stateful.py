"""Streaming forms of the batch operators.

Keyed state lives in ``transformWithStateInPandas`` (RocksDB).  Before the shuffle the rows
of every Arrow batch are reduced per key, so a hot key sends a few rows per ten
thousand to its state task.
"""

from __future__ import annotations

import bisect
import json
import zlib
from typing import Any, Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkweave.functions._util import strip
from talkweave.functions.jsontext import get_path
from talkweave.functions.prompts import MEMORY_END, MEMORY_START
from talkweave.operators.classify import check_classification
from talkweave.operators.leads import company_key
from talkweave.operators.runs import workflow_summary
from talkweave.operators.sessions import STORE_TURNS, window_size
from talkweave.operators.tasks import apply_task_updates
from talkweave.session import shared_dir, use_rocksdb_state


def stream_workflow_summary(usage: DataFrame) -> DataFrame:
    """A1 kept up to date; write it in update mode."""
    return workflow_summary(usage)


def stream_classify_check(results: DataFrame, profile: dict) -> DataFrame:
    """F18 on arriving rows."""
    return check_classification(results, profile)


def _reduced(df: DataFrame, reduce, schema: str) -> DataFrame:
    """Applies a reducing pandas function to every Arrow batch before the shuffle.

    Each batch is reduced by itself, so the cost is linear and no partition is held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield reduce(batch)

    return df.mapInPandas(run, schema)


# --- T2 -----------------------------------------------------------------------------
class _Memory(StatefulProcessor):
    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "seq long, role string, content string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.messages.get())
        fresh = [tuple(r) for pdf in rows for r in pdf[["seq", "role", "content"]].itertuples(index=False)]
        window = sorted([tuple(m) for m in known] + fresh)[-self.size:]
        self.messages.put([(int(s), r, c) for s, r, c in window])
        lines = [f"{'User' if role == 'user' else 'Assistant'}: {content}" for _, role, content in window]
        yield pd.DataFrame(
            {"session_id": [key[0]], "last_seq": [int(window[-1][0])],
             "context": ["\n".join([MEMORY_START, *lines, MEMORY_END])]}
        )

    def close(self) -> None:
        pass


def stream_memory(messages: DataFrame, turns: int = STORE_TURNS, limit: int | None = None) -> DataFrame:
    """(session_id, last_seq, context) for every session touched by a micro-batch."""
    size = window_size(limit, turns)
    use_rocksdb_state(messages.sparkSession)
    rows = messages.select("session_id", "seq", "role", "content")
    trimmed = _reduced(
        rows,
        lambda pdf: pdf.sort_values("seq", kind="stable").groupby("session_id", sort=False).tail(size),
        rows.schema.simpleString()[7:-1].replace(":", " "),
    )
    return trimmed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Memory(size),
        outputStructType=f"session_id {dict(rows.dtypes)['session_id']}, last_seq long, context string",
        outputMode="Append", timeMode="None",
    )


# --- T3 -----------------------------------------------------------------------------
class _LastSubject(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, subject string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.last.get()) if self.last.exists() else None
        for pdf in rows:
            top = pdf.loc[pdf["seq"].idxmax()]
            if best is None or top["seq"] > best[0]:
                best = (int(top["seq"]), top["subject"])
        self.last.update(best)
        yield pd.DataFrame({"session_id": [key[0]], "seq": [best[0]], "subject": [best[1]]})

    def close(self) -> None:
        pass


def stream_subject(messages: DataFrame, document_turns_update: bool = False) -> DataFrame:
    """The last detected subject of every session touched by a micro-batch."""
    use_rocksdb_state(messages.sparkSession)
    rows = messages.filter(F.col("subject").isNotNull())
    if not document_turns_update and "is_document" in messages.columns:
        rows = rows.filter(~F.col("is_document"))
    rows = rows.select("session_id", F.col("seq").cast("long").alias("seq"), "subject")
    key = dict(rows.dtypes)["session_id"]
    schema = f"session_id {key}, seq long, subject string"
    trimmed = _reduced(
        rows, lambda pdf: pdf.sort_values("seq", kind="stable").groupby("session_id", sort=False).tail(1), schema
    )
    return trimmed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_LastSubject(), outputStructType=schema, outputMode="Append", timeMode="None"
    )


# --- T4 -----------------------------------------------------------------------------
class _FirstLead(StatefulProcessor):
    """Sends the first lead of a company, and again whenever an earlier one comes."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "input_seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            row = pdf.loc[[pdf["input_seq"].idxmin()]]
            if first is None or row["input_seq"].iloc[0] < first["input_seq"].iloc[0]:
                first = row
        if first is None:
            return
        before = self.seen.get()[0] if self.seen.exists() else None
        now = int(first["input_seq"].iloc[0])
        if before is None or now < before:
            self.seen.update((now,))
            yield first.assign(_key=key[0], replaces=pd.array([before], dtype="Int64"))[self.columns]

    def close(self) -> None:
        pass


def stream_lead_dedup(leads: DataFrame) -> DataFrame:
    """T4: the first lead per company; rows without a company pass.

    A lead with a smaller ``input_seq`` than the one sent before is sent as its replacement: ``replaces`` is the
    ``input_seq`` of the row it takes the place of, null for a first row.  :func:`current_leads` applies the
    replacements, so that files may come in any order.  State holds a number per company and grows with them by design.
    """
    use_rocksdb_state(leads.sparkSession)
    keyed = leads.withColumn("_key", company_key(F.col("company_name"))).withColumn(
        "input_seq", F.col("input_seq").cast("long")
    )
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    named = _reduced(
        keyed.filter(F.col("_key") != ""),
        lambda pdf: pdf.sort_values("input_seq", kind="stable").groupby("_key", sort=False).head(1),
        own,
    )
    first = named.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=_FirstLead([*keyed.columns, "replaces"]), outputStructType=f"{own}, replaces long",
        outputMode="Append", timeMode="None",
    )
    unnamed = keyed.filter(F.col("_key") == "").withColumn("replaces", F.lit(None).cast("long"))
    return first.unionByName(unnamed).drop("_key")


def current_leads(sent: DataFrame) -> DataFrame:
    """The leads a stream of :func:`stream_lead_dedup` stands for: what was sent without what was replaced."""
    key = company_key(F.col("company_name"))
    gone = sent.filter(F.col("replaces").isNotNull()).select(key.alias("_key"), F.col("replaces").alias("_gone")).distinct()
    kept = sent.withColumn("_k", key)
    return kept.join(gone, (F.col("_k") == F.col("_key")) & (F.col("input_seq") == F.col("_gone")), "left_anti").drop("_k", "replaces")


# --- T5 -----------------------------------------------------------------------------
_RUN = (
    "tool_calls long, completed boolean, last_step long, failed_calls long, tool_latency_ms double, "
    "first_ts timestamp, last_ts timestamp"
)
_RUN_COMBINE = {
    "tool_calls": "sum", "completed": "max", "last_step": "max", "failed_calls": "sum",
    "tool_latency_ms": "sum", "first_ts": "min", "last_ts": "max",
}


class _Run(StatefulProcessor):
    """Adds the rows of a batch to the run so far, whatever their order.

    With ``idle_ms``, a run without rows for so long leaves the state; what comes later is another part of it.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _RUN)
        self.part = handle.getValueState("part", "part long, due long")

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that is known of the part was sent with its last rows.
        if self.part.exists() and self.part.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            self.part.clear()
        yield from ()

    def _place(self, timerValues) -> int:
        """The number of the part: the time at which its first rows came; the timer is set anew."""
        if self.idle_ms is None:
            return 0
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.part.get() if self.part.exists() else None
        if known is not None:
            self.handle.deleteTimer(known[1])
        part = now if known is None else known[0]
        self.part.update((part, now + self.idle_ms))
        self.handle.registerTimer(now + self.idle_ms)
        return part

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pdf[list(_RUN_COMBINE)] for pdf in rows]
        if self.state.exists():
            parts.insert(0, pd.DataFrame([tuple(self.state.get())], columns=list(_RUN_COMBINE)))
        whole = pd.concat(parts).agg(_RUN_COMBINE)
        values = {
            "tool_calls": int(whole["tool_calls"]), "completed": bool(whole["completed"]),
            "last_step": int(whole["last_step"]), "failed_calls": int(whole["failed_calls"]),
            "tool_latency_ms": float(whole["tool_latency_ms"]),
            "first_ts": pd.Timestamp(whole["first_ts"]), "last_ts": pd.Timestamp(whole["last_ts"]),
        }
        self.state.update(
            tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in values.values())
        )
        yield pd.DataFrame([{"trace_id": key[0], "part": self._place(timerValues), **values}])

    def close(self) -> None:
        pass


def stream_run_summary(steps: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """T5: A2 per trace and part of it, sent on every change; :func:`current_runs` puts the parts together.

    The state of a trace is a few numbers.  Without ``idle_ms`` it is kept and a trace has one part.  With it, a
    trace that gets no rows for so many milliseconds leaves the state, whose size is then that of the active traces;
    rows that come later begin another part, so nothing is lost and rows may still come in any order and at any time.
    Spark runs micro-batches without rows for the timers, so such a stream takes a processing-time trigger and has no end.
    """
    use_rocksdb_state(steps.sparkSession)
    call = F.col("event") == "agent_tool_call"
    ok = get_path("payload", "ok", "boolean")
    flat = steps.select(
        "trace_id", call.cast("long").alias("tool_calls"),
        (F.col("event") == "agent_final_answer").alias("completed"), F.col("step").cast("long").alias("last_step"),
        F.coalesce(call & ~ok, F.lit(False)).cast("long").alias("failed_calls"),
        F.coalesce(F.when(call, get_path("payload", "latency_ms", "double")), F.lit(0.0)).alias("tool_latency_ms"),
        F.col("timestamp").cast("timestamp").alias("first_ts"), F.col("timestamp").cast("timestamp").alias("last_ts"),
    )
    schema = f"trace_id {dict(flat.dtypes)['trace_id']}, {_RUN}"
    partial = _reduced(
        flat, lambda pdf: pdf.groupby("trace_id", sort=False, as_index=False).agg(_RUN_COMBINE), schema
    )
    return partial.groupBy("trace_id").transformWithStateInPandas(
        statefulProcessor=_Run(idle_ms), outputStructType=f"trace_id {dict(flat.dtypes)['trace_id']}, part long, {_RUN}",
        outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def current_runs(sent: DataFrame) -> DataFrame:
    """One row per trace from what a stream of :func:`stream_run_summary` sent: the last version of every part, combined."""
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    parts = latest(sent, ["trace_id", "part"])
    return parts.groupBy("trace_id").agg(*[combine[how](name).alias(name) for name, how in _RUN_COMBINE.items()])


# --- T6 -----------------------------------------------------------------------------
def stream_audit(updates: DataFrame, tasks: DataFrame, folder: str,
                 derive: Callable[[DataFrame], DataFrame] = lambda batch: batch):
    """A stream writer that applies patches to a task table and keeps their audit rows.

    ``derive`` makes patches from rows.  Rows may come in any order: a micro-batch logs its rows in
    ``rows/v=<batch>`` below ``folder``, and computes the tasks it touches anew from ``tasks`` and all
    rows logged so far, so the result is that of the batch form.  Their patches are derived once and written to
    ``patches/v=<batch>``.  Only touched tasks and their audit
    rows are written, to ``tasks/v=<batch>`` and ``audit/v=<batch>``; read them by
    :func:`audited_tasks` and :func:`audit_trail`.  A replayed batch overwrites its own output, so a
    lost executor or driver leaves no duplicates.
    """
    spark = updates.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/v={batch_id}")
        logged = spark.read.schema(batch.schema).parquet(f"{folder}/rows").filter(F.col("v") <= batch_id)

        def of(rows: DataFrame, patches: DataFrame) -> DataFrame:
            """The rows of the tasks that have patches."""
            touched = patches.select(strip("task_id").alias("_touched")).distinct()
            return rows.join(touched, strip("task_id") == F.col("_touched"), "left_semi")

        derived = derive(logged.drop("v"))
        if batch_id > 0:
            derived = of(derived, derive(logged.filter(F.col("v") == batch_id).drop("v")))
        # The tasks and their audit read the patches many times.
        derived.write.mode("overwrite").parquet(f"{folder}/patches/v={batch_id}")
        patches = spark.read.schema(derived.schema).parquet(f"{folder}/patches/v={batch_id}")
        merged, audit, _ = apply_task_updates(of(tasks, patches), patches)
        merged.write.mode("overwrite").parquet(f"{folder}/tasks/v={batch_id}")
        audit.write.mode("overwrite").parquet(f"{folder}/audit/v={batch_id}")

    return updates.writeStream.foreachBatch(apply)


_STEP = "kind string, task_id string, seq long, at string, names array<string>, values array<string>, before array<string>, after array<string>"


# A state key is a group of tasks, whose state lies in so many slots, so that frames are paid for per group, and
# calls of the state store per slot, not per task.
TASK_GROUPS = 1024
TASK_SLOTS = 16
# Patches of a task that are kept and replayed together, and rows sent in one frame.
PAGE = 64
_SENT_ROWS = 4096


class _Patches(StatefulProcessor):
    """The patches of a group of tasks in order; a patch that comes late is replayed with those after it.

    ``tasks`` has, by slot, each task's cells in the task table and its log: the first seq of every page and the last
    page.  The full pages before are in ``pages``.  A page has the state before its first patch, so that a replay begins
    at the page of the first changed patch.  A slot is read and written once for all its tasks in a batch.
    """

    def __init__(self, columns: list[str], page: int = PAGE):
        self.columns = columns
        self.fields = [c for c in columns if c not in ("task_id", "created_at")]
        self.page = page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = handle.getMapState("tasks", "slot int", "held string")
        self.pages = handle.getMapState("pages", "task_id string, place int", "page string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues) -> None:
        slots: dict[int, dict[str, list[str]]] = {}
        for task, cells in zip(initialState["task_id"], initialState["_cells"]):
            slots.setdefault(_slot(task), {}).setdefault(task, [cells, ""])
        for slot, tasks in slots.items():
            self.tasks.updateValue((slot,), (json.dumps(tasks | self._held(slot)),))

    def _held(self, slot: int) -> dict[str, list[str]]:
        """The (cells, log) of the tasks of a slot."""
        known = self.tasks.getValue((slot,))
        return {} if known is None else json.loads(known[0])

    def _given(self, rows: Iterator[pd.DataFrame]) -> dict[str, dict[int, dict]]:
        """The new parts of patches by task and seq; of a field given twice the larger value."""
        given: dict[str, dict[int, dict]] = {}
        for pdf in rows:
            for task, seq, at, field, value in pdf[["task_id", "seq", "at", "field", "value"]].itertuples(index=False):
                _add(given.setdefault(task, {}), {"seq": int(seq), "at": at, "payload": {field: value}})
        return given

    def _replayed(self, task: str, cells: str, log: str, given: dict[int, dict]) -> tuple[list[dict], str]:
        """The new states of a task from its first changed patch on, and its new log."""
        raw = json.loads(cells)
        start = {"cells": {c: raw.get(c) or "" for c in self.columns} | {"task_id": task}, "given": [], "patches": []}
        known = json.loads(log) if log else {"starts": [min(given)], "last": start}
        starts, first = known["starts"], min(given)
        place = max(0, bisect.bisect_right(starts, first) - 1)
        pages = [json.loads(self.pages.getValue((task, i))[0]) for i in range(place, len(starts) - 1)] + [known["last"]]
        patches: dict[int, dict] = {}
        for patch in [p for page in pages for p in page["patches"]] + list(given.values()):
            _add(patches, patch)
        state, had = pages[0]["cells"], set(pages[0]["given"])
        out, order, kept = [], sorted(patches), []
        for i, seq in enumerate(order):
            if i % self.page == 0:
                kept.append({"cells": state, "given": sorted(had), "patches": []})
            patch = patches[seq]
            kept[-1]["patches"].append(patch)
            after = state | {f: v for f, v in patch["payload"].items() if f in self.fields} | {"updated_at": patch["at"]}
            if after["status"].strip().lower() == "done" and after["completed_at"] == "":
                after["completed_at"] = patch["at"]
            had |= patch["payload"].keys()
            if seq >= first:
                names = sorted(patch["payload"])
                out.append({"kind": "patch", "task_id": task, "seq": seq, "at": patch["at"], "names": names, "values": [patch["payload"][n] for n in names],
                            "before": [state[c] for c in self.columns], "after": [after[c] for c in self.columns]})
            state = after
        for i, page in enumerate(kept[:-1]):
            self.pages.updateValue((task, place + i), (json.dumps(page),))
        log = json.dumps({"starts": starts[:place] + [page["patches"][0]["seq"] for page in kept], "last": kept[-1]})
        # Fields no patch gave keep the value of the table, also null.
        set_here = had | {"updated_at", "completed_at"}
        final = [state[c] if c in set_here and c in self.fields else raw.get(c) for c in self.columns]
        out.append({"kind": "task", "task_id": task, "seq": order[-1], "at": None, "names": None, "values": None, "before": None, "after": final})
        return out, log

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots: dict[int, list[tuple[str, dict[int, dict]]]] = {}
        for task, given in self._given(rows).items():
            slots.setdefault(_slot(task), []).append((task, given))
        blank = dict.fromkeys(f.split()[0] for f in _STEP.split(", "))
        out: list[dict] = []
        for slot, touched in slots.items():
            held = self._held(slot)
            for task, given in touched:
                if task in held:
                    states, log = self._replayed(task, *held[task], given)
                    held[task][1] = log
                    out += states
                else:
                    out += [blank | {"kind": "reject", "task_id": task, "seq": s} for s in sorted(given)]
                if len(out) >= _SENT_ROWS:
                    yield pd.DataFrame(out)
                    out = []
            if held:
                self.tasks.updateValue((slot,), (json.dumps(held),))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _slot(task: str) -> int:
    return zlib.crc32(task.encode()) % TASK_SLOTS


def _add(patches: dict[int, dict], part: dict) -> None:
    """Adds a part of a patch to the patches of a task: the later time, and of a field given twice the larger value."""
    if part["seq"] not in patches:
        patches[part["seq"]] = part
        return
    patch = patches[part["seq"]]
    patch["at"] = max(patch["at"], part["at"])
    for field, value in part["payload"].items():
        patch["payload"][field] = max(patch["payload"][field], value) if field in patch["payload"] else value


def stream_patches(updates: DataFrame, tasks: DataFrame) -> DataFrame:
    """T6 as one stateful operator over patch rows (task_id, seq, at, field, value without nulls).

    The task table is the initial state, read once.  A micro-batch reads its own rows and the slots of the tasks it
    touches (all tasks lie in ``TASK_GROUPS * TASK_SLOTS`` slots, by hash); each of these tasks replays its patches from the first changed one on and sends their new states (kind
    ``patch``), the task (``task``), or a rejection (``reject``).  Rows may come in any order.  See :func:`patched_history` and :func:`patched_tasks`.
    """
    use_rocksdb_state(updates.sparkSession)
    columns = tasks.columns
    group = F.pmod(F.xxhash64("task_id"), F.lit(TASK_GROUPS)).cast("int").alias("_group")
    cells = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_cells")
    base = tasks.select(strip("task_id").alias("task_id"), cells).select("*", group)
    rows = updates.select(
        strip("task_id").alias("task_id"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("string").alias("at"), "field", "value"
    )
    return rows.select("*", group).groupBy("_group").transformWithStateInPandas(
        statefulProcessor=_Patches(columns), outputStructType=_STEP, outputMode="Append", timeMode="None",
        initialState=base.groupBy("_group"),
    )


def patched_history(sent: DataFrame, columns: list[str]) -> DataFrame:
    """The history (task_id, seq, at, payload, before, after) a stream of :func:`stream_patches` stands for."""
    last = latest(sent.filter("kind = 'patch'"), ["task_id", "seq"])

    def cells(name: str) -> Column:
        return F.struct(*[F.get(name, F.lit(i)).alias(c) for i, c in enumerate(columns)]).alias(name)

    return last.select("task_id", "seq", "at", F.map_from_arrays("names", "values").alias("payload"), cells("before"), cells("after"))


def patched_tasks(tasks: DataFrame, sent: DataFrame) -> DataFrame:
    """The task table after the patches a stream of :func:`stream_patches` has taken."""
    last = latest(sent.filter("kind = 'task'"), ["task_id"]).select(F.col("task_id").alias("_tid"), "after")
    joined = tasks.join(last, strip("task_id") == F.col("_tid"), "left")
    return joined.select(*[F.when(F.col("_tid").isNotNull(), F.get("after", F.lit(i))).otherwise(F.col(c)).alias(c) for i, c in enumerate(tasks.columns)])


def _last_written(versions: DataFrame) -> DataFrame:
    """The rows of each task's last version."""
    last = versions.groupBy(strip("task_id").alias("_tid")).agg(F.max("v").alias("_v"))
    current = versions.join(last, (strip("task_id") == F.col("_tid")) & (F.col("v") == F.col("_v")))
    return current.drop("v", "_tid", "_v")


def audited_tasks(tasks: DataFrame, folder: str) -> DataFrame:
    """The task table after all micro-batches of :func:`stream_audit`."""
    written = _last_written(tasks.sparkSession.read.parquet(f"{folder}/tasks")).select(tasks.columns)
    touched = written.select(strip("task_id").alias("_touched")).distinct()
    untouched = tasks.join(touched, strip("task_id") == F.col("_touched"), "left_anti")
    return untouched.unionByName(written)


def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    """The audit rows after all micro-batches of :func:`stream_audit`."""
    return _last_written(spark.read.parquet(f"{folder}/audit"))


# --- draining -------------------------------------------------------------------------
def drain(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Runs a stream over the available input and returns what it sent, with its batch number.

    Each micro-batch overwrites a folder of its own, so replays do not duplicate rows.
    """
    spark: SparkSession = stream.sparkSession
    root = shared_dir(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .outputMode(output_mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")


def latest(sent: DataFrame, keys: list[str], order: Column | str = "batch") -> DataFrame:
    """The last version of each key among the rows a stream sent."""
    rest = [c for c in sent.columns if c not in keys]
    picked = sent.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*").drop("batch")
