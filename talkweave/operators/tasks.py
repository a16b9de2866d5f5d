"""Task tables: listing, creation, ordered patches with an audit trail, user names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions._util import strip, text_or_blank
from talkweave.functions.text import has_confirmation, normalize_tags
from talkweave.operators.skew import (
    CHUNK_COLUMNS, SPAN, across_chunks, chunk_window, first_per_key, running_last, with_groups,
)

# --- fixed values: sheet headers and defaults --------------------------------
TASK_COLUMNS = (
    "task_id", "title", "description", "category", "project", "status", "priority",
    "due_date", "tags", "notes", "created_at", "updated_at", "completed_at",
    "source_agent", "trace_id",
)
AUDIT_COLUMNS = (
    "event_id", "timestamp", "action", "task_id", "trace_id", "session_id",
    "payload_json", "before_json", "after_json", "status", "message",
)
OPEN_STATUSES = ("pending", "in_progress", "blocked")
# --- end of fixed values ----------------------------------------------------


def reconcile_headers(df: DataFrame, required) -> DataFrame:
    """Existing columns in their order, then the missing ones as ''."""
    missing = [F.lit("").alias(c) for c in required if c not in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in df.columns], *missing)


def task_filter(status=None, category="", project="", search="", include_done=False) -> Column:
    """The row test behind :func:`list_tasks`."""
    if not status:
        wanted = list(OPEN_STATUSES)
    else:
        parts = status if isinstance(status, (list, tuple)) else str(status).split(",")
        wanted = [str(s).strip().lower() for s in parts if str(s).strip()]
    current = F.lower(strip(text_or_blank("status")))
    keep = F.lit(True) if include_done else current != "done"
    if wanted:
        keep = keep & ((current == "") | current.isin(*wanted))
    for name, needle in (("category", category), ("project", project)):
        if str(needle).strip():
            keep = keep & F.lower(text_or_blank(name)).contains(str(needle).strip().lower())
    if str(search).strip():
        joined = F.concat_ws(" ", *[text_or_blank(c) for c in ("title", "description", "tags", "notes")])
        keep = keep & F.lower(joined).contains(str(search).strip().lower())
    return keep


def list_tasks(tasks: DataFrame, order: str, limit: int | None = None, **filters) -> DataFrame:
    """Matching rows in sheet order, all of them without a limit; an empty status passes, ``done`` needs include_done."""
    found = tasks.filter(task_filter(**filters)).orderBy(order)
    return found if limit is None else found.limit(limit)


def confirmed_only(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes with ``confirmed`` set and a confirming user message; (accepted, rejects)."""
    ok = F.coalesce(F.col("confirmed"), F.lit(False)) & has_confirmation("user_message")
    rejects = df.filter(~ok).withColumn("code", F.lit("confirmation_required"))
    return df.filter(ok), rejects


def audit_rows(df: DataFrame, action: str, message: str, payload: Column, before: Column | None,
               after: Column | None, at: Column, key: list[Column]) -> DataFrame:
    """Audit rows with JSON text columns, '' for null; ids derive from content."""

    def as_json(value: Column | None) -> Column:
        return F.lit("") if value is None else F.coalesce(F.to_json(value), F.lit(""))

    def given(name: str) -> Column:
        return text_or_blank(name) if name in df.columns else F.lit("")

    digest = F.md5(F.concat_ws("|", F.lit(action), *[k.cast("string") for k in key]))
    values = [
        F.concat(F.lit("EVT_"), F.substring(digest, 1, 10)), at.cast("string"), F.lit(action),
        F.col("task_id"), given("trace_id"), given("session_id"),
        as_json(payload), as_json(before), as_json(after), F.lit("ok"), F.lit(message),
    ]
    return df.select(*[v.alias(n) for n, v in zip(AUDIT_COLUMNS, values)])


def create_tasks(new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(task rows, audit rows, rejects without a title).

    ``new`` has request_id and any of the task columns, ``tags`` as an array.
    """

    def cell(name: str, default: str = "") -> Column:
        if name not in new.columns:
            return F.lit(default)
        text = strip(F.coalesce(F.col(name).cast("string"), F.lit(default)))
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))

    given_id = F.nullif(F.col("task_id"), F.lit("")) if "task_id" in new.columns else F.lit(None)
    derived = F.concat(F.lit("TASK_"), F.substring(F.md5(F.col("request_id").cast("string")), 1, 10))
    values = {c: cell(c) for c in TASK_COLUMNS}
    values |= {
        "task_id": F.coalesce(given_id, derived),
        "status": cell("status", "pending"),
        "priority": cell("priority", "medium"),
        "tags": normalize_tags("tags") if "tags" in new.columns else F.lit(""),
        "created_at": now.cast("string"), "updated_at": now.cast("string"), "completed_at": F.lit(""),
    }
    titled = cell("title") != ""
    rejects = new.filter(~titled).withColumn("code", F.lit("title is required"))
    rows = new.filter(titled).select(
        F.struct(*new.columns).alias("_payload"), *[v.alias(c) for c, v in values.items()]
    )
    audit = audit_rows(
        rows, "create_task", "Task created", F.col("_payload"), None,
        F.struct(*TASK_COLUMNS), F.col("created_at"), [F.col("task_id")],
    )
    return rows.drop("_payload"), audit, rejects


def completion_patches(completions: DataFrame) -> DataFrame:
    """Completions (task_id, seq, at, note) as patches of status, completed_at and notes."""
    pairs = F.array(
        F.struct(F.lit("status").alias("field"), F.lit("done").alias("value")),
        F.struct(F.lit("completed_at").alias("field"), F.col("at").cast("string").alias("value")),
        F.struct(F.lit("notes").alias("field"), F.nullif(text_or_blank("note"), F.lit("")).alias("value")),
    )
    rows = completions.select("task_id", "seq", "at", F.explode(pairs).alias("p"))
    return rows.select("task_id", "seq", "at", "p.*").filter(F.col("value").isNotNull())


def task_history(tasks: DataFrame, updates: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """State of each task before and after every patch; (history, rejects of unknown tasks).

    ``updates`` has task_id, seq, at, field and value; rows sharing (task_id, seq)
    form one patch.  History columns are task_id, seq, payload, before, after.
    """
    columns = tasks.columns
    fields = [c for c in columns if c not in ("task_id", "created_at")]
    base = tasks.select(
        strip("task_id").alias("task_id"), *[text_or_blank(c).alias(f"b_{c}") for c in columns if c != "task_id"]
    )
    # Windows run over the patches and the first status alone; the other cells are joined to the sorted rows afterwards.
    joined = _patches(updates).join(base.groupBy("task_id").agg(F.max("b_status").alias("_status")), "task_id", "left")
    rejects = joined.filter(F.col("_status").isNull()).select(
        "task_id", "seq", F.concat(F.lit("Task not found: "), F.col("task_id")).alias("message")
    )
    last: dict[str, Column | str] = {f"l_{f}": f"p_{f}" for f in fields if f != "updated_at"}
    last |= {"l_updated_at": "at", "l_set": F.when(F.col("p_completed_at").isNotNull(), F.col("seq"))}
    raw = updates.select(strip("task_id").alias("task_id"), "seq")
    known = joined.filter(F.col("_status").isNotNull()).select("*", *[F.try_element_at("payload", F.lit(f)).alias(f"p_{f}") for f in fields])
    steps = running_last(known, ["task_id"], "seq", last, span, count_in=raw, keep_chunks=True)
    status = F.coalesce("p_status", "l_status", "_status")
    steps = steps.withColumns({"set_before": F.col("l_set"), "done": F.lower(strip(status)) == "done"})
    sets = F.col("p_completed_at").isNotNull()
    # completed_at keeps its explicit value; a blank one is stamped by the first patch that leaves the task done at or
    # after the patch that set that value, found among the rows before in the same windows.
    earlier = chunk_window(["task_id"], "seq")
    steps = steps.withColumn("_done_before", F.last(F.when(F.col("done"), F.col("seq")), ignorenulls=True).over(earlier))
    no_done = F.col("_done_before").isNull() | F.coalesce(F.col("_done_before") < F.col("set_before"), F.lit(False))
    first_done = F.when(F.col("done") & (sets | no_done), F.struct("seq", "at"))
    steps = steps.withColumn("_stamp", F.last(first_done, ignorenulls=True).over(earlier))
    # Of a value that holds over a border between chunks the stamp is looked up; a patch that sets one ends the one before.
    segment = F.when(sets, F.col("seq")).otherwise(F.col("set_before"))
    told = steps.select(*CHUNK_COLUMNS, "task_id", "seq", "at", "done", segment.alias("_own"), F.explode(F.array_distinct(F.array(segment, "set_before"))).alias("set_before"))
    own_done = F.when(F.col("done") & F.col("_own").eqNullSafe(F.col("set_before")), F.struct("seq", "at"))
    steps = with_groups(steps, across_chunks(told, ["task_id"], "set_before", {"_first": F.min(own_done)}), ["task_id"], "set_before")

    before = {f: F.coalesce(F.col(f"l_{f}"), F.col(f"b_{f}")) for f in fields}
    after = {f: F.coalesce(F.col(f"p_{f}"), before[f]) for f in fields} | {"updated_at": F.col("at")}
    steps = steps.join(base, "task_id")
    local = F.col("_stamp").isNotNull() & (F.col("set_before").isNull() | (F.col("_stamp.seq") >= F.col("set_before")))
    reached = F.when(F.col("_across"), F.col("_first.seq") < F.col("seq")).otherwise(local)
    stamp = F.when(F.col("_across"), F.col("_first.at")).otherwise(F.col("_stamp.at"))
    kept = F.when(before["completed_at"] != "", before["completed_at"]).when(reached, stamp)

    now_done = F.when(F.col("done"), F.col("at")).otherwise("")
    completed_before = kept.otherwise("")
    completed_after = (
        F.when(F.coalesce(F.col("p_completed_at"), F.lit("")) != "", F.col("p_completed_at")).when(sets, now_done).otherwise(kept.otherwise(now_done))
    )

    created = F.col("b_created_at") if "created_at" in columns else F.lit("")

    def state(values: dict[str, Column], completed: Column) -> Column:
        cells = values | {"task_id": F.col("task_id"), "created_at": created, "completed_at": completed}
        return F.struct(*[cells[c].alias(c) for c in columns])

    history = steps.select(
        "task_id", "seq", "at", "payload", state(before, completed_before).alias("before"), state(after, completed_after).alias("after")
    )
    return history, rejects


def _patches(updates: DataFrame) -> DataFrame:
    """One row per (task_id, seq) with its fields as a map (the larger value if one is given twice)."""
    entries = F.array_sort(F.collect_list(F.struct("field", "value")))
    rows = updates.groupBy(strip("task_id").alias("task_id"), "seq").agg(
        F.max(F.col("at").cast("string")).alias("at"), entries.alias("_e")
    )
    names = F.array_distinct(F.transform("_e", lambda e: e["field"]))
    last = F.transform(
        names, lambda n: F.element_at(F.filter("_e", lambda e: e["field"] == n), -1)["value"]
    )
    return rows.select("task_id", "seq", "at", F.map_from_arrays(names, last).alias("payload"))


def _is_done(status: Column) -> Column:
    return F.lower(strip(status)) == "done"


def final_tasks(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """The task table after all patches, by aggregates that combine before the shuffle.

    It equals the last ``after`` state of :func:`task_history`.  A blank
    ``completed_at`` is stamped by the first patch that leaves the task done after
    the last explicit value; that patch is found from the status patches around it.
    """
    columns = tasks.columns
    fields = [c for c in columns if c not in ("task_id", "created_at", "updated_at")]
    rows = updates.select(
        strip("task_id").alias("_tid"), "seq", F.col("at").cast("string").alias("at"), "field", "value"
    )
    point = F.struct("seq", "at")
    per_field = rows.groupBy("_tid", "field").agg(
        F.max(F.struct("seq", "value")).alias("last"), F.max(point).alias("hi"), F.min(point).alias("lo")
    )
    # At most one entry per task column.
    per_task = per_field.groupBy("_tid").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("field").isin(*fields), F.struct("field", F.col("last.value"))))
        ).alias("_new"),
        F.max("hi").alias("_hi"),
        F.min("lo").alias("_lo"),
        F.max(F.when(F.col("field") == "completed_at", F.col("last.seq"))).alias("_set"),
        F.min(F.when(F.col("field") == "status", F.col("lo.seq"))).alias("_status_lo"),
    )
    base = tasks.withColumn("_tid", strip("task_id"))
    patched = base.join(per_task, "_tid", "left")

    def new(name: str) -> Column:
        return F.coalesce(F.try_element_at("_new", F.lit(name)), F.col(name))

    # Tasks whose last explicit completed_at is blank and that were done at some time.
    open_tasks = patched.filter(F.col("_hi").isNotNull() & (text_or_blank(new("completed_at")) == "")).select(
        "_tid", F.coalesce("_set", F.lit(-1).cast("long")).alias("_set"),
    )
    status = rows.filter(F.col("field") == "status").join(open_tasks, "_tid")
    around = status.groupBy("_tid").agg(
        F.max(F.when(F.col("seq") <= F.col("_set"), F.struct("seq", "value"))).alias("_at_set"),
        F.min(F.when((F.col("seq") > F.col("_set")) & _is_done(F.col("value")), point)).alias("_next_done"),
    )
    at_set = rows.filter(F.col("field") == "completed_at").groupBy("_tid").agg(F.max(point).alias("_set_point"))
    joined = patched.join(around, "_tid", "left").join(at_set, "_tid", "left")
    explicit = F.col("_set").isNotNull()
    done_at_set = F.coalesce(_is_done(F.coalesce(F.col("_at_set.value"), F.col("status"))), F.lit(False))
    status_in_first = F.coalesce(F.col("_status_lo") == F.col("_lo.seq"), F.lit(False))
    stamp = (
        F.when(explicit & done_at_set, F.col("_set_point.at"))
        .when(~explicit & done_at_set & ~status_in_first, F.col("_lo.at"))
        .otherwise(F.coalesce(F.col("_next_done.at"), F.lit("")))
    )
    touched = F.col("_hi").isNotNull()
    value = new("completed_at")
    final = {f: new(f) for f in fields} | {
        "updated_at": F.coalesce(F.col("_hi.at"), F.col("updated_at")) if "updated_at" in columns else None,
        "completed_at": F.when(touched & (text_or_blank(value) == ""), stamp).otherwise(value),
    }
    return joined.select(*[final[c].alias(c) if c in final else F.col(c) for c in columns])


def apply_task_updates(
    tasks: DataFrame, updates: DataFrame, span: int = SPAN
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks after all patches, audit rows, rejects)."""
    history, rejects = task_history(tasks, updates, span)
    audit = audit_rows(
        history, "update_task", "Task updated", F.col("payload"), F.col("before"), F.col("after"),
        F.col("at"), [F.col("task_id"), F.col("seq")],
    )
    return final_tasks(tasks, updates), audit, rejects


def _deletions(text: Column, distance: int) -> Column:
    """All strings made by leaving out up to ``distance`` characters."""

    def drop_one(s: Column) -> Column:
        places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            places, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
        )

    found = F.array(text)
    for _ in range(distance):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, drop_one))))
    return found


def resolve_users(names: DataFrame, users: DataFrame, max_dist: int = 2) -> DataFrame:
    """Closest user name within the tenant, ties by user id; unresolved rows keep null.

    Names within ``max_dist`` edits share a string made by at most that many
    deletions on either side, so candidates come from an equality join on such
    strings.  Each spelling is resolved once, whatever the number of its rows.
    """
    wanted = names.select("tenant_id", F.col("name").alias("_n")).distinct()
    known = users.groupBy("tenant_id", F.col("name").alias("_u")).agg(F.min("id").alias("user_id"))
    exact = wanted.join(known, (wanted["tenant_id"] == known["tenant_id"]) & (F.col("_n") == F.col("_u"))).select(
        wanted["tenant_id"], "_n", "user_id", F.lit(0).alias("distance")
    )
    resolved = exact

    def low(c: str) -> Column:
        return F.lower(F.col(c))

    # Distance by distance: most names are settled by the few strings of a short distance.
    for distance in range(1, max_dist + 1):
        rest = wanted.join(resolved.select("tenant_id", "_n"), ["tenant_id", "_n"], "left_anti")
        left = rest.withColumn("_key", F.explode(_deletions(low("_n"), distance)))
        right = known.withColumn("_key", F.explode(_deletions(low("_u"), distance)))
        near = (
            left.join(right, ["tenant_id", "_key"])
            .select("tenant_id", "_n", "_u", "user_id")
            .withColumn("distance", F.levenshtein(low("_n"), low("_u")))
            .filter(F.col("distance") <= distance)
            .groupBy("tenant_id", "_n")
            .agg(F.min(F.struct("distance", "user_id")).alias("_best"))
            .select("tenant_id", "_n", F.col("_best.user_id").alias("user_id"), F.col("_best.distance").alias("distance"))
        )
        resolved = resolved.unionByName(near)
    return names.join(resolved.withColumnRenamed("_n", "name"), ["tenant_id", "name"], "left")


def first_task(tasks: DataFrame, order: str) -> DataFrame:
    """One row per trimmed task id, the first in sheet order."""
    keyed = tasks.withColumn("_tid", strip(text_or_blank("task_id")))
    return first_per_key(keyed, ["_tid"], [order]).drop("_tid")
