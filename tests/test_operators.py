"""Operators on small tables with known or modelled results."""

import io
import json
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkweave.operators import classify as CL
from talkweave.operators import leads as LD
from talkweave.operators import plugins as PL
from talkweave.operators import registry as RG
from talkweave.operators import retrieval as RT
from talkweave.operators import runs as RN
from talkweave.operators import sessions as SS
from talkweave.operators import skew
from talkweave.operators import tasks as TK
from talkweave.plans import composites as CP
from talkweave.plans import mappings as M
from talkweave.sources import attachments as A
from talkweave.sources import logs as LG
from talkweave.sources import specs as SP

RNG = random.Random(11)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- skew-safe windows -----------------------------------------------------------------
@pytest.fixture(scope="module")
def messages(spark):
    """One session holds a third of all rows; sequence numbers have gaps."""
    data = []
    for session, n in [("hot", 60), *[(f"s{i}", RNG.randint(1, 12)) for i in range(20)]]:
        seqs = sorted(RNG.sample(range(n * 2), n))
        data += [(session, s, RNG.choice(["user", "assistant", "system"]), f"m{s}", RNG.choice([None, "A", "B"])) for s in seqs]
    return spark.createDataFrame(data, "session_id string, seq long, role string, content string, subject string")


@pytest.mark.parametrize("span", [1, 3, 7, 1000])
def test_windows_do_not_depend_on_chunks(messages, span):
    data = sorted(messages.collect(), key=lambda r: (r["session_id"], r["seq"]))
    before, last, count = {}, {}, {}
    for r in data:
        mates = [m for m in data if m["session_id"] == r["session_id"] and m["seq"] < r["seq"]]
        key = (r["session_id"], r["seq"])
        before[key] = [m["content"] for m in mates[-4:]]
        last[key] = next((m["subject"] for m in reversed(mates) if m["subject"]), None)
        count[key] = len(mates) + 1
    got = SS.memory_before(messages, 2, span=span).collect()
    assert {(r["session_id"], r["seq"]): [b["content"] for b in r["before"]] for r in got} == before
    got = SS.carry_subject(messages, span=span).collect()
    assert {(r["session_id"], r["seq"]): r["current_subject"] for r in got} == last
    got = skew.running_count(messages, ["session_id"], "seq", "n", span).collect()
    assert {(r["session_id"], r["seq"]): r["n"] for r in got} == count


def test_rank_filter_is_applied_before_the_shuffle(messages):
    plan = SS.memory_window(messages)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_memory(spark, messages):
    assert SS.window_size(50) == 12 and SS.window_size(2) == 4 and SS.window_size() == 12
    hot = SS.memory_window(messages).filter("session_id = 'hot'")
    assert hot.count() == 12
    few = spark.createDataFrame([("s", 1, "user", "a"), ("s", 2, "system", "b")], "session_id string, seq long, role string, content string")
    assert SS.memory_context(few).first()["context"] == "--- Conversation Memory ---\nUser: a\nAssistant: b\n--- End Memory ---"
    cleared = SS.clear_session(few, few.filter("seq = 1"))
    assert rows_of(cleared.select("seq"), "seq") == [(2,)]


def test_document_turns(spark):
    data = [("s", 1, "A", False), ("s", 2, "B", True), ("s", 3, None, False)]
    turns = spark.createDataFrame(data, "session_id string, seq long, subject string, is_document boolean")
    assert [r[0] for r in SS.carry_subject(turns).orderBy("seq").select("current_subject").collect()] == [None, "A", "A"]
    campus = SS.carry_subject(turns, document_turns_update=True)
    assert [r[0] for r in campus.orderBy("seq").select("current_subject").collect()] == [None, "A", "B"]


# --- retrieval ------------------------------------------------------------------------
FILTERS = [
    None,
    {"must": [{"field": "kind", "value": "{{ kind }}"}]},
    {"must_not": [{"field": "kind", "value": ["{{ kind }}", "c"]}], "should": [{"field": "tag", "op": "contains", "value": "{{ tag }}"}]},
    {"should": [{"field": "kind", "value": "a"}, {"field": "tag", "value": "xy"}, {"field": "kind", "value": "{{ kind }}"}], "minimum_should_match": 2},
]


def passes(cfg, meta, ctx):
    """Plain model of a filter."""
    if cfg is None:
        return True
    cfg = RT.resolve_filter(cfg, ctx)

    def test(c):
        have, want = meta.get(c["field"]), c["value"]
        if c.get("op") == "contains":
            return have is not None and want in have
        return have in (want if isinstance(want, list) else [want])

    hits = [test(c) for c in cfg["should"]]
    enough = not hits or sum(hits) >= (cfg["minimum_should_match"] or 1)
    return all(map(test, cfg["must"])) and not any(map(test, cfg["must_not"])) and enough


@pytest.mark.parametrize("cfg", FILTERS)
@pytest.mark.parametrize("blocks", [{}, {"max_block": 4, "slice_rows": 9}])
def test_vector_topk_against_brute_force(spark, cfg, blocks):
    rng = np.random.default_rng(5)
    metas = [{"kind": RNG.choice("abc"), "tag": RNG.choice(["xy", "yz"])} for _ in range(40)]
    vectors = np.round(rng.normal(size=(40, 6)), 2)
    vectors[7] = vectors[3]  # equal scores
    chunks = spark.createDataFrame(
        [(i, [float(x) for x in v], m) for i, (v, m) in enumerate(zip(vectors, metas))], "id long, vector array<float>, metadata map<string,string>"
    )
    asked = np.round(rng.normal(size=(11, 6)), 2)
    contexts = [{"kind": RNG.choice(["a", "b", "", "c"]), "tag": RNG.choice(["x", ""])} for _ in range(11)]
    queries = spark.createDataFrame(
        [(i, [float(x) for x in v], c) for i, (v, c) in enumerate(zip(asked, contexts))],
        "query_id long, vector array<float>, context map<string,string>",
    )
    got = {}
    for r in RT.vector_topk(queries, chunks, 3, cfg, **blocks).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    unit = lambda m: (lambda f: f / np.linalg.norm(f, axis=1, keepdims=True))(m.astype(np.float32).astype(np.float64))
    scores = np.round(unit(asked) @ unit(vectors).T, 6)
    for q in range(11):
        kept = [i for i in range(40) if passes(cfg, metas[i], contexts[q])]
        best = sorted(kept, key=lambda i: (-scores[q, i], i))[:3]
        assert got.get(q, []) == [(i, scores[q, i]) for i in best]


def test_vector_topk_sends_a_vector_once(spark, monkeypatch):
    # Queries that share a vector are searched for once, so few of them travel as one block, however many ask.
    chunks = spark.range(60).select("id", F.array(*[F.sin((F.col("id") + 1) * (i + 1)).cast("float") for i in range(3)]).alias("vector"))
    vectors = chunks.select((F.col("id") % 5).alias("v"), "vector").filter("id < 5")
    asked = spark.range(400).select(F.col("id").alias("query_id"), (F.col("id") % 5).alias("v")).join(vectors, "v")
    monkeypatch.setattr(RT, "_streamed", lambda *_: pytest.fail("more than one block"))
    rows = RT.vector_topk(asked, chunks, 3, max_block=8).collect()
    assert len(rows) == 1200 and {(r["query_id"] % 5, r["id"], r["score"]) for r in rows if r["rank"] == 1} == {(i, i, 1.0) for i in range(5)}


def test_vector_topk_deals_rows_to_tasks_not_to_tiles(spark, monkeypatch):
    # Each query was sent once for every slice_rows chunks; it goes to as many slices as there are tasks, or fewer.
    sent = []
    whole = RT.stream_blocks
    monkeypatch.setattr(RT, "stream_blocks", lambda t, q, slices, *rest: sent.append((slices, rest[-1])) or whole(t, q, slices, *rest))
    chunks = spark.range(300).select("id", F.array(*[F.sin((F.col("id") + 1) * (i + 1)).cast("float") for i in range(3)]).alias("vector"))
    asked = chunks.withColumnRenamed("id", "query_id")
    got = {r["query_id"]: r["id"] for r in RT.vector_topk(asked, chunks, 2, max_block=16, slice_rows=5).collect() if r["rank"] == 1}
    assert got == {i: i for i in range(300)}
    [(slices, parts)] = sent
    assert slices <= 8 and parts <= 8 and slices * parts >= 8
    assert RT._grid(600_000, 600_000, 512, 12) == (6, 6)


def test_vector_topk_screens_before_it_scores(spark):
    # Scores closer than single precision tells apart, copies, zero vectors and vectors without a score.
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(5000, 8))
    rows[1000:1500] = rows[0] + rng.normal(size=(500, 8)) * 1e-9
    rows[2000:2600], rows[3000], rows[3001, 2] = rows[5], 0.0, np.nan
    unit = rows / np.where((n := np.linalg.norm(rows, axis=1, keepdims=True)) == 0, 1.0, n)
    asked = np.concatenate([unit[:40], unit[3000:3002]])
    table = pa.table({"_id": np.arange(5000)[::-1].copy(), "_vector": pa.array(list(rows[::-1]))})
    block = {"ids": np.zeros((42, 2), dtype=np.int64), "matrix": asked, "rough": asked.astype(np.float32), "filters": []}
    got = list(zip(*RT._best_of(block, RT._tiles(table.to_batches(), None, 700), None, 6)))
    scores = np.round(np.einsum("ij,kj->ik", asked, unit), 12) + 0.0
    for q in range(42):
        order = [i for i in np.lexsort((np.arange(5000), -scores[q])) if np.isfinite(scores[q, i])][:6]
        assert [(int(i), round(float(s), 11)) for r, i, s in got if r == q] == [(i, round(float(scores[q, i]), 11)) for i in order]


def test_filter_rules(spark):
    rows = spark.createDataFrame([(1, {"a": "x", "n": "5"}), (2, {"a": "y"}), (3, {})], "id long, metadata map<string,string>")

    def ids(cfg):
        return [r[0] for r in rows.filter(RT.metadata_filter(cfg)).orderBy("id").select("id").collect()]

    assert ids(None) == ids({}) == [1, 2, 3]
    assert ids({"must": [{"field": "a", "value": None}, {"field": "", "value": "x"}]}) == [1, 2, 3]
    assert ids({"must": [{"field": "metadata.a", "value": "x"}]}) == [1]
    assert ids({"must": [{"field": "n", "value": 5}]}) == []  # types differ
    assert ids({"must_not": [{"field": "a", "op": "in", "value": ["x"]}]}) == [2, 3]
    assert ids({"should": [{"field": "a", "value": "x"}], "minimum_should_match": 2}) == []
    assert ids({"minimum_should_match": 2}) == [1, 2, 3]
    with pytest.raises(ValueError):
        ids({"must": [{"field": "a", "op": "gt", "value": "x"}]})
    resolved = RT.resolve_filter({"must": [{"field": "a", "value": " {{x}} "}, {"field": "b", "value": ["{{y}}", "k"]}]}, {"x": " "})
    assert [c["field"] for c in resolved["must"]] == ["b"] and resolved["must"][0]["value"] == ["k"]


def test_dedup_and_rescore(spark):
    shape = "query_id long, id long, rank int, score double, content string, metadata map<string,string>, query string, chapter string"
    rows = spark.createDataFrame(
        [
            (1, 1, 1, 0.9, "same", {"heading": "Example 2.1"}, "example 2.1", "C"),
            (1, 2, 2, 0.8, "same", {}, "example 2.1", "C"),
            (1, 3, 3, 0.7, "", {"content_type": "example", "chapter_name": "C"}, "example 2.1", "C"),
            (1, 4, 4, 0.6, None, {}, "example 2.1", "C"),
            (1, 5, 5, 0.5, "z", {"has_images": "true"}, "example 2.1", "C"),
            (2, 6, 1, 0.5, "a", {"has_images": "true"}, "show it", ""),
            (2, 7, 2, 0.5, "b", {}, "show it", ""),
        ],
        shape,
    )
    kept = RT.dedup_content(rows)
    assert [r[0] for r in rows_of(kept.select("id"), "id")] == [1, 3, 5, 6, 7]
    scored = {r["id"]: (r["score"], r["rank"]) for r in RT.rescore(kept).collect()}
    assert scored == {1: (1.4, 1), 3: (1.2, 2), 5: (0.5, 3), 6: (0.8, 1), 7: (0.5, 2)}
    text = {r["query_id"]: r["context"] for r in RT.rag_context(RT.rescore(kept)).collect()}
    assert text[2] == "Retrieved context:\n[1] \na\n[2] \nb"


def test_results_are_ranked_without_their_texts(spark, tmp_path):
    shape = "id long, vector array<double>, content string, metadata map<string,string>"
    rows = [(1, [1.0, 0.0], "same", {"heading": "2.1"}), (2, [1.0, 0.1], "same", {}), (3, [1.0, 0.2], "other", {}), (4, [1.0, 0.3], None, {}), (5, [1.0, 0.4], "", {})]
    chunks = spark.createDataFrame(rows, shape)
    asked = spark.createDataFrame([(1, [1.0, 0.0], "example 2.1", "C")], "query_id long, vector array<double>, query string, chapter string")
    plain = CP.rag_results(asked, chunks, 5)
    assert "content" not in plain.columns
    assert [r["id"] for r in plain.orderBy("rank").collect()] == [1, 3, 4]
    # A stored hash is taken as it is: here all texts count as one.
    assert [r["id"] for r in CP.rag_results(asked, chunks.withColumn("content_hash", F.lit("h")), 5).collect()] == [1]
    made = CP.rag_retrieve(asked.withColumn("context", F.create_map(F.lit("a"), F.lit("b"))), chunks, 5).first()["prompt"]
    assert "same" in made and "other" in made and made.count("same") == 1


def test_text_is_not_shuffled_for_its_hash(spark):
    folder = "/root/testdata/sf0.001"
    plan = M.chunks(spark, folder).select("id", "content_hash")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join Inner")[0]
    assert "text" not in above and "md5" not in above


# --- leads ----------------------------------------------------------------------------
def test_leads(spark):
    shape = "input_seq long, company_name string, contact_name string, founder_name string, email string, status string"
    leads = spark.createDataFrame(
        [(1, "Acme ", "", "Fo", "e1", " "), (2, " ACME", "Co", "Fo", "e2", "Won"), (3, " ", None, None, None, None), (4, "", "", "", "", ""),
         (5, "Known", "c", "", "", "x"), (6, "New co", "c", "", "", "x")],
        shape,
    )
    existing = spark.createDataFrame([(" known ",), ("",)], "company_name string")
    assert [r[0] for r in rows_of(LD.first_lead(leads).select("input_seq"), "input_seq")] == [1, 3, 4, 5, 6]
    assert [r[0] for r in rows_of(LD.anti_existing(leads, existing).select("input_seq"), "input_seq")] == [1, 2, 3, 4, 6]
    assert tuple(LD.export_counts(leads, existing).first()) == (4, 2, 6)
    saved = LD.save_leads(leads).collect()
    assert saved[0]["Contact Name"] == "Fo" and saved[0]["Status"] == "New" and saved[1]["Status"] == "Won" and saved[0]["Phone"] == ""
    assert LD.existing_companies(leads, "No such column").count() == 0


def test_lookup_profile(spark):
    students = spark.createDataFrame(
        [(1, "7", "Ann", "Class_9", "School", "X"), (2, "7", "Second", "Class_1", "School", "X")],
        "row long, studentId string, Name string, `Class/Course` string, Institute_Type string, Board string",
    )
    asked = spark.createDataFrame([(1, 7), (2, 8)], "request_id long, student_id long")
    found = {r["request_id"]: r for r in LD.lookup_profile(asked, students, "row").collect()}
    assert (found[1]["name"], found[1]["class"], found[1]["student_found"]) == ("Ann", "Class_9", True)
    assert (found[2]["name"], found[2]["board"], found[2]["student_found"]) == ("Student", "CBSE", False)


# --- tasks ----------------------------------------------------------------------------
def apply_plainly(task, patches):
    """Row-wise model of ordered patches: yields the state after each."""
    state = dict(task)
    for patch in patches:
        before = dict(state)
        state.update({k: v for k, v in patch["fields"].items() if k in state and k not in ("task_id", "created_at")})
        state["updated_at"] = patch["at"]
        if state["status"].strip().lower() == "done" and not state["completed_at"]:
            state["completed_at"] = patch["at"]
        yield before, dict(state)


@pytest.mark.parametrize("span", [2, 1000])
def test_task_patches_against_row_model(spark, span):
    base = {c: "" for c in TK.TASK_COLUMNS}
    tasks, patches = {}, {}
    for i in range(25):
        key = f"T{i}"
        status = RNG.choice(["pending", "Done ", "done", ""])
        tasks[key] = base | {"task_id": key, "title": "t", "status": status, "completed_at": RNG.choice(["", "", "c0"]), "created_at": "c"}
        patches[key] = []
        for n in range(RNG.choice([0, 1, 3, 9])):
            fields = {
                f: RNG.choice(["done", "DONE", "pending"]) if f == "status" else RNG.choice(["", "", f"c{n}"]) if f == "completed_at" else f"{f}{n}"
                for f in RNG.sample(["status", "completed_at", "notes", "created_at", "bogus"], RNG.randint(1, 3))
            }
            patches[key].append({"seq": n * 2, "at": f"2024-01-{n + 1:02d}", "fields": fields})
    table = spark.createDataFrame([tuple(t.values()) for t in tasks.values()], ", ".join(f"{c} string" for c in TK.TASK_COLUMNS))
    flat = [(k, p["seq"], p["at"], f, v) for k, ps in patches.items() for p in ps for f, v in p["fields"].items()]
    flat += [("nobody", 1, "2024-01-01", "status", "done")]
    updates = spark.createDataFrame(flat, "task_id string, seq long, at string, field string, value string")
    history, _ = TK.task_history(table, updates, span)
    got = {(r["task_id"], r["seq"]): (r["before"].asDict(), r["after"].asDict()) for r in history.collect()}
    merged, audit, rejects = TK.apply_task_updates(table, updates, span)
    final = {r["task_id"]: r.asDict() for r in merged.collect()}
    for key, task in tasks.items():
        states = list(apply_plainly(task, patches[key]))
        for patch, (before, after) in zip(patches[key], states):
            assert got[key, patch["seq"]] == (before, after)
        assert final[key] == (states[-1][1] if states else task)
    assert audit.count() == sum(map(len, patches.values()))
    assert [r["task_id"] for r in rejects.collect()] == ["nobody"]


def test_task_list_and_create(spark):
    shape = "seq long, task_id string, title string, status string, category string, project string, description string, tags string, notes string"
    data = [(1, "a", "A", "", "", "", "", "", ""), (2, "b", "B", "done", "", "", "", "", ""), (3, "c", "C", "Blocked", "Home", "", "", "Red", ""),
            (4, "d", "D", "archived", "", "", "", "", "")]
    tasks = spark.createDataFrame(data, shape)

    def ids(**filters):
        return [r["task_id"] for r in TK.list_tasks(tasks, "seq", **filters).collect()]

    assert ids() == ["a", "c"]
    assert ids(status="done") == ["a"]
    assert ids(status="done, archived", include_done=True) == ["a", "b", "d"]
    assert ids(category="HOME") == ids(search="red") == ["c"]
    assert ids(limit=1) == ["a"]
    new = spark.createDataFrame([(1, " T ", None), (2, " ", "x")], "request_id long, title string, priority string")
    made, audit, rejects = TK.create_tasks(new, F.lit("now"))
    row = made.first()
    assert (row["title"], row["status"], row["priority"], row["created_at"]) == ("T", "pending", "medium", "now")
    assert json.loads(audit.first()["after_json"])["title"] == "T" and audit.columns == list(TK.AUDIT_COLUMNS)
    assert [r["request_id"] for r in rejects.collect()] == [2]
    gate = spark.createDataFrame([(1, True, "Yes"), (2, True, "no"), (3, False, "yes"), (4, None, None)], "id long, confirmed boolean, user_message string")
    accepted, refused = TK.confirmed_only(gate)
    assert [r["id"] for r in accepted.collect()] == [1] and {r["code"] for r in refused.collect()} == {"confirmation_required"}
    done = TK.completion_patches(spark.createDataFrame([("a", 1, "t", "n"), ("b", 1, "t", None)], "task_id string, seq long, at string, note string"))
    assert done.count() == 5


def test_resolve_users(spark):
    users = spark.createDataFrame([("t", 5, "Anna Lee"), ("t", 3, "Anna Lee"), ("t", 1, "Bob"), ("u", 9, "Cara")], "tenant_id string, id long, name string")
    names = ["anna lee", "Ana Lee", "Anna Lee", "Bo", "Rob", "Cara", "Zebedee", "xAnnaLee"]
    asked = spark.createDataFrame([("t", n) for n in names], "tenant_id string, name string")
    got = {r["name"]: r["user_id"] for r in TK.resolve_users(asked, users, 2).collect()}
    assert got == {"anna lee": 3, "Ana Lee": 3, "Anna Lee": 3, "Bo": 1, "Rob": 1, "Cara": None, "Zebedee": None, "xAnnaLee": 3}


# --- registry --------------------------------------------------------------------------
def test_directory(spark):
    table = spark.createDataFrame([("a", "bot", "bot", {"x": "1"}, "c0", "u0")], "agent_id string, name string, slug string, ctx map<string,string>, created_at string, updated_at string")
    new = spark.createDataFrame([("n1", "Bot", 1), ("n2", "New", 2), ("n3", "new", 3)], "agent_id string, name string, seq long")
    made = {r["agent_id"]: r["slug"] for r in RG.directory_create(table, new, F.lit("now"), "seq").collect()}
    assert made["n2"] == "new" and made["n1"].startswith("bot-") and made["n3"].startswith("new-") and len(made["n3"]) == 12
    changes = spark.createDataFrame([("a", 1, "x", {"y": "2"}), ("a", 2, None, {"x": "3"}), ("b", 1, "n", None)], "agent_id string, seq long, name string, ctx map<string,string>")
    rows = {r["agent_id"]: r for r in RG.upsert(table, changes, "agent_id", "seq", F.lit("now")).collect()}
    assert rows["a"]["name"] == "x" and rows["a"]["ctx"]["x"] == "3" and rows["a"]["created_at"] == "c0" and rows["a"]["updated_at"] == "now"
    assert rows["b"]["created_at"] == "now" and rows["b"]["slug"] is None
    updated, unknown = RG.directory_update(table, changes.drop("ctx"), "agent_id", "seq")
    assert updated.first()["name"] == "x" and [r["agent_id"] for r in unknown.collect()] == ["b"]
    left, missing = RG.delete_by_key(table, changes, "agent_id")
    assert left.count() == 0 and [r["agent_id"] for r in missing.collect()] == ["b"]


def test_tool_catalogue(spark):
    schema = '{"type":"object","properties":{"q":{"description":"d"},"n":{"type":"integer"}},"required":["q"]}'
    tools = spark.createDataFrame([("zzz", "x", None), ("rag_search", "x", schema)], "name string, description string, input_schema string")
    rows = RG.tool_catalogue(tools).collect()
    assert [r["name"] for r in rows] == ["rag_search", "zzz"]
    assert [tuple(p) for p in rows[0]["params"]] == [("q", "string", "d", True), ("n", "integer", "", False)] and rows[1]["params"] == []


def test_attempts(spark):
    data = [(1, 1, "a", True, None), (2, 1, "a", False, "Quota hit"), (2, 2, "b", True, None), (3, 1, "a", False, "bad key"), (3, 2, "b", True, None),
            (4, 1, "a", False, "timeout"), (4, 2, "b", False, "503")]
    attempts = spark.createDataFrame(data, "call_id long, rank int, provider string, ok boolean, error string")
    assert rows_of(RN.resolve_attempts(attempts), "call_id") == [(1, True, "a", None), (2, True, "b", None), (3, False, None, "bad key"), (4, False, None, "503")]


def test_summary_of_requested_workflows(spark):
    usage = spark.createDataFrame([("w", 1, 2, 3.0), ("w", 3, 4, 5.0)], "workflow string, input_tokens long, output_tokens long, latency_ms double")
    asked = spark.createDataFrame([("w",), ("none",)], "workflow string")
    rows = {r["workflow"]: r for r in RN.workflow_summary(usage, asked).collect()}
    assert (rows["w"]["total_calls"], rows["w"]["total_tokens"], rows["w"]["avg_latency_ms"]) == (2, 10, 4.0)
    assert rows["none"]["total_calls"] == 0 and rows["none"]["total_tokens"] is None


# --- classification ---------------------------------------------------------------------
PROFILE = {
    "description": "D", "instructions": ["One."],
    "dimensions": [
        {"name": "flag", "field_type": "boolean", "description": "F."}, {"name": "q", "description": "Q.", "allowed_values": ["a", "b"]},
        {"name": "code", "field_type": "string", "description": "C.", "required": False, "allow_null": True},
        {"name": "tags", "field_type": "array_enum", "description": "T.", "allowed_values": ["x"], "required": False},
        {"name": "p", "field_type": "number", "description": "P."},
    ],
}


@pytest.mark.parametrize(
    "result, broken",
    [
        ('{"flag":true,"q":"a","p":0.5}', []),
        ('{"flag":true,"q":"a","p":1,"code":null,"tags":["x"]}', []),
        ('{"flag":"yes","q":"z","p":"1","tags":["x","y"],"more":1}', ["type:flag", "enum:q", "enum:tags", "type:p", "extra:more"]),
        ('{"q":null,"p":1,"flag":false,"tags":"x"}', ["null:q", "type:tags"]),
        ("{}", ["missing:flag", "missing:q", "missing:p"]),
        ("[1]", ["not_an_object"]),
        ("nonsense", ["not_an_object"]),
    ],
)
def test_classification(value, result, broken):
    assert value(CL.violations(F.try_parse_json(F.lit(result)), PROFILE)) == broken


def test_classification_texts(value):
    struct, schema = CL.classification_schema(PROFILE)
    assert [f.dataType.simpleString() for f in struct] == ["boolean", "string", "string", "array<string>", "double"]
    assert schema["required"] == ["flag", "q", "p"] and schema["properties"]["code"]["anyOf"][1] == {"type": "null"}
    lines = CL.system_prompt(PROFILE).split("\n")
    assert lines[4:7] == ["Profile: D", "Instruction 1: One.", "Dimensions:"]
    assert lines[8] == "- q (enum) Q. Allowed values: a, b."
    assert lines[9] == "- code (string) C. Return null if the value cannot be inferred confidently. This field is optional."
    prompt = value(CL.classification_prompt(PROFILE, F.lit("hi"), {"s": F.lit('a"é'), "none": F.lit(None).cast("string")}))
    assert json.loads(prompt.split("Additional context JSON:\n")[1]) == {"s": 'a"é'}
    assert prompt.endswith("{\n  " + json.dumps("s") + ": " + json.dumps('a"é', ensure_ascii=False) + "\n}")


# --- sources -----------------------------------------------------------------------------
def test_uploads(spark):
    shape = "request_id long, message string, documents array<struct<base64:string,filename:string,mimeType:string>>, file_base64 string, file_name string, file_mime_type string"
    rows = spark.createDataFrame(
        [(1, "m", [("aGVsbG8=", "notes.md", "text/markdown"), ("data:text/plain;base64,aGk=", None, None)], "YWJj", None, None),
         (2, "m", [("not-valid***", "x", None)], None, None, None), (3, "m", [(None, "x", None)], None, None, None), (4, "plain", [], None, None, None)],
        shape,
    )
    files, rejects = A.decode_documents(rows)
    got = [(r["request_id"], r["position"], r["filename"], bytes(r["bytes"])) for r in files.orderBy("request_id", "position").collect()]
    assert got == [(1, 1, "notes.md", b"hello"), (1, 2, "upload-2", b"hi"), (1, 3, "upload", b"abc")]
    assert rows_of(rejects.select("request_id", "reason"), "request_id") == [(2, "base64 must be valid base64"), (3, "base64 is required")]
    from talkweave.plans.composites import attachment_ingest

    out = attachment_ingest(rows.drop("file_base64", "file_name", "file_mime_type"))
    texts = {r["request_id"]: r["message"] for r in out["messages"].collect()}
    assert texts == {1: "m\n\n--- Attached content ---\n[File: notes.md]\nhello\n--- End of attached content ---", 4: "plain"}
    assert {r["request_id"] for r in out["rejects"].collect()} == {2, 3}


def test_upload_limits(spark):
    files = spark.createDataFrame(
        [(1, 1, "a", bytearray(b"12345")), (2, 1, "b", bytearray(b"123")), (2, 2, "c", bytearray(b"123")), (3, 1, "d", bytearray(b"1"))],
        "request_id long, position long, filename string, bytes binary",
    )
    ok, bad = A.check_upload_sizes(files, 4, 5)
    assert [r["request_id"] for r in ok.collect()] == [3]
    reasons = dict(rows_of(bad, "request_id"))
    assert reasons[1].startswith("File 'a' exceeds") and reasons[2].startswith("combined upload size")


def test_text_of_files(spark):
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", "<a")
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("xl/other.xml", "<a/>")
    data = [(1, "a.txt", "  caf\xe9 ".encode()), (2, "b.txt", b"x\xff\xfey"), (3, "c.xlsx", broken.getvalue()), (4, "d.xlsx", empty.getvalue()),
            (5, "e.pdf", b"%PDF"), (6, "f.xls", b"x")]
    files = spark.createDataFrame([(i, n, None, bytearray(b)) for i, n, b in data], "request_id long, filename string, mime string, bytes binary")
    out = {r["request_id"]: r for r in A.extract_text(files).collect()}
    assert out[1]["block"] == "[File: a.txt]\ncafé"
    assert out[2]["block"] == "[File: b.txt]\nx��y"
    assert out[3]["block"].startswith("[Spreadsheet: c.xlsx]\n[XLSX extraction error:")
    assert out[4]["block"] is None and out[4]["note"] == "Spreadsheet contained no extractable text"
    assert out[5]["kind"] == "document" and out[5]["block"] is None
    assert out[6]["note"].startswith("Legacy .xls")


def test_natural_order():
    names = ["s10", "s2", "s1b", "s1a"]
    assert sorted(names, key=A.natural_key) == ["s1a", "s1b", "s2", "s10"]


def test_log_lines(spark):
    lines = [
        "2024-01-01 00:00:00,000 INFO api.request request request_id=r1 method=GET path=/a b status=200 duration_ms=5",
        "2024-01-01 00:00:00,000 ERROR api.request request_failed request_id=- method=- path=- status=- duration_ms=-",
        "Traceback (most recent call last):",
    ]
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    assert [tuple(r) for r in LG.parse_request_lines(frame).collect()] == [("r1", "GET", "/a b", 200, 5), (None,) * 5]
    run = "2024 INFO agent.runtime x event=e trace_id=t session_id=- agent_id=a workflow_id=- step=3 tool=- status=timeout=20 payload={\"k\": \"a b\"}"
    row = LG.parse_runtime_lines(spark.createDataFrame([(run,)], "value string")).first()
    assert (row["event"], row["session_id"], row["step"], row["status"], row["payload"]) == ("e", None, 3, "timeout=20", '{"k": "a b"}')


def test_event_and_interaction_lines(spark, tmp_path):
    frame = spark.createDataFrame([("t0", "e", '{"n":1,"event":"own"}')], "timestamp string, event string, raw string")
    typed = LG.event_lines(frame.withColumn("data", F.parse_json("raw"))).first()["value"]
    assert json.loads(typed) == {"timestamp": "t0", "event": "own", "n": 1}
    texts = LG.event_lines(frame.withColumn("data", F.create_map(F.lit("k"), F.lit("v")))).first()["value"]
    assert json.loads(texts) == {"timestamp": "t0", "event": "e", "k": "v"}
    row = ("t", "s", "u", "c", "w", "q", "sub", "x" * 600, 1, 2, 3.0, 0, None)
    names = "timestamp session_id student_id student_class workflow user_query detected_subject ai_response".split()
    shape = ", ".join(f"{n} string" for n in names) + ", input_tokens long, output_tokens long, latency_ms double, retrieval_count int, retrieval_scores array<double>"
    LG.write_interactions(spark.createDataFrame([row], shape), str(tmp_path / "i"), "c", answer_chars=500)
    assert len(LG.interaction_rows(spark.createDataFrame([row], shape), "c").first()["ai_response"]) == 600
    line = json.loads(spark.read.text(str(tmp_path / "i")).first()["value"])
    assert "retrieval" not in line and line["student_rating"] is None and line["total_tokens"] == 3 and len(line["ai_response"]) == 500


def test_spec_folder(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("agent_id: yaml_a\nallowed_tools: [x]\n")
    (tmp_path / "a.json").write_text('{"agent_id": "json_a"}')
    (tmp_path / "b.yaml").write_text("description: no id\n")
    (tmp_path / "c.yaml").write_text("{: bad")
    (tmp_path / "_d.yaml").write_text("tool_name: hidden\nendpoint_url: /x\n")
    (tmp_path / "e.yaml").write_text("tool_name: t\nendpoint_url: /x\nbase_url_env: B\n")
    assert {r["id"] for r in SP.read_specs(spark, str(tmp_path), "agent").collect()} >= {"json_a", "b", "c"}
    listed = SP.read_specs(spark, str(tmp_path), "agent", listing=True)
    assert {"yaml_a", "b"} <= {r["id"] for r in listed.collect()} and "c" not in {r["id"] for r in listed.collect()}
    typed = {r["id"]: r for r in SP.normalize_specs(listed, "agent").collect()}
    assert (typed["yaml_a"]["allowed_tools"], typed["b"]["max_steps"], typed["b"]["response_mode"]) == (["x"], 8, "text")
    tools = SP.read_remote_tools(spark, str(tmp_path), base_urls={"B": "http://h/"}).collect()
    assert [(t["tool_name"], t["endpoint_url"], t["timeout_seconds"]) for t in tools] == [("t", "http://h/x", 30)]


# --- plug-ins ---------------------------------------------------------------------------
def test_plugins(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id long, p string")

    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [{"text": p * 2, "input_tokens": 1} for p in prompts]

    got = {r["id"]: r["model_result"] for r in PL.map_model(rows, model, "p").collect()}
    assert got[1]["text"] == "aa" and got[1]["error"] is None and got[2]["error"] == "no" and got[3]["text"] is None
    vectors = PL.embed_batch(rows, lambda ts: [[float(len(t))] for t in ts], "p").orderBy("id").collect()
    assert [r["vector"] for r in vectors] == [[1.0], [3.0], None]


def test_upsert_merges_maps_over_changes(spark):
    base = spark.createDataFrame([(1, {"a": "0"}, "t")], "k long, m map<string,string>, updated_at string")
    changes = spark.createDataFrame(
        [(1, 1, {"b": "1"}), (1, 2, {"c": "2"}), (1, 3, {"b": "3"}), (1, 4, None), (2, 1, {}), (3, 1, None)], "k long, seq long, m map<string,string>"
    )
    got = {r["k"]: r["m"] for r in RG.upsert(base, changes, "k", "seq", F.lit("now")).collect()}
    assert got == {1: {"a": "0", "b": "3", "c": "2"}, 2: {}, 3: None}


def test_resolved_filter_edges():
    item = {"field": "a", "value": "{{ x }}"}
    assert RT.resolve_filter({"must": [item]}, {"x": None})["must"] == []
    assert RT.resolve_filter({"must": [{"field": "", "value": "v"}, {"value": "v"}]}, {})["must"] == []
    with pytest.raises(ValueError):
        RT.resolve_filter({"must": [{"field": "a", "op": "regex", "value": "v"}]}, {})
