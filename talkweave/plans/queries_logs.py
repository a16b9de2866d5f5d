"""Log, usage and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.operators import runs as R
from talkweave.plans import mappings as M
from talkweave.plans.catalog import query, stream_table, table
from talkweave.session import shared_dir
from talkweave.sources import logs as L
from talkweave.streaming import stateful as ST

_SUMMARY = f"""SELECT workflow, count(*) AS total_calls, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
  CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
  round(sum(latency_ms), 2) AS total_latency_ms, round(avg(latency_ms), 4) AS avg_latency_ms FROM usage GROUP BY workflow"""


def _rounded(df):
    return df.withColumn("total_latency_ms", F.round("total_latency_ms", 2)).withColumn(
        "avg_latency_ms", F.round("avg_latency_ms", 4)
    ).select(
        "workflow", "total_calls", "total_input_tokens", "total_output_tokens", "total_tokens",
        "total_latency_ms", "avg_latency_ms",
    )


@query("workflow_summary", f"WITH {M.USAGE} {_SUMMARY}")
def workflow_summary(spark, d):
    return _rounded(R.workflow_summary(M.usage(table(spark, d, "events"))))


@query(
    "workflow_summary_requested",
    f"""WITH {M.USAGE}, asked AS (SELECT DISTINCT lower(n_name) AS workflow FROM nation UNION SELECT event_type FROM events
    WHERE value > 10), s AS ({_SUMMARY}) SELECT asked.workflow, coalesce(total_calls, 0) AS total_calls, total_input_tokens,
    total_output_tokens, total_tokens, total_latency_ms, avg_latency_ms FROM asked LEFT JOIN s USING (workflow)""",
)
def workflow_summary_requested(spark, d):
    events = table(spark, d, "events")
    asked = table(spark, d, "nation").select(F.lower("n_name").alias("workflow")).union(
        events.filter(F.col("value") > 10).select("event_type")
    )
    return _rounded(R.workflow_summary(M.usage(events), asked))


@query("stream_workflow_summary", f"WITH {M.USAGE} {_SUMMARY}")
def stream_workflow_summary(spark, d):
    usage = M.usage(stream_table(spark, d, "events"))
    sent = ST.drain(ST.stream_workflow_summary(usage), "stream-usage", "update")
    return _rounded(ST.latest(sent, ["workflow"]))


_RUNS = """SELECT 'T' || user_id AS trace_id, count(*) FILTER (WHERE event_type <> 'signup') AS tool_calls,
  bool_or(event_type = 'signup') AS completed, CAST(max(event_id) AS INTEGER) AS last_step,
  count(*) FILTER (WHERE event_type = 'error') AS failed_calls,
  round(coalesce(sum(CASE WHEN event_type <> 'signup' THEN value END), 0), 2) AS tool_latency_ms,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0, 3) AS wall_ms FROM events GROUP BY user_id"""


def _steps(events):
    return M.steps(events).withColumn("payload", F.try_parse_json("payload"))


@query("run_summary", _RUNS)
def run_summary(spark, d):
    runs = R.run_summary(_steps(table(spark, d, "events")))
    return runs.withColumn("tool_latency_ms", F.round("tool_latency_ms", 2)).withColumn("wall_ms", F.round("wall_ms", 3))


@query("stream_run_summary", _RUNS)
def stream_run_summary(spark, d):
    sent = ST.drain(ST.stream_run_summary(_steps(stream_table(spark, d, "events"))), "stream-runs")
    runs = ST.current_runs(sent)
    wall = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1000.0
    return runs.select(
        "trace_id", "tool_calls", "completed", F.col("last_step").cast("int").alias("last_step"), "failed_calls",
        F.round("tool_latency_ms", 2).alias("tool_latency_ms"), F.round(wall, 3).alias("wall_ms"),
    )


@query(
    "run_endings",
    """WITH t AS (SELECT user_id, list(event_type) AS kinds FROM events GROUP BY user_id)
    SELECT user_id AS trace_id, list_contains(kinds, 'click') AS timeout, list_contains(kinds, 'view') AS
    max_tool_calls_reached, list_contains(kinds, 'error') AS invalid_decision FROM t""",
)
def run_endings(spark, d):
    # One bounded step array per run: the distinct kinds of its steps.
    kind = (
        F.when(F.col("event_type") == "click", "timeout").when(F.col("event_type") == "view", "max_tool_calls_reached")
        .when(F.col("event_type") == "error", "invalid_decision").otherwise("tool_call")
    )
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("trace_id")).agg(
        F.collect_set(F.struct(kind.alias("type"))).alias("steps")
    )
    return R.run_endings(runs)


@query(
    "tool_policy_audit",
    f"""WITH {M.CALLS}, {M.POLICY_AGENTS}, {M.POLICY_TOOLS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY trace_id
    ORDER BY step) AS ordinal FROM calls) SELECT trace_id, step, c.agent_id, tool_name, ordinal,
    CASE WHEN last_tool > 0 AND CAST(tool_name[6:] AS INTEGER) > last_tool * 2 THEN 'not_allowed'
      WHEN t.name IS NULL THEN 'not_found'
      WHEN error_code = 'tool_timeout' OR latency_ms > timeout_seconds * 1000 THEN 'timeout' ELSE 'ok' END AS verdict,
    ordinal > max_tool_calls AS over_budget
    FROM numbered c LEFT JOIN policy_agents a ON c.agent_id = a.agent_id LEFT JOIN policy_tools t ON c.tool_name = t.name""",
)
def tool_policy_audit(spark, d):
    audited = R.tool_policy_audit(
        M.calls(table(spark, d, "events")), M.policy_agents(table(spark, d, "region")),
        M.policy_tools(table(spark, d, "nation")),
    )
    return audited.drop("latency_ms", "error_code")


_ERRORS = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Rate limit hit' WHEN '2-HIGH' THEN 'HTTP 503 from host'
  WHEN '3-MEDIUM' THEN 'Bad request' ELSE 'request TIMED OUT' END"""


@query(
    "provider_attempts",
    f"""WITH attempts AS (SELECT o_custkey AS call_id, o_orderkey AS rank, 'p' || (o_orderkey % 3) AS provider,
    o_orderstatus = 'F' AS ok, {_ERRORS} AS error, o_orderpriority = '3-MEDIUM' AS fatal FROM orders),
    s AS (SELECT call_id, min(rank) FILTER (WHERE ok) AS ok_rank, min(rank) FILTER (WHERE NOT ok AND fatal) AS fatal_rank,
      max(rank) FILTER (WHERE NOT ok) AS last_rank FROM attempts GROUP BY call_id),
    v AS (SELECT *, ok_rank IS NOT NULL AND (fatal_rank IS NULL OR ok_rank < fatal_rank) AS won FROM s)
    SELECT v.call_id, won AS ok, CASE WHEN won THEN provider END AS provider, CASE WHEN NOT won THEN error END AS error
    FROM v JOIN attempts a ON a.call_id = v.call_id AND a.rank = CASE WHEN won THEN ok_rank ELSE coalesce(fatal_rank, last_rank) END""",
)
def provider_attempts(spark, d):
    p = F.col("o_orderpriority")
    error = (
        F.when(p == "1-URGENT", "Rate limit hit").when(p == "2-HIGH", "HTTP 503 from host")
        .when(p == "3-MEDIUM", "Bad request").otherwise("request TIMED OUT")
    )
    attempts = table(spark, d, "orders").select(
        F.col("o_custkey").alias("call_id"), F.col("o_orderkey").alias("rank"),
        F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("provider"),
        (F.col("o_orderstatus") == "F").alias("ok"), error.alias("error"),
    )
    return R.resolve_attempts(attempts)


@query(
    "request_log",
    f"""SELECT 'r' || event_id AS request_id, upper(event_type) AS method, '/u/' || user_id || ' x' AS path,
    CASE WHEN event_type <> 'error' THEN CAST(200 + {M.K} AS INTEGER) END AS status, CAST(floor(value) AS BIGINT) AS duration_ms
    FROM events""",
)
def request_log(spark, d):
    number = F.floor("value").cast("string")
    status = F.when(F.col("event_type") == "error", "-").otherwise((M.props_k() + 200).cast("string"))
    lines = table(spark, d, "events").select(
        F.concat(
            M.event_time(), F.lit(" INFO api.request request request_id=r"), F.col("event_id").cast("string"),
            F.lit(" method="), F.upper("event_type"), F.lit(" path=/u/"), F.col("user_id").cast("string"),
            F.lit(" x status="), status, F.lit(" duration_ms="), number,
        ).alias("value")
    )
    return L.parse_request_lines(lines)


@query(
    "runtime_log",
    f"""SELECT event_type AS event, 'T' || event_id AS trace_id, CAST(NULL AS VARCHAR) AS session_id, 'a b' AS agent_id,
    CAST(NULL AS VARCHAR) AS workflow_id, CAST({M.K} AS INTEGER) AS step,
    CASE WHEN event_type <> 'view' THEN 'tool_' || user_id END AS tool, 'ok=True latency_ms=1' AS status, props AS payload
    FROM events""",
)
def runtime_log(spark, d):
    tool = F.when(F.col("event_type") == "view", "-").otherwise(F.concat(F.lit("tool_"), F.col("user_id").cast("string")))
    lines = table(spark, d, "events").select(
        F.concat(
            M.event_time(), F.lit(" INFO agent.runtime x event="), F.col("event_type"), F.lit(" trace_id=T"),
            F.col("event_id").cast("string"), F.lit(" session_id=- agent_id=a b workflow_id=- step="),
            M.props_k().cast("string"), F.lit(" tool="), tool, F.lit(" status=ok=True latency_ms=1 payload="), F.col("props"),
        ).alias("value")
    )
    return L.parse_runtime_lines(lines)


@query(
    "token_usage_files",
    f"""WITH {M.USAGE} SELECT "timestamp", workflow, node_name, node_type, model, input_tokens, output_tokens,
    input_tokens + output_tokens AS total_tokens, latency_ms FROM usage""",
)
def token_usage_files(spark, d):
    path = shared_dir(spark, "token-usage")
    L.write_token_usage(M.usage(table(spark, d, "events")), path)
    return L.read_token_usage(spark, path)


@query(
    "interaction_files",
    """SELECT 's' || conv_id AS session_id, turn, text AS ai_response, 'academic' AS detected_intent,
    conv_id + turn AS total_tokens, CASE WHEN turn % 3 > 0 THEN CAST(turn % 3 AS INTEGER) END AS results_count,
    CASE WHEN turn % 3 > 0 THEN text END AS retrieval_query, false AS teacher_approved FROM conversations""",
)
def interaction_files(spark, d):
    rows = table(spark, d, "conversations").select(
        F.lit("2024-01-01T00:00:00").alias("timestamp"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.lit("u").alias("student_id"), F.lit("Class_10").alias("student_class"), F.lit("w").alias("workflow"),
        F.col("text").alias("user_query"), F.lit("English").alias("detected_subject"), F.col("text").alias("ai_response"),
        F.col("conv_id").alias("input_tokens"), F.col("turn").alias("output_tokens"), F.col("turn").cast("double").alias("latency_ms"),
        (F.col("turn") % 3).alias("retrieval_count"), F.array(F.lit(0.5)).alias("retrieval_scores"),
    )
    path = shared_dir(spark, "interactions")
    L.write_interactions(rows, path, "content")
    back = L.read_interactions(spark, path)
    return back.select(
        "session_id", F.col("output_tokens").alias("turn"), "ai_response", "detected_intent", "total_tokens",
        F.col("retrieval.results_count").alias("results_count"), F.col("retrieval.query").alias("retrieval_query"),
        "teacher_approved",
    )


@query(
    "step_files",
    f"""SELECT {M.EVENT_TIME} AS "timestamp", 'T' || user_id AS trace_id, CAST(event_id AS INTEGER) AS step,
    CASE WHEN event_type = 'signup' THEN 'agent_final_answer' ELSE 'agent_tool_call' END AS event,
    'tool_' || ({M.K} % 12) AS tool_name, event_type <> 'error' AS ok, value AS latency_ms FROM events""",
)
def step_files(spark, d):
    path = shared_dir(spark, "steps")
    L.write_steps(M.steps(table(spark, d, "events")), path)
    back = L.read_steps(spark, path)
    return back.select(
        "timestamp", "trace_id", "step", "event", F.get_json_object("payload", "$.tool_name").alias("tool_name"),
        F.get_json_object("payload", "$.ok").cast("boolean").alias("ok"),
        F.get_json_object("payload", "$.latency_ms").cast("double").alias("latency_ms"),
    )


@query(
    "event_files",
    f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'own' ELSE {M.EVENT_TIME} END AS "timestamp", event_type AS event,
    {M.K} AS k FROM events""",
)
def event_files(spark, d):
    data = F.when(
        F.col("user_id") % 2 == 0, F.create_map(F.lit("k"), M.props_k().cast("string"), F.lit("timestamp"), F.lit("own"))
    ).otherwise(F.create_map(F.lit("k"), M.props_k().cast("string")))
    rows = table(spark, d, "events").select(M.event_time().alias("timestamp"), F.col("event_type").alias("event"), data.alias("data"))
    path = shared_dir(spark, "events")
    L.write_events(rows, path)
    back = spark.read.schema("timestamp string, event string, k string").json(path)
    return back.withColumn("k", F.col("k").cast("long"))


@query(
    "node_log_files",
    """SELECT conv_id, turn, role AS node_type, text AS input_text, length(text) AS n_output FROM conversations""",
)
def node_log_files(spark, d):
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("role").alias("node_type"), F.col("text").alias("input_text"), F.col("text").alias("output_text")
    )
    path = shared_dir(spark, "node-logs")
    L.export_node_logs(rows, path)
    schema = "conv_id long, turn long, node_type string, input_text string, output_text string"
    back = spark.read.schema(schema).json(path)
    return back.select("conv_id", "turn", "node_type", "input_text", F.length("output_text").cast("long").alias("n_output"))
