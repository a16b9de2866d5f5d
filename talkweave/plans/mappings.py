"""The given tables seen as the tables of a conversation application.

Each mapping has a SQL twin, used as a common table expression of the DuckDB form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.operators.retrieval import content_hash
from talkweave.plans.catalog import table

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def event_time() -> Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")


EVENT_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def usage(events: DataFrame) -> DataFrame:
    return events.select(
        event_time().alias("timestamp"), F.col("event_type").alias("workflow"),
        F.concat(F.lit("node_"), (F.col("user_id") % 7).cast("string")).alias("node_name"),
        F.lit("agent").alias("node_type"), F.lit("m1").alias("model"), props_k().alias("input_tokens"),
        F.col("user_id").alias("output_tokens"), F.col("value").alias("latency_ms"),
    )


USAGE = f"""usage AS (SELECT {EVENT_TIME} AS "timestamp", event_type AS workflow,
  'node_' || (user_id % 7) AS node_name, 'agent' AS node_type, 'm1' AS model,
  {K} AS input_tokens, user_id AS output_tokens, value AS latency_ms FROM events)"""


def messages(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


MESSAGES = "messages AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations)"


def steps(events: DataFrame) -> DataFrame:
    """Step log: sign-ups end a run, errors are failed calls, the rest are good calls."""
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("tool_"), (props_k() % 12).cast("string")).alias("tool_name"),
            (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"),
        )
    )
    return events.select(
        event_time().alias("timestamp"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("trace_id"),
        F.lit("s").alias("session_id"), F.concat(F.lit("agent_"), (F.col("user_id") % 5).cast("string")).alias("agent_id"),
        F.col("event_id").cast("int").alias("step"),
        F.when(F.col("event_type") == "signup", "agent_final_answer").otherwise("agent_tool_call").alias("event"),
        payload.alias("payload"),
    )


def calls(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("step"),
        F.concat(F.lit("agent_"), (F.col("user_id") % 5).cast("string")).alias("agent_id"),
        F.concat(F.lit("tool_"), (props_k() % 12).cast("string")).alias("tool_name"),
        (F.col("value") * 400).alias("latency_ms"),
        F.when(F.col("event_type") == "error", "tool_timeout").alias("error_code"),
    )


CALLS = f"""calls AS (SELECT user_id AS trace_id, event_id AS step, 'agent_' || (user_id % 5) AS agent_id,
  'tool_' || ({K} % 12) AS tool_name, value * 400 AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'tool_timeout' END AS error_code FROM events)"""


def policy_agents(regions: DataFrame) -> DataFrame:
    """Five agents from the regions; the first has no allow-list."""
    tools = F.transform(F.sequence(F.lit(0), F.col("r_regionkey") * 2), lambda i: F.concat(F.lit("tool_"), i.cast("string")))
    return regions.select(
        F.concat(F.lit("agent_"), F.col("r_regionkey").cast("string")).alias("agent_id"),
        F.when(F.col("r_regionkey") == 0, F.array().cast("array<string>")).otherwise(tools).alias("allowed_tools"),
        (F.col("r_regionkey") + 2).alias("max_tool_calls"),
    )


POLICY_AGENTS = """policy_agents AS (SELECT 'agent_' || r_regionkey AS agent_id, r_regionkey AS last_tool,
  r_regionkey + 2 AS max_tool_calls FROM region)"""


def policy_tools(nations: DataFrame) -> DataFrame:
    """Ten tools from the nations, with a time limit of their own or none."""
    return nations.filter(F.col("n_nationkey") < 10).select(
        F.concat(F.lit("tool_"), F.col("n_nationkey").cast("string")).alias("name"),
        F.when(F.col("n_nationkey") > 3, F.col("n_nationkey")).alias("timeout_seconds"),
    )


POLICY_TOOLS = """policy_tools AS (SELECT 'tool_' || n_nationkey AS name,
  CASE WHEN n_nationkey > 3 THEN n_nationkey ELSE 20 END AS timeout_seconds FROM nation WHERE n_nationkey < 10)"""


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with the text, its hash and labels of the document of the same id.

    The hash is taken before the join, so that plans which read no more of a text than that do not shuffle it.
    """
    e = table(spark, folder, "embeddings")
    d = table(spark, folder, "documents").withColumn("content_hash", content_hash("text"))
    label = F.col("label").cast("string")
    kinds = F.array(F.lit("exercise"), F.lit("example"), F.lit("text"))
    meta = {
        "level": F.concat(F.lit("Class_"), label), "subject": F.col("lang"), "topic_name": F.col("source"),
        "chapter_name": F.concat(F.lit("Chapter "), label), "heading": F.concat(F.lit("Example "), label),
        "content_type": F.element_at(kinds, F.col("label") % 3 + 1),
        "has_images": F.when(F.col("label") % 2 == 0, "true").otherwise("false"),
    }
    entries = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)])
    return e.join(d, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("text").alias("content"),
        "content_hash", entries.alias("metadata"),
    )


CHUNKS = """chunks AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, text AS content, label,
  'Class_' || label AS level, lang AS subject, source AS topic_name, 'Chapter ' || label AS chapter_name,
  'Example ' || label AS heading, ['exercise', 'example', 'text'][label % 3 + 1] AS content_type,
  CASE WHEN label % 2 = 0 THEN 'true' ELSE 'false' END AS has_images
  FROM embeddings JOIN documents ON vec_id = doc_id)"""


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """User messages as queries; the vector is that of the embedding with the session's number."""
    m = table(spark, folder, "conversations").filter(F.col("role") == "user")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vector"))
    turn = F.col("turn").cast("string")
    text = F.concat(F.when(F.col("turn") % 4 == 2, "Show exercise ").otherwise("Example "), turn, F.lit(" of "), F.col("text"))
    return m.join(e, "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"), text.alias("query"), "vector",
        F.concat(F.lit("Chapter "), (F.col("conv_id") % 10).cast("string")).alias("chapter"),
        F.create_map(F.lit("level"), F.concat(F.lit("Class_"), (F.col("conv_id") % 10).cast("string")),
                     F.lit("subject"), F.when(F.col("turn") % 2 == 0, "en").otherwise("")).alias("context"),
    )


ASKED = """asked AS (SELECT conv_id * 1000 + turn AS query_id, conv_id AS session_id, turn AS seq,
  CASE WHEN turn % 4 = 2 THEN 'Show exercise ' ELSE 'Example ' END || turn || ' of ' || text AS query,
  CAST(embedding AS DOUBLE[]) AS vector, 'Chapter ' || (conv_id % 10) AS chapter,
  'Class_' || (conv_id % 10) AS ctx_level, CASE WHEN turn % 2 = 0 THEN 'en' ELSE '' END AS ctx_subject, turn
  FROM conversations JOIN embeddings ON vec_id = conv_id WHERE role = 'user')"""

_COSINE = "list_dot_product(q.vector, c.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(c.vector, c.vector)))"
COSINE, COSINE_RANK = f"round({_COSINE}, 6)", f"round({_COSINE}, 12)"


def tasks(orders: DataFrame) -> DataFrame:
    """Orders as tasks."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "In_Progress").otherwise("pending")
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("task_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.lit("").alias("description"), F.col("o_orderpriority").alias("category"),
        F.concat(F.lit("P"), (F.col("o_custkey") % 10).cast("string")).alias("project"),
        F.when(F.col("o_orderkey") % 17 == 0, "").otherwise(status).alias("status"),
        F.lit("medium").alias("priority"), day.alias("due_date"), F.lit("a, b").alias("tags"),
        F.lit("").alias("notes"), day.alias("created_at"), day.alias("updated_at"), F.lit("").alias("completed_at"),
        F.lit("seed").alias("source_agent"), F.lit("").alias("trace_id"),
    )


TASKS = """tasks AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, 'Order ' || o_orderkey AS title, '' AS description,
  o_orderpriority AS category, 'P' || (o_custkey % 10) AS project,
  CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'In_Progress'
    ELSE 'pending' END AS status,
  'medium' AS priority, strftime(o_orderdate, '%Y-%m-%d') AS due_date, 'a, b' AS tags, '' AS notes,
  strftime(o_orderdate, '%Y-%m-%d') AS created_at, strftime(o_orderdate, '%Y-%m-%d') AS updated_at, '' AS completed_at,
  'seed' AS source_agent, '' AS trace_id, o_orderkey FROM orders)"""


def task_updates(lineitem: DataFrame) -> DataFrame:
    """Order lines as ordered patches, one field each (one order in 29 is unknown to the task table)."""
    n = F.col("l_linenumber")
    field = (
        F.when(n % 3 == 0, "status").when(n % 3 == 1, "notes").when(F.col("l_linestatus") == "F", "completed_at")
        .otherwise("created_at")
    )
    value = (
        F.when(n % 3 == 0, F.when(F.col("l_returnflag") == "R", "done").otherwise("pending"))
        .when(n % 3 == 1, F.concat(F.lit("qty "), F.col("l_quantity").cast("int").cast("string")))
        .otherwise(F.when(F.col("l_returnflag") == "A", "").otherwise(F.lit("2001-01-01")))
    )
    key = F.when(F.col("l_orderkey") % 29 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    return lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        *[F.max(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")]
    ).select(
        key.cast("string").alias("task_id"), n.cast("long").alias("seq"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), field.alias("field"), value.alias("value"),
    )


UPDATES = """updates AS (SELECT CAST(CASE WHEN l_orderkey % 29 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS VARCHAR) AS task_id,
  CAST(l_linenumber AS BIGINT) AS seq, strftime(l_shipdate, '%Y-%m-%d') AS stamp,
  CASE WHEN l_linenumber % 3 = 0 THEN 'status' WHEN l_linenumber % 3 = 1 THEN 'notes'
    WHEN l_linestatus = 'F' THEN 'completed_at' ELSE 'created_at' END AS field,
  CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_returnflag = 'R' THEN 'done' ELSE 'pending' END
    WHEN l_linenumber % 3 = 1 THEN 'qty ' || CAST(l_quantity AS INTEGER)
    ELSE CASE WHEN l_returnflag = 'A' THEN '' ELSE '2001-01-01' END END AS value
  FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus,
    max(l_quantity) AS l_quantity, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL))"""


def leads(part: DataFrame) -> DataFrame:
    """Parts as leads: the name is the company, one in nine is blank."""
    key = F.col("p_partkey")
    company = F.when(key % 9 == 0, "  ").when(key % 4 == 0, F.upper("p_name")).otherwise(
        F.concat(F.lit(" "), F.col("p_name"))
    )
    return part.select(
        key.alias("input_seq"), company.alias("company_name"), F.col("p_type").alias("specialty"),
        F.when(key % 2 == 0, F.col("p_brand")).otherwise("").alias("contact_name"),
        F.concat(F.lit("F "), F.col("p_brand")).alias("founder_name"),
        F.concat(F.when(key % 5 == 0, "info").otherwise(F.concat(F.lit("u"), key.cast("string"))),
                 F.when(key % 11 == 0, "").otherwise("@"), F.lit("c"), F.col("p_size").cast("string"),
                 F.lit(".com")).alias("email"),
        F.when(key % 3 == 0, " ").otherwise("Won").alias("status"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("value_proposition"),
    )


LEADS = """leads AS (SELECT p_partkey AS input_seq,
  CASE WHEN p_partkey % 9 = 0 THEN '  ' WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS company_name,
  p_type AS specialty, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS contact_name,
  'F ' || p_brand AS founder_name,
  (CASE WHEN p_partkey % 5 = 0 THEN 'info' ELSE 'u' || p_partkey END) ||
    (CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '@' END) || 'c' || p_size || '.com' AS email,
  CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'Won' END AS status, 'size ' || p_size AS value_proposition FROM part)"""


def companies(part: DataFrame) -> DataFrame:
    """Companies on file: the names of the larger parts."""
    return part.filter(F.col("p_size") > 48).select(F.initcap("p_name").alias("company_name"))


COMPANIES = "companies AS (SELECT p_name AS company_name FROM part WHERE p_size > 48)"
