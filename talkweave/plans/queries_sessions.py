"""Session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions import text as TX
from talkweave.operators import sessions as S
from talkweave.plans import mappings as M
from talkweave.plans.catalog import query, stream_table, table
from talkweave.streaming import stateful as ST

TURNS = 2
KEYWORDS = {"Chemistry": ("the",), "Physics": ("une", "que"), "Biology": ("und", "der"), "Hindi": ("los",)}


def _messages(spark, d):
    return M.messages(table(spark, d, "conversations"))


_LINE = "CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content"

LATEST = f"""SELECT session_id, seq, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id
  ORDER BY seq DESC) AS rn FROM messages) WHERE rn <= {2 * TURNS}"""

CONTEXT = f"""SELECT session_id, '--- Conversation Memory ---' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY seq)
  || chr(10) || '--- End Memory ---' AS context FROM ({LATEST}) GROUP BY session_id"""


@query("memory_window_latest", f"WITH {M.MESSAGES} {LATEST}")
def memory_window_latest(spark, d):
    return S.memory_window(_messages(spark, d), TURNS)


@query(
    "memory_window_before",
    f"""WITH {M.MESSAGES} SELECT a.session_id, a.seq, CAST(count(b.seq) AS BIGINT) AS n_before,
    CASE WHEN count(b.seq) = 0 THEN '' ELSE '--- Conversation Memory ---' || chr(10) ||
      string_agg(CASE WHEN b.role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || b.content, chr(10) ORDER BY b.seq)
      || chr(10) || '--- End Memory ---' END AS memory
    FROM messages a LEFT JOIN messages b ON a.session_id = b.session_id AND b.seq < a.seq AND b.seq >= a.seq - {2 * TURNS}
    GROUP BY a.session_id, a.seq""",
)
def memory_window_before(spark, d):
    rows = S.memory_before(_messages(spark, d), TURNS)
    return rows.select(
        "session_id", "seq", F.size("before").cast("long").alias("n_before"), S.transcript(F.col("before")).alias("memory")
    )


@query("memory_context", f"WITH {M.MESSAGES} {CONTEXT}")
def memory_context(spark, d):
    return S.memory_context(_messages(spark, d), TURNS)


def _with_subject(messages):
    subject = TX.heuristic_subject("content", KEYWORDS)
    return messages.withColumn("subject", F.when(F.col("role") == "user", subject)).withColumn(
        "is_document", F.col("seq") % 5 == 4
    )


_SUBJECT_CASE = """CASE WHEN role <> 'user' THEN NULL
  WHEN contains(lower(content), 'the') THEN 'Chemistry'
  WHEN contains(lower(content), 'une') OR contains(lower(content), 'que') THEN 'Physics'
  WHEN contains(lower(content), 'und') OR contains(lower(content), 'der') THEN 'Biology'
  WHEN contains(lower(content), 'los') THEN 'Hindi' END"""
_SUBJECTS = f"subjects AS (SELECT *, {_SUBJECT_CASE} AS subject, seq % 5 = 4 AS is_document FROM messages)"


@query(
    "carried_subject",
    f"""WITH {M.MESSAGES}, {_SUBJECTS} SELECT session_id, seq, subject,
    last_value(CASE WHEN NOT is_document THEN subject END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_subject FROM subjects""",
)
def carried_subject(spark, d):
    rows = S.carry_subject(_with_subject(_messages(spark, d)))
    return rows.select("session_id", "seq", "subject", "current_subject")


@query(
    "carried_subject_documents",
    f"""WITH {M.MESSAGES}, {_SUBJECTS} SELECT session_id, seq,
    last_value(subject IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_subject FROM subjects""",
)
def carried_subject_documents(spark, d):
    rows = S.carry_subject(_with_subject(_messages(spark, d)), document_turns_update=True)
    return rows.select("session_id", "seq", "current_subject")


@query(
    "clear_session",
    f"""WITH {M.MESSAGES}, clears AS (SELECT session_id, max(seq) AS cleared FROM messages WHERE role = 'system' OR
    length(content) > 1000 GROUP BY session_id) SELECT m.session_id, m.seq, m.role FROM messages m
    LEFT JOIN clears c ON m.session_id = c.session_id WHERE c.cleared IS NULL OR m.seq > c.cleared""",
)
def clear_session(spark, d):
    messages = _messages(spark, d)
    clears = messages.filter((F.col("role") == "system") | (F.length("content") > 1000))
    return S.clear_session(messages, clears).select("session_id", "seq", "role")


@query("stream_memory", f"WITH {M.MESSAGES} {CONTEXT}")
def stream_memory(spark, d):
    stream = M.messages(stream_table(spark, d, "conversations"))
    sent = ST.drain(ST.stream_memory(stream, TURNS), "stream-memory")
    return ST.latest(sent, ["session_id"]).select("session_id", "context")


@query(
    "stream_subject",
    f"""WITH {M.MESSAGES}, {_SUBJECTS} SELECT session_id, arg_max(subject, seq) AS subject FROM subjects
    WHERE subject IS NOT NULL AND NOT is_document GROUP BY session_id""",
)
def stream_subject(spark, d):
    stream = _with_subject(M.messages(stream_table(spark, d, "conversations")))
    sent = ST.drain(ST.stream_subject(stream), "stream-subject")
    return ST.latest(sent, ["session_id"]).select("session_id", "subject")
