"""Chat sessions: history windows, transcripts, carried subject, clears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.prompts import MEMORY_END, MEMORY_START
from talkweave.operators.skew import SPAN, preceding_rows, running_last, top_per_key

STORE_TURNS = 6


def window_size(limit: int | None = None, turns: int = STORE_TURNS) -> int:
    """Messages a reader sees: the store keeps ``2*turns`` whatever limit is asked for."""
    return 2 * min(turns, limit or turns)


def memory_window(messages: DataFrame, turns: int = STORE_TURNS, limit: int | None = None) -> DataFrame:
    """X1, latest form: the last messages of each session."""
    size = window_size(limit, turns)
    return top_per_key(messages, ["session_id"], [F.desc("seq")], size, "_rank").drop("_rank")


def memory_before(
    messages: DataFrame, turns: int = STORE_TURNS, limit: int | None = None, span: int = SPAN
) -> DataFrame:
    """X1, as-of form: for each message the array of messages before it."""
    return preceding_rows(
        messages, ["session_id"], "seq", ["role", "content"], window_size(limit, turns), "before", span
    )


def transcript(window: Column) -> Column:
    """Transcript of an ordered array of (role, content); '' when empty.

    Every role but ``user`` is shown as Assistant.
    """
    lines = F.transform(
        window,
        lambda m: F.concat(F.when(m["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), m["content"]),
    )
    body = F.concat(F.lit(MEMORY_START + "\n"), F.array_join(lines, "\n"), F.lit("\n" + MEMORY_END))
    return F.when(F.size(window) > 0, body).otherwise("")


def memory_context(messages: DataFrame, turns: int = STORE_TURNS, limit: int | None = None) -> DataFrame:
    """One transcript per session; the gathered list is bounded by the window size."""
    latest = memory_window(messages, turns, limit)
    gathered = F.array_sort(F.collect_list(F.struct("seq", "role", "content")))
    return latest.groupBy("session_id").agg(transcript(gathered).alias("context"))


def carry_subject(messages: DataFrame, document_turns_update: bool = False, span: int = SPAN) -> DataFrame:
    """The session's last detected subject before each message.

    ``messages`` has ``subject`` (null when none was detected) and, where document
    turns must not update the subject, the boolean column ``is_document``.
    """
    subject = F.col("subject")
    if not document_turns_update and "is_document" in messages.columns:
        subject = F.when(~F.col("is_document"), subject)
    return running_last(messages, ["session_id"], "seq", {"current_subject": subject}, span)


def clear_session(messages: DataFrame, clears: DataFrame) -> DataFrame:
    """Rows at or before a session's last clear are dropped."""
    last = clears.groupBy("session_id").agg(F.max("seq").alias("_cleared"))
    joined = messages.join(last, "session_id", "left")
    return joined.filter(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared"))).drop("_cleared")
