"""Run logs: usage summaries, run summaries, policy audits, provider attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.jsontext import get_path
from talkweave.functions.text import is_retryable_error
from talkweave.operators.skew import SPAN, running_count

DEFAULT_TIMEOUT_SECONDS = 20
DEFAULT_MAX_TOOL_CALLS = 6

USAGE_SUMS = {
    "total_input_tokens": "input_tokens",
    "total_output_tokens": "output_tokens",
    "total_latency_ms": "latency_ms",
}


def workflow_summary(usage: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """A1: calls, tokens and latency per workflow.

    With a requested list, a workflow without rows shows ``total_calls`` 0 and nulls.
    """
    summary = usage.groupBy("workflow").agg(
        F.count(F.lit(1)).alias("total_calls"),
        *[F.sum(c).alias(n) for n, c in USAGE_SUMS.items()],
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )
    if workflows is None:
        return summary
    asked = workflows.select("workflow").distinct().join(summary, "workflow", "left")
    return asked.withColumn("total_calls", F.coalesce("total_calls", F.lit(0)))


def run_summary(steps: DataFrame) -> DataFrame:
    """A2: one row per trace from the step log.

    ``steps`` has trace_id, step, event, timestamp and a VARIANT ``payload``.
    """
    call = F.col("event") == "agent_tool_call"
    failed = call & (get_path("payload", "ok", "boolean") == F.lit(False))
    at = F.col("timestamp").cast("timestamp")
    return steps.groupBy("trace_id").agg(
        F.count_if(call).alias("tool_calls"),
        F.bool_or(F.col("event") == "agent_final_answer").alias("completed"),
        F.max("step").alias("last_step"),
        F.count_if(failed).alias("failed_calls"),
        F.coalesce(F.sum(F.when(call, get_path("payload", "latency_ms", "double"))), F.lit(0.0)).alias(
            "tool_latency_ms"
        ),
        ((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1000.0).alias("wall_ms"),
    )


# Endings that only the returned step arrays tell.
ARRAY_ENDINGS = ("timeout", "max_tool_calls_reached", "invalid_decision")


def run_endings(runs: DataFrame) -> DataFrame:
    """A2 over returned ``steps`` arrays: which endings each run shows."""
    kinds = F.transform("steps", lambda s: s["type"])
    return runs.select("trace_id", *[F.array_contains(kinds, e).alias(e) for e in ARRAY_ENDINGS])


def tool_policy_audit(
    calls: DataFrame, agents: DataFrame, tools: DataFrame,
    per_tool_timeout: dict[str, int] | None = None, span: int = SPAN,
) -> DataFrame:
    """Verdict of each logged call and whether it is beyond the agent's call budget.

    calls: trace_id, step, agent_id, tool_name, latency_ms, error_code.
    agents: agent_id, allowed_tools, max_tool_calls.  tools: name, timeout_seconds.
    """
    a = agents.select(
        "agent_id", F.coalesce("allowed_tools", F.array().cast("array<string>")).alias("_allowed"),
        F.coalesce("max_tool_calls", F.lit(DEFAULT_MAX_TOOL_CALLS)).alias("_budget"),
    )
    t = tools.select(F.col("name").alias("tool_name"), F.col("timeout_seconds").alias("_timeout"),
                     F.lit(True).alias("_known"))
    numbered = running_count(calls, ["trace_id"], "step", "ordinal", span)
    joined = numbered.join(a, "agent_id", "left").join(t, "tool_name", "left")
    own = F.lit(None).cast("int")
    for name, seconds in (per_tool_timeout or {}).items():
        own = F.when(F.col("tool_name") == name, F.lit(seconds)).otherwise(own)
    seconds = F.coalesce(own, F.nullif(F.col("_timeout"), F.lit(0)), F.lit(DEFAULT_TIMEOUT_SECONDS))
    not_allowed = (F.size("_allowed") > 0) & ~F.array_contains("_allowed", F.col("tool_name"))
    slow = (F.col("error_code") == "tool_timeout") | (F.col("latency_ms") > seconds * 1000)
    verdict = (
        F.when(not_allowed, "not_allowed")
        .when(F.col("_known").isNull(), "not_found")
        .when(slow, "timeout")
        .otherwise("ok")
    )
    budget = F.coalesce("_budget", F.lit(DEFAULT_MAX_TOOL_CALLS))
    return joined.select(
        *calls.columns, "ordinal", verdict.alias("verdict"), (F.col("ordinal") > budget).alias("over_budget")
    )


def resolve_attempts(attempts: DataFrame, retryable: Column | None = None) -> DataFrame:
    """Outcome of each call's ordered provider attempts.

    The first success wins unless a fatal error came before it; the reported error
    is that fatal one, or the last.  Only aggregates, so long calls combine map-side.
    """
    fatal = ~F.col("ok") & ~(retryable if retryable is not None else is_retryable_error("error"))
    row = F.struct("rank", "provider", "error")
    per_call = attempts.groupBy("call_id").agg(
        F.min(F.when(F.col("ok"), row)).alias("_ok"),
        F.min(F.when(fatal, row)).alias("_fatal"),
        F.max(F.when(~F.col("ok"), row)).alias("_last"),
    )
    won = F.col("_ok.rank").isNotNull() & (
        F.col("_fatal.rank").isNull() | (F.col("_ok.rank") < F.col("_fatal.rank"))
    )
    lost = F.coalesce(F.col("_fatal"), F.col("_last"))
    return per_call.select(
        "call_id", won.alias("ok"), F.when(won, F.col("_ok.provider")).alias("provider"),
        F.when(~won, lost["error"]).alias("error"),
    )
