"""Plug-in points: user functions over text columns, and named steps."""

from __future__ import annotations

import json
import time
from typing import Any, Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.records import missing_args

MODEL_RESULT = (
    "text string, input_tokens long, output_tokens long, model string, latency_ms double, error string"
)
TOOL_RESULT = "ok boolean, data string, error struct<code:string,message:string>, latency_ms double"

TextFunction = Callable[[list[str]], list[dict[str, Any]]]


def _call_rows(fn: Callable[[list], list], items: list) -> list[tuple[Any, Exception | None]]:
    """One call for the batch; if it raises, one call per item to find the bad ones."""
    try:
        return [(value, None) for value in fn(items)]
    except Exception:  # a user function may raise anything; it becomes a row error
        out = []
        for item in items:
            try:
                out.append((fn([item])[0], None))
            except Exception as exc:
                out.append((None, exc))
        return out


def _object_frame(columns: dict[str, Any]) -> pd.DataFrame:
    """Plain Python values, so that null and mixed columns reach Arrow as they are."""
    return pd.DataFrame({n: pd.Series(list(values), dtype=object) for n, values in columns.items()})


def map_model(df: DataFrame, fn: TextFunction, prompt_col: str, output: str = "model_result") -> DataFrame:
    """A user's text function over a column, in Arrow batches.

    Only the prompt column goes to Python.  Null prompts give a null text; errors
    stay in their row.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [part.strip().split(" ")[0] for part in MODEL_RESULT.split(",")]
        for prompts in batches:
            rows: list[dict] = [{} for _ in range(len(prompts))]
            wanted = [i for i, p in enumerate(prompts) if p is not None]
            started = time.perf_counter()
            answers = _call_rows(fn, [prompts.iloc[i] for i in wanted])
            spent = (time.perf_counter() - started) * 1000 / max(1, len(wanted))
            for i, (value, error) in zip(wanted, answers):
                rows[i] = {"latency_ms": spent, **(value or {}), "error": None if error is None else str(error)}
            yield _object_frame({n: [r.get(n) for r in rows] for n in names})

    udf = F.pandas_udf(run, MODEL_RESULT).asNondeterministic()
    return df.withColumn(output, udf(F.col(prompt_col)))


def embed_batch(df: DataFrame, fn: Callable[[list[str]], list[list[float]]], text_col: str,
                output: str = "vector") -> DataFrame:
    """A user's embedding function over a text column, one call per Arrow batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors: list = [None] * len(texts)
            wanted = [i for i, t in enumerate(texts) if t is not None]
            for i, vector in zip(wanted, fn([texts.iloc[i] for i in wanted]) if wanted else []):
                vectors[i] = vector
            yield pd.Series(vectors, dtype=object)

    return df.withColumn(output, F.pandas_udf(run, "array<float>").asNondeterministic()(F.col(text_col)))


def apply_tool(df: DataFrame, fn: Callable[[dict], Any], schema: dict, arguments_col: str,
               output: str = "tool_result") -> DataFrame:
    """D3: a user's tool over JSON arguments with the result (ok, data, error, latency).

    Missing required arguments are found in the JVM; such rows never reach the tool.
    """
    required = schema.get("required") or [] if schema.get("type") == "object" else []
    wanted = F.array(*[F.lit(r) for r in required]).cast("array<string>")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for arguments, missing in batches:
            rows = []
            for text, gap in zip(arguments, missing):
                started = time.perf_counter()
                data, error = None, None
                if gap:
                    error = {"code": "invalid_arguments", "message": f"Missing required field: {gap}"}
                else:
                    try:
                        value = fn(json.loads(text) if text else {})
                        data = json.dumps(value if isinstance(value, dict) else {"result": value}, ensure_ascii=False)
                    except Exception as exc:
                        error = {"code": getattr(exc, "code", "tool_runtime_error"), "message": str(exc)}
                rows.append((error is None, data, error, (time.perf_counter() - started) * 1000))
            yield _object_frame(dict(zip(("ok", "data", "error", "latency_ms"), zip(*rows))))

    udf = F.pandas_udf(run, TOOL_RESULT).asNondeterministic()
    gap = F.try_element_at(missing_args(F.coalesce(F.col(arguments_col), F.lit("{}")), wanted), F.lit(1))
    return df.withColumn(output, udf(F.col(arguments_col), gap))


def run_branches(df: DataFrame, branch: Column, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """D4 with P10: rows of each branch value go through the function given for it; results are united."""
    marked = df.withColumn("_branch", branch)
    parts = [
        marked.filter(F.col("_branch") == value).drop("_branch").transform(fn)
        for value, fn in steps.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
