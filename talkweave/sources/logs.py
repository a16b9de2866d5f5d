"""Log sources and sinks: request and runtime lines, token usage, interactions, steps, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: line formats and file columns ------------------------------
REQUEST_LINE = (
    r"^(?<head>.*?)request_id=(\S+) method=(\S+) path=(.*?) status=(\S+) duration_ms=(\S+)\s*$"
)
REQUEST_FIELDS = ("request_id", "method", "path", "status", "duration_ms")
RUNTIME_LINE = (
    r"(?s)^(.*?)event=(.*?) trace_id=(.*?) session_id=(.*?) agent_id=(.*?) workflow_id=(.*?) "
    r"step=(.*?) tool=(.*?) status=(.*?) payload=(.*)$"
)
RUNTIME_FIELDS = (
    "event", "trace_id", "session_id", "agent_id", "workflow_id", "step", "tool", "status", "payload",
)
USAGE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("workflow", T.StringType()),
        T.StructField("node_name", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)
RETRIEVAL_TYPE = (
    "struct<query:string,collection:string,results_count:int,top_scores:array<double>,filter_used:string>"
)
INTERACTION_SCHEMA = (
    "timestamp string, session_id string, student_id string, student_class string, workflow string, "
    "user_query string, detected_subject string, detected_intent string, ai_response string, "
    "input_tokens long, output_tokens long, total_tokens long, latency_ms double, student_rating int, "
    f"teacher_approved boolean, retrieval {RETRIEVAL_TYPE}"
)
STEP_SCHEMA = (
    "timestamp string, trace_id string, session_id string, agent_id string, step int, event string, "
    "payload string"
)
INTENT = "academic"
# --- end of fixed values ----------------------------------------------------


def _fields(line: Column, pattern: str, names: tuple[str, ...]) -> list[Column]:
    """Groups 2.. of the line pattern by name; '-' means missing."""
    values = [F.regexp_extract(line, pattern, i + 2) for i in range(len(names))]
    return [F.when(line.rlike(pattern) & (v != "-"), v).alias(n) for n, v in zip(names, values)]


def parse_request_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Request log lines as columns; lines of another shape are left out."""
    rows = df.filter(F.col(line).rlike(REQUEST_LINE)).select(*_fields(F.col(line), REQUEST_LINE, REQUEST_FIELDS))
    return rows.withColumn("status", F.col("status").try_cast("int")).withColumn(
        "duration_ms", F.col("duration_ms").try_cast("long")
    )


def parse_runtime_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Runtime log lines as columns; the payload may hold blanks."""
    rows = df.filter(F.col(line).rlike(RUNTIME_LINE)).select(*_fields(F.col(line), RUNTIME_LINE, RUNTIME_FIELDS))
    return rows.withColumn("step", F.col("step").try_cast("int"))


def read_request_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_request_lines((spark.readStream if stream else spark.read).text(path))


def read_runtime_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_runtime_lines((spark.readStream if stream else spark.read).text(path))


def usage_rows(df: DataFrame) -> DataFrame:
    """The nine usage columns; the total is input plus output."""
    total = (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens")
    return df.select(*[total if f.name == "total_tokens" else F.col(f.name).cast(f.dataType) for f in USAGE_SCHEMA])


def write_token_usage(df: DataFrame, path: str) -> None:
    """Appended CSV with a header."""
    usage_rows(df).write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_token_usage(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(USAGE_SCHEMA).option("header", True).option("escape", '"').option("multiLine", False).csv(path)


def interaction_rows(df: DataFrame, collection: str, answer_chars: int | None = None) -> DataFrame:
    """Interaction records; ``answer_chars`` cuts the answer, retrieval is present only with results."""
    answer = F.col("ai_response") if answer_chars is None else F.substring("ai_response", 1, answer_chars)
    retrieval = F.struct(
        F.col("user_query").alias("query"), F.lit(collection).alias("collection"),
        F.col("retrieval_count").cast("int").alias("results_count"),
        F.coalesce("retrieval_scores", F.array().cast("array<double>")).alias("top_scores"),
        F.lit(None).cast("string").alias("filter_used"),
    )
    return df.select(
        "timestamp", "session_id", "student_id", "student_class", "workflow", "user_query", "detected_subject",
        F.lit(INTENT).alias("detected_intent"),
        answer.alias("ai_response"),
        "input_tokens", "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "latency_ms",
        F.lit(None).cast("int").alias("student_rating"), F.lit(False).alias("teacher_approved"),
        F.when(F.col("retrieval_count") > 0, retrieval).alias("retrieval"),
    )


def write_interactions(df: DataFrame, path: str, collection: str, answer_chars: int | None = None) -> None:
    """Appended JSON lines; empty fields are written as null, a missing retrieval not at all."""
    rows = interaction_rows(df, collection, answer_chars)
    keep_nulls = {"ignoreNullFields": "false"}
    base = [c for c in rows.columns if c != "retrieval"]
    line = F.when(F.col("retrieval").isNull(), F.to_json(F.struct(*base), keep_nulls)).otherwise(
        F.to_json(F.struct(*rows.columns), keep_nulls)
    )
    rows.select(line.alias("value")).write.mode("append").text(path)


def read_interactions(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(INTERACTION_SCHEMA).json(path)


def write_steps(df: DataFrame, path: str) -> None:
    """JSON lines; ``payload`` is JSON text and is written as an object."""
    payload = F.coalesce(F.try_parse_json("payload"), F.parse_json(F.lit("{}")))
    columns = ["timestamp", "trace_id", "session_id", "agent_id", "step", "event"]
    df.select(*columns, payload.alias("payload")).write.mode("append").json(path)


def read_steps(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The payload comes back as JSON text."""
    return (spark.readStream if stream else spark.read).schema(STEP_SCHEMA).json(path)


def event_lines(df: DataFrame, data: str = "data") -> DataFrame:
    """JSON text of ``{timestamp, event, **data}``; data keys win on a clash.

    ``data`` is a MAP<STRING,STRING>, or a VARIANT object to keep value types.
    """
    typed = dict(df.dtypes)[data] == "variant"
    value_type = "variant" if typed else "string"
    empty = F.create_map().cast(f"map<string,{value_type}>")
    head = F.create_map(
        F.lit("timestamp"), F.col("timestamp").cast("string").cast(value_type),
        F.lit("event"), F.col("event").cast(value_type),
    )
    extra = F.coalesce(F.col(data).try_cast("map<string,variant>") if typed else F.col(data), empty)
    kept = F.map_filter(head, lambda k, _: ~F.map_contains_key(extra, k))
    return df.select(F.to_json(F.map_concat(kept, extra)).alias("value"))


def write_events(df: DataFrame, path: str, data: str = "data") -> None:
    event_lines(df, data).write.mode("append").text(path)


def export_node_logs(df: DataFrame, path: str) -> None:
    """Full node log rows, texts included, as JSON lines."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)
