"""Specification files (JSON and YAML) as tables."""

from __future__ import annotations

import json
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions._util import blank_to_null, text_or_blank
from talkweave.operators.skew import first_per_key

# --- fixed values: file precedence, id fields, defaults ------------------------
EXTENSIONS = ("json", "yaml", "yml")
ID_FIELDS = {
    "agent": "agent_id", "workflow": "workflow_id", "profile": "profile_id", "tool": "tool_name",
    "settings": "workflow",
}
AGENT_TYPE = (
    "struct<agent_id:string,version:string,description:string,model_profile:string,system_prompt:string,"
    "system_prompt_path:string,developer_prompt:string,developer_prompt_path:string,response_mode:string,"
    "output_schema:string,allowed_tools:array<string>,allowed_sub_agents:array<string>,memory_window:int,"
    "max_steps:int,max_tool_calls:int,max_runtime_seconds:int,default_context:map<string,string>,"
    "metadata:map<string,string>>"
)
AGENT_DEFAULTS = {
    "agent_id": "", "version": "1.0", "description": "", "system_prompt": "", "developer_prompt": "",
    "response_mode": "text", "memory_window": 6, "max_steps": 8, "max_tool_calls": 6,
    "max_runtime_seconds": 45,
}
WORKFLOW_TYPE = (
    "struct<workflow_id:string,version:string,description:string,start_at:string,nodes:array<struct<"
    "node_id:string,node_type:string,config:map<string,string>,input_map:map<string,string>,"
    "output_map:map<string,string>,transitions:array<struct<to:string,when:string>>>>,"
    "metadata:map<string,string>>"
)
WORKFLOW_DEFAULTS = {"workflow_id": "", "version": "1.0", "description": "", "start_at": ""}
CONDITION_TYPE = "array<struct<field:string,op:string,value:string>>"
SETTINGS_TYPE = (
    "struct<workflow:string,version:string,description:string,nodes:array<struct<name:string,type:string,"
    "model:string,model_profile:string,system_prompt:string,system_prompt_path:string,output_format:string,"
    "embedding_collection:string,tools:array<string>,temperature:double,max_tokens:int>>,"
    f"vector_store:struct<provider:string,collection:string,filters:struct<must:{CONDITION_TYPE},"
    f"should:{CONDITION_TYPE},must_not:{CONDITION_TYPE},minimum_should_match:int>>>"
)
SETTINGS_DEFAULTS = {"workflow": "", "version": "1.0", "description": ""}
PROFILE_TYPE = (
    "struct<profile_id:string,version:string,workflow_id:string,description:string,"
    "instructions:array<string>,dimensions:array<struct<name:string,description:string,field_type:string,"
    "allowed_values:array<string>,required:boolean,allow_null:boolean,metadata:map<string,string>>>,"
    "metadata:map<string,string>>"
)
PROFILE_DEFAULTS = {"profile_id": "", "version": "1.0", "description": ""}
MODEL_TYPE = (
    "map<string,struct<provider:string,model:string,temperature:double,max_tokens:int,embedding_model:string>>"
)
DEFAULT_MODEL = "gemini-2.5-flash"
APP_TYPE = (
    "struct<model:struct<provider:string,model_name:string,temperature:double,max_tokens:int>,"
    "retrieval:struct<embedding_model:string,top_k:int,score_threshold:double>,"
    "logging:struct<enabled:boolean,log_retrieval:boolean,log_tokens:boolean,export_to_csv:boolean,"
    "csv_path:string,export_to_json:boolean,json_path:string>,workflows_dir:string>"
)
# --- end of fixed values ----------------------------------------------------


def parse_files(files: DataFrame) -> DataFrame:
    """(path, content) as (name, extension, spec): the spec is JSON text, null when unreadable."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def one(path: str, content: bytes) -> str | None:
            try:
                text = bytes(content).decode("utf-8")
                value = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
                return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, dict) else None
            except (ValueError, yaml.YAMLError):
                return None

        for batch in batches:
            yield pd.DataFrame(
                {"path": batch["path"], "spec": [one(p, c) for p, c in zip(batch["path"], batch["content"])]}
            )

    parsed = files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(
        parse, "path string, spec string"
    )
    file = F.substring_index("path", "/", -1)
    return parsed.select(
        F.regexp_extract(file, r"^(.*)\.[^.]+$", 1).alias("name"),
        F.regexp_extract(file, r"\.([^.]+)$", 1).alias("extension"), "spec",
    )


def specs_of(files: DataFrame, kind: str, listing: bool = False) -> DataFrame:
    """S1 over (path, content) rows: (id, name, spec).

    A lookup prefers json over yaml over yml for one file name; a listing takes
    only .yaml files and skips unreadable ones.  A missing id is the file name.
    """
    rows = parse_files(files).filter(F.col("extension").isin(*EXTENSIONS))
    if listing:
        rows = rows.filter((F.col("extension") == "yaml") & F.col("spec").isNotNull())
    else:
        ranks = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), F.col("extension"))
        rows = first_per_key(rows.withColumn("_rank", ranks), ["name"], ["_rank"]).drop("_rank")
    own = F.get_json_object("spec", f"$.{ID_FIELDS[kind]}")
    return rows.select(F.coalesce(own, F.col("name")).alias("id"), "name", "spec")


def read_specs(spark: SparkSession, directory: str, kind: str, listing: bool = False) -> DataFrame:
    """S1 over the files of a folder."""
    return specs_of(spark.read.format("binaryFile").load(directory), kind, listing)


def remote_tools_of(files: DataFrame, base_urls: dict[str, str] | None = None,
                    urls: dict[str, str] | None = None) -> DataFrame:
    """Tool specs with their endpoint; names starting with '_' and incomplete specs are dropped.

    ``urls`` and ``base_urls`` hold the values of the settings that ``endpoint_url_env``
    and ``base_url_env`` name.
    """
    rows = parse_files(files).filter(
        (F.col("extension") == "yaml") & ~F.col("name").startswith("_") & F.col("spec").isNotNull()
    )

    def key(name: str) -> Column:
        return F.get_json_object("spec", f"$.{name}")

    def setting(table: dict[str, str] | None, name: Column) -> Column:
        entries = [F.lit(x) for pair in (table or {}).items() for x in pair]
        return F.try_element_at(F.create_map(*entries).cast("map<string,string>"), name)

    full, base_env = key("endpoint_url_env"), key("base_url_env")
    base = F.rtrim(text_or_blank(setting(base_urls, base_env)), F.lit("/"))
    joined = F.concat(base, F.lit("/"), F.ltrim(text_or_blank(key("endpoint_url")), F.lit("/")))
    endpoint = F.when(blank_to_null(full).isNotNull(), F.coalesce(setting(urls, full), key("endpoint_url"))).when(
        blank_to_null(base_env).isNotNull() & (base != ""), joined
    ).otherwise(key("endpoint_url"))
    out = rows.select(
        key("tool_name").alias("tool_name"), F.coalesce(key("description"), F.lit("")).alias("description"),
        endpoint.alias("endpoint_url"), F.coalesce(key("method"), F.lit("POST")).alias("method"),
        F.coalesce(key("timeout_seconds").try_cast("int"), F.lit(30)).alias("timeout_seconds"),
        F.coalesce(key("request_body_mode"), F.lit("wrapped")).alias("request_body_mode"),
        F.coalesce(key("input_schema"), F.lit('{"type":"object","properties":{}}')).alias("input_schema"),
    )
    return out.filter((text_or_blank("tool_name") != "") & (text_or_blank("endpoint_url") != ""))


def read_remote_tools(spark: SparkSession, directory: str, **settings) -> DataFrame:
    """S2 over the files of a folder."""
    return remote_tools_of(spark.read.format("binaryFile").load(directory), **settings)


def _with_defaults(df: DataFrame, type_: str, defaults: dict, lists=(), maps=()) -> DataFrame:
    rows = df.select("id", F.from_json("spec", type_).alias("s")).select("id", "s.*")
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)))
    for name in lists:
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    for name in maps:
        rows = rows.withColumn(name, F.coalesce(name, F.create_map().cast("map<string,string>")))
    return rows


def normalize_specs(df: DataFrame, kind: str) -> DataFrame:
    """S3: typed spec rows with the defaults of their kind."""
    empty_map = F.create_map().cast("map<string,string>")
    if kind == "agent":
        return _with_defaults(
            df, AGENT_TYPE, AGENT_DEFAULTS, ("allowed_tools", "allowed_sub_agents"), ("default_context", "metadata")
        )
    if kind == "workflow":
        rows = _with_defaults(df, WORKFLOW_TYPE, WORKFLOW_DEFAULTS, ("nodes",), ("metadata",))

        def node(n: Column) -> Column:
            moves = F.coalesce(n["transitions"], F.array().cast("array<struct<to:string,when:string>>"))
            return F.struct(
                *[F.coalesce(n[f], F.lit("")).alias(f) for f in ("node_id", "node_type")],
                *[F.coalesce(n[f], empty_map).alias(f) for f in ("config", "input_map", "output_map")],
                F.transform(
                    moves,
                    lambda t: F.struct(
                        F.coalesce(t["to"], F.lit("")).alias("to"), F.coalesce(t["when"], F.lit("always")).alias("when")
                    ),
                ).alias("transitions"),
            )

        return rows.withColumn("nodes", F.transform("nodes", node))
    if kind == "settings":
        rows = _with_defaults(df, SETTINGS_TYPE, SETTINGS_DEFAULTS, ("nodes",))
        texts = ("name", "type", "system_prompt")

        def setting(n: Column) -> Column:
            return F.struct(
                *[F.coalesce(n[f], F.lit("")).alias(f) for f in texts],
                F.coalesce(n["model"], F.lit(DEFAULT_MODEL)).alias("model"),
                *[n[f].alias(f) for f in ("model_profile", "system_prompt_path", "output_format", "embedding_collection")],
                F.coalesce(n["tools"], F.array().cast("array<string>")).alias("tools"),
                F.coalesce(n["temperature"], F.lit(0.7)).alias("temperature"),
                F.coalesce(n["max_tokens"], F.lit(4096)).alias("max_tokens"),
            )

        return rows.withColumn("nodes", F.transform("nodes", setting))
    if kind == "profile":
        rows = _with_defaults(df, PROFILE_TYPE, PROFILE_DEFAULTS, ("instructions", "dimensions"), ("metadata",))

        def dimension(d: Column) -> Column:
            return F.struct(
                *[F.coalesce(d[f], F.lit("")).alias(f) for f in ("name", "description")],
                F.coalesce(d["field_type"], F.lit("enum")).alias("field_type"),
                F.coalesce(d["allowed_values"], F.array().cast("array<string>")).alias("allowed_values"),
                F.coalesce(d["required"], F.lit(True)).alias("required"),
                F.coalesce(d["allow_null"], F.lit(False)).alias("allow_null"),
                F.coalesce(d["metadata"], empty_map).alias("metadata"),
            )

        return rows.withColumn("dimensions", F.transform("dimensions", dimension))
    if kind == "model":
        table = F.from_json(F.get_json_object("spec", "$.profiles"), MODEL_TYPE)
        rows = df.select(F.explode(table).alias("name", "p"))
        return rows.select(
            "name", F.coalesce("p.provider", F.lit("gemini")).alias("provider"),
            F.coalesce("p.model", F.lit(DEFAULT_MODEL)).alias("model"),
            F.coalesce("p.temperature", F.lit(0.7)).alias("temperature"),
            F.coalesce("p.max_tokens", F.lit(4096)).alias("max_tokens"), "p.embedding_model",
        )
    if kind == "app":
        rows = df.select("id", F.from_json("spec", APP_TYPE).alias("s")).select("id", "s.*")
        return rows.select(
            "id",
            F.coalesce("model.provider", F.lit("gemini")).alias("provider"),
            F.coalesce("model.model_name", F.lit(DEFAULT_MODEL)).alias("model_name"),
            F.coalesce("model.temperature", F.lit(0.7)).alias("temperature"),
            F.coalesce("model.max_tokens", F.lit(4096)).alias("max_tokens"),
            F.coalesce("retrieval.top_k", F.lit(10)).alias("top_k"),
            F.coalesce("retrieval.score_threshold", F.lit(0.5)).alias("score_threshold"),
            F.coalesce("logging.enabled", F.lit(True)).alias("logging_enabled"),
            F.coalesce("logging.csv_path", F.lit("logs/token_usage.csv")).alias("csv_path"),
            F.coalesce("workflows_dir", F.lit("config/workflow_settings")).alias("workflows_dir"),
        )
    raise ValueError(f"Unknown spec kind: {kind}")
