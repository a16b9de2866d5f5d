"""Agent, tool, workflow and directory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.functions._util import blank_to_null, strip, text_or_blank
from talkweave.functions.text import requires_auth, slugify, tool_category
from talkweave.operators.skew import first_per_key

# --- fixed values: enums, bounds and defaults ---------------------------------
SCOPES = ("generic", "business", "business_tenant")
STATUSES = ("draft", "active", "inactive")
RESPONSE_MODES = ("text", "json")
BOUNDS = {
    "memory_window": (1, 50),
    "max_steps": (1, 50),
    "max_tool_calls": (0, 50),
    "max_runtime_seconds": (5, 300),
}
LENGTHS = {"name": (1, 128), "slug": (0, 128), "placeholder_text": (0, 256), "version": (0, 16)}
DIRECTORY_DEFAULTS = {
    "scope": "generic", "status": "draft", "version": "1.0", "response_mode": "text",
    "memory_window": 6, "max_steps": 8, "max_tool_calls": 6, "max_runtime_seconds": 45,
}
NODE_DEFAULTS = {"temperature": "0.7", "max_tokens": "1024", "use_retrieval": "true",
                 "max_chunks": "5", "rewrite_query": "true"}
EMPTY_SCHEMA = '{"type":"object","properties":{}}'
# --- end of fixed values ----------------------------------------------------
TOOL_BUCKETS = 16
AGENT_SLICES = 64


def directory_query(df: DataFrame, order: str, limit: int | None = None, offset: int = 0, **equals) -> DataFrame:
    """P5: equality filters for the given arguments, then K4."""
    for name, value in equals.items():
        if value:
            df = df.filter(F.col(name) == value)
    return paginate(df, order, limit, offset)


def paginate(df: DataFrame, order: str, limit: int | None, offset: int = 0) -> DataFrame:
    """K4: the offset applies after the limit, so offset >= limit returns nothing."""
    page = df.orderBy(order)
    if limit:
        page = page.limit(limit)
    return page.offset(offset) if offset else page


def get_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """First row whose trimmed key equals the trimmed value; empty when there is none."""
    return df.filter(strip(text_or_blank(key)) == str(value).strip()).orderBy(order).limit(1)


def get_by_slug(df: DataFrame, slug: str, order: str) -> DataFrame:
    """P6."""
    return df.filter(F.col("slug") == slug).orderBy(order).limit(1)


def exists(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The keys that the table holds."""
    return keys.join(table.select(key).distinct(), key, "left_semi")


def validate_directory(df: DataFrame) -> DataFrame:
    """Adds ``violations``, the list of broken rules."""

    def present(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    def broken(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(True)), name)

    scope = F.col("scope")
    rules = [
        broken("scope", scope.isin(*SCOPES)),
        broken("status", F.col("status").isin(*STATUSES)),
        broken("response_mode", F.col("response_mode").isin(*RESPONSE_MODES)),
        broken("business_id", ~scope.isin("business", "business_tenant") | present("business_id")),
        broken("tenant_id", (scope != "business_tenant") | present("tenant_id")),
        F.when(F.col("name").isNull(), "name"),
    ]
    rules += [broken(n, F.length(n).between(lo, hi)) for n, (lo, hi) in LENGTHS.items() if n in df.columns]
    rules += [broken(n, F.col(n).between(lo, hi)) for n, (lo, hi) in BOUNDS.items() if n in df.columns]
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def runnable_agents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active rows, and the others with the reason."""
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    reason = F.concat(F.lit("not active (status="), F.coalesce("status", F.lit("None")), F.lit(")"))
    return df.filter(active), df.filter(~active).withColumn("reason", reason)


# --- table maintenance ---------------------------------------------------------
def latest_changes(changes: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last non-null value of each field, and of each entry of a map field."""
    fields = [c for c in changes.columns if c not in (key, order)]
    maps = [c for c in fields if isinstance(changes.schema[c].dataType, T.MapType)]
    out = changes.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields if c not in maps],
        *[F.max(F.col(c).isNotNull()).alias(f"_has_{c}") for c in maps],
    )
    for c in maps:
        entries = changes.select(key, order, F.explode(c).alias("_field", "_value"))
        last = entries.groupBy(key, "_field").agg(F.max_by("_value", order).alias("_value"))
        merged = last.groupBy(F.col(key).alias("_key")).agg(
            F.map_from_entries(F.collect_list(F.struct("_field", "_value"))).alias(c)
        )
        # A change with an empty map is a change, with nothing to merge.
        empty = F.when(F.col(f"_has_{c}"), F.map_from_arrays(F.array(), F.array()).cast(changes.schema[c].dataType))
        out = out.join(merged, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(c, F.coalesce(c, empty)).drop("_key", f"_has_{c}")
    return out.select(key, *fields)


def _merge_maps(old: Column, new: Column) -> Column:
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str, now: Column) -> DataFrame:
    """Field-level merge by key.

    Absent (null) fields keep the old value, map fields merge, ``created_at`` is set
    once and ``updated_at`` every time.  Changes are reduced to one row per key
    before the join, so a key with many changes costs no skew.
    """
    latest = latest_changes(changes, key, order)
    new = latest.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in latest.columns if c != key])
    joined = table.join(new, F.col(key) == F.col("_k"), "full_outer")
    types = {f.name: f.dataType for f in table.schema.fields}

    def merged(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(key), F.col("_k"))
        old = F.col(c)
        fresh = F.col(f"_n_{c}") if f"_n_{c}" in new.columns else None
        if c == "updated_at":
            return F.when(F.col("_k").isNotNull(), now.cast(types[c])).otherwise(old)
        if c == "created_at":
            return F.coalesce(old, *([fresh] if fresh is not None else []), now.cast(types[c]))
        if fresh is None:
            return old
        return _merge_maps(old, fresh) if isinstance(types[c], T.MapType) else F.coalesce(fresh, old)

    return joined.select(*[merged(c).alias(c) for c in table.columns])


def directory_create(table: DataFrame, new: DataFrame, now: Column, order: str) -> DataFrame:
    """New directory rows with defaults and a unique slug.

    A slug already in the table, or taken by an earlier row of the batch, gets the
    first 8 hex digits of the id's MD5 as a suffix.
    """

    def given(name: str) -> Column:
        return F.col(name) if name in new.columns else F.lit(None).cast("string")

    wanted = F.coalesce(blank_to_null(given("slug")), slugify(F.coalesce(given("name"), F.col("agent_id"))))
    rows = new.withColumn("_slug", wanted)
    owners = rows.groupBy("_slug").agg(F.min(order).alias("_owner"))
    taken = table.select(F.col("slug").alias("_slug"), F.lit(True).alias("_taken")).distinct()
    marked = rows.join(owners.join(taken, "_slug", "left"), "_slug", "left")
    collides = F.col("_taken").isNotNull() | (F.col(order) != F.col("_owner"))
    suffix = F.substring(F.md5(F.col("agent_id").cast("string")), 1, 8)
    slug = F.when(collides, F.concat("_slug", F.lit("-"), suffix)).otherwise(F.col("_slug"))
    filled = {"slug": slug, "created_at": now.cast("string"), "name": F.coalesce(given("name"), F.lit(""))}
    for name, default in DIRECTORY_DEFAULTS.items():
        filled[name] = F.coalesce(F.col(name), F.lit(default)) if name in new.columns else F.lit(default)
    keep = [c for c in new.columns if c not in filled and c != order]
    return marked.select(*keep, *[v.alias(n) for n, v in filled.items()])


def directory_update(table: DataFrame, patches: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Non-null patch fields replace old ones; (table, rejects of unknown ids)."""
    latest = latest_changes(patches, key, order)
    fields = [c for c in latest.columns if c != key]
    new = latest.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = table.join(new, key, "left")
    merged = [F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns]
    rejects = latest.join(table.select(key), key, "left_anti").select(key, F.lit("not found").alias("reason"))
    return joined.select(*merged), rejects


def delete_by_key(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """U4: (table without the keys, rejects of unknown keys)."""
    gone = keys.select(key).distinct()
    return table.join(gone, key, "left_anti"), gone.join(table.select(key), key, "left_anti")


def seed(table: DataFrame, standard: DataFrame, key: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Insert standard records, or overwrite with ``force``; (table, key and outcome)."""
    tagged = standard.withColumn("is_standard", F.lit(True))
    known = table.select(key).withColumn("_known", F.lit(True))
    skip = F.lit(False) if force else F.coalesce("_known", F.lit(False))
    outcome = standard.select(key).join(known, key, "left").select(
        key, F.when(skip, "skipped").otherwise("seeded").alias("outcome")
    )
    if force:
        kept = table.join(standard.select(key), key, "left_anti")
        return kept.unionByName(tagged, allowMissingColumns=True), outcome
    fresh = tagged.join(table.select(key), key, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True), outcome


def file_over_db(files: DataFrame, db: DataFrame, key: str) -> DataFrame:
    """Stored records replace file specs of the same id."""
    both = files.withColumn("_rank", F.lit(1)).unionByName(
        db.withColumn("_rank", F.lit(0)), allowMissingColumns=True
    )
    return first_per_key(both.filter(F.coalesce(key, F.lit("")) != ""), [key], ["_rank"]).drop("_rank")


# --- specs -----------------------------------------------------------------------
def list_specs(df: DataFrame, kind: str) -> DataFrame:
    """P20: summary projection of workflow or agent specs, by id."""
    text = [F.coalesce("description", F.lit("")).alias("description"), F.coalesce("version", F.lit("1.0")).alias("version")]
    if kind == "workflow":
        return df.select("workflow_id", *text, F.transform("nodes", lambda n: n["node_id"]).alias("nodes"))
    return df.select("agent_id", *text, "allowed_tools", F.coalesce("model_profile", F.lit("")).alias("model_profile"))


def nodes_of(workflows: DataFrame, node_id: str | None = None, node_type: str | None = None) -> DataFrame:
    """The first node by id, or all nodes of a type."""
    nodes = F.col("nodes")
    if node_id is not None:
        nodes = F.slice(F.filter(nodes, lambda n: n["node_id"] == node_id), 1, 1)
    if node_type is not None:
        nodes = F.filter(nodes, lambda n: n["node_type"] == node_type)
    return workflows.select("workflow_id", F.explode(nodes).alias("node"))


def dimension_of(profiles: DataFrame, name: str) -> DataFrame:
    """The first dimension of that name, per profile."""
    hit = F.filter("dimensions", lambda d: d["name"] == name)
    return profiles.select("profile_id", F.explode(F.slice(hit, 1, 1)).alias("dimension"))


def workflow_node_details(workflows: DataFrame, agents: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per node with per-type details as JSON text.

    Node ``config`` is a MAP<STRING,STRING>; agents and profiles are unique by id.
    """
    nodes = workflows.select("workflow_id", F.posexplode("nodes").alias("position", "node"))
    config = F.col("node.config")

    def setting(name: str, default: str = "") -> Column:
        return F.coalesce(F.try_element_at(config, F.lit(name)), F.lit(NODE_DEFAULTS.get(name, default)))

    kind = F.lower(strip(F.col("node.node_type")))
    nodes = nodes.withColumn("_kind", kind).withColumn(
        "_agent", F.when(kind == "agent", F.nullif(setting("agent_id"), F.lit("")))
    ).withColumn("_profile", F.when(kind == "classification", F.nullif(setting("profile_id"), F.lit(""))))
    agent_fields = [c for c in ("agent_id", "description", "model_profile", "allowed_tools", "max_steps",
                                "max_tool_calls", "response_mode", "system_prompt") if c in agents.columns]
    profile_fields = [c for c in ("profile_id", "description", "instructions", "dimensions") if c in profiles.columns]
    a = agents.select(F.col("agent_id").alias("_agent"), F.struct(*agent_fields).alias("_a"))
    p = profiles.select(F.col("profile_id").alias("_profile"), F.struct(*profile_fields).alias("_p"))
    joined = nodes.join(a, "_agent", "left").join(p, "_profile", "left")

    def settings(*names: str) -> Column:
        return F.to_json(F.struct(*[setting(n).alias(n) for n in names]))

    def found(row: str, key: str, what: str) -> Column:
        text = F.concat(F.lit(f"{what} not found: "), F.col(key))
        error = F.to_json(F.struct(text.alias("error")))
        return F.when(F.col(key).isNull(), "{}").when(F.col(row).isNull(), error).otherwise(F.to_json(row))

    details = (
        F.when(F.col("_kind") == "agent", found("_a", "_agent", "Agent spec"))
        .when(F.col("_kind") == "classification", found("_p", "_profile", "Classification profile"))
        .when(F.col("_kind") == "llm", settings("system_prompt", "temperature", "max_tokens"))
        .when(F.col("_kind") == "tool", settings("tool_name", "arguments"))
        .when(
            F.col("_kind") == "rag",
            settings("system_prompt", "use_retrieval", "collection_name", "max_chunks", "rewrite_query"),
        )
        .otherwise("{}")
    )
    return joined.select(
        "workflow_id", "position", F.col("node.node_id").alias("node_id"),
        F.col("node.node_type").alias("node_type"), details.alias("details"),
    )


def resolve_model(agents: DataFrame, model_profiles: DataFrame, base_model: str, strict: bool = False) -> DataFrame:
    """The profile's model, or the base model; ``strict`` adds an error for unknown profiles."""
    p = model_profiles.select(F.col("name").alias("model_profile"), F.col("model").alias("_model"))
    joined = agents.join(p, "model_profile", "left")
    out = joined.withColumn("model", F.coalesce("_model", F.lit(base_model)))
    if strict:
        unknown = blank_to_null("model_profile").isNotNull() & F.col("_model").isNull()
        message = F.concat(F.lit("Unknown model_profile: "), F.col("model_profile"))
        out = out.withColumn("error", F.when(unknown, message))
    return out.drop("_model")


def tool_specs(agents: DataFrame, tools: DataFrame) -> DataFrame:
    """Tools visible to each agent; an empty allow-list sees all of them.

    Listed tools come from an equality join on the exploded allow-lists.  Agents with
    an empty list see every tool by definition: slices of agents meet buckets of tools, so
    no task holds all of either.
    """
    schema = F.coalesce(blank_to_null("input_schema"), F.lit(EMPTY_SCHEMA)).alias("input_schema")
    specs = tools.select(F.col("name"), "description", schema)
    allowed = F.coalesce("allowed_tools", F.array().cast("array<string>"))
    listed = agents.select("agent_id", F.explode(F.array_distinct(allowed)).alias("name")).join(specs, "name")

    def part(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    bucketed = specs.withColumn("_bucket", part("name", TOOL_BUCKETS)).withColumn("_slice", every(AGENT_SLICES))
    open_agents = agents.filter(F.size(allowed) == 0).select(
        "agent_id", part("agent_id", AGENT_SLICES).alias("_slice"), every(TOOL_BUCKETS).alias("_bucket")
    )
    columns = ["agent_id", "name", "description", "input_schema"]
    return listed.select(columns).unionByName(open_agents.join(bucketed, ["_bucket", "_slice"]).select(columns))


def tool_params(input_schema: Column) -> Column:
    """Parameters of a JSON-Schema object as array<struct(name, type, description, required)>."""
    shape = "struct<properties:map<string,string>,required:array<string>>"
    schema = F.from_json(input_schema, shape)
    required = F.coalesce(schema["required"], F.array().cast("array<string>"))

    def param(entry: Column) -> Column:
        prop = entry["value"]
        return F.struct(
            entry["key"].alias("name"),
            F.coalesce(F.get_json_object(prop, "$.type"), F.lit("string")).alias("type"),
            F.coalesce(F.get_json_object(prop, "$.description"), F.lit("")).alias("description"),
            F.array_contains(required, entry["key"]).alias("required"),
        )

    entries = F.coalesce(
        F.map_entries(schema["properties"]),
        F.array().cast("array<struct<key:string,value:string>>"),
    )
    return F.transform(entries, param)


def tool_catalogue(tools: DataFrame) -> DataFrame:
    """K3: tools with parameters, category and auth flag, by category and name."""
    return tools.select(
        "name", "description", tool_category("name").alias("category"),
        tool_params(F.col("input_schema")).alias("params"), requires_auth("name").alias("requires_auth"),
    ).orderBy("category", "name")
