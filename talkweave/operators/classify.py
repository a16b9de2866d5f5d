"""Profile-driven classification: schemas, prompts and conformance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.functions._util import ColumnLike, as_col
from talkweave.functions.jsontext import get_path
from talkweave.functions.prompts import CLASSIFY_PROMPT, CLASSIFY_SYSTEM_LINES, fill, json_text

_SPARK_TYPES = {
    "boolean": T.BooleanType(),
    "number": T.DoubleType(),
    "array_enum": T.ArrayType(T.StringType()),
}
_JSON_KINDS = {
    "boolean": "^BOOLEAN$",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "array_enum": "^ARRAY",
}


def _setting(dimension: dict, name: str):
    defaults = {"field_type": "enum", "allowed_values": [], "required": True, "allow_null": False, "description": ""}
    value = dimension.get(name)
    return defaults[name] if value is None else value


def classification_schema(profile: dict) -> tuple[T.StructType, dict]:
    """the result's StructType and its JSON Schema."""
    fields, properties = [], {}
    for d in profile["dimensions"]:
        kind, allowed = _setting(d, "field_type"), list(_setting(d, "allowed_values"))
        fields.append(T.StructField(d["name"], _SPARK_TYPES.get(kind, T.StringType())))
        shape: dict = {"type": {"boolean": "boolean", "number": "number", "array_enum": "array"}.get(kind, "string")}
        if kind == "array_enum":
            shape["items"] = {"type": "string", "enum": allowed}
        elif kind == "enum":
            shape["enum"] = allowed
        shape["description"] = _setting(d, "description")
        properties[d["name"]] = {"anyOf": [shape, {"type": "null"}]} if _setting(d, "allow_null") else shape
    required = [d["name"] for d in profile["dimensions"] if _setting(d, "required")]
    return T.StructType(fields), {
        "type": "object", "properties": properties, "required": required, "additionalProperties": False,
    }


def system_prompt(profile: dict) -> str:
    """the instruction text of a profile."""
    out = list(CLASSIFY_SYSTEM_LINES)
    if profile.get("description"):
        out.append(f"Profile: {profile['description']}")
    out += [f"Instruction {i}: {t}" for i, t in enumerate(profile.get("instructions") or [], 1)]
    out.append("Dimensions:")
    for d in profile["dimensions"]:
        line = [f"- {d['name']} ({_setting(d, 'field_type')})", _setting(d, "description")]
        if _setting(d, "allowed_values"):
            line.append(f"Allowed values: {', '.join(d['allowed_values'])}.")
        if _setting(d, "allow_null"):
            line.append("Return null if the value cannot be inferred confidently.")
        if not _setting(d, "required"):
            line.append("This field is optional.")
        out.append(" ".join(line))
    return "\n".join(out)


def classification_prompt(profile: dict, conversation: ColumnLike, context: dict[str, ColumnLike]) -> Column:
    """the user prompt; null context fields are left out."""

    def quoted(c: Column) -> Column:
        text = F.to_json(F.array(c))
        return F.substring(text, 2, F.length(text) - 2)

    pairs = [
        F.when(as_col(v).isNotNull(), F.concat(F.lit(f'  "{name}": '), quoted(as_col(v).cast("string"))))
        for name, v in context.items()
    ]
    lines = F.array_join(F.array_compact(F.array(*pairs)), ",\n") if pairs else F.lit("")
    as_json = F.when(lines == "", "{}").otherwise(F.concat(F.lit("{\n"), lines, F.lit("\n}")))
    schema = json_text(classification_schema(profile)[1], indent=2)
    return fill(CLASSIFY_PROMPT, schema=schema, conversation=as_col(conversation), context=as_json)


def violations(result: ColumnLike, profile: dict) -> Column:
    """broken rules of a result VARIANT as ``rule:field`` texts."""
    value = as_col(result)
    names = [d["name"] for d in profile["dimensions"]]
    found = []
    for d in profile["dimensions"]:
        name, kind = d["name"], _setting(d, "field_type")
        item = get_path(value, name)
        allowed = list(_setting(d, "allowed_values"))
        is_null = F.is_variant_null(item)
        typed = F.schema_of_variant(item).rlike(_JSON_KINDS.get(kind, "^STRING$"))
        if kind == "enum":
            listed = item.try_cast("string").isin(*allowed)
        elif kind == "array_enum":
            listed = F.forall(item.try_cast("array<string>"), lambda x: x.isin(*allowed))
        else:
            listed = F.lit(True)
        found.append(
            F.when(item.isNull(), F.lit(f"missing:{name}") if _setting(d, "required") else F.lit(None))
            .when(is_null, F.lit(None) if _setting(d, "allow_null") else F.lit(f"null:{name}"))
            .when(~typed, f"type:{name}")
            .when(~listed, f"enum:{name}")
        )
    keys = F.map_keys(value.try_cast("map<string,variant>"))
    extra = F.transform(
        F.array_sort(F.array_except(keys, F.array(*[F.lit(n) for n in names]))),
        lambda k: F.concat(F.lit("extra:"), k),
    )
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(~F.coalesce(is_object, F.lit(False)), F.array(F.lit("not_an_object"))).otherwise(
        F.concat(F.array_compact(F.array(*found)), extra)
    )


def check_classification(df: DataFrame, profile: dict, result: str = "result") -> DataFrame:
    """adds the ``violations`` array; empty means the result conforms."""
    return df.withColumn("violations", violations(result, profile))
