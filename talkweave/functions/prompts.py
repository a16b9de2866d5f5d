"""Text blocks that feed a model: contexts, prompts, banners and templates."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions._util import ColumnLike, as_col, first_filled, strip

# --- fixed values: wording of the generated texts ---------------------------
RAG_PROMPT = (
    "Use the retrieved context to answer the question clearly and directly.\n"
    "If context is empty, answer using your own knowledge.\n\n"
    "Question: {query}\n\n"
    "{retrieved_context}\n"
)
CONTEXT_HEADER = "Retrieved context:"
CONTEXT_EMPTY = "Retrieved context: (none)\n"
MEMORY_START = "--- Conversation Memory ---"
MEMORY_END = "--- End Memory ---"
ATTACHED_START = "--- Attached content ---"
ATTACHED_END = "--- End of attached content ---"
EXTRACT_PROMPT = (
    "Extract structured data from the text below.\n"
    "Return JSON that matches this schema description:\n"
    "{schema}\n\n"
    "Text:\n{text}"
)
IMAGE_PROMPT = (
    "Create JSON for an educational image based on the text below.\n"
    "Return ONLY valid JSON with these keys:\n"
    "- image_description\n"
    "- image_caption\n"
    "- image_generation_prompt\n\n"
    "Topic: {topic}\n"
    "Level: {level}\n"
    "Board: {board}\n\n"
    "Text:\n{text}"
)
CLASSIFY_SYSTEM_LINES = (
    "You classify customer conversations into structured workflow fields.",
    "Return only valid JSON.",
    "Use only the allowed values for enum fields.",
    "If a nullable field is unknown, return null.",
)
CLASSIFY_PROMPT = (
    "Classify the following conversation according to the configured dimensions.\n"
    "Return JSON matching this schema exactly.\n\n"
    "Schema:\n{schema}\n\n"
    "Conversation:\n{conversation}\n\n"
    "Additional context JSON:\n{context}"
)
DATE_LINE = (
    "[System: Today's date is {date} (UTC). "
    "Use this as the anchor for all relative date calculations.]\n\n"
)
NO_ANSWER = "I could not complete the task."
# --- end of fixed values ----------------------------------------------------


def fill(template: str, **parts: Column | str) -> Column:
    """Concatenate a template with columns put in place of its ``{name}`` marks."""
    pieces: list[Column] = []
    rest = template
    while rest:
        before, mark, tail = rest.partition("{")
        if before:
            pieces.append(F.lit(before))
        if not mark:
            break
        name, _, rest = tail.partition("}")
        value = parts[name]
        pieces.append(F.lit(value) if isinstance(value, str) else F.coalesce(value, F.lit("")))
    return F.concat(*pieces)


def build_prompt(query: ColumnLike, context: ColumnLike, memory: ColumnLike | None = None) -> Column:
    """Memory text, when there is any, and the question with its context."""
    body = fill(RAG_PROMPT, query=as_col(query), retrieved_context=as_col(context))
    if memory is None:
        return body
    return F.concat_ws("\n\n", F.nullif(as_col(memory), F.lit("")), body)


def extract_prompt(text: ColumnLike, schema: str) -> Column:
    """F37."""
    return fill(EXTRACT_PROMPT, schema=schema, text=as_col(text))


def image_metadata_prompt(
    text: ColumnLike, topic: ColumnLike, level: ColumnLike, board: ColumnLike
) -> Column:
    """F37."""
    return fill(
        IMAGE_PROMPT,
        topic=F.coalesce(F.nullif(as_col(topic), F.lit("")), F.lit("General")),
        level=F.coalesce(F.nullif(as_col(level), F.lit("")), F.lit("N/A")),
        board=F.coalesce(F.nullif(as_col(board), F.lit("")), F.lit("N/A")),
        text=as_col(text),
    )


def render_template(text: ColumnLike, values: dict[str, ColumnLike]) -> Column:
    """F32 with a fixed key set: ``{{ key }}`` marks are filled, unknown keys give ''.

    The text is cut at its marks once, so a filled-in value is never filled again.
    """
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), as_col(v).cast("string"))])
    return render_with_map(text, table)


def render_with_map(text: ColumnLike, context: ColumnLike) -> Column:
    """F32 with the keys in a MAP<STRING,STRING> column."""
    mark = r"\{\{\s*([a-zA-Z0-9_]+)\s*\}\}"
    raw = as_col(text)
    fixed = F.split(raw, mark)
    keys = F.regexp_extract_all(raw, F.lit(mark), F.lit(1))
    filled = F.transform(
        keys, lambda k: F.coalesce(F.try_element_at(as_col(context), k), F.lit(""))
    )
    parts = F.transform(
        F.arrays_zip(fixed.alias("fixed"), filled.alias("value")),
        lambda p: F.concat(F.coalesce(p["fixed"], F.lit("")), F.coalesce(p["value"], F.lit(""))),
    )
    return F.array_join(parts, "")


def date_banner(prompt: ColumnLike, at: ColumnLike) -> Column:
    """a weekday and date line in front; a blank prompt stays as it is."""
    text = as_col(prompt)
    line = fill(DATE_LINE, date=F.date_format(as_col(at), "EEEE, dd MMMM yyyy"))
    return F.when(text != "", F.concat(line, text)).otherwise(text)


def json_text(value, indent: int | None = None) -> str:
    return json.dumps(value, ensure_ascii=False, indent=indent)


def final_output(text: ColumnLike, mode: ColumnLike, formatted: ColumnLike, has_schema: ColumnLike,
                 failed: ColumnLike) -> Column:
    """struct(text, json) of a finished run.

    ``formatted`` is the JSON text a formatting step returned, ``failed`` tells
    that this step raised.
    """
    answer = strip(F.coalesce(as_col(text), F.lit("")))
    answer = F.when(answer == "", NO_ANSWER).otherwise(answer)
    is_json = as_col(mode) == "json"
    plain = F.to_json(F.struct(answer.alias("result")))
    broken = F.to_json(
        F.struct(F.lit("formatting_failed").alias("error"), answer.alias("text_fallback"))
    )
    payload = (
        F.when(~as_col(has_schema), plain).when(as_col(failed), broken).otherwise(as_col(formatted))
    )
    return F.struct(
        F.when(as_col(mode) == "text", answer).alias("text"), F.when(is_json, payload).alias("json")
    )


def topic_of(metadata: ColumnLike) -> Column:
    m = as_col(metadata)
    return first_filled(
        F.try_element_at(m, F.lit("topic_name")), F.try_element_at(m, F.lit("chapter_name"))
    )
