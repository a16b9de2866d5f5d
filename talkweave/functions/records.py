"""Record-level functions: profiles, due dates, defaults, maps and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions._util import ColumnLike, as_col, bind, blank_to_null, rstrip, strip
from talkweave.functions.jsontext import get_path

# --- fixed values: profile and task defaults --------------------------------
DEFAULT_PROFILE = {
    "name": "Student",
    "email": None,
    "class": "Class_10",
    "board": "CBSE",
    "medium": "English",
    "institute_type": "School",
    "institute_name": "N/A",
    "learning_preferences": "Standard learning style",
    "learning_goal": "conceptual understanding",
    "chapter_name": "N/A",
    "topic": "N/A",
}
TASK_DEFAULTS = {"status": "todo", "source": "agent", "priority": "medium"}
TASK_LISTS = ("tags", "dependentTaskIds", "connectedTaskIds", "attachments")
SECRET_KEYS = ("password", "token", "secret")
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# --- end of fixed values ----------------------------------------------------


def parse_profile(row: dict[str, Column]) -> dict[str, Column]:
    """profile fields of one student record.

    ``row`` holds the sheet's columns; a column the sheet lacks is left out.
    """

    def cell(name: str, default: str | None = None) -> Column:
        return row.get(name, F.lit(default).cast("string"))

    course = cell("Class/Course", "10")
    number = strip(F.replace(F.replace(course, F.lit("Class_"), F.lit("")), F.lit("Class"), F.lit("")))
    number = F.when(number.rlike("^[0-9]+$"), number).otherwise("10")
    institute = cell("Institute_Type", "School")
    is_school = F.lower(institute) == "school"
    preferences = F.coalesce(
        blank_to_null(cell("Learning_Preferences")),
        cell("Learning_Prefrences", DEFAULT_PROFILE["learning_preferences"]),
    )
    return {
        "name": cell("Name", "Student"),
        "email": cell("Email"),
        "class": F.concat(F.lit("Class_"), number),
        "board": F.when(is_school, cell("Board", "CBSE")),
        "medium": cell("Medium", "English"),
        "institute_type": institute,
        "institute_name": cell("Institute_Name", "N/A"),
        "learning_preferences": preferences,
        "learning_goal": F.lit(DEFAULT_PROFILE["learning_goal"]),
        "chapter_name": F.lit("N/A"),
        "topic": F.lit("N/A"),
        "course": F.when(~is_school, course),
    }


def _valid_date(year: Column, month: Column, day: Column) -> Column:
    """Date of the parts, null when there is no such day."""
    first = F.make_date(year, month, F.lit(1))
    return F.when(day.between(1, F.day(F.last_day(first))), F.date_add(first, day - 1))


def resolve_due_date(text: ColumnLike, anchor: ColumnLike) -> Column:
    """DATE meant by a text relative to an anchor date, null without a hint.

    Tried in order: ISO date, tomorrow/today, "in n days|weeks", end of month, "next <weekday>",
    "<month> <day>[, year]", "<day>st|nd|rd|th".  A past month-day moves to the next year and a
    past or missing day to the next month that has it.
    """
    spelled = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
    month_day = rf"\b({spelled}) (\d{{1,2}})(?:st|nd|rd|th)?\b(?:,? (\d{{4}})\b)?"

    def found(low: Column, pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(low, pattern, group), F.lit(""))

    def number(low: Column, pattern: str, group: int = 1) -> Column:
        return found(low, pattern, group).try_cast("int")

    def position(names: tuple[str, ...], name: Column) -> Column:
        return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), name).cast("int"), F.lit(0))

    def parts(v: dict[str, Column]) -> dict[str, Column]:
        low = v["low"]
        return {
            "day0": v["day0"],
            "direct": F.coalesce(
                F.try_to_date(found(low, r"\b(\d{4}-\d{2}-\d{2})\b"), "yyyy-MM-dd"),
                F.when(low.rlike(r"\btomorrow\b"), F.date_add(v["day0"], 1)),
                F.when(low.rlike(r"\btoday\b"), v["day0"]),
                F.date_add(v["day0"], number(low, r"\bin (\d{1,4}) days?\b")),
                F.date_add(v["day0"], number(low, r"\bin (\d{1,3}) weeks?\b") * 7),
                F.when(low.rlike(r"\bend of (the )?month\b"), F.last_day(v["day0"])),
            ),
            "weekday": position(WEEKDAYS, found(low, rf"\bnext ({'|'.join(WEEKDAYS)})\b")),
            "month": position(tuple(m[:3] for m in MONTHS), F.substring(found(low, month_day, 1), 1, 3)),
            "day": number(low, month_day, 2),
            "year": number(low, month_day, 3),
            "ordinal": number(low, r"\b(\d{1,2})(?:st|nd|rd|th)\b"),
        }

    def choose(v: dict[str, Column]) -> Column:
        day0 = v["day0"]
        # First such weekday strictly after the day.
        ahead = (F.pmod(v["weekday"] - 2 - F.weekday(day0), F.lit(7)) + 1).cast("int")
        years = F.when(v["year"].isNotNull(), F.array(v["year"])).otherwise(
            F.array(F.year(day0), F.year(day0) + 1)
        )
        dated = F.transform(years, lambda y: _valid_date(y, v["month"], v["day"]))
        by_month = F.filter(dated, lambda x: (x >= day0) | v["year"].isNotNull())
        months = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.add_months(F.trunc(day0, "month"), i))
        days = F.transform(months, lambda m: _valid_date(F.year(m), F.month(m), v["ordinal"]))
        by_day = F.filter(days, lambda x: x >= day0)
        return F.coalesce(
            v["direct"],
            F.date_add(day0, ahead),
            F.when(v["month"].isNotNull(), F.try_element_at(by_month, F.lit(1))),
            F.when(v["month"].isNull(), F.try_element_at(by_day, F.lit(1))),
        )

    base = {"low": F.lower(as_col(text)), "day0": as_col(anchor).cast("date")}
    return bind(base, lambda v: bind(parts(v), choose))


def task_defaults(row: dict[str, Column], user_id: Column, agent_id: str) -> dict[str, Column]:
    """the fields of a formal task with unset ones filled in."""
    out = dict(row)
    filled = {**{k: F.lit(v) for k, v in TASK_DEFAULTS.items()},
              "requesterId": user_id, "sourceAgentId": F.lit(agent_id)}
    for name, value in filled.items():
        out[name] = F.coalesce(blank_to_null(row[name]), value) if name in row else value
    for name in TASK_LISTS:
        empty = F.array().cast("array<string>")
        out[name] = F.coalesce(row[name], empty) if name in row else empty
    return out


def merge_context(defaults: ColumnLike, context: ColumnLike) -> Column:
    """Union of two maps in which the right one wins; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(as_col(defaults), empty), F.coalesce(as_col(context), empty)
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def redact_context(context: ColumnLike, keys=SECRET_KEYS) -> Column:
    """P12."""
    return F.map_filter(as_col(context), lambda k, _: ~k.isin(*keys))


def missing_args(arguments_json: ColumnLike, required: ColumnLike) -> Column:
    """Required keys absent from a JSON object."""
    given = F.coalesce(F.json_object_keys(as_col(arguments_json)), F.array().cast("array<string>"))
    return F.array_except(F.coalesce(as_col(required), F.array().cast("array<string>")), given)


def decision_kind(decision: ColumnLike) -> Column:
    """struct(kind, tool_name, arguments) of a decision VARIANT."""
    raw = F.lower(strip(F.coalesce(get_path(decision, "type", "string"), F.lit(""))))
    kind = F.when(raw.isin("tool_call", "final_answer"), raw).otherwise("invalid")
    is_call = kind == "tool_call"
    return F.struct(
        kind.alias("kind"),
        F.when(is_call, strip(F.coalesce(get_path(decision, "tool_name", "string"), F.lit("")))).alias(
            "tool_name"
        ),
        F.when(is_call, F.coalesce(get_path(decision, "arguments", "string"), F.lit("{}"))).alias(
            "arguments"
        ),
    )


def _boolean(result: ColumnLike, path: str) -> Column:
    """A JSON boolean; other values, such as "yes", give null."""
    value = get_path(result, path)
    return F.when(F.schema_of_variant(value) == "BOOLEAN", value.try_cast("boolean"))


def ticket_draft(result: ColumnLike) -> list[Column]:
    """the four ticket fields of a classification result."""
    return [
        _boolean(result, "needs_ticket").alias("needs_ticket"),
        *[
            get_path(result, name, "string").alias(name)
            for name in ("ticket_queue", "ticket_title", "ticket_summary")
        ],
    ]


def ticket_rules(result: ColumnLike) -> Column:
    """names of the broken rules."""
    needs = _boolean(result, "needs_ticket")
    queue = get_path(result, "ticket_queue", "string")
    confidence = get_path(result, "confidence", "double")
    return F.array_compact(
        F.array(
            F.when(needs == (queue == "no_ticket"), "queue_disagrees"),
            F.when(~confidence.between(0.0, 1.0), "confidence_out_of_range"),
        )
    )


def clip_block(text: ColumnLike, note: ColumnLike, limit: int | None = None) -> Column:
    """struct(block, chars_extracted, note); with a limit a longer text is cut and marked."""
    if limit is None:
        whole = as_col(text)
        return F.struct(whole.alias("block"), F.length(whole).cast("long").alias("chars_extracted"), as_col(note).alias("note"))

    def clip(v: dict[str, Column]) -> Column:
        block, label = v["block"], v["label"]
        fits = F.length(block) <= limit
        cut = F.when(fits, block).otherwise(rstrip(F.substring(block, 1, limit)))
        mark = F.lit(f"\n\n[Attachment text truncated at {limit} characters]")
        return F.struct(
            F.when(fits, block).otherwise(F.concat(cut, mark)).alias("block"),
            F.length(cut).cast("long").alias("chars_extracted"),
            F.when(fits, label).otherwise(F.concat(label, F.lit(f"; truncated at {limit} characters"))).alias("note"),
        )

    return bind({"block": as_col(text), "label": as_col(note)}, clip)


def strip_tags(html: ColumnLike, replacement: str = "") -> Column:
    """tags out."""
    return F.regexp_replace(as_col(html), "<[^>]+>", replacement)


def collapse_spaces(text: ColumnLike) -> Column:
    return F.regexp_replace(as_col(text), r"(?U)\s+", " ")


def snippet_around(
    text: ColumnLike, needle: str, before: int, after: int, ignore_case: bool = False
) -> Column:
    """text around the first occurrence; null when absent or at the very start."""
    raw = as_col(text)
    hay = F.lower(raw) if ignore_case else raw
    found = F.instr(hay, F.lit(needle.lower() if ignore_case else needle)) - 1
    start = F.greatest(found - before, F.lit(0))
    return F.when(found > 0, F.substring(raw, start + 1, found + after - start))
