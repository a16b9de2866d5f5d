"""JSON text repair, strict parsing and dotted-path access."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from typing import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.functions._util import ColumnLike, as_col, strip

# --- fixed values: repair patterns and their replacements, in order ---------
REPAIRS = (
    (r",\s*([}\]])", "$1"),
    (r'("|\d|true|false|null)\s*\n\s*"', '$1,\n"'),
    (r"([{,]\s*)'([^']+)'\s*:", '$1"$2":'),
    (r":\s*'([^']*)'(\s*[,}])", ': "$1"$2'),
)
OBJECT_PATTERN = r"(\{[\s\S]*\})"
CODE_FENCE = "```"
# --- end of fixed values ----------------------------------------------------

_END = "end-of-text"


def strict_json(text: ColumnLike) -> Column:
    """VARIANT of a complete JSON document, null for anything else.

    The lenient parser stops at the end of the first value, so the text is parsed
    as the first item of a two-item array whose second item is a sentinel: text
    after the value, a missing value or a second value all break that shape.
    """
    raw = as_col(text)
    pair = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{_END}"]')))
    whole = (F.try_variant_get(pair, "$[1]", "string") == _END) & F.try_variant_get(
        pair, "$[2]", "variant"
    ).isNull()
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def is_strict_json(text: ColumnLike) -> Column:
    return strict_json(text).isNotNull()


def repair_json(text: ColumnLike) -> Column:
    """trailing commas, a missing comma at a line end, single-quoted keys and values."""
    out = as_col(text)
    for pattern, replacement in REPAIRS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def safe_json(text: ColumnLike) -> Column:
    """strict parse, then the repaired text, then its widest object repaired; else null."""
    raw = as_col(text)
    widest = F.nullif(F.regexp_extract(raw, OBJECT_PATTERN, 1), F.lit(""))
    return F.coalesce(strict_json(raw), strict_json(repair_json(raw)), strict_json(repair_json(widest)))


def strip_fences(text: ColumnLike) -> Column:
    """F16: drop the first and last line of a fenced text of more than two lines."""
    raw = strip(text)
    lines = F.split(raw, "\n")
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(raw.startswith(CODE_FENCE) & (F.size(lines) > 2), inner).otherwise(raw)


def balanced_ends(text: str) -> Iterator[tuple[int, list[int]]]:
    """Every opening bracket with the closing ones of its kind at equal depth, in order.

    Depth counts one bracket kind and ignores quoting.  Closing positions are
    indexed by depth, so each opening bracket looks up its own ends instead of
    walking the rest of the text.
    """
    starts: list[tuple[int, str, int]] = []
    ends: dict[tuple[str, int], list[int]] = defaultdict(list)
    depth = {"{": 0, "[": 0}
    for pos in (m.start() for m in re.finditer(r"[\[\]{}]", text)):
        ch = text[pos]
        if ch in depth:
            starts.append((pos, ch, depth[ch]))
            depth[ch] += 1
        else:
            kind = "{" if ch == "}" else "["
            depth[kind] -= 1
            ends[kind, depth[kind]].append(pos)
    for pos, kind, level in starts:
        closers = ends[kind, level]
        yield pos, closers[bisect_right(closers, pos):]


_PY_REPAIRS = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", r)) for p, r in REPAIRS]


def _decoder() -> json.JSONDecoder:
    # Non-numbers (NaN, Infinity) are accepted as in Python, and become null.
    return json.JSONDecoder(parse_constant=lambda _: None)


def _loads(text: str):
    return _decoder().decode(text)


def _repaired(text: str) -> str:
    for pattern, replacement in _PY_REPAIRS:
        text = pattern.sub(replacement, text)
    return text


def _loads_repaired(text: str):
    return _loads(_repaired(text))


def _loads_safely(text: str):
    widest = re.search(OBJECT_PATTERN, text)
    attempts = [(_loads, text), (_loads_repaired, text)]
    if widest:
        attempts.append((_loads_repaired, widest.group(1)))
    for load, candidate in attempts:
        try:
            return True, load(candidate)
        except (ValueError, RecursionError):
            continue
    return False, None


class _Spans:
    """Repaired spans of one text; a start from which no longer span can parse is not tried again."""

    def __init__(self, text: str):
        self.text = text
        self.decoder = _decoder()
        self.dead: dict[int, int] = {}  # start -> end from which on every span fails
        self.tried: dict[int, int] = {}  # start -> last end that failed
        self.opens = [m.start() for m in re.finditer(r"\{", text)]
        self.closes = [m.start() for m in re.finditer(r"\}", text)]

    def parsed(self, start: int, end: int) -> tuple[bool, object]:
        if end >= self.dead.get(start, len(self.text)) or self.tried.get(start) == end:
            return False, None
        whole = _repaired(self.text[start : end + 1])
        try:
            return True, self.decoder.decode(whole)
        except RecursionError:
            pass
        except json.JSONDecodeError as error:
            # The span ends with a bracket, so more text can only change what follows the last
            # single quote, close an open string, or go on where the span ended.
            stable = whole.rfind("'")
            if error.pos < (len(whole) if stable < 0 else stable) and not error.msg.startswith("Unterminated"):
                self.dead[start] = end
        except ValueError:
            pass
        self.tried[start] = end
        return False, None

    def widest(self, start: int) -> tuple[int, int] | None:
        """The opening brace of the widest object of spans that begin at ``start``, and the first closing one after it."""
        at = bisect_left(self.opens, start)
        if at == len(self.opens) or self.opens[at] == start:
            return None
        to = bisect_right(self.closes, self.opens[at])
        return (self.opens[at], self.closes[to]) if to < len(self.closes) else None

    def last_close(self, end: int) -> int:
        return self.closes[bisect_right(self.closes, end) - 1]

    def first(self, start: int, ends: list[int]) -> tuple[bool, object]:
        """The value of the first span at ``start`` that parses as it is, repaired, or by its widest object."""
        try:
            value, stop = self.decoder.raw_decode(self.text, start)
        except (ValueError, RecursionError):
            value, stop = None, -1
        widest = self.widest(start)
        at = 0
        while at < len(ends):
            end = ends[at]
            if end == stop - 1:
                return True, value
            found, repaired = self.parsed(start, end)
            if found:
                return True, repaired
            if widest and widest[1] <= end:
                found, repaired = self.parsed(widest[0], self.last_close(end))
                if found:
                    return True, repaired
            at += 1
            if start in self.dead and stop - 1 <= end:
                # Only a widest object is left to find, from its first closing brace on.
                if not widest or self.dead.get(widest[0], len(self.text)) <= end:
                    break
                at = max(at, bisect_left(ends, widest[1]))
        return False, None


def find_json(text: str | None) -> str | None:
    """The JSON text found in free text, null when there is none."""
    if text is None:
        return None
    try:
        return json.dumps(_loads(text), ensure_ascii=False)
    except (ValueError, RecursionError):
        pass
    spans = _Spans(text)
    for start, ends in balanced_ends(text):
        found, value = spans.first(start, ends)
        if found:
            return json.dumps(value, ensure_ascii=False)
    found, value = _loads_safely(text)
    return json.dumps(value, ensure_ascii=False) if found else None


@F.pandas_udf(T.StringType())
def _find_json_udf(texts: pd.Series) -> pd.Series:
    return texts.map(find_json, na_action="ignore")


def extract_json(text: ColumnLike) -> Column:
    """VARIANT found in a model answer.

    Blank text gives ``{}``; hopeless text gives an error object with its first
    200 characters.  Clean documents stay in the JVM: the Python scan receives
    null for them and only works on the rest.
    """
    raw = strip(text)
    clean = strict_json(raw)
    scanned = _find_json_udf(F.when((raw != "") & clean.isNull(), raw))
    error = F.to_json(
        F.struct(F.lit("malformed_json").alias("error"), F.substring(raw, 1, 200).alias("raw"))
    )
    return F.when(raw == "", F.parse_json(F.lit("{}"))).otherwise(
        F.coalesce(clean, F.try_parse_json(scanned), F.try_parse_json(error))
    )


def _json_path(path: str) -> str:
    return "$" + "".join('["' + part.replace('"', '\\"') + '"]' for part in path.split("."))


def get_path(state: ColumnLike, path: str, type_: str = "variant", default: Column | None = None) -> Column:
    """Value at a dotted path of a VARIANT; the default only when a hop is missing."""
    base = as_col(state)
    if not path:
        return F.lit(None).cast(type_) if default is None else default
    value = F.try_variant_get(base, _json_path(path), type_)
    if default is None:
        return value
    present = F.try_variant_get(base, _json_path(path), "variant").isNotNull()
    return F.when(present, value).otherwise(default)


def map_inputs(state: ColumnLike, input_map: dict[str, str]) -> list[Column]:
    """Named arguments projected out of the state."""
    return [get_path(state, path).alias(name) for name, path in input_map.items()]


def map_outputs(state: ColumnLike, output: ColumnLike, output_map: dict[str, str]) -> Column:
    """The state with output paths written at state paths, parents created as needed."""
    tree: dict = {}
    for target, source in output_map.items():
        parts = [p for p in target.split(".") if p]
        if not parts:
            continue
        node = tree
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node[parts[-1]] = get_path(output, source)
    return _write_tree(as_col(state), tree)


def _write_tree(base: Column, tree: dict) -> Column:
    fields = F.coalesce(
        base.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")
    )
    null = F.parse_json(F.lit("null"))
    entries = []
    for key, sub in tree.items():
        value = _write_tree(F.try_element_at(fields, F.lit(key)), sub) if isinstance(sub, dict) else sub
        entries += [F.lit(key), F.coalesce(value, null)]
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*tree))
    return F.to_variant_object(F.map_concat(kept, F.create_map(*entries)))


def py_text(value: Column) -> Column:
    """Text of a VARIANT scalar as Python prints it: True, None, 1.0."""
    text = value.try_cast("string")
    kind = F.schema_of_variant(value)
    return (
        F.when(F.is_variant_null(value), "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.startswith("DECIMAL") & ~text.contains("."), F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


def truthy(value: Column) -> Column:
    """Python truthiness of a VARIANT: null, false, zero and empty values are false."""
    text = value.try_cast("string")
    kind = F.schema_of_variant(value)
    empty = (
        F.is_variant_null(value)
        | ((kind == "BOOLEAN") & (text == "false"))
        | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (text.try_cast("double") == 0))
        | text.isin("", "[]", "{}") & kind.rlike("^(STRING|ARRAY|OBJECT)")
        & ((kind == "STRING") & (text == "") | (kind != "STRING"))
    )
    return value.isNotNull() & ~F.coalesce(empty, F.lit(False))


def check_condition(expr: str | None, state: ColumnLike) -> Column:
    """Always, truthy:p, exists:p, equals:p:v and not_equals:p:v; anything else is false."""
    text = (expr or "always").strip()
    verb, _, rest = text.partition(":")
    if text == "always":
        return F.lit(True)
    if verb == "truthy":
        return truthy(get_path(state, rest))
    if verb == "exists":
        value = get_path(state, rest)
        return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))
    if verb in ("equals", "not_equals") and ":" in rest:
        path, _, expected = rest.partition(":")
        same = F.coalesce(py_text(get_path(state, path)), F.lit("")) == expected
        return same if verb == "equals" else ~same
    return F.lit(False)


def route(transitions: list[dict], state: ColumnLike) -> Column:
    """P10: target of the first transition whose condition holds, else null."""
    branches = [F.when(check_condition(t.get("when"), state), F.lit(t["to"])) for t in transitions]
    return F.coalesce(*branches) if branches else F.lit(None).cast("string")
