"""Small shared helpers for column functions."""

from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Union[Column, str]


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small literal map, null when absent."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def blank_to_null(value: ColumnLike) -> Column:
    """Empty string (not blanks) becomes null, as an empty value does in ``a or b``."""
    return F.nullif(as_col(value), F.lit(""))


def first_filled(*values: ColumnLike) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


# Characters Python's ``str.strip`` removes.
PY_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: ColumnLike) -> Column:
    """Both ends without Unicode white space."""
    return F.trim(as_col(value), F.lit(PY_SPACE))


def rstrip(value: ColumnLike) -> Column:
    return F.rtrim(as_col(value), F.lit(PY_SPACE))


def text_or_blank(value: ColumnLike) -> Column:
    """Null becomes ''."""
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def bind(values: dict[str, Column], body) -> Column:
    """``body`` over named intermediate values that are computed once per row.

    A column expression has no local variables: a value used in several places is
    spelled out, and computed, in each.  A one-element ``transform`` gives it a name.
    """
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return F.element_at(F.transform(F.array(row), lambda r: body({n: r[n] for n in values})), 1)
