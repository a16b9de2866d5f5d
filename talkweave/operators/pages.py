"""HTML page scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions._util import ColumnLike, as_col, strip
from talkweave.functions.records import collapse_spaces, snippet_around, strip_tags

H1_PATTERN = r"(?s)<h1[^>]*>(.*?)</h1>"


def first_headings(html: ColumnLike, n: int = 5, chars: int = 150) -> Column:
    """K5: texts of the first ``n`` h1 elements, blank ones left out."""
    bodies = F.slice(F.regexp_extract_all(as_col(html), F.lit(H1_PATTERN), F.lit(1)), 1, n)
    texts = F.filter(F.transform(bodies, lambda b: strip(strip_tags(b))), lambda t: t != "")
    return F.transform(texts, lambda t: F.substring(t, 1, chars))


def heading_classes(html: ColumnLike, needle: str = "heading", n: int = 10) -> Column:
    """A10: distinct class attributes holding the needle, in sorted order, at most ``n``."""
    pattern = rf'class="([^"]*{needle}[^"]*)"'
    found = F.array_distinct(F.regexp_extract_all(as_col(html), F.lit(pattern), F.lit(1)))
    return F.slice(F.array_sort(found), 1, n)


def page_scan(pages: DataFrame, needle: str, name: str) -> DataFrame:
    """Headings, classes, context of the first needle and text around a name, per page."""
    context = F.substring(collapse_spaces(strip_tags(snippet_around("html", needle, 300, 500), " ")), 1, 600)
    return pages.select(
        "page_id",
        first_headings("html").alias("headings"),
        heading_classes("html", needle).alias("classes"),
        context.alias("context"),
        F.substring(snippet_around("html", name, 200, 300, ignore_case=True), 1, 500).alias("around_name"),
    )
