"""Pattern spans with code-point offsets, found by JVM expressions only.

Texts are content-addressed first, so equal texts are read by the rules once, and findings are
joined back to every row that holds the text.  ``split`` gives the gaps between the matches that
``regexp_extract_all`` returns; running sums of both lengths are the offsets.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm.common import whole

SALTS = 256  # parts that the rows of one text are dealt over

class Rule(NamedTuple):
    """A named, versioned pattern; ``keep`` judges a whole match, ``base`` marks contract kinds."""

    name: str
    version: int
    pattern: str
    keep: Callable[[Column], Column] | None = None
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def addressed(rows: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob, text): the content address of each row's text; null counts as empty."""
    content = whole(F.col(text))
    return rows.select(F.col(path).alias("path"), F.sha2(content, 256).alias("blob"), content.alias("text"))


def find_spans(texts: DataFrame, rules: list[Rule], due: Column | None = None, context: int = 0) -> DataFrame:
    """(blob, rule, version, start, end) of every kept match in ``texts`` (blob, text).

    Matches of a rule are leftmost and do not overlap; ends are exclusive.  ``due`` is an array of
    rule keys to run on the row (default: all).  With ``context`` there are two more columns for
    features: ``hit`` (the match) and ``before`` (so many characters in front of it).
    """

    def found(rule: Rule) -> Column:
        gaps = F.transform(
            F.split(F.col("text"), rule.pattern, -1),
            lambda g: F.struct(
                F.length(g).alias("size"), (F.right(g, F.lit(context)) if context else F.lit("")).alias("tail")
            ),
        )
        hits = F.transform(
            F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)),
            lambda m: F.struct(
                F.length(m).alias("size"), (rule.keep(m) if rule.keep else F.lit(True)).alias("kept"),
                (m if context else F.lit("")).alias("match"),
            ),
        )
        entry = F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), gaps.alias("gaps"), hits.alias("hits")
        )
        wanted = F.col("text").rlike(rule.pattern)
        return F.when(wanted if due is None else F.array_contains(due, rule.key) & wanted, entry)

    per_rule = texts.select("blob", F.explode(F.array(*[found(r) for r in rules])).alias("f")).filter("f IS NOT NULL")
    hits = per_rule.select(
        "blob", "f.rule", "f.version", F.posexplode(F.arrays_zip("f.gaps", "f.hits")).alias("pos", "h")
    ).filter("h.hits IS NOT NULL")
    upto = Window.partitionBy("blob", "rule", "version").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("h.hits.size").cast("long")
    return (
        hits.select(
            "blob", "rule", "version", "pos", size.alias("size"), F.col("h.hits.kept").alias("kept"),
            (size + F.col("h.gaps.size")).alias("step"), F.col("h.hits.match").alias("hit"), F.col("h.gaps.tail").alias("before"),
        )
        .withColumn("end", F.sum("step").over(upto))
        .filter("kept")
        .select(
            "blob", "rule", "version", (F.col("end") - F.col("size")).alias("start"), "end",
            *(["hit", "before"] if context else []),
        )
    )


def spelled(spans: Column) -> Column:
    """'kind:start:end' of (.., rule, start, end) structs, joined by commas in the given order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def per_blob(findings: DataFrame, rules: list[Rule], by_kind: bool) -> DataFrame:
    """One row per text with findings: counts of the base kinds, the digest of their spans, and all spans.

    Spans are ordered by kind and start (``by_kind``) or by start and kind, kinds in the order of ``rules``.
    """
    place = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(i)) for i, r in enumerate(rules)])
    order = (place.alias("place"), "start") if by_kind else ("start", place.alias("place"))
    bases = [r.name for r in rules if r.base]
    listed = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(*order, "rule", "end"))).alias("all"))
    base = F.filter("all", lambda s: s["rule"].isin(bases))

    def count(name: str) -> Column:
        return F.size(F.filter("all", lambda s: s["rule"] == name)).cast("long").alias(f"n_{name}")

    return listed.select(
        "blob",
        *[count(n) for n in bases],
        spelled(base).alias("base"), spelled(F.col("all")).alias("spans"),
    )


def joined_back(paths: DataFrame, found: DataFrame, bases: list[str], id_name: str) -> DataFrame:
    """Findings for every path: one row per row of ``paths`` (path, blob), with zeros where nothing was found.

    A text that many paths hold is dealt over ``SALTS`` parts by path; its findings are sent once to
    each part that has rows, so never more often than it has rows.
    """
    dealt = paths.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    parts = dealt.select("blob", "part").distinct().join(found, "blob")
    return dealt.join(parts, ["blob", "part"], "left").select(
        F.col("path").alias(id_name),
        *[F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}") for n in bases],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
