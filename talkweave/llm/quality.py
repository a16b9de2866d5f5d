"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per
rule.  A policy is a named version, a mask of bits, so a new version or an ablation is bit arithmetic on the
stored ledger and never reads a text again.

Null, empty and wordless texts have no words and fail ``few_words``; null ids and repeated rows keep their rows,
each judged by itself; an empty table gives an empty ledger; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions._util import bind
from talkweave.llm import register
from talkweave.llm.common import WORD, saved, table, whole, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
# Rule name -> failure condition over the measurements; the place in the list is the bit.
FAILS: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 50 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "100 * n_upper > 60 * word_chars"),
    ("long_words", "word_chars > 40 * n_words"),
]
BASE = ("few_words", "repeated")
# The second version lets headings in capitals and long tokens (code, languages without spaces) pass.
POLICIES = {
    "v1": ("few_words", "repeated", "symbols", "dup_lines", "shouting", "long_words"),
    "v2": ("few_words", "repeated", "symbols", "dup_lines"),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, (name, _) in enumerate(FAILS) if name in rules)


def repeated_words(tokens: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more in the array, the first included.

    Windows are compared by a 64-bit hash.  Texts without a repeated window stop at the hash set.
    """

    def positions(hashes: Column) -> Column:
        # Equal hashes are neighbours once sorted; what is left are the starts of repeated windows.
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(
            {"p": pairs},
            lambda v: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            v["p"],
                            lambda x, i: F.struct(
                                x["i"].alias("i"),
                                (
                                    F.coalesce(F.get(v["p"], i - 1)["h"] == x["h"], F.lit(False))
                                    | F.coalesce(F.get(v["p"], i + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(starts: Column) -> Column:
        return bind(
            {"s": starts},
            lambda v: F.aggregate(
                F.transform(v["s"], lambda x, i: F.least(F.lit(size), F.coalesce(F.get(v["s"], i + 1) - x, F.lit(size)))),
                F.lit(0), lambda a, x: a + x,
            ),
        )

    def of(v: dict[str, Column]) -> Column:
        return F.when(F.size(F.array_distinct(v["h"])) == F.size(v["h"]), F.lit(0)).otherwise(covered(positions(v["h"])))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))

    return bind({"w": tokens}, lambda v: F.when(F.size(v["w"]) <= size, F.lit(0)).otherwise(bind({"h": hashes(v["w"])}, of)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of every rule; null text has no words and no lines."""
    body = whole(F.col(text))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))

    def facts(v: dict[str, Column]) -> Column:
        return F.struct(
            F.size(v["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(v["w"], "")).cast("long").alias("word_chars"),
            (F.length(v["t"]) - F.length(F.regexp_replace(v["t"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(v["l"]).cast("long").alias("n_lines"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
            repeated_words(v["w"]).cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(v["t"], "[^A-Z]+", "")).cast("long").alias("n_upper"),
        )

    return docs.withColumn("_facts", bind({"t": body, "w": words(F.col(text)), "l": lines}, facts))


def ledger(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, measurements, failed): one row per document, with bit i set where rule i fails."""
    facts = measured(docs.select(key, text), text).select(key, "_facts.*")
    bits = F.lit(0)
    for i, (_, condition) in enumerate(FAILS):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)))
    return facts.withColumn("failed", bits)


def passes(policy: str = "v1") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def sole_rule(policy: str = "v1") -> Column:
    """The rule without which a ledger row would pass a policy; null if none or more than one rule fails."""
    bits = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])))
    return F.coalesce(*[F.when(bits == 1 << i, F.lit(name)) for i, (name, _) in enumerate(FAILS)])


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, fails, only): documents each rule of a policy fails, and those it alone keeps out.

    One aggregate by failure bits (at most two to the number of rules), then bit arithmetic.
    """
    used = mask(POLICIES[policy])
    by_bits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(used)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << i).alias("bit")) for i, (name, _) in enumerate(FAILS) if used >> i & 1
    ])
    return by_bits.select("bits", "n", F.explode(each).alias("r")).groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only"),
    )


@register("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger under both policy versions, with the rule that alone keeps a document out and how many it keeps out."""
    rows = saved(ledger(table(spark, folder, "documents"), "doc_id"), "quality-ledger")
    # One row per rule, whatever the table.
    effect = F.broadcast(ablations(rows).select(F.col("rule").alias("sole_rule"), F.col("only").alias("sole_docs")))
    return rows.withColumn("sole_rule", sole_rule()).join(effect, "sole_rule", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"), passes().alias("kept"), "failed",
        "n_lines", "n_upper", passes("v2").alias("kept_v2"), "sole_rule", "sole_docs",
    )
