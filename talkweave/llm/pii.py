"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap the contract's base spans.  Boosted trees score
every candidate by its format and context, but not by what defines a base span (plus sign, check sum,
number ranges), so candidates that look like known personal data score high as well.  The threshold is the lowest score
whose precision over all held-out candidates (a hash fold of the whole table) reaches a target.  Base spans always stay.

Null text counts as empty; repeated rows are reported as often as they occur; other columns are not read.
With no candidates, or candidates of one label only, no span is added.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import saved, table
from talkweave.llm.spans import Rule, addressed, find_spans, joined_back, per_blob

LABELLED_ROWS = 20_000
CONTEXT = 24
FEATURES = ("digits", "spaces", "dots", "dashes", "brackets", "letters", "size", "groups", "after_word", "after_digit", "hint", "mail")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(m: Column) -> Column:
    """Check sum of the digits: every second digit from the right doubled, nines cast out."""
    rev = F.split(F.reverse(digits_of(m)), "")
    doubled = F.transform(
        rev, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).otherwise(d.cast("int")).cast("int")
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def digits_between(m: Column, low: int, high: int) -> Column:
    return F.length(digits_of(m)).between(low, high)


# --- fixed values: base patterns of the contract -----------------------------------
# Written so that no run of characters is read again from each of its places: a match can only begin
# where a run begins or where the last match ended, and loops do not backtrack.
LOCAL = "A-Za-z0-9._%+-"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
BASE = [
    Rule("email", 1, rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Rule(
        "ip", 1, r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    ),
    Rule("card", 1, r"[0-9](?:[\x20-]?[0-9])++", lambda m: digits_between(m, 16, 19) & luhn(m)),
    Rule("phone", 1, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: digits_between(m, 8, 15)),
]
GENERATORS = [
    Rule("digits", 1, r"[0-9](?:[\x20().-]{0,2}+[0-9]){7,}+", base=False),
    Rule("mailish", 1, r"(?:(?<![^\x20\x09-\x0D@])|\G)[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++", base=False),
]
HINT = r"(?i)(tel|phone|call|mobile|fax|mail|contact|card|visa|account|iban|address)"


def features(candidates: DataFrame) -> DataFrame:
    """Format of the match and its left context as numbers."""

    def count(pattern: str) -> Column:
        return (F.length("hit") - F.length(F.regexp_replace("hit", pattern, ""))).cast("double")

    values = {
        "digits": count("[0-9]"), "spaces": count(r"\x20"), "dots": count(r"\."), "dashes": count("-"),
        "brackets": count("[()]"), "letters": count("[A-Za-z]"), "size": (F.col("end") - F.col("start")).cast("double"),
        "groups": F.size(F.split("hit", "[^0-9A-Za-z]+")).cast("double"),
        "after_word": F.col("before").rlike(r"[A-Za-z]\x20?$").cast("double"),
        "after_digit": F.col("before").rlike("[0-9]$").cast("double"),
        "hint": F.col("before").rlike(HINT).cast("double"), "mail": (F.col("rule") == "mailish").cast("double"),
    }
    return candidates.select("*", *[v.alias(n) for n, v in values.items()])


def folds(rows: DataFrame, labelled_rows: int) -> tuple[DataFrame, DataFrame]:
    """(label, vector) to fit on, at most ``labelled_rows`` in hash order, and all of those held out, a quarter by hash."""
    hashed = rows.select("label", "vector", F.xxhash64("blob", "start", "end").alias("h"))
    fit = hashed.filter("h % 4 != 0").orderBy("h", "label").limit(labelled_rows)
    return fit.select("label", "vector"), hashed.filter("h % 4 = 0").select("label", "vector")


def likely_spans(
    candidates: DataFrame, base: DataFrame, precision: float = 0.98, labelled_rows: int = LABELLED_ROWS
) -> DataFrame:
    """Candidates that overlap no base span and score above the calibrated threshold.

    The trees are fitted on at most ``labelled_rows`` candidates, taken in hash order; the threshold covers
    every candidate of the fold that is kept from fitting.
    """
    known = base.groupBy("blob").agg(F.collect_list(F.struct("start", "end")).alias("known"))
    overlaps = F.exists("known", lambda k: (k["start"] < F.col("end")) & (k["end"] > F.col("start")))
    marked = features(
        candidates.join(known, "blob", "left")
        .withColumn("label", F.coalesce(overlaps, F.lit(False)).cast("double"))
        .drop("known")
    )
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(marked)
    sample, held_out = folds(rows, labelled_rows)
    sample = saved(sample, "pii-sample")
    if sample.select("label").distinct().count() < 2:
        return candidates.limit(0)
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=12, maxDepth=4, seed=8).fit(sample)

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("score", vector_to_array("probability")[1])

    # Precision at each cut of the whole held-out fold, a table of at most 101 rows.
    cuts = (
        scored(held_out).groupBy(F.floor(F.col("score") * 100).alias("cut"))
        .agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("cut")).collect()
    )
    good = total = 0.0
    threshold = None
    for row in cuts:
        good, total = good + row["good"], total + row["n"]
        if good >= precision * total:
            threshold = row["cut"] / 100
    if threshold is None:
        return candidates.limit(0)
    chosen = scored(rows.filter("label = 0")).filter(F.col("score") >= threshold)
    return chosen.select(*candidates.columns)


@register("op8_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = BASE + GENERATORS
    blobs = addressed(docs, "doc_id", "text").select("blob", "text").dropDuplicates(["blob"])
    found = saved(find_spans(blobs, rules, context=CONTEXT), "pii")
    base = found.filter(F.col("rule").isin([r.name for r in BASE]))
    extra = likely_spans(found.filter(~F.col("rule").isin([r.name for r in BASE])), base)
    spans = per_blob(base.unionByName(extra), rules, by_kind=True)
    return joined_back(
        addressed(docs, "doc_id", "text").select("path", "blob"), spans, [r.name for r in BASE], "doc_id"
    )
