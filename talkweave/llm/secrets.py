"""Secret scan over an incremental ledger of content-addressed texts.

Every version of a file is addressed by the hash of its text.  The ledger says which rule versions
have read which text; only the missing pairs are scanned, each text once for all the paths and
versions that hold it, and findings are joined back to all of them.

Null text counts as empty and has no findings; null paths keep their row; repeated rows are reported
as often as they occur; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions._util import bind
from talkweave.llm import register
from talkweave.llm.common import table, whole
from talkweave.llm.spans import Rule, addressed, find_spans, joined_back, per_blob
from talkweave.session import shared_dir

DELIVERIES = 2

# --- fixed values: patterns of the contract, then those the scan adds -------------
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    Rule("assign", 1, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", base=False),
]


def scan_unseen(
    versions: DataFrame, path: str, text: str, rules: list[Rule] = RULES, scanned: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scans the (text, rule version) pairs that ``scanned`` (blob, rules) does not hold.

    Returns the new findings (blob, rule, version, start, end) and the new ledger rows
    (blob, rules); append both to the ledger's tables.
    """
    every = F.array(*[F.lit(r.key) for r in rules])
    # A partial aggregate drops copies before the shuffle, so a hot text moves once per input partition.
    blobs = addressed(versions, path, text).select("blob", "text").dropDuplicates(["blob"])
    if scanned is None:
        due = blobs.withColumn("due", every)
    else:
        seen = scanned.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("seen"))
        due = (
            blobs.join(seen, "blob", "left")
            .withColumn("due", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
            .filter(F.size("due") > 0)
            .drop("seen")
        )
    return find_spans(due, rules, None if scanned is None else F.col("due")), due.select("blob", F.col("due").alias("rules"))


def extend_ledger(
    versions: DataFrame, path: str, text: str, folder: str, delivery: str, rules: list[Rule] = RULES
) -> DataFrame:
    """The findings of the ledger stored in ``folder`` after it has taken in a delivery of versions.

    Only (text, rule version) pairs that no other delivery has scanned are scanned.  A delivery has folders of
    its own, findings first, so one that was cut off is simply taken in again.
    """
    spark = versions.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/scanned")
    known = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    scanned = None
    if known:
        scanned = spark.read.schema("blob string, rules array<string>, delivery string").parquet(f"{folder}/scanned")
        scanned = scanned.filter(F.col("delivery") != delivery).select("blob", "rules")
    findings, pairs = scan_unseen(versions, path, text, rules, scanned)
    kind = findings.schema.add("delivery", "string")
    findings.write.mode("overwrite").parquet(f"{folder}/findings/delivery={delivery}")
    pairs.write.mode("overwrite").parquet(f"{folder}/scanned/delivery={delivery}")
    return spark.read.schema(kind).parquet(f"{folder}/findings").drop("delivery")


def secret_findings(
    versions: DataFrame, path: str, findings: DataFrame, rules: list[Rule] = RULES, text: str = "text"
) -> DataFrame:
    """All findings of the ledger joined back to every path."""
    found = per_blob(findings, rules, by_kind=False)
    paths = addressed(versions, path, text).select("path", "blob")
    return joined_back(paths, found, [r.name for r in rules if r.base], path)


def redact_findings(versions: DataFrame, text: str, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``versions`` with ``mark`` in place of every found span; spans that overlap give one mark.

    Findings are joined back by content address, so every copy is redacted; other columns stay as they are,
    and a null text stays null.
    """
    names = [f"c{i}" for i in range(len(versions.columns))]
    body = names[versions.columns.index(text)]
    spans = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def cut(rows: Column) -> Column:
        # The text up to each span that ends beyond all before it, then the mark; the rest follows at the end.
        first = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))
        done = F.aggregate(
            rows, first,
            lambda a, s: F.when(
                s["start"] >= a["at"],
                F.struct(
                    F.concat(
                        a["out"],
                        F.array(F.substring(F.col(body), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)),
                    ).alias("out"),
                    s["end"].alias("at"),
                ),
            ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        )
        return bind(
            {"d": done},
            lambda v: F.concat(
                F.array_join(v["d"]["out"], ""), F.substring(F.col(body), (v["d"]["at"] + 1).cast("int"), F.length(body))
            ),
        )

    rows = versions.toDF(*names).withColumn("blob", F.sha2(whole(F.col(body)), 256)).join(spans, "blob", "left")
    clean = F.when(F.col("spans").isNull(), F.col(body)).otherwise(cut(F.col("spans")))
    return rows.select(*[(clean if n == body else F.col(n)).alias(c) for n, c in zip(names, versions.columns)])


@register("op1_secret_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The documents come in ``DELIVERIES`` parts; a text that an earlier part held is not scanned again."""
    docs = table(spark, folder, "documents")
    ledger = shared_dir(spark, "secret-ledger")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(DELIVERIES))
    for i in range(DELIVERIES):
        findings = extend_ledger(docs.filter(part == i), "doc_id", "text", ledger, str(i))
    return secret_findings(docs, "doc_id", findings)
