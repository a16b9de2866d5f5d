"""Leads, companies and student profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions._util import first_filled, strip, text_or_blank
from talkweave.functions.mail import email_status, is_generic_email, lead_quality
from talkweave.functions.records import DEFAULT_PROFILE, parse_profile
from talkweave.operators.skew import first_per_key

LEAD_COLUMNS = (
    "Company Name", "Specialty", "Contact Name", "Email", "Phone", "Website",
    "City", "State", "Zip Code", "Status", "Notes",
)


def company_key(name: Column) -> Column:
    return F.lower(strip(text_or_blank(name)))


def existing_companies(leads: DataFrame, column: str = "Company Name") -> DataFrame:
    """Trimmed, non-blank names; empty when the column is absent."""
    if column not in leads.columns:
        return leads.select(F.lit("").alias("company_name")).filter(F.lit(False))
    return leads.select(strip(text_or_blank(F.col(f"`{column}`"))).alias("company_name")).filter(
        F.col("company_name") != ""
    )


def first_lead(leads: DataFrame) -> DataFrame:
    """The batch's first row per company; rows without a company are all kept."""
    keyed = leads.withColumn("_key", company_key(F.col("company_name")))
    return first_per_key(keyed, ["_key"], ["input_seq"], keep_all=F.col("_key") == "").drop("_key")


def anti_existing(leads: DataFrame, existing: DataFrame) -> DataFrame:
    """Leads whose company is not on file; rows without a company always pass.

    Blank rows carry a join key of their own, so they spread over the tasks.
    """
    key = company_key(F.col("company_name"))
    keyed = leads.withColumn("_key", key).withColumn(
        "_spread", F.when(F.col("_key") == "", F.xxhash64("input_seq")).otherwise(F.lit(0).cast("long"))
    )
    known = (
        existing.select(company_key(F.col("company_name")).alias("_key"))
        .filter(F.col("_key") != "")
        .distinct()
        .withColumn("_spread", F.lit(0).cast("long"))
    )
    return keyed.join(known, ["_key", "_spread"], "left_anti").drop("_key", "_spread")


def export_counts(leads: DataFrame, existing: DataFrame) -> DataFrame:
    """A3: added, duplicates_skipped and total_processed.

    Counted per company first, so the join sees one row per company.
    """
    per_key = leads.groupBy(company_key(F.col("company_name")).alias("_key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = existing.select(company_key(F.col("company_name")).alias("_key")).distinct().withColumn(
        "known", F.lit(True)
    )
    flagged = per_key.join(known, "_key", "left")
    added = F.when(F.col("_key") == "", F.col("n")).when(F.col("known"), 0).otherwise(1)
    totals = flagged.agg(
        F.coalesce(F.sum(added), F.lit(0)).alias("added"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    )
    return totals.select(
        "added", (F.col("total") - F.col("added")).alias("duplicates_skipped"),
        F.col("total").alias("total_processed"),
    )


def save_leads(leads: DataFrame) -> DataFrame:
    """U8: the eleven sheet columns with their fallbacks; absent inputs count as ''."""

    def cell(name: str) -> Column:
        return text_or_blank(F.col(name)) if name in leads.columns else F.lit("")

    def pick(*names: str) -> Column:
        return strip(first_filled(*[cell(n) for n in names]))

    status = F.coalesce(F.nullif(strip(cell("status")), F.lit("")), F.lit("New"))
    values = [
        pick("company_name"), pick("specialty"), pick("contact_name", "founder_name"),
        pick("email", "contact_email"), pick("phone", "contact_phone"),
        pick("website", "company_website"), pick("city"), pick("state"), pick("zip_code"),
        status, pick("notes", "value_proposition"),
    ]
    return leads.select(*[v.alias(n) for n, v in zip(LEAD_COLUMNS, values)])


def score_leads(leads: DataFrame, probes: DataFrame, **spam) -> DataFrame:
    """F9, F24 and F25 over a table of leads and a table of address probes (unique per email)."""
    joined = leads.join(probes, "email", "left")
    checked = email_status(
        F.col("email"), F.col("mx_host"), F.col("rcpt_code"), F.col("random_code"), F.col("error")
    )
    return (
        joined.withColumn("check", checked)
        .withColumn("email_status", F.col("check.status"))
        .withColumn("generic", is_generic_email("email"))
        .withColumn("quality", lead_quality("email_status", "subject", "body", **spam))
        .drop("check", "mx_host", "rcpt_code", "random_code", "error")
    )


def lookup_profile(requests: DataFrame, students: DataFrame, order: str) -> DataFrame:
    """The student's first record, compared as text, else the default profile."""
    names = [c for c in students.columns if c not in ("studentId", order)]
    parsed = parse_profile({c: F.col(f"`{c}`") for c in names})
    first = first_per_key(
        students.withColumn("_sid", F.col("studentId").cast("string")), ["_sid"], [order]
    ).select("_sid", *[c.alias(f"_p_{n}") for n, c in parsed.items()], F.lit(True).alias("student_found"))
    joined = requests.withColumn("_sid", F.col("student_id").cast("string")).join(first, "_sid", "left")
    found = F.coalesce(F.col("student_found"), F.lit(False))
    profile = [
        F.when(found, F.col(f"_p_{n}")).otherwise(F.lit(DEFAULT_PROFILE.get(n)).cast("string")).alias(n)
        for n in parsed
    ]
    return joined.select(*requests.columns, *profile, found.alias("student_found"))
