"""E-mail and lead scoring functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions._util import ColumnLike, as_col, bind
from talkweave.functions.text import all_of

# --- fixed values: spam rules (``winner`` stands twice and counts twice) ----
SPAM_KEYWORDS = (
    "free", "winner", "guaranteed", "no cost", "money back",
    "urgent", "winner", "cash", "prize", "investment",
    "act now", "limited time", "offer", "discount", "save",
)
GENERIC_MAILBOXES = ("info", "support", "contact")
PROTECTED_HOSTS = ("outlook", "google")
# --- end of fixed values ----------------------------------------------------

# A plain subset of the address grammar: dot-separated atoms before the at sign,
# at least two host labels after it, lengths within the usual limits.
EMAIL_PATTERN = (
    r"^(?=.{3,254}$)(?=[^@]{1,64}@)[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
    r"@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9-]{0,61}[A-Za-z0-9]$"
)


def is_all_caps(text: Column) -> Column:
    """At least one cased character and no lower-case one."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def _any_of(keywords: list[str]) -> str:
    """A pattern that finds, at every word border, the longest keyword that begins there, so that one pass finds all."""
    longest_first = sorted(keywords, key=len, reverse=True)
    return r"(?U)\b(?=(" + "|".join(rf"\Q{w}\E" for w in longest_first) + r")\b)"


def _holders(word: str, keywords: list[str]) -> list[str]:
    """Keywords that begin with ``word`` as a whole word; where one of them is found, ``word`` is."""
    return [w for w in keywords if re.match(re.escape(word) + r"\b", w)]


def spam_score(subject: ColumnLike, body: ColumnLike, keywords=SPAM_KEYWORDS) -> Column:
    """struct(score, status, triggers).

    The keyword list is a parameter; each entry, repeats included, is one rule.
    """
    texts = {
        "head": F.coalesce(as_col(subject), F.lit("")),
        "text": F.coalesce(as_col(body), F.lit("")),
    }
    unique = list(dict.fromkeys(keywords))

    def measures(v: dict[str, Column]) -> dict[str, Column]:
        head, text = v["head"], v["text"]
        low = F.lower(F.concat(head, F.lit(" "), text))
        return {
            "hits": F.regexp_extract_all(low, F.lit(_any_of(unique)), F.lit(1)) if unique else F.array().cast("array<string>"),
            "caps": is_all_caps(head) & (F.length(head) > 5),
            "shouting": head.contains("!!!") | head.contains("???"),
            "links": F.regexp_count(text, F.lit(r"https?://")),
            "words": F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")),
            "leave": F.lower(text).contains("unsubscribe") | F.lower(text).contains("opt-out"),
        }

    def counted(v: dict[str, Column]) -> dict[str, Column]:
        def found(word: str) -> Column:
            return F.size(F.filter(v["hits"], lambda h: h.isin(_holders(word, unique))))

        counts = {f"n{i}": found(w) for i, w in enumerate(unique)}
        return {k: c for k, c in v.items() if k != "hits"} | counts

    def score(v: dict[str, Column]) -> Column:
        # One entry per rule: (applies, score change, trigger text).
        rules: list[tuple[Column, Column, Column]] = []
        for word in keywords:
            n = v[f"n{unique.index(word)}"]
            label = F.format_string(f"Spammy keyword found: '{word}' (%dx)", n)
            rules.append((n > 0, -F.least(n * F.lit(0.5), F.lit(2.0)), label))
        rules += [
            (v["caps"], F.lit(-2.0), F.lit("Subject is all caps")),
            (v["shouting"], F.lit(-1.0), F.lit("Excessive punctuation in subject")),
            (v["links"] > 3, F.lit(-1.5), F.format_string("Too many links (%d)", v["links"])),
            (v["words"] < 20, F.lit(-1.0), F.lit("Email body is too short")),
            (v["leave"], F.lit(1.0), F.lit("Unsubscribe link detected (+1)")),
        ]
        change = reduce(lambda a, b: a + b, [F.when(hit, delta).otherwise(0.0) for hit, delta, _ in rules])
        value = F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.lit(10.0) + change)), 1)
        status = F.when(value < 5, "Spammy").when(value < 8, "Average").otherwise("Good")
        triggers = F.array_compact(F.array(*[F.when(hit, label) for hit, _, label in rules]))
        return F.struct(value.alias("score"), status.alias("status"), triggers.alias("triggers"))

    return bind(texts, lambda t: bind(measures(t), lambda m: bind(counted(m), score)))


def email_syntax(email: ColumnLike) -> Column:
    """F8: syntax stage only (a documented subset of the full address grammar)."""
    address = as_col(email)
    return F.coalesce(address.rlike(EMAIL_PATTERN) & ~F.split(address, "@")[0].contains(".."), F.lit(False))


def email_status(
    email: ColumnLike, mx_host: ColumnLike, rcpt_code: ColumnLike, random_code: ColumnLike, error: ColumnLike
) -> Column:
    """struct(valid_syntax, mx_found, smtp_verified, status, message) from probe results."""
    probe = {
        "email": as_col(email), "mx": as_col(mx_host), "code": as_col(rcpt_code),
        "random": as_col(random_code), "failed": as_col(error), "syntax": email_syntax(email),
    }

    def verdict(v: dict[str, Column]) -> Column:
        syntax, mx, code, failed = v["syntax"], v["mx"], v["code"], v["failed"]
        has_mx = syntax & mx.isNotNull()
        answered = has_mx & failed.isNull() & code.isNotNull()
        protected = F.lower(mx).rlike("|".join(PROTECTED_HOSTS))
        status = (
            F.when(~has_mx, "invalid")
            .when(~answered, "risky")
            .when(code == 250, "valid")
            .when((code == 550) & ~protected, "invalid")
            .otherwise("risky")
        )
        message = (
            F.when(~syntax, "The email address is not valid.")
            .when(~has_mx, F.concat(F.lit("No MX records found for "), F.substring_index(v["email"], "@", -1)))
            .when(~answered, F.concat(F.lit("SMTP Verification failed: "), F.coalesce(failed, F.lit(""))))
            .when((code == 250) & (F.coalesce(v["random"], F.lit(0)) == 250), "Valid (Catch-all domain)")
            .when(code == 250, "Email is valid and reachable.")
            .when(
                (code == 550) & protected,
                "Server is protected (Outlook/Google). Mailbox might exist but probe was rejected.",
            )
            .when(code == 550, "Mailbox does not exist (550).")
            .otherwise(F.concat(F.lit("Server responded with code "), code.cast("string")))
        )
        return F.struct(
            syntax.alias("valid_syntax"),
            has_mx.alias("mx_found"),
            (answered & (code == 250)).alias("smtp_verified"),
            status.alias("status"),
            message.alias("message"),
        )

    return bind(probe, verdict)


def is_generic_email(email: ColumnLike) -> Column:
    """F24."""
    mailbox = F.lower(F.substring_index(as_col(email), "@", 1))
    return F.coalesce(as_col(email).contains("@") & mailbox.isin(*GENERIC_MAILBOXES), F.lit(False))


def lead_quality(status: ColumnLike, subject: ColumnLike, body: ColumnLike, keywords=SPAM_KEYWORDS) -> Column:
    """``Passed`` or ``Needs Review`` from the address status and the mail text."""
    head = F.coalesce(as_col(subject), F.lit(""))
    text = F.coalesce(as_col(body), F.lit(""))
    clean = ((head == "") & (text == "")) | (spam_score(head, text, keywords)["score"] >= 7)
    return F.when(all_of([as_col(status) == "valid", clean]), "Passed").otherwise("Needs Review")


def subject_line(draft: ColumnLike) -> Column:
    """split ``**Subject:** …``, a blank line and the body."""
    text = as_col(draft)
    pattern = r"(?s)^\s*\*\*Subject:\*\*[ \t]*([^\n]*)\n\s*\n(.*)$"
    found = text.rlike(pattern)
    return F.struct(
        F.when(found, F.trim(F.regexp_extract(text, pattern, 1))).alias("subject"),
        F.when(found, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"),
    )
