"""Queries over text functions: labels, mail scores, JSON text, dates, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions import jsontext as J
from talkweave.functions import mail as ML
from talkweave.functions import prompts as P
from talkweave.functions import records as RC
from talkweave.functions import text as TX
from talkweave.operators import classify as CL
from talkweave.operators import leads as LD
from talkweave.operators import pages as PG
from talkweave.plans import mappings as M
from talkweave.plans.catalog import query, stream_table, table
from talkweave.streaming import stateful as ST


# --- query labels -----------------------------------------------------------------
_WORDED = """worded AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Exercise ' || turn || '.' || conv_id WHEN 1 THEN 'see EXAMPLE' || conv_id
  WHEN 2 THEN 'Theorem of' WHEN 3 THEN 'activity  7.' WHEN 4 THEN 'Show' ELSE '' END || ' ' || text AS q FROM conversations)"""


def _worded(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    lead = (
        F.when(turn % 6 == 0, F.concat(F.lit("Exercise "), turn.cast("string"), F.lit("."), conv))
        .when(turn % 6 == 1, F.concat(F.lit("see EXAMPLE"), conv)).when(turn % 6 == 2, "Theorem of")
        .when(turn % 6 == 3, "activity  7.").when(turn % 6 == 4, "Show").otherwise("")
    )
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(lead, F.lit(" "), F.col("text")).alias("q"))


@query(
    "classify_query",
    rf"""WITH {_WORDED}, n AS (SELECT *, regexp_extract(lower(q), 'exercise\s*(\d+\.?\d*)', 1) AS ex, regexp_extract(lower(q),
      'example\s*(\d+\.?\d*)', 1) AS exa, regexp_extract(lower(q), 'theorem\s*(\d+\.?\d*)', 1) AS th,
      regexp_extract(lower(q), 'activity\s*(\d+\.?\d*)', 1) AS ac FROM worded),
    k AS (SELECT *, CASE WHEN ex <> '' THEN 'exercise' WHEN exa <> '' THEN 'example' WHEN th <> '' THEN 'theorem' WHEN ac <> '' THEN 'activity' END AS kind,
      coalesce(nullif(ex, ''), nullif(exa, ''), nullif(th, ''), nullif(ac, '')) AS number FROM n)
    SELECT conv_id, turn, CASE WHEN kind IS NOT NULL THEN 'exact' WHEN regexp_matches(lower(q), 'diagram|figure|picture|image|show')
      THEN 'visual' ELSE 'conceptual' END AS type, number, CASE WHEN kind = 'exercise' THEN 'EXERCISE ' || number
      WHEN kind IS NOT NULL THEN upper(kind[1]) || kind[2:] || ' ' || number END AS heading, kind AS content_type FROM k""",
)
def classify_query(spark, d):
    rows = _worded(spark, d).withColumn("i", TX.classify_query("q"))
    return rows.select("conv_id", "turn", "i.type", "i.number", "i.heading", "i.content_type")


_EXACT = "'" + "|".join(TX.EXACT_WORDS) + "'"


@query(
    "query_type",
    f"WITH {_WORDED} SELECT conv_id, turn, CASE WHEN regexp_matches(lower(q), {_EXACT}) THEN 'exact' ELSE 'conceptual' END AS kind FROM worded",
)
def query_type(spark, d):
    return _worded(spark, d).select("conv_id", "turn", TX.query_type("q").alias("kind"))


def _subject_case(column: str, keywords) -> str:
    parts = " ".join(f"WHEN regexp_matches({column}, '{'|'.join(ws)}') THEN '{s}'" for s, ws in keywords.items())
    return f"CASE {parts} END"


@query("heuristic_subject", f"SELECT doc_id, {_subject_case('lower(text)', TX.SUBJECT_KEYWORDS)} AS subject FROM documents")
def heuristic_subject(spark, d):
    return table(spark, d, "documents").select("doc_id", TX.heuristic_subject("text").alias("subject"))


_SMALL = {"Physics": ("newton",), "Biology": ("enzyme",), "Chemistry": ("schwur",)}
_NORMALIZED = "CASE lower(t) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TX.SUBJECT_SYNONYMS.items()) + " ELSE t END"
_VALID = ", ".join(f"'{s}'" for s in TX.VALID_SUBJECTS)


@query(
    "classify_subject",
    f"""WITH l AS (SELECT doc_id, {_subject_case('lower(text)', _SMALL)} AS h, CASE lang WHEN 'en' THEN ' Social Science' WHEN 'de' THEN 'MATHS now'
    WHEN 'fr' THEN '' ELSE 'Ümlaut Bio' END AS label FROM documents),
    w AS (SELECT doc_id, coalesce(h, nullif(regexp_extract(label, '([^ ]+)', 1), ''), 'Mathematics') AS t FROM l),
    m AS (SELECT doc_id, {_NORMALIZED} AS s FROM w) SELECT doc_id, CASE WHEN s IN ({_VALID}) THEN s ELSE 'Mathematics' END AS subject FROM m""",
)
def classify_subject(spark, d):
    label = (
        F.when(F.col("lang") == "en", " Social Science").when(F.col("lang") == "de", "MATHS now").when(F.col("lang") == "fr", "")
        .otherwise("Ümlaut Bio")
    )
    return table(spark, d, "documents").select("doc_id", TX.classify_subject("text", label, _SMALL).alias("subject"))


@query(
    "pick_intent",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type ELSE 'view' END AS intent FROM events""",
)
def pick_intent(spark, d):
    label = F.concat(F.lit("\n"), F.col("event_type"), F.lit(" maybe"))
    return table(spark, d, "events").select("event_id", TX.pick_intent(label, ["view", "click", "error"]).alias("intent"))


# --- mail -----------------------------------------------------------------------------
WORDS = ("the", "und", "une", "los", "the", "of")


def _word_count(text: str, word: str) -> str:
    """Whole-word count with Unicode borders: separators are doubled so that neighbours do not share one."""
    return (
        rf"len(regexp_extract_all(regexp_replace({text}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), "
        rf"'(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)'))"
    )


_MAILS = """mails AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(source) || ' ' || upper(lang) WHEN 1 THEN source || '???' WHEN 2 THEN upper(lang)
  ELSE lang END AS subject, text || CASE WHEN doc_id % 5 = 0 THEN ' http://a https://b http://c http://d' ELSE '' END ||
  CASE WHEN doc_id % 7 = 0 THEN ' Opt-Out' ELSE '' END AS body FROM documents)"""


def _mails(spark, d):
    key = F.col("doc_id")
    subject = (
        F.when(key % 4 == 0, F.concat(F.upper("source"), F.lit(" "), F.upper("lang"))).when(key % 4 == 1, F.concat("source", F.lit("???")))
        .when(key % 4 == 2, F.upper("lang")).otherwise(F.col("lang"))
    )
    body = F.concat(
        F.col("text"), F.when(key % 5 == 0, " http://a https://b http://c http://d").otherwise(""),
        F.when(key % 7 == 0, " Opt-Out").otherwise(""),
    )
    return table(spark, d, "documents").select("doc_id", subject.alias("subject"), body.alias("body"))


_COUNTED = f"""counted AS (SELECT doc_id, subject, body, {', '.join(f"{_word_count(chr(34) + 'low' + chr(34), w)} AS w{i}" for i, w in enumerate(WORDS))},
  len(regexp_extract_all(body, 'https?://')) AS links, len(regexp_extract_all(body, '\\S+')) AS words,
  upper(subject) = subject AND lower(subject) <> subject AND length(subject) > 5 AS caps,
  contains(subject, '!!!') OR contains(subject, '???') AS punct, contains(lower(body), 'unsubscribe') OR contains(lower(body), 'opt-out') AS unsub
  FROM (SELECT *, lower(subject || ' ' || body) AS low FROM mails))"""
_SCORED = f"""scored AS (SELECT doc_id, round(greatest(0.0, least(10.0, 10.0 {' '.join(f'- least(0.5 * w{i}, 2.0)' for i in range(len(WORDS)))}
  - CASE WHEN caps THEN 2 ELSE 0 END - CASE WHEN punct THEN 1 ELSE 0 END - CASE WHEN links > 3 THEN 1.5 ELSE 0 END
  - CASE WHEN words < 20 THEN 1 ELSE 0 END + CASE WHEN unsub THEN 1 ELSE 0 END)), 1)::DOUBLE AS score,
  concat_ws(';', {', '.join(f"CASE WHEN w{i} > 0 THEN 'Spammy keyword found: ''{w}'' (' || w{i} || 'x)' END" for i, w in enumerate(WORDS))},
  CASE WHEN caps THEN 'Subject is all caps' END, CASE WHEN punct THEN 'Excessive punctuation in subject' END,
  CASE WHEN links > 3 THEN 'Too many links (' || links || ')' END, CASE WHEN words < 20 THEN 'Email body is too short' END,
  CASE WHEN unsub THEN 'Unsubscribe link detected (+1)' END) AS triggers FROM counted)"""


@query(
    "spam_score",
    f"""WITH {_MAILS}, {_COUNTED}, {_SCORED} SELECT doc_id, score, CASE WHEN score < 5 THEN 'Spammy' WHEN score < 8 THEN 'Average' ELSE 'Good' END
    AS status, triggers FROM scored""",
)
def spam_score(spark, d):
    rows = _mails(spark, d).withColumn("s", ML.spam_score("subject", "body", WORDS))
    return rows.select("doc_id", "s.score", "s.status", F.array_join("s.triggers", ";").alias("triggers"))


@query(
    "lead_quality",
    f"""WITH {_MAILS}, {_COUNTED}, {_SCORED} SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND score >= 7 THEN 'Passed' ELSE 'Needs Review' END AS quality
    FROM scored""",
)
def lead_quality(spark, d):
    status = F.when(F.col("doc_id") % 3 > 0, "valid").otherwise("risky")
    return _mails(spark, d).select("doc_id", ML.lead_quality(status, "subject", "body", WORDS).alias("quality"))


_ADDRESS = r"'^[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]$'"


@query("email_syntax", f"WITH {M.LEADS} SELECT input_seq, regexp_matches(email, {_ADDRESS}) AS valid FROM leads")
def email_syntax(spark, d):
    return M.leads(table(spark, d, "part")).select("input_seq", ML.email_syntax("email").alias("valid"))


@query("generic_email", f"WITH {M.LEADS} SELECT input_seq, starts_with(email, 'info@') AS generic FROM leads")
def generic_email(spark, d):
    return M.leads(table(spark, d, "part")).select("input_seq", ML.is_generic_email("email").alias("generic"))


def _probes(leads):
    """One probe per address; the host and codes derive from the address."""
    code = F.pmod(F.length("email") + F.ascii(F.substring("email", -5, 1)), F.lit(5))
    return leads.select("email").distinct().select(
        "email", F.when(code != 0, F.when(code == 1, "mx.Google.com").otherwise("mx.host")).alias("mx_host"),
        F.when(code == 2, 250).when(code == 3, 451).otherwise(550).alias("rcpt_code"),
        F.when(F.length("email") % 2 == 0, 250).otherwise(550).alias("random_code"),
        F.when(F.ascii(F.substring("email", -5, 1)) == 55, "timed out").alias("error"),
    )


_PROBED = f"""probed AS (SELECT *, (length(email) + ascii(substr(email, length(email) - 4, 1))) % 5 AS code,
  ascii(substr(email, length(email) - 4, 1)) = 55 AS failed, regexp_matches(email, {_ADDRESS}) AS ok FROM leads)"""


@query(
    "email_status",
    f"""WITH {M.LEADS}, {_PROBED} SELECT input_seq, ok AS valid_syntax, ok AND code <> 0 AS mx_found,
    ok AND code = 2 AND NOT failed AS smtp_verified,
    CASE WHEN NOT ok OR code = 0 THEN 'invalid' WHEN failed THEN 'risky' WHEN code = 2 THEN 'valid' WHEN code = 3 OR code = 1 THEN 'risky'
      ELSE 'invalid' END AS status,
    CASE WHEN NOT ok THEN 'The email address is not valid.' WHEN code = 0 THEN 'No MX records found for ' || split_part(email, '@', 2)
      WHEN failed THEN 'SMTP Verification failed: timed out' WHEN code = 2 AND length(email) % 2 = 0 THEN 'Valid (Catch-all domain)'
      WHEN code = 2 THEN 'Email is valid and reachable.' WHEN code = 3 THEN 'Server responded with code 451'
      WHEN code = 1 THEN 'Server is protected (Outlook/Google). Mailbox might exist but probe was rejected.'
      ELSE 'Mailbox does not exist (550).' END AS message FROM probed""",
)
def email_status(spark, d):
    leads = M.leads(table(spark, d, "part"))
    joined = leads.join(_probes(leads), "email", "left")
    checked = ML.email_status(
        F.col("email"), F.col("mx_host"), F.col("rcpt_code"), F.col("random_code"), F.col("error")
    )
    return joined.select("input_seq", checked.alias("c")).select("input_seq", "c.*")


@query(
    "scored_leads",
    f"""WITH {M.LEADS}, {_PROBED} SELECT input_seq, starts_with(email, 'info@') AS generic, CASE WHEN ok AND code = 2 AND NOT failed
    THEN 'Passed' ELSE 'Needs Review' END AS quality FROM probed""",
)
def scored_leads(spark, d):
    leads = M.leads(table(spark, d, "part"))
    blank = leads.withColumn("subject", F.lit("")).withColumn("body", F.lit(""))
    return LD.score_leads(blank, _probes(leads)).select("input_seq", "generic", "quality")


@query(
    "subject_line",
    """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source || ' ' || lang END AS subject, text AS body FROM documents""",
)
def subject_line(spark, d):
    head = F.concat(F.lit("**Subject:** "), F.col("source"), F.lit(" "), F.col("lang"), F.lit(" \n\n"))
    draft = F.when(F.col("doc_id") % 3 > 0, F.concat(head, F.col("text"))).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", ML.subject_line(draft).alias("s"))
    return rows.select("doc_id", "s.subject", "s.body")


# --- JSON text ------------------------------------------------------------------------
def _damaged():
    """The props document of an event, damaged in one of eight ways."""
    clean, number = F.col("props"), M.props_k().cast("string")
    forms = [
        clean,
        F.concat(F.lit('{"k": '), number, F.lit(",}")),
        F.concat(F.lit("{'k': "), number, F.lit("}")),
        F.concat(F.lit('{"k": '), number, F.lit('\n"z": \'x\'}')),
        F.concat(F.lit("```json\n"), clean, F.lit("\n```")),
        F.concat(F.lit("The answer is "), clean, F.lit(" as asked {for}.")),
        F.concat(clean, F.lit(" "), clean),
        F.concat(F.lit("no json, only "), number),
    ]
    out = forms[-1]
    for i, form in enumerate(forms[:-1]):
        out = F.when(F.col("event_id") % 8 == i, form).otherwise(out)
    return out


@query("repair_json", rf"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '{{"k": ' || {M.K} || '}}' WHEN 2 THEN '{{"k": ' || {M.K} || '}}'
  WHEN 3 THEN '{{"k": ' || {M.K} || ',' || chr(10) || '"z": "x"}}' WHEN 4 THEN '```json' || chr(10) || props || chr(10) || '```'
  WHEN 5 THEN 'The answer is ' || props || ' as asked {{for}}.' WHEN 6 THEN props || ' ' || props
  ELSE 'no json, only ' || {M.K} END AS repaired FROM events""")
def repair_json(spark, d):
    return table(spark, d, "events").select("event_id", J.repair_json(_damaged()).alias("repaired"))


@query("safe_json", f"SELECT event_id, CASE WHEN event_id % 8 < 5 THEN {M.K} END AS k FROM events")
def safe_json(spark, d):
    parsed = J.safe_json(_damaged())
    return table(spark, d, "events").select("event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"))


@query("strict_json", "SELECT event_id, event_id % 8 = 0 AS strict FROM events")
def strict_json(spark, d):
    return table(spark, d, "events").select("event_id", J.is_strict_json(_damaged()).alias("strict"))


@query(
    "extract_json",
    f"""SELECT event_id, CASE WHEN event_id % 8 < 7 THEN {M.K} END AS k, CASE WHEN event_id % 8 = 7 THEN 'malformed_json' END AS error,
    CASE WHEN event_id % 8 = 7 THEN 'no json, only ' || {M.K} END AS raw FROM events""",
)
def extract_json(spark, d):
    rows = table(spark, d, "events").select("event_id", J.extract_json(_damaged()).alias("v"))
    return rows.select(
        "event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.error", "string").alias("error"),
        F.try_variant_get("v", "$.raw", "string").alias("raw"),
    )


@query("strip_fences", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props || chr(10) || event_type ELSE '```' || props END AS body
  FROM events""")
def strip_fences(spark, d):
    n = F.col("event_id") % 3
    text = (
        F.when(n == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```\n")))
        .when(n == 1, F.concat(F.lit(" ```\n"), F.col("props"), F.lit("\n"), F.col("event_type"), F.lit("\n```")))
        .otherwise(F.concat(F.lit("```"), F.col("props")))
    )
    return table(spark, d, "events").select("event_id", J.strip_fences(text).alias("body"))


def _state():
    """A nested state document per event."""
    return F.try_parse_json(
        F.concat(
            F.lit('{"input":{"kind":"'), F.col("event_type"), F.lit('","value":'), F.col("value").cast("string"),
            F.lit(',"flag":'), (F.col("user_id") % 2 == 0).cast("string"), F.lit(',"none":null,"list":[],"zero":0},"nodes":{"a":'),
            F.col("props"), F.lit("}}"),
        )
    )


@query(
    "state_paths",
    f"""SELECT event_id, event_type AS kind, {M.K} AS k, 'fallback' AS missing, CAST(NULL AS VARCHAR) AS present_null FROM events""",
)
def state_paths(spark, d):
    rows = table(spark, d, "events").withColumn("state", _state())
    return rows.select(
        "event_id", J.get_path("state", "input.kind", "string").alias("kind"), J.get_path("state", "nodes.a.k", "bigint").alias("k"),
        J.get_path("state", "nodes.b.k", "string", F.lit("fallback")).alias("missing"),
        J.get_path("state", "input.none", "string", F.lit("fallback")).alias("present_null"),
    )


@query(
    "state_conditions",
    f"""SELECT event_id, true AS always, user_id % 2 = 0 AS truthy_flag, false AS truthy_list, false AS truthy_zero, {M.K} > 0 AS truthy_k,
    false AS exists_null, true AS exists_list, event_type = 'click' AS is_click, user_id % 2 = 0 AS is_true, event_type <> 'view' AS not_view,
    true AS missing_is_blank, false AS unknown FROM events""",
)
def state_conditions(spark, d):
    conditions = {
        "always": "", "truthy_flag": "truthy:input.flag", "truthy_list": "truthy:input.list", "truthy_zero": "truthy:input.zero",
        "truthy_k": "truthy:nodes.a.k", "exists_null": "exists:input.none", "exists_list": "exists:input.list",
        "is_click": "equals:input.kind:click", "is_true": "equals:input.flag:True", "not_view": "not_equals:input.kind:view",
        "missing_is_blank": "equals:input.gone:", "unknown": "sometimes:input.kind",
    }
    rows = table(spark, d, "events").withColumn("state", _state())
    return rows.select("event_id", *[J.check_condition(c, "state").alias(n) for n, c in conditions.items()])


@query(
    "state_routes",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'clicked' WHEN user_id % 2 = 0 THEN 'even' WHEN event_type = 'view' THEN 'viewed' END
    AS branch FROM events""",
)
def state_routes(spark, d):
    moves = [
        {"to": "clicked", "when": "equals:input.kind:click"}, {"to": "even", "when": "truthy:input.flag"},
        {"to": "viewed", "when": "equals:input.kind:view"},
    ]
    rows = table(spark, d, "events").withColumn("state", _state())
    return rows.select("event_id", J.route(moves, "state").alias("branch"))


@query(
    "state_mapping",
    f"""SELECT event_id, event_type AS arg_kind, {M.K} AS written, event_type AS kept, event_type AS nested, true AS null_written FROM events""",
)
def state_mapping(spark, d):
    rows = table(spark, d, "events").withColumn("state", _state()).withColumn(
        "output", F.try_parse_json(F.concat(F.lit('{"r":'), F.col("props"), F.lit(',"t":"'), F.col("event_type"), F.lit('"}')))
    )
    written = J.map_outputs("state", "output", {"outputs.x.k": "r.k", "input.value.deep": "t", "outputs.gone": "nope"})
    args = J.map_inputs("state", {"kind": "input.kind"})
    rows = rows.select("event_id", *args, written.alias("after"))
    return rows.select(
        "event_id", F.col("kind").try_cast("string").alias("arg_kind"), J.get_path("after", "outputs.x.k", "bigint").alias("written"),
        J.get_path("after", "input.kind", "string").alias("kept"), J.get_path("after", "input.value.deep", "string").alias("nested"),
        F.is_variant_null(J.get_path("after", "outputs.gone")).alias("null_written"),
    )


@query(
    "decision_kinds",
    f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'final_answer' ELSE 'invalid' END AS kind,
    CASE WHEN event_type = 'click' THEN 'tool_' || user_id END AS tool_name, CASE WHEN event_type = 'click' THEN
    CASE WHEN user_id % 2 = 0 THEN replace(props, ' ', '') ELSE '{{}}' END END AS arguments FROM events""",
)
def decision_kinds(spark, d):
    kind = F.col("event_type")
    arguments = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(',"arguments":'), F.col("props"))).otherwise("")
    decision = (
        F.when(kind == "click", F.concat(F.lit('{"type":" Tool_Call ","tool_name":" tool_'), F.col("user_id").cast("string"), F.lit('"'), arguments, F.lit("}")))
        .when(kind == "view", '{"type":"FINAL_answer"}').when(kind == "error", '{"thought":"x"}').otherwise('{"type":"other"}')
    )
    rows = table(spark, d, "events").select("event_id", RC.decision_kind(F.try_parse_json(decision)).alias("c"))
    return rows.select("event_id", "c.*")


# --- classification results -------------------------------------------------------------
PROFILE = {
    "description": "Sorts events.",
    "instructions": ["Read all of it.", "Pick one value."],
    "dimensions": [
        {"name": "needs_ticket", "field_type": "boolean", "description": "Open a ticket?"},
        {"name": "ticket_queue", "field_type": "enum", "description": "Queue.", "allowed_values": ["sales", "parts", "no_ticket"]},
        {"name": "tags", "field_type": "array_enum", "description": "Tags.", "allowed_values": ["a", "b"], "required": False},
        {"name": "error_code", "field_type": "string", "description": "Code.", "required": False, "allow_null": True},
        {"name": "ticket_title", "field_type": "string", "description": "Title."},
        {"name": "confidence", "field_type": "number", "description": "0 to 1."},
    ],
}


def _results(rows):
    """A result document per event: some conform, others break one rule or more."""
    kind, k = F.col("event_type"), M.props_k()
    queue = F.when(k % 5 == 0, "no_ticket").when(k % 5 == 1, "garage").otherwise("sales")
    title = F.when(kind == "view", "").otherwise(F.when(kind == "error", ',"ticket_title":null').otherwise(',"ticket_title":"T"'))
    tags = F.when(kind == "click", ',"tags":["a","c"]').when(kind == "signup", ',"tags":["a","b"]').otherwise("")
    needs = F.when(k % 11 == 0, '"yes"').otherwise("true")
    extra = F.when(k % 7 == 0, ',"note":1').otherwise("")
    text = F.concat(
        F.lit('{"needs_ticket":'), needs, F.lit(',"ticket_queue":"'), queue, F.lit('","error_code":null,"confidence":'),
        (k / 50.0).cast("string"), title, tags, extra, F.lit("}"),
    )
    return rows.select("event_id", F.try_parse_json(text).alias("result"))


_VIOLATIONS = f"""SELECT event_id, concat_ws(',', CASE WHEN {M.K} % 11 = 0 THEN 'type:needs_ticket' END, CASE WHEN {M.K} % 5 = 1 THEN 'enum:ticket_queue' END,
  CASE WHEN event_type = 'click' THEN 'enum:tags' END, CASE WHEN event_type = 'view' THEN 'missing:ticket_title' WHEN event_type = 'error' THEN
  'null:ticket_title' END, CASE WHEN {M.K} % 7 = 0 THEN 'extra:note' END) AS violations FROM events"""


@query("classification_violations", _VIOLATIONS)
def classification_violations(spark, d):
    checked = CL.check_classification(_results(table(spark, d, "events")), PROFILE)
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("stream_classification_violations", _VIOLATIONS)
def stream_classification_violations(spark, d):
    checked = ST.stream_classify_check(_results(stream_table(spark, d, "events")), PROFILE)
    flat = checked.select("event_id", F.array_join("violations", ",").alias("violations"))
    return ST.drain(flat, "stream-check").drop("batch")


@query(
    "ticket_rules",
    f"""SELECT event_id, concat_ws(',', CASE WHEN {M.K} % 11 > 0 AND {M.K} % 5 = 0 THEN 'queue_disagrees' END,
    CASE WHEN {M.K} > 50 THEN 'confidence_out_of_range' END) AS broken FROM events""",
)
def ticket_rules(spark, d):
    return _results(table(spark, d, "events")).select("event_id", F.array_join(RC.ticket_rules("result"), ",").alias("broken"))


@query(
    "ticket_drafts",
    f"""SELECT event_id, CASE WHEN {M.K} % 11 = 0 THEN NULL ELSE true END AS needs_ticket, CASE {M.K} % 5 WHEN 0 THEN 'no_ticket' WHEN 1 THEN 'garage'
    ELSE 'sales' END AS ticket_queue, CASE WHEN event_type NOT IN ('view', 'error') THEN 'T' END AS ticket_title,
    CAST(NULL AS VARCHAR) AS ticket_summary FROM events""",
)
def ticket_drafts(spark, d):
    return _results(table(spark, d, "events")).select("event_id", *RC.ticket_draft("result"))


_SCHEMA_SQL = P.json_text(CL.classification_schema(PROFILE)[1], indent=2).replace("'", "''")


@query(
    "classification_prompt",
    f"""SELECT conv_id, turn, 'Classify the following conversation according to the configured dimensions.' || chr(10) ||
    'Return JSON matching this schema exactly.' || chr(10) || chr(10) || 'Schema:' || chr(10) || '{_SCHEMA_SQL}' || chr(10) || chr(10) ||
    'Conversation:' || chr(10) || text || chr(10) || chr(10) || 'Additional context JSON:' || chr(10) || CASE WHEN role = 'user' THEN
    '{{' || chr(10) || '  "role": "user",' || chr(10) || '  "turn": "' || turn || '"' || chr(10) || '}}' WHEN role = 'system' THEN '{{}}'
    ELSE '{{' || chr(10) || '  "turn": "' || turn || '"' || chr(10) || '}}' END AS prompt FROM conversations""",
)
def classification_prompt(spark, d):
    role = F.when(F.col("role") == "user", F.col("role"))
    turn = F.when(F.col("role") != "system", F.col("turn"))
    prompt = CL.classification_prompt(PROFILE, "text", {"role": role, "turn": turn})
    return table(spark, d, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


# --- dates, templates, defaults -------------------------------------------------------------
_DUE_TEXT = """CASE o_orderkey % 10 WHEN 0 THEN 'the ' || (1 + o_custkey % 31) || 'th' WHEN 1 THEN 'By end of month please'
  WHEN 2 THEN 'next Friday' WHEN 3 THEN 'Tomorrow!' WHEN 4 THEN 'in ' || (o_custkey % 40) || ' days'
  WHEN 5 THEN 'on May ' || (1 + o_custkey % 31) WHEN 6 THEN 'whenever' WHEN 7 THEN 'due 2001-02-' || printf('%02d', 1 + o_custkey % 31)
  WHEN 8 THEN 'next monday' ELSE 'February ' || (1 + o_custkey % 31) END"""


def _due_text():
    n, key = F.col("o_orderkey") % 10, F.col("o_custkey")
    day = (key % 31 + 1).cast("string")
    return (
        F.when(n == 0, F.concat(F.lit("the "), day, F.lit("th"))).when(n == 1, "By end of month please").when(n == 2, "next Friday")
        .when(n == 3, "Tomorrow!").when(n == 4, F.concat(F.lit("in "), (key % 40).cast("string"), F.lit(" days")))
        .when(n == 5, F.concat(F.lit("on May "), day)).when(n == 6, "whenever")
        .when(n == 7, F.concat(F.lit("due 2001-02-"), F.lpad(day, 2, "0"))).when(n == 8, "next monday")
        .otherwise(F.concat(F.lit("February "), day))
    )


def _month_day(month: int) -> str:
    def make(year: str) -> str:
        return f"try_cast(({year}) || '-{month:02d}-' || printf('%02d', n) AS DATE)"

    now, later = make("year(a)"), make("year(a) + 1")
    return f"CASE WHEN {now} >= a THEN {now} ELSE {later} END"


def _in_month(offset: int) -> str:
    first = f"CAST(date_trunc('month', a) + INTERVAL {offset} MONTH AS DATE)"
    return f"try_cast(strftime({first}, '%Y-%m-') || printf('%02d', n) AS DATE)"


@query(
    "due_dates",
    f"""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, 1 + o_custkey % 31 AS n, o_custkey % 40 AS span, o_orderkey % 10 AS kind FROM orders)
    SELECT o_orderkey, strftime(CASE kind WHEN 0 THEN coalesce(CASE WHEN {_in_month(0)} >= a THEN {_in_month(0)} END, {_in_month(1)}, {_in_month(2)})
      WHEN 1 THEN last_day(a) WHEN 2 THEN CAST(a + CAST(((5 - isodow(a) - 1 + 14) % 7 + 1) AS INTEGER) AS DATE) WHEN 3 THEN CAST(a + 1 AS DATE)
      WHEN 4 THEN CAST(a + CAST(span AS INTEGER) AS DATE) WHEN 5 THEN {_month_day(5)}
      WHEN 7 THEN try_cast('2001-02-' || printf('%02d', n) AS DATE)
      WHEN 8 THEN CAST(a + CAST(((1 - isodow(a) - 1 + 14) % 7 + 1) AS INTEGER) AS DATE) WHEN 9 THEN {_month_day(2)} END, '%Y-%m-%d') AS due FROM t""",
)
def due_dates(spark, d):
    due = F.date_format(RC.resolve_due_date(_due_text(), "o_orderdate"), "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", due.alias("due"))


@query(
    "task_defaults",
    """SELECT o_orderkey, 'u' || o_custkey AS "requesterId", 'task_agent' AS "sourceAgentId", 'todo' AS status, 'agent' AS source,
    CASE WHEN o_orderstatus = 'F' THEN 'high' ELSE 'medium' END AS priority, 0 AS n_tags FROM orders""",
)
def task_defaults(spark, d):
    user = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    fields = RC.task_defaults({"priority": F.when(F.col("o_orderstatus") == "F", "high").otherwise("")}, user, "task_agent")
    names = ("requesterId", "sourceAgentId", "status", "source", "priority")
    return table(spark, d, "orders").select(
        "o_orderkey", *[fields[n].alias(n) for n in names], F.size(fields["tags"]).alias("n_tags")
    )


@query(
    "rendered_templates",
    """SELECT doc_id, 'Lang ' || lang || ', ' || text || ' from ' || source || '.' AS text FROM documents""",
)
def rendered_templates(spark, d):
    template = F.lit("Lang {{ lang }}, {{text}} from {{nobody}}{{ source}}.")
    filled = P.render_template(template, {"lang": "lang", "text": "text", "source": "source"})
    return table(spark, d, "documents").select("doc_id", filled.alias("text"))


@query(
    "date_banners",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE '[System: Today''s date is ' || strftime(o_orderdate, '%A, %d %B %Y') ||
    ' (UTC). Use this as the anchor for all relative date calculations.]' || chr(10) || chr(10) || o_orderpriority END AS prompt FROM orders""",
)
def date_banners(spark, d):
    prompt = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", P.date_banner(prompt, "o_orderdate").alias("prompt"))


@query(
    "extraction_prompts",
    """SELECT doc_id, 'Extract structured data from the text below.' || chr(10) || 'Return JSON that matches this schema description:' || chr(10) ||
    '{"a": "string"}' || chr(10) || chr(10) || 'Text:' || chr(10) || text AS extract, 'Create JSON for an educational image based on the text below.'
    || chr(10) || 'Return ONLY valid JSON with these keys:' || chr(10) || '- image_description' || chr(10) || '- image_caption' || chr(10) ||
    '- image_generation_prompt' || chr(10) || chr(10) || 'Topic: ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'General' END || chr(10) ||
    'Level: ' || lang || chr(10) || 'Board: N/A' || chr(10) || chr(10) || 'Text:' || chr(10) || text AS image FROM documents""",
)
def extraction_prompts(spark, d):
    topic = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    image = P.image_metadata_prompt("text", topic, "lang", F.lit(None).cast("string"))
    return table(spark, d, "documents").select(
        "doc_id", P.extract_prompt("text", '{"a": "string"}').alias("extract"), image.alias("image")
    )


@query(
    "final_outputs",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN 'I could not complete the task.' ELSE text END END AS text,
    CASE WHEN role <> 'user' THEN CASE WHEN turn % 3 = 0 THEN CASE WHEN turn % 4 = 0 THEN 'I could not complete the task.' ELSE text END
      WHEN turn % 3 = 1 THEN 'formatting_failed' ELSE 'done' END END AS json_value FROM conversations""",
)
def final_outputs(spark, d):
    text = F.when(F.col("turn") % 4 == 0, " \n ").otherwise(F.col("text"))
    mode = F.when(F.col("role") == "user", "text").otherwise("json")
    out = P.final_output(text, mode, F.lit('{"x":"done"}'), F.col("turn") % 3 > 0, F.col("turn") % 3 == 1)
    rows = table(spark, d, "conversations").select("conv_id", "turn", out.alias("o"))
    value = F.coalesce(*[F.get_json_object("o.json", f"$.{k}") for k in ("result", "error", "x")])
    return rows.select("conv_id", "turn", "o.text", value.alias("json_value"))


@query(
    "retryable_errors",
    f"""SELECT event_id, event_type IN ('click', 'view', 'purchase') OR (event_type = 'error' AND {M.K} = 50) AS retryable FROM events""",
)
def retryable_errors(spark, d):
    kind = F.col("event_type")
    message = (
        F.when(kind == "click", "RATE LIMIT exceeded").when(kind == "view", "Too many tokens").when(kind == "purchase", "got 502")
        .when(kind == "error", F.when(M.props_k() == 50, "code 503").otherwise("code 500")).otherwise("bad key")
    )
    return table(spark, d, "events").select("event_id", TX.is_retryable_error(message).alias("retryable"))


@query(
    "providers",
    """SELECT c_custkey, replace(lower(c_mktsegment), '-', '_') || CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE ',machinery' END || ',open_ai' AS providers
    FROM customer""",
)
def providers(spark, d):
    parsed = TX.parse_providers(F.concat(F.lit(" "), F.col("c_mktsegment")), F.lit("Machinery, ,open-ai,"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(parsed, ",").alias("providers"))


@query(
    "image_names",
    """SELECT doc_id, substr(replace(lower(source || ' A ' || text), ' ', '-'), 1, 30) AS name,
    'https://x.org/' || source || CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.png' END AS url,
    CASE WHEN doc_id % 3 = 0 THEN 'existing' END AS reused, substr(text, 1, 120) AS preview FROM documents""",
)
def image_names(spark, d):
    file = F.concat(F.col("source"), F.when(F.col("doc_id") % 2 == 0, ".png").otherwise(""))
    reused = TX.reuse_image(F.when(F.col("doc_id") % 3 != 1, F.lit("u")), F.col("doc_id") % 3 == 2)
    return table(spark, d, "documents").select(
        "doc_id", TX.image_name(F.concat("source", F.lit(" A "), "text")).alias("name"),
        TX.public_url(F.lit("https://x.org//"), file).alias("url"), reused["source"].alias("reused"),
        TX.message_preview("text").alias("preview"),
    )


# --- pages -----------------------------------------------------------------------------------
@query(
    "first_headings",
    """SELECT page_id, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)[1:5],
    lambda b: trim(regexp_replace(b, '<[^>]+>', '', 'g'))), lambda t: t <> ''), lambda t: substr(t, 1, 150)), '|') AS headings FROM pages""",
)
def first_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(PG.first_headings("html"), "|").alias("headings"))


@query(
    "heading_classes",
    """SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'class="([^"]*a[^"]*)"', 1)))[1:10], '|') AS classes FROM pages""",
)
def heading_classes(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(PG.heading_classes("html", "a"), "|").alias("classes"))


@query("stripped_pages", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def stripped_pages(spark, d):
    return table(spark, d, "pages").select("page_id", RC.strip_tags("html").alias("text"))


_SNIP = "substr(html, greatest(strpos({0}, '{1}') - 1 - {2}, 0) + 1, strpos({0}, '{1}') - 1 + {3} - greatest(strpos({0}, '{1}') - 1 - {2}, 0))"


@query(
    "page_scan",
    f"""WITH s AS (SELECT page_id, CASE WHEN strpos(html, 'class') > 1 THEN {_SNIP.format('html', 'class', 300, 500)} END AS c,
    CASE WHEN strpos(lower(html), 'charset=') > 1 THEN {_SNIP.format('lower(html)', 'charset=', 200, 300)} END AS n FROM pages)
    SELECT page_id, substr(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), 1, 600) AS context,
    substr(n, 1, 500) AS around_name FROM s""",
)
def page_scan(spark, d):
    return PG.page_scan(table(spark, d, "pages"), "class", "CharSet=").select("page_id", "context", "around_name")
