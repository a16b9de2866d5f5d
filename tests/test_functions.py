"""Hand-computed values of the column functions."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from talkweave.functions import jsontext as J
from talkweave.functions import mail as M
from talkweave.functions import prompts as P
from talkweave.functions import records as R
from talkweave.functions import text as T
from talkweave.sources import attachments as A

lit = F.lit


@pytest.mark.parametrize(
    "query, type_, number, heading",
    [
        ("Exercise 1.1", "exact", "1.1", "EXERCISE 1.1"),
        ("see example2", "exact", "2", "Example 2"),
        ("theorem 3 or exercise 4", "exact", "4", "EXERCISE 4"),
        ("show me", "visual", None, None),
        ("why is it so", "conceptual", None, None),
    ],
)
def test_classify_query(value, query, type_, number, heading):
    row = value(T.classify_query(lit(query)))
    assert (row["type"], row["number"], row["heading"]) == (type_, number, heading)


def test_query_type(value):
    assert value(T.query_type(lit("Please SOLVE it"))) == "exact"
    assert value(T.query_type(lit("why"))) == "conceptual"


@pytest.mark.parametrize(
    "query, label, subject",
    [
        ("the force on an atom", None, "Chemistry"),  # table order decides
        ("a database", None, "Chemistry"),  # "base" inside a word
        ("यह कविता", None, "Hindi"),
        ("history of it", None, "Social Science"),
        ("xyz", "Social Science", "Social Science"),
        ("xyz", "phy stuff", "Physics"),
        ("xyz", "Astrology", "Mathematics"),
        ("xyz", None, "Mathematics"),
    ],
)
def test_classify_subject(value, query, label, subject):
    assert value(T.classify_subject(lit(query), lit(label).cast("string"))) == subject


def test_small_text_functions(value):
    assert value(T.pick_intent(lit("greet now"), ["ask", "greet"])) == "greet"
    assert value(T.pick_intent(lit(""), ["ask", "greet"])) == "ask"
    assert value(T.slugify(lit(" Héllo, World_ a--b \n"))) == "héllo-world-a-b"
    assert value(T.normalize_tags(F.array(lit(" a "), lit(" "), lit("b")))) == "a, b"
    assert value(T.normalize_tags(lit(None).cast("array<string>"))) == ""
    assert value(T.parse_providers(lit("Open-AI "), lit("x, open-ai,, Y"))) == ["open_ai", "x", "y"]
    assert value(T.tool_category(lit("todo_list"))) == "productivity"
    assert value(T.tool_category(lit("rag_search"))) == "knowledge"
    assert value(T.tool_category(lit("zzz"))) == "other"
    assert value(T.requires_auth(lit("web_search"))) is True
    assert value(T.has_confirmation(lit("Please GO AHEAD!"))) is True
    assert value(T.has_confirmation(lit("yesterday"))) is False
    assert value(T.public_url(lit("http://h/"), lit("a"))) == "http://h/a.png"
    assert value(T.reuse_image(lit("u"), lit(False)))["source"] == "existing"
    assert value(T.reuse_image(lit("u"), lit(True))) is None


# --- mail -----------------------------------------------------------------------------
def model_spam(subject, body):
    """Row-wise model: a list of (count or flag, weight, text)."""
    both = (subject + " " + body).lower()
    hits = []
    for word in M.SPAM_KEYWORDS:
        n = len(re.findall(rf"\b{word}\b", both))
        hits.append((n > 0, -min(n / 2, 2), f"Spammy keyword found: '{word}' ({n}x)"))
    links = len(re.findall("https?://", body))
    hits.append((subject.isupper() and len(subject) > 5, -2, "Subject is all caps"))
    hits.append(("!!!" in subject or "???" in subject, -1, "Excessive punctuation in subject"))
    hits.append((links > 3, -1.5, f"Too many links ({links})"))
    hits.append((len(body.split()) < 20, -1, "Email body is too short"))
    hits.append(("unsubscribe" in body.lower() or "opt-out" in body.lower(), 1, "Unsubscribe link detected (+1)"))
    score = 10 + sum(w for hit, w, _ in hits if hit)
    return max(0.0, min(10.0, score)), [t for hit, _, t in hits if hit]


def test_spam_score_matches_row_model(spark):
    rng = random.Random(7)
    words = [
        "free", "éfree", "winner", "no cost", "Cash", "act now", "http://x", "opt-out", "tree", "SAVE", "a", "été", "offer,",
        "free free", "_free",
    ]
    rows = [
        (rng.choice(["HELLO!", "ABCDE", "ABCDEF", "Hi???", "x!!!", ""]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))))
        for _ in range(200)
    ]
    frame = spark.createDataFrame(rows, "s string, b string").select("s", "b", M.spam_score("s", "b").alias("r"))
    for row in frame.collect():
        assert (row["r"]["score"], list(row["r"]["triggers"])) == model_spam(row["s"], row["b"])


def test_spam_score_traps(value):
    long_body = "word " * 20
    assert value(M.spam_score(lit("hi"), lit(long_body + "winner")))["score"] == 9.0  # counted twice
    assert value(M.spam_score(lit("hi"), lit(long_body + "free " * 5)))["score"] == 8.0  # capped
    assert value(M.spam_score(lit("ABCDE"), lit(long_body)))["score"] == 10.0
    assert value(M.spam_score(lit("ABCDEF"), lit(long_body)))["status"] == "Good"
    assert value(M.spam_score(lit("hi"), lit(long_body + "opt-out")))["score"] == 10.0


def test_email(value):
    good, bad = ["a@b.co", "a.b+c@x-y.example.org"], ["a@b", "a..b@c.com", "@c.com", "a b@c.com", "a@-b.com", "a@b.c"]
    assert all(value(M.email_syntax(lit(e))) for e in good)
    assert not any(value(M.email_syntax(lit(e))) for e in bad)
    assert value(M.is_generic_email(lit("Info@x.com"))) and not value(M.is_generic_email(lit("info")))


@pytest.mark.parametrize(
    "email, mx, code, other, error, status, message",
    [
        ("a@b.co", "mx", 250, 550, None, "valid", "Email is valid and reachable."),
        ("a@b.co", "mx", 250, 250, None, "valid", "Valid (Catch-all domain)"),
        ("a@b.co", "x.OUTLOOK.com", 550, 550, None, "risky", None),
        ("a@b.co", "mx", 550, 550, None, "invalid", "Mailbox does not exist (550)."),
        ("a@b.co", "mx", 451, 550, None, "risky", "Server responded with code 451"),
        ("a@b.co", None, None, None, None, "invalid", "No MX records found for b.co"),
        ("a@b.co", "mx", None, None, "boom", "risky", "SMTP Verification failed: boom"),
        ("a", "mx", 250, 550, None, "invalid", None),
    ],
)
def test_email_status(value, email, mx, code, other, error, status, message):
    row = value(M.email_status(lit(email), lit(mx).cast("string"), lit(code).cast("int"), lit(other).cast("int"), lit(error).cast("string")))
    assert row["status"] == status
    assert message is None or row["message"] == message


def test_lead_quality_and_subject(value):
    assert value(M.lead_quality(lit("valid"), lit(""), lit(None))) == "Passed"
    assert value(M.lead_quality(lit("valid"), lit("FREE CASH!!!"), lit(""))) == "Needs Review"
    assert value(M.lead_quality(lit("risky"), lit(""), lit(""))) == "Needs Review"
    row = value(M.subject_line(lit("**Subject:** Hello\n\nBody\n\nmore")))
    assert (row["subject"], row["body"]) == ("Hello", "Body\n\nmore")


# --- JSON ------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"a":1}', {"a": 1}),
        ('{"a":1,}', {"a": 1}),
        ('{"a":1\n"b":2}', {"a": 1, "b": 2}),
        ("{'a': 'x'}", {"a": "x"}),
        ('```json\n{"a":1}\n```', {"a": 1}),
        ('text {"a": [1, 2]} more', {"a": [1, 2]}),
        ('{"a":1} {"b":2}', {"a": 1}),
        ('{"a":"}"} x', {"a": "}"}),
        ('{"a": NaN}', {"a": None}),
        ('{"a":1} trailing', {"a": 1}),
        ("  ", {}),
        ("hopeless", {"error": "malformed_json", "raw": "hopeless"}),
        ("[1, 2", {"error": "malformed_json", "raw": "[1, 2"}),
        ("42", 42),
        ('{bad} then {"ok": true}', {"ok": True}),
    ],
)
def test_extract_json(value, text, expected):
    assert json.loads(value(F.to_json(J.extract_json(lit(text))))) == expected


def model_spans(text):
    """Plain scan for the balanced spans."""
    for start, ch in enumerate(text):
        if ch in "{[":
            closing, depth = {"{": "}", "[": "]"}[ch], 0
            for end in range(start, len(text)):
                depth += (text[end] == ch) - (text[end] == closing)
                if depth == 0 and text[end] == closing:
                    yield text[start : end + 1]


def test_balanced_spans_match_plain_scan():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("{}[]a") for _ in range(rng.randint(0, 14)))
        assert [text[a : b + 1] for a, ends in J.balanced_ends(text) for b in ends] == list(model_spans(text))


def model_find(text):
    """Every balanced span in turn, then the text, each parsed as it is, repaired and by its widest object."""
    try:
        return json.dumps(J._loads(text), ensure_ascii=False)
    except ValueError:
        pass
    for candidate in [*model_spans(text), text]:
        found, value = J._loads_safely(candidate)
        if found:
            return json.dumps(value, ensure_ascii=False)
    return None


def test_find_json_matches_plain_scan():
    rng = random.Random(5)
    marks = ["{", "}", "[", "]", '"', "'", ":", ",", "a", "1", " ", "\n", "{'a':", '{"a":', "'b'", '"c"', "true"]
    for _ in range(20000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 24)))
        assert J.find_json(text) == model_find(text), text


@pytest.mark.parametrize("piece", ["{a b} ", "[a b] ", "{'a b} ", '{"a b} ', "[a b] {c} ", "[{a] ", "{'a': 'b} "])
def test_find_json_is_fast_on_text_that_is_no_json(piece):
    start = time.perf_counter()
    assert J.find_json(piece * 4000) is None
    assert time.perf_counter() - start < 5


def test_strict_json(value):
    strict = lambda t: value(J.is_strict_json(lit(t)))
    assert all(map(strict, ['{"a":1}', "[]", '"s"', " 1 ", "null"]))
    assert not any(map(strict, ['{"a":1} x', "1, 2", "", "[1", '{"a":1}] x', "1], [2", "{'a':1}", '1,"end-of-text"']))


def test_json_functions_on_random_text(spark):
    """Strict parsing and repair against the standard library on damaged documents."""
    rng = random.Random(23)
    texts = []
    for _ in range(400):
        doc = json.dumps({"a": rng.randint(0, 9), "b": [rng.choice("xyz"), None], "c": {"d": rng.random() < 0.5}}, indent=rng.choice([None, 1]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(doc))
            doc = doc[:at] + rng.choice([",", "'", "}", "{", "]", "\n", '"', " x", ""]) + doc[at + rng.randint(0, 1):]
        texts.append(doc)

    def loads(text):
        try:
            # Repeated keys are an error of the strict parser, and left to the fallback.
            return [json.loads(text, object_pairs_hook=lambda p: dict(p) if len(dict(p)) == len(p) else 1 / 0)]
        except (ValueError, ZeroDivisionError):
            return []

    def repaired(text):
        for pattern, replacement in J.REPAIRS:
            text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", replacement), text)
        return text

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    strict, fixed, found = (F.to_json(J.strict_json("t")), J.repair_json("t"), F.to_json(J.extract_json("t")))
    for row in frame.select("t", strict.alias("s"), fixed.alias("r"), found.alias("f")).collect():
        assert ([] if row["s"] is None else [json.loads(row["s"])]) == loads(row["t"])
        assert row["r"] == repaired(row["t"])
        want = J.find_json(row["t"].strip())
        assert json.loads(row["f"]) == (json.loads(want) if want else {"error": "malformed_json", "raw": row["t"].strip()[:200]})


def test_safe_json(value):
    assert value(F.to_json(J.safe_json(lit("x {'a': 1,} y")))) == '{"a":1}'
    assert value(J.safe_json(lit("x")).isNull())
    assert value(J.strip_fences(lit("```\na\nb\n```"))) == "a\nb"
    assert value(J.strip_fences(lit("```\nb"))) == "```\nb"


STATE = '{"a":{"t":true,"f":false,"z":0,"e":"","l":[],"n":null,"d":1.0,"s":"x","o":{},"w":"[]"}}'


@pytest.mark.parametrize(
    "condition, expected",
    [
        ("always", True), ("", True), (None, True), ("truthy:a.t", True), ("truthy:a.f", False), ("truthy:a.z", False),
        ("truthy:a.e", False), ("truthy:a.l", False), ("truthy:a.n", False), ("truthy:a.o", False), ("truthy:a.w", True),
        ("truthy:a", True), ("truthy:a.missing", False), ("exists:a.n", False), ("exists:a.f", True), ("exists:a.q", False),
        ("equals:a.t:True", True), ("equals:a.t:true", False), ("equals:a.n:None", True), ("equals:a.d:1.0", True),
        ("equals:a.s:x", True), ("equals:a.q:", True), ("not_equals:a.s:y", True), ("not_equals:a.s:x", False),
        ("equals:a.s", False), ("nonsense", False),
    ],
)
def test_check_condition(value, condition, expected):
    assert value(J.check_condition(condition, F.parse_json(lit(STATE)))) is expected


def test_map_outputs(value):
    state, out = F.parse_json(lit('{"a":{"b":1},"k":5}')), F.parse_json(lit('{"t":"x","r":{"q":[1]}}'))
    written = J.map_outputs(state, out, {"a.c": "r.q", "k.deep": "t", "none": "zz"})
    assert json.loads(value(F.to_json(written))) == {"a": {"b": 1, "c": [1]}, "k": {"deep": "x"}, "none": None}


# --- records --------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, anchor, due",
    [
        ("by the 31st", "2023-04-15", "2023-05-31"), ("31st", "2023-05-31", "2023-05-31"), ("15th", "2023-05-20", "2023-06-15"),
        ("30th", "2023-01-31", "2023-03-30"), ("end of month", "2024-02-10", "2024-02-29"), ("END OF THE MONTH", "2023-02-01", "2023-02-28"),
        ("next Friday", "2023-06-02", "2023-06-09"), ("next monday", "2023-06-02", "2023-06-05"), ("tomorrow", "2023-12-31", "2024-01-01"),
        ("in 3 days", "2023-06-02", "2023-06-05"), ("in 2 weeks", "2023-06-02", "2023-06-16"), ("May 31", "2023-06-02", "2024-05-31"),
        ("May 31", "2023-05-31", "2023-05-31"), ("dec 5th, 2022", "2023-05-31", "2022-12-05"), ("Feb 29", "2023-01-10", "2024-02-29"),
        ("Feb 29", "2022-01-10", None), ("someday", "2023-01-10", None), ("2025-02-30", "2023-01-10", None),
        ("2025-02-03", "2023-01-10", "2025-02-03"),
    ],
)
def test_resolve_due_date(value, text, anchor, due):
    found = value(R.resolve_due_date(lit(text), F.to_date(lit(anchor))))
    assert (str(found) if found else None) == due


def test_parse_profile(value):
    def profile(**cells):
        named = {k.replace("Class_Course", "Class/Course"): lit(v) for k, v in cells.items()}
        return value(F.struct(*[c.alias(n) for n, c in R.parse_profile(named).items()]))

    assert profile(Class_Course="Class 11", Board="ICSE")["class"] == "Class_11"
    assert profile(Class_Course="Class 11", Board="ICSE")["board"] == "ICSE"
    college = profile(Class_Course="B.Tech", Institute_Type="College", Board="X")
    assert (college["class"], college["board"], college["course"]) == ("Class_10", None, "B.Tech")
    assert profile(Learning_Preferences="", Learning_Prefrences="audio")["learning_preferences"] == "audio"


def test_small_records(value):
    left, right = F.create_map(lit("a"), lit("1"), lit("token"), lit("t")), F.create_map(lit("a"), lit("2"))
    assert value(R.redact_context(R.merge_context(left, right))) == {"a": "2"}
    assert value(R.missing_args(lit('{"a":null}'), F.array(lit("a"), lit("b")))) == ["b"]
    clip = value(R.clip_block(lit("abc   def"), lit("n"), 5))
    assert clip["block"] == "abc\n\n[Attachment text truncated at 5 characters]"
    assert (clip["chars_extracted"], clip["note"]) == (3, "n; truncated at 5 characters")
    assert value(R.clip_block(lit("abcde"), lit("n"), 5))["block"] == "abcde"
    assert value(R.snippet_around(lit("ab NEEDLE cd"), "needle", 2, 8, True)) == "b NEEDLE c"
    assert value(R.snippet_around(lit("needle"), "needle", 2, 8)) is None
    assert value(R.decision_kind(F.parse_json(lit('{"type":" TOOL_CALL ","tool_name":" x "}'))))["tool_name"] == "x"
    assert value(R.decision_kind(F.parse_json(lit('{"type":"x"}'))))["kind"] == "invalid"


def test_prompts(value):
    context = F.create_map(lit("name"), lit("{{x}}"))
    assert value(P.render_with_map(lit("Hi {{ name }} {{x}}!"), context)) == "Hi {{x}} !"
    assert value(P.date_banner(lit(""), F.to_date(lit("2024-02-29")))) == ""
    assert value(P.date_banner(lit("p"), F.to_date(lit("2024-02-29")))).startswith("[System: Today's date is Thursday, 29 February 2024 (UTC).")
    out = value(P.final_output(lit(" "), lit("json"), lit("{}"), lit(True), lit(True)))
    assert json.loads(out["json"]) == {"error": "formatting_failed", "text_fallback": "I could not complete the task."}
    assert value(P.final_output(lit("a"), lit("text"), lit(None).cast("string"), lit(False), lit(False)))["text"] == "a"


@pytest.mark.parametrize(
    "name, declared, mime, kind",
    [
        ("a.PNG", None, "image/png", "image"), ("a.txt", "Text/Markdown; charset=x", "text/markdown", "text"),
        ("a.xlsx", "application/octet-stream", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "spreadsheet"),
        ("a.xls", "", "application/vnd.ms-excel", "unsupported"), ("noext", None, "application/octet-stream", "unsupported"),
        (".png", None, "application/octet-stream", "unsupported"), ("dir.png/file", None, "application/octet-stream", "unsupported"),
        ("a.b.Csv", None, "text/csv", "text"), ("v.webm", "video/webm", "video/webm", "audio"),
    ],
)
def test_mime(value, name, declared, mime, kind):
    found = A.infer_mime(lit(name), lit(declared).cast("string"))
    assert value(found) == mime
    assert value(A.attachment_kind(found)) == kind


def test_spam_keywords_that_hold_each_other(value):
    """A keyword counts wherever it stands as a whole word, also inside or over longer ones."""
    words = ("free", "free money", "money", "money back", "c++", "back")
    r = value(M.spam_score(lit("Free money back"), lit("freedom FREE money, moneyback back. " + "word " * 30), words))
    assert [t for t in r["triggers"] if "Spammy" in t] == [
        "Spammy keyword found: 'free' (2x)", "Spammy keyword found: 'free money' (2x)", "Spammy keyword found: 'money' (2x)",
        "Spammy keyword found: 'money back' (1x)", "Spammy keyword found: 'back' (2x)",
    ]
    assert value(M.spam_score(lit("hi"), lit("word " * 30), ()))["score"] == 10.0


def test_whole_blocks_without_a_limit(value):
    clip = value(R.clip_block(lit("x" * 200_000), lit("n")))
    assert (len(clip["block"]), clip["chars_extracted"], clip["note"]) == (200_000, 200_000, "n")


def test_subject_keywords_are_searched_literally_in_a_text_lowered_once(spark, value):
    # Every subject lower-cased the text again and tried all of its words at every place.
    plan = spark.range(1).select(T.heuristic_subject(F.col("id").cast("string")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") == 1 and "RLIKE" not in plan
    assert value(T.heuristic_subject(F.lit("x MoLeCuLe y"))) == "Chemistry"
    assert value(T.heuristic_subject(F.lit(None).cast("string"))) is None
    assert value(T.heuristic_subject(F.lit("q.*"), {"A": ("q.x",), "B": (".*",)})) == "B"
