"""Text and label functions (Column in, Column out)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions._util import ColumnLike, as_col, bind, lookup, strip

# --- fixed values: query wording -------------------------------------------
NUMBERED_KINDS = ("exercise", "example", "theorem", "activity")
NUMBER_PATTERN = r"\s*(\d+\.?\d*)"
VISUAL_WORDS = ("diagram", "figure", "picture", "image", "show")
EXACT_WORDS = (
    "exercise", "example", "theorem", "question", "problem",
    "solve", "find", "calculate", "prove",
)

# --- fixed values: subjects -------------------------------------------------
VALID_SUBJECTS = (
    "Mathematics", "Science", "Physics", "Chemistry", "Biology",
    "Social Science", "English", "Hindi",
)
SUBJECT_SYNONYMS = {
    "mathematics": "Mathematics", "math": "Mathematics", "maths": "Mathematics",
    "science": "Science", "sci": "Science",
    "physics": "Physics", "phy": "Physics",
    "chemistry": "Chemistry", "chem": "Chemistry",
    "biology": "Biology", "bio": "Biology",
    "social science": "Social Science", "social": "Social Science",
    "history": "Social Science", "geography": "Social Science", "civics": "Social Science",
    "political science": "Social Science", "economics": "Social Science",
    "english": "English", "eng": "English",
    "hindi": "Hindi",
}
SUBJECT_KEYWORDS = {
    "Chemistry": (
        "atom", "atomic", "molecule", "molecular", "electron", "proton",
        "neutron", "periodic", "chemical", "reaction", "acid", "base",
        "salt", "ionic", "covalent", "bond", "valence", "isotope",
        "compound", "mixture",
    ),
    "Physics": (
        "force", "motion", "velocity", "acceleration", "newton",
        "current", "voltage", "resistance", "magnet", "magnetic",
        "energy", "power", "work", "light", "optics", "ray",
        "lens", "mirror", "gravity",
    ),
    "Biology": (
        "cell", "organism", "photosynthesis", "respiration", "gene",
        "dna", "enzyme", "plant", "animal", "ecosystem",
    ),
    "Mathematics": (
        "equation", "algebra", "geometry", "triangle", "circle",
        "area", "volume", "matrix", "integral", "derivative",
        "factor", "ratio", "percent", "probability", "statistics",
    ),
    "English": (
        "grammar", "essay", "poem", "poetry", "novel",
        "verb", "noun", "adjective", "tense", "comprehension",
    ),
    "Hindi": ("व्याकरण", "कविता", "कहानी", "संज्ञा", "क्रिया", "समास", "उपसर्ग"),
    "Social Science": (
        "history", "geography", "civics", "economics", "constitution",
        "democracy", "map", "latitude", "longitude",
    ),
}
DEFAULT_SUBJECT = "Mathematics"

# --- fixed values: tools and providers --------------------------------------
TOOL_CATEGORIES = {
    "rag_search": "knowledge",
    "http_request": "api",
    "web_search": "web",
    "web_research": "web",
    "image_generate": "media",
    "file_analyze": "data",
    "json_extract": "data",
}
AUTH_TOOLS = ("http_request", "web_search", "web_research", "rag_search", "image_generate")
RETRY_SIGNALS = (
    "rate limit", "quota", "429", "timeout", "timed out", "deadline", "overloaded",
    "capacity", "context length", "token limit", "max tokens", "too many tokens",
    "service unavailable", "503", "bad gateway", "502", "not implemented",
    "finish_reason", "no text",
)
CONFIRMATION_PATTERN = r"(?iU)\b(yes|confirm|confirmed|go ahead|proceed|approved|approve|do it)\b"
# --- end of fixed values ----------------------------------------------------


def _holds_any(text: Column, words) -> Column:
    """Substring test for a word list; a literal search runs through the bytes, an alternation tries every word at every place."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words]) if words else F.when(text.isNotNull(), True)


def _contains_any(text: Column, words) -> Column:
    """:func:`_holds_any` of a computed text, which is computed once and not for every word."""
    return F.get(F.transform(F.array(text), lambda t: _holds_any(t, words)), F.lit(0))


def classify_query(query: ColumnLike, kinds=NUMBERED_KINDS, visual_words=VISUAL_WORDS) -> Column:
    """struct(type, query_type, number, heading, content_type)."""
    missing = F.lit(None).cast("string")

    def answer(type_, query_type, number=missing, heading=missing, content_type=missing):
        return F.struct(
            type_.alias("type"), query_type.alias("query_type"), number.alias("number"),
            heading.alias("heading"), content_type.alias("content_type"),
        )

    def choose(v: dict[str, Column]) -> Column:
        out = F.when(
            _contains_any(v["low"], visual_words), answer(F.lit("visual"), F.lit("visual"))
        ).otherwise(answer(F.lit("conceptual"), F.lit("conceptual")))
        for kind in reversed(kinds):
            number = F.regexp_extract(v["low"], "(?U)" + kind + NUMBER_PATTERN, 1)
            label = kind.upper() if kind == "exercise" else kind.capitalize()
            hit = answer(
                F.lit("exact"), F.lit(kind), number, F.concat(F.lit(label + " "), number), F.lit(kind)
            )
            out = F.when(number != "", hit).otherwise(out)
        return out

    return bind({"low": strip(F.lower(as_col(query)))}, choose)


def query_type(query: ColumnLike, words=EXACT_WORDS) -> Column:
    """``exact`` when any of the words occurs, else ``conceptual``."""
    return F.when(_contains_any(F.lower(as_col(query)), words), "exact").otherwise("conceptual")


def heuristic_subject(query: ColumnLike, keywords=None) -> Column:
    """first subject, in table order, with a keyword as a substring; else null."""

    def found(low: Column) -> Column:
        tests = [(s, _holds_any(low, ws)) for s, ws in (keywords or SUBJECT_KEYWORDS).items()]
        return F.coalesce(*[F.when(hit, F.lit(subject)) for subject, hit in tests])

    # Bound, so that a text is lower-cased once and not for every test.
    return F.get(F.transform(F.array(F.lower(as_col(query))), found), F.lit(0))


def normalize_subject(subject: ColumnLike) -> Column:
    """synonym map, then the default unless the result is a valid subject."""
    raw = as_col(subject)
    mapped = F.coalesce(lookup(SUBJECT_SYNONYMS, F.lower(raw)), raw)
    return F.when(mapped.isin(*VALID_SUBJECTS), mapped).otherwise(DEFAULT_SUBJECT)


def first_token(text: ColumnLike) -> Column:
    """First whitespace-separated token, null when there is none."""
    token = F.regexp_extract(as_col(text), r"(?U)([^\s\x1c-\x1f]+)", 1)
    return F.when(token != "", token)


def classify_subject(query: ColumnLike, model_label: ColumnLike, keywords=None) -> Column:
    """keyword subject, else first token of the supplied label, else the default."""
    return normalize_subject(
        F.coalesce(heuristic_subject(query, keywords), first_token(model_label), F.lit(DEFAULT_SUBJECT))
    )


def pick_intent(label: ColumnLike, intents) -> Column:
    """the label's first token when allowed, else the first intent."""
    token = first_token(label)
    return F.when(token.isin(*intents), token).otherwise(intents[0])


def slugify(name: ColumnLike) -> Column:
    """F11."""
    kept = F.regexp_replace(strip(F.lower(as_col(name))), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(kept, r"(?U)[\s_-]+", "-")


def normalize_tags(tags: ColumnLike) -> Column:
    """trimmed, non-blank tags joined by a comma and a blank; null gives ''."""
    kept = F.filter(F.transform(as_col(tags), lambda t: strip(t)), lambda t: t != "")
    return F.coalesce(F.array_join(kept, ", "), F.lit(""))


def is_retryable_error(message: ColumnLike) -> Column:
    """F29 (the not-implemented signal is one of the listed texts)."""
    return _contains_any(F.lower(as_col(message)), RETRY_SIGNALS)


def normalize_provider(name: ColumnLike) -> Column:
    """F30."""
    return F.replace(F.lower(strip(as_col(name))), F.lit("-"), F.lit("_"))


def parse_providers(primary: ColumnLike, fallbacks_csv: ColumnLike) -> Column:
    """primary first, then the fallbacks without blanks or the primary itself."""
    first = normalize_provider(primary)
    parts = F.split(F.coalesce(as_col(fallbacks_csv), F.lit("")), ",")
    rest = F.filter(F.transform(parts, lambda p: normalize_provider(p)), lambda p: (p != "") & (p != first))
    return F.concat(F.array(first), rest)


def tool_category(name: ColumnLike) -> Column:
    """F31."""
    tool = as_col(name)
    return F.when(tool.startswith("todo"), "productivity").otherwise(
        F.coalesce(lookup(TOOL_CATEGORIES, tool), F.lit("other"))
    )


def requires_auth(name: ColumnLike) -> Column:
    """F31."""
    return as_col(name).isin(*AUTH_TOOLS)


def has_confirmation(message: ColumnLike, pattern: str = CONFIRMATION_PATTERN) -> Column:
    """The latest user text contains a confirmation phrase."""
    return F.coalesce(as_col(message).rlike(pattern), F.lit(False))


def image_name(query: ColumnLike) -> Column:
    """the fallback file name made from a query."""
    return F.substring(F.replace(F.lower(as_col(query)), F.lit(" "), F.lit("-")), 1, 30)


def public_url(base: ColumnLike, name: ColumnLike) -> Column:
    """Add ``.png`` unless present and join without a double slash."""
    file = as_col(name)
    file = F.when(file.endswith(".png"), file).otherwise(F.concat(file, F.lit(".png")))
    return F.concat(F.rtrim(as_col(base), F.lit("/")), F.lit("/"), file)


def message_preview(text: ColumnLike, n: int = 120) -> Column:
    """P13."""
    return F.substring(F.coalesce(as_col(text), F.lit("")), 1, n)


def reuse_image(existing_url: ColumnLike, force: ColumnLike) -> Column:
    """struct(image_url, image_generated, source); null when one must be generated."""
    url = as_col(existing_url)
    reuse = (F.coalesce(url, F.lit("")) != "") & ~F.coalesce(as_col(force), F.lit(False))
    return F.when(
        reuse,
        F.struct(
            url.alias("image_url"), F.lit(False).alias("image_generated"), F.lit("existing").alias("source")
        ),
    )


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
