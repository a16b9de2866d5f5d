"""Main text of web pages by a maximum-scoring subsequence of words and tags.

Words score +1.  Tags score negative; their weights are learned from the pages that label themselves,
that is, hold an ``article`` or ``main`` element: tags, and words of class names, that stand outside it
cost more than those inside.  Weights are kept for the elements of HTML and the words listed below; all
other names share one, so that the table of weights has the same bound at every size.
Elements that are known not to be article text (menus, forms, adverts, reader comments, hidden ones ...)
are left out, but no content element, nothing around one and no heading because of its class or id.  One
linear scan finds the best contiguous region; the content element around the region gives the blocks.

Null html is empty; a page without text gives ''; repeated pages, ids or urls and null ones keep their
rows; an empty table gives no rows; equal regions: the first; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from functools import lru_cache
from typing import Iterator, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import table, whole

# --- fixed values: element names by role ----------------------------------------
ROOTS = frozenset("article main".split())
DROPPED = frozenset(
    "head script style noscript template iframe object svg math canvas audio video nav footer aside form button select "
    "textarea dialog menu".split()
)
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul".split()
)
CLOSES_ITSELF = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("ul ol dl table body html article main section div".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ELEMENTS = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite "
    "code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map "
    "mark math menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp "
    "script search section select slot small source span strike strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
# Words of class names and ids that say what an element is; the second kind may hold a headline inside a content element.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored promo promos promotion "
    "promotions sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus cookie cookies "
    "consent gdpr notice notices alert alerts popup modal newsletter subscribe subscription signup login share shares sharing "
    "social related recommended pagination pager widget toolbar".split()
)
OUTER_MARKS = frozenset("banner header masthead topbar".split())
# Words that say nothing by themselves.
NEUTRAL = frozenset(
    "list lists box slot section area wrap wrapper container block unit bar links link button buttons icons panel thread holder "
    "inner outer group row col column site page main user reader post posts article articles entry top bottom left right small "
    "large wide inline sticky fixed form items item meta google dfp leaderboard rail primary secondary mobile desktop global "
    "policy message text media tools count banner header".split()
)
# After these words an element holds what readers wrote, whatever follows, but for states of a whole post.
SPOKEN = frozenset("comment comments disqus".split())
STATES = frozenset("open closed on off enabled disabled allowed".split())
# --- end of fixed values ----------------------------------------------------
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
TOKEN = re.compile(
    # A tag ends at its ">", before the next "<" or with the page, so that a broken one is read once.
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)(?:>|(?=<)|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
P_SCOPES = SCOPES | {"li", "td", "th", "blockquote"}
RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
CLASS_WORDS = MARKS | OUTER_MARKS | NEUTRAL
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Names(NamedTuple):
    """What the attributes of a tag say."""

    hidden: bool  # not shown, or of a role that is no article text
    tokens: tuple[tuple[str, ...], ...]  # words of each class name and id


NO_NAMES = Names(False, ())


@lru_cache(maxsize=4096)
def names_of(attributes: str) -> Names:
    hidden, tokens, seen = False, [], set()
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in seen:
            continue  # the first of repeated attributes counts
        seen.add(key)
        if key in ("class", "id"):
            tokens += [tuple(w.lower() for w in NAME_PARTS.findall(token)) for token in value.split()]
        elif key == "role":
            hidden |= value.strip().lower() in ROLES
        elif key == "style":
            hidden |= INVISIBLE.search(value) is not None
        else:
            hidden = True
    return Names(hidden, tuple(tokens))


def spoken(tokens: tuple[tuple[str, ...], ...]) -> bool:
    """Whether a name is that of reader comments."""
    return any(w and w[0] in SPOKEN and not (len(w) > 1 and w[1] in STATES) for w in tokens)


def marked(tokens: tuple[tuple[str, ...], ...], in_root: bool) -> bool:
    """Whether a name is made up of marks and words that say nothing."""
    marks = MARKS if in_root else MARKS | OUTER_MARKS
    return spoken(tokens) or any(any(w in marks for w in t) and all(w in marks or w in NEUTRAL for w in t) for t in tokens)


class Item(NamedTuple):
    """A tag or a run of text of a page, in page order."""

    tag: str  # '' for text
    text: str
    root: int  # number of the innermost article or main element around it, -1 for none
    block: int
    words: tuple[tuple[str, ...], ...] = ()  # of the class names and id of an opening tag


class Open:
    """The open elements, and where those of a name stand, so that an end tag finds its element at once."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, int]] = []  # name, inside a left-out element, content element, place
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, out: bool, root: int, place: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, out, root, place))

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, names: tuple[str, ...], stop: frozenset[str] = frozenset()) -> None:
        """Closes the innermost element of these names, if no element of ``stop`` is inside it."""
        at = self.last(names)
        if at < 0 or at < self.last(stop):
            return
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()

    def left_out(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def root(self) -> int:
        return self.stack[-1][2] if self.stack else -1


def _around_roots(page: str) -> set[int]:
    """Places of the elements that hold a content element."""
    around: set[int] = set()
    for _ in items(page, around, True):
        pass
    return around


def items(page: str, around: set[int] | None = None, collect: bool = False) -> Iterator[Item]:
    """Tags and text outside left-out elements, with the block and the content element they belong to.

    ``around`` has the places of elements that hold a content element, found when first needed; with
    ``collect`` they are put into it and no element is left out because of its class or id, but for comments
    that are content elements by name.
    """
    opened = Open()
    at = block = roots = 0
    size = len(page)
    while at < size:
        found = TOKEN.search(page, at)
        end = found.start() if found else size
        if end > at and not opened.left_out():
            yield Item("", page[at:end], opened.root(), block)
        if not found:
            return
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            block += 1
        if found[1]:
            opened.close((name,))
            if not opened.left_out():
                yield Item("/" + name, "", opened.root(), block)
            continue
        if name in BLOCKS and name != "p":
            opened.close(("p",), SCOPES)
        elif name == "p":
            opened.close(("p",), P_SCOPES)
        if name in CLOSES_ITSELF:
            opened.close(CLOSES_ITSELF[name], SCOPES)
        names = names_of(found[3]) if found[3].strip() else NO_NAMES
        inside = opened.root() >= 0
        out = opened.left_out() or name in DROPPED or (name == "header" and not inside)
        if not out and name not in ("html", "body"):
            out = names.hidden
            if name in ROOTS:
                out |= name != "main" and spoken(names.tokens)
            elif name not in HEADINGS and not collect and marked(names.tokens, inside):
                if around is None:
                    around = _around_roots(page)
                out |= found.start() not in around
        if not out:
            yield Item(name, "", opened.root(), block, names.tokens)
        if name in RAW:
            # Raw text ends at its own end tag only.
            stop = RAW_ENDS[name].search(page, at)
            if not out and name != "title":
                yield Item("", page[at:stop.start() if stop else size], opened.root(), block)
            at = stop.end() if stop else size
        elif name not in VOID and not found[3].endswith("/"):
            inner = opened.root()
            if name in ROOTS and not out:
                inner, roots = roots, roots + 1
                if collect:
                    # What is around an element in the set is in the set.
                    for *_, place in reversed(opened.stack):
                        if place in around:
                            break
                        around.add(place)
            opened.push(name, out, inner, found.start())


def keys_of(part: Item) -> set[str]:
    """Names under which a tag has its weight: the tag, and the words of an opening tag's class names."""
    bare = part.tag.lstrip("/")
    keys = {part.tag if bare in ELEMENTS else "/?" if part.tag[0] == "/" else "?"}
    return keys.union(f".{w}" if w in CLASS_WORDS else ".?" for token in part.words for w in token)


def score(part: Item, weights: dict[str, float], default: float) -> float:
    """Words of a text; the weight of a tag, less the most telling word of its class names."""
    if not part.tag:
        return float(len(part.text.split()))
    tag, *_ = keys = sorted(keys_of(part), key=lambda k: k[0] == ".")
    return weights.get(tag, default) + min((weights.get(k, 0.0) for k in keys[1:]), default=0.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum; the first one of equal sums."""
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_span = total, (start, i + 1)
    return best_span


def extract(page: str, weights: dict[str, float], default: float = -1.0) -> str:
    """Blocks of the content element (or else the region) that the best run of words lies in."""
    parts = list(items(page))
    scores = [score(p, weights, default) for p in parts]
    start, end = best_region(scores)
    if start == end:
        return ""
    by_root: Counter = Counter()
    for p, s in zip(parts[start:end], scores[start:end]):
        if not p.tag:
            by_root[p.root] += s
    if max(by_root) >= 0:
        # Content elements that the region touches are kept whole.
        roots = {r for r in by_root if r >= 0}
        chosen = [p for p in parts if p.root in roots]
    else:
        first, last = parts[start].block, parts[end - 1].block
        chosen = [p for p in parts if first <= p.block <= last]
    blocks: dict[int, list[str]] = {}
    for p in chosen:
        if not p.tag:
            blocks.setdefault(p.block, []).append(entities.unescape(p.text))
        elif p.tag == "br":
            blocks.setdefault(p.block, []).append(" ")
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n\n".join(line for line in lines if line)


def tag_weights(pages: DataFrame, html: str) -> dict[str, float]:
    """Negative weight of each name of :func:`keys_of`, from all pages that hold a content element.

    A tag costs one word, and more by the log odds of standing outside the content element; a word of a class
    name costs these log odds.  The names are those of the lists above, at most some 500 rows.
    """

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for page in batch.column(0).to_pylist():
                parts = list(items(page))
                if any(p.tag and p.root >= 0 for p in parts):
                    seen.update((k, p.root >= 0) for p in parts if p.tag for k in keys_of(p))
            tags, inside = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tags, pa.string()), pa.array(inside, pa.bool_()), pa.array(list(seen.values()), pa.int64())],
                ["tag", "inside", "n"],
            )

    counted = pages.select(whole(F.col(html))).mapInArrow(count, "tag string, inside boolean, n long")
    sums = counted.groupBy("tag").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inner"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outer"),
    )

    def weight(tag: str, inner: int, outer: int) -> float:
        odds = max(0.0, math.log((outer + 1) / (inner + 1)))
        return -odds if tag[0] == "." else -1.0 - odds

    return {r["tag"]: weight(*r) for r in sums.select("tag", "inner", "outer").collect()}


def main_text(pages: DataFrame, html: str, weights: dict[str, float]) -> DataFrame:
    """``pages`` with ``text``, the main text ('' if none); an input column of that name is replaced."""
    keep = [c for c in pages.columns if c != "text" or c == html]
    names = [f"c{i}" for i in range(len(keep))]
    plain = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [extract(p, weights) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*names, "_text"])

    out = plain.withColumn("_html", whole(F.col(names[keep.index(html)]))).mapInArrow(run, f"{schema}, _text string")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names) if c != "text"], F.col("_text").alias("text"))


@register("op9_html_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    weights = tag_weights(pages, "html")
    done = main_text(pages, "html", weights)
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
