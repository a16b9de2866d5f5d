"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns.  Its key is the exclusive-or of two 64-bit hashes per turn and place, so that the
keys of all prefixes of a conversation are running values, which also a conversation that holds a third of all turns gets
in parallel chunks.

The trie is cut into units, each processed by one task: below a node with more than ``unit`` members only the child with most
members stays in its parent's unit, below any other all children do, and a new unit begins every ``band`` levels.
So a path to the root passes few units (about the logarithm of the number of conversations).

1. Within shards (units by hash): nodes are sorted in reverse level order, and every node sends its total forward to its
   parent through a priority queue that spills.
2. Across shard roots: units in reverse order of the number of units above them add the totals of the units that hang on them.
3. Within shards once more, now with the messages of the units below.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import dropped, saved, table, whole, words
from talkweave.operators.skew import SPAN, _chunked, running, running_count

UNIT = 1024
BAND = 1 << 20
# Ids of the ends of a node are joined in pieces of about so many.
ENDS = 1 << 16
QUEUE = 1 << 20
KEY = ["k1", "k2"]
PARENT = ["p1", "p2"]


class Queue:
    """A priority queue of tuples; beyond ``limit`` of them sorted runs go to a file of the task, gone when it ends."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            file, self.heap, spilled = tempfile.TemporaryFile(), [], sorted(self.heap)
            for i in range(0, len(spilled), 4096):
                pickle.dump(spilled[i:i + 4096], file)
            file.seek(0)
            self._next(self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple]) -> None:
        first = next(run, None)
        if first is not None:
            heapq.heappush(self.runs, (first, len(self.runs), run))

    def least(self) -> tuple | None:
        ends = [x for x in (self.heap[:1], [r[0] for r in self.runs[:1]]) if x]
        return min(ends)[0] if ends else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] <= self.heap[0]):
            item, _, run = heapq.heappop(self.runs)
            self._next(run)
            return item
        return heapq.heappop(self.heap)


def turns_of(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, digest, words): the digest stands for role and text; rows without conversation id are left out."""
    r, t = whole(F.col(role)), whole(F.col(text))
    return conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"),
        F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256).alias("digest"), F.size(words(F.col(text))).cast("long").alias("words"),
    )


def in_order(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """``turns`` with ``pos`` from 1: by turn, null first, ties by digest."""
    return running_count(turns, ["c"], "turn", "pos", span, ties=["digest"]).drop("turn")


def with_heads(ordered: DataFrame, donor: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Turns (c, pos, digest, words) and conversations (c) in which the first ``head`` turns of each are those of ``donor``.

    Both are columns over ``c``; ``head`` is at most ``longest``.
    """
    convs = ordered.groupBy("c").agg(F.count(F.lit(1)).alias("own")).withColumns({"b": donor, "h": head.cast("long")})
    first = ordered.filter(F.col("pos") <= longest)
    given = first.withColumnRenamed("c", "b")
    held = given.groupBy("b").agg(F.max("pos").alias("some"))
    table_of = saved(convs.join(held, "b", "left").withColumn("shift", F.least("h", F.coalesce("some", F.lit(0).cast("long")))), "conversations")
    heads = table_of.join(given, "b").filter(F.col("pos") <= F.col("h")).select("c", "pos", "digest", "words")
    own = ordered.join(table_of.select("c", "h", "shift"), "c").filter(F.col("pos") > F.col("h"))
    rest = own.select("c", (F.col("pos") - F.col("h") + F.col("shift")).alias("pos"), "digest", "words")
    return heads.union(rest), table_of.select("c")


def members_of(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """(c, depth, words, k1, k2, p1, p2): the node every turn of every conversation leads to, and its parent."""
    terms = {f"t{i}": F.xxhash64(F.lit(i), "pos", "digest") for i in (1, 2)}
    rows = turns.select("c", F.col("pos").alias("depth"), "words", *[t.alias(n) for n, t in terms.items()])
    keyed = running(rows, ["c"], "depth", {"k1": ("xor", F.col("t1")), "k2": ("xor", F.col("t2"))}, span)
    return keyed.select("c", "depth", "words", *KEY, F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"))


def ends_of(ends: DataFrame, span: int = ENDS) -> DataFrame:
    """(k1, k2, ends_sha256): digest of the comma-joined ids, ascending, of the conversations that end at a node.

    A digest needs its input in order: pieces of the list are joined in parallel and then read one after another.
    """
    ids = F.sort_array(F.collect_list("c")).cast("array<string>")
    pieces = _chunked(ends, KEY, "c", span).groupBy(*KEY, "_chunk").agg(F.array_join(ids, ",").alias("ids"))

    def run(batches):
        at, digest = None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([digest.hexdigest()])], [*KEY, "ends_sha256"]
            )

        for batch in batches:
            for k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        yield done()
                    at, digest = (k1, k2), hashlib.sha256()
                digest.update(ids.encode())
        if at is not None:
            yield done()

    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "_chunk").select(*KEY, "ids")
    return dealt.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def nodes_of(members: DataFrame, convs: DataFrame, ends_span: int = ENDS) -> DataFrame:
    """A row per node: keys, depth, conv_id, n_convs, n_children, heavy child, parent's conv_id and n_convs, own weights."""
    zero = F.lit(0).cast("long")
    # Members of a node agree in all but their id.
    inner = members.groupBy(*KEY).agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(x).alias(x) for x in ("depth", "words", *PARENT)]
    )
    blank = F.lit(None).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("depth"), zero.alias("words"), blank.alias("p1"), blank.alias("p2")
    )
    nodes = saved(inner.unionByName(root), "trie-nodes")
    last = members.groupBy("c").agg(F.max_by(F.struct(*KEY), "depth").alias("k")).select("c", "k.k1", "k.k2")
    turnless = convs.join(members.select("c"), "c", "left_anti").select("c", zero.alias("k1"), zero.alias("k2"))
    ends = ends_of(saved(last.union(turnless), "trie-ends"), ends_span)
    heavy = F.max_by(F.struct(*KEY), F.struct("n_convs", -F.col("conv_id"))).alias("heavy")
    below = nodes.filter("depth > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"), heavy).withColumnsRenamed(dict(zip(PARENT, KEY)))
    full = saved(
        nodes.join(below, KEY, "left").join(ends, KEY, "left").withColumns({
            "n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())),
        }),
        "trie-full-nodes",
    )
    # One row per parent meets all its children; adaptive execution splits a parent with very many.
    above = full.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"),
        F.col("heavy").alias("parent_heavy"),
    )
    return full.drop("heavy").join(above, PARENT, "left")


def with_units(nodes: DataFrame, members: DataFrame, unit: int = UNIT, band: int = BAND, span: int = SPAN) -> DataFrame:
    """``nodes`` with the unit they are in (depth and conv_id of its top node), its ``level``, and whether they are its top."""
    heavy = (F.col("parent_heavy.k1") == F.col("k1")) & (F.col("parent_heavy.k2") == F.col("k2"))
    top = F.col("depth").eqNullSafe(0) | ((F.col("parent_convs") > unit) & ~heavy) | (F.col("depth") % band == 0)
    marked = saved(nodes.withColumn("top", top).drop("parent_heavy", "parent_convs"), "trie-marked")
    place = F.when(F.col("top"), F.struct("depth", "conv_id"))
    paths = members.select("c", "depth", *KEY).join(marked.select(*KEY, "conv_id", "top"), KEY)
    running_tops = running(
        paths, ["c"], "depth", {"unit": ("max", place), "level": ("sum", F.col("top").cast("long"))}, span
    )
    # The first member walks a node's path; the root's unit has no top on the path below it.
    own = running_tops.filter(F.col("c") == F.col("conv_id")).select(
        *KEY, F.coalesce("unit.depth", F.lit(0).cast("long")).alias("u_depth"), F.coalesce("unit.conv_id", F.lit(-1).cast("long")).alias("u_conv"), "level"
    )
    zero = F.lit(0).cast("long")
    root = marked.filter("depth = 0").select(*KEY, zero.alias("u_depth"), F.lit(-1).cast("long").alias("u_conv"), zero.alias("level"))
    return marked.join(own.union(root), KEY)


_PASSED = [
    ("k1", "long"), ("k2", "long"), ("p1", "long"), ("p2", "long"), ("depth", "long"), ("u_depth", "long"), ("u_conv", "long"), ("level", "long"),
    ("top", "boolean"), ("conv_id", "long"), ("parent_conv_id", "long"), ("n_convs", "long"), ("n_children", "long"), ("ends_sha256", "string"),
    ("leaves", "long"), ("saved", "long"),
]


def forwarded(nodes: DataFrame, messages: DataFrame | None = None, limit: int = QUEUE) -> DataFrame:
    """``nodes`` whose ``leaves`` and ``saved`` are those of their subtrees within the unit, and of the ``messages`` below.

    Messages (k1, k2, depth, u_depth, u_conv, leaves, saved) are for nodes; there is at most one for each.
    """
    names = [n for n, _ in _PASSED]
    at = {n: i for i, n in enumerate(names)}

    def run(batches):
        queue, extra = Queue(limit), (None, 0, 0)
        for batch in batches:
            columns = {n: batch.column(at[n]).to_pylist() for n in ("k1", "k2", "p1", "p2", "depth", "top", "leaves", "saved")}
            is_node, keep, leaves, spared = batch.column(len(names)).to_pylist(), [], [], []
            for i, (k1, k2, p1, p2, depth, top, n, s) in enumerate(zip(*columns.values())):
                if not is_node[i]:
                    extra = ((k1, k2), n, s)
                    continue
                if extra[0] == (k1, k2):
                    n, s = n + extra[1], s + extra[2]
                while (least := queue.least()) and least[:3] == (-depth, k1, k2):
                    _, _, _, more, spared_below = queue.pop()
                    n, s = n + more, s + spared_below
                if not top:
                    queue.push((1 - depth, p1, p2, n, s))
                keep.append(i)
                leaves.append(n)
                spared.append(s)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-3], pa.array(leaves, pa.int64()), pa.array(spared, pa.int64())], names)

    rows = nodes.select(*names, F.lit(True).alias("is_node"))
    if messages is not None:
        rows = rows.unionByName(messages.withColumn("is_node", F.lit(False)), allowMissingColumns=True)
    # Reverse level order; a message comes before its node.
    dealt = rows.repartition("u_depth", "u_conv").sortWithinPartitions(F.desc("depth"), *KEY, "is_node")
    return dealt.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _PASSED))


def across(tops: DataFrame, parents: DataFrame) -> DataFrame:
    """Messages for the nodes that units hang on, from the tops (with totals of their own units) and all nodes as ``parents``."""
    unit = ["u_depth", "u_conv"]
    hung = parents.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("u_depth").alias("on_depth"), F.col("u_conv").alias("on_conv")
    )
    roots = saved(
        tops.select(*unit, *PARENT, "depth", "level", "leaves", "saved").join(hung, PARENT), "trie-roots"
    )
    highest = roots.agg(F.max("level")).first()[0]
    done = []
    for level in range(highest, 0, -1):
        now = roots.filter(F.col("level") == level)
        if done:
            below = done[-1].groupBy(F.col("on_depth").alias("u_depth"), F.col("on_conv").alias("u_conv")).agg(
                F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
            )
            now = now.join(below, unit, "left").withColumns({
                n: F.col(n) + F.coalesce(f"more_{n}", F.lit(0)) for n in ("leaves", "saved")
            }).drop("more_leaves", "more_saved")
        done.append(saved(now, "trie-totals"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("on_depth").alias("u_depth"), F.col("on_conv").alias("u_conv")).agg(
        (F.max("depth") - 1).alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )


def prefix_trie(
    turns: DataFrame, convs: DataFrame, unit: int = UNIT, band: int = BAND, span: int = SPAN, ends_span: int = ENDS, limit: int = QUEUE
) -> DataFrame:
    """A row per node of the trie of ``turns`` (c, pos, digest, words) of ``convs`` (c).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Defined results: rows without conversation id are left out; null roles and texts are empty; turns with one number are taken
    in the order of their digests, repeated rows as often as they occur; conversations without turns are members of
    the root; an empty table has no node; other columns are not read.  Results do not depend on the parameters.
    """
    members = saved(members_of(turns, span), "trie-members")
    units = with_units(nodes_of(members, convs, ends_span), members, unit, band, span)
    weighed = saved(
        units.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "trie-units"
    )
    dropped(members)
    done = forwarded(weighed, limit=limit)
    tops = saved(done.filter("top AND depth > 0"), "trie-tops")
    if tops.limit(1).count():
        done = forwarded(weighed, across(tops, weighed), limit)
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, sha256(length(role) || ':' || role || text) AS digest, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos
  FROM t
), crc AS (
  SELECT c, b, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))) AS inverted
  FROM (SELECT DISTINCT c, c - c % 20 AS b FROM o)
), convs AS (
  SELECT c, b, xor(inverted, 4294967295) % 4 AS h FROM crc
), sized AS (
  SELECT c, b, h, least(h, (SELECT count(*) FROM o WHERE o.c = convs.b)) AS shift FROM convs
), rebuilt AS (
  SELECT s.c, o.pos, o.digest, o.words FROM sized s JOIN o ON o.c = s.b AND o.pos <= s.h
  UNION ALL
  SELECT s.c, o.pos - s.h + s.shift, o.digest, o.words FROM sized s JOIN o ON o.c = s.c AND o.pos > s.h
), m AS (
  SELECT c, 0 AS depth, '' AS k, NULL::VARCHAR AS p, 0::BIGINT AS words FROM convs
  UNION ALL
  SELECT m.c, m.depth + 1, sha256(m.k || r.digest), m.k, r.words FROM m JOIN rebuilt r ON r.c = m.c AND r.pos = m.depth + 1
), l AS (
  SELECT *, lead(k) OVER (PARTITION BY c ORDER BY depth) IS NULL AS last FROM m
), n AS (
  SELECT k, any_value(p) AS p, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM l GROUP BY k
), ch AS (
  SELECT p AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY p
), f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)
), up AS (
  SELECT k AS top, k, p, n_children = 0 AS leaf, (n_convs - 1) * words AS own FROM f
  UNION ALL
  SELECT f.k, up.k, f.p, up.leaf, up.own FROM up JOIN f ON f.k = up.p
), tot AS (
  SELECT top, count(*) FILTER (WHERE leaf) AS n_leaves, sum(own) AS saved_tokens FROM up GROUP BY top
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN tot ON tot.top = f.k LEFT JOIN f q ON q.k = f.p
"""


@register("op11_prefix_trie", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    ordered = saved(in_order(turns_of(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")), "turns")
    head = F.crc32(F.col("c").cast("string").cast("binary")) % 4
    return prefix_trie(*with_heads(ordered, F.col("c") - F.col("c") % 20, head, 3))
