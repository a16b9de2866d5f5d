"""Exact similarity join of word-shingle sets by prefix trees.

Sets are ordered by one global order: shingle hashes, with the shingles that many prefixes hold moved
to the end.  Two sets that link share a shingle in their prefixes, so sets meet under the shingles
of their prefixes.  The work is done in this order:

1. Every set is paired with three leaders per shingle (the set with most copies there and two by hash), which
   takes a few rows per set and shingle and joins groups of near copies, however large, into
   components.  ``ROUNDS`` such rounds are done, each with the sets of other components than its leaders'.
2. Sets under shingles whose sets are still in different components meet in cells of two blocks each.  All
   sets of a cell that have a possible partner go into one trie in the global order, which each set walks.

A pair first has to pass two bounds on the overlap, by size and by a histogram of the hashes.  On a
walk the overlap counted so far is shared along shared paths, and subtrees that cannot reach the
required overlap by the remaining lengths are cut.  A cell sends out links that join the same
components as all its links, so no table of pairs grows with the square of a group.

Defined results: null or wordless texts have no shingles, link with nothing and are their own component; equal
sets are one class and copies are never paired; a row without id takes the smallest id of its
component, null if there is none; repeated rows keep their rows; other columns are not read.
Shingles and sets are compared by 63 and 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import dropped, saved, saved_parts, table, whole
from talkweave.llm.tokens import chunks, mixed, shingle_hashes, word_hashes

FREQUENT = 100  # sets with a shingle in their prefix from which it moves to the end of the order
FREQUENT_ROWS = 1 << 20  # at most so many shingles are moved
PASSES = 2
BUCKETS = 128
ROUNDS = 2
CELL = 1024  # sets of a block
CELL_SHINGLES = 1 << 20  # shingles of a block
PAIRS = 1 << 23  # bytes of the sketches that are compared at once
# Rows with texts are shuffled in so many parts, one after another, unless they are fewer than ``PART_ROWS`` a part.
PARTS = 4
PART_ROWS = 1 << 10
BITS = 1 << 24
HALF = np.uint64(1)
LAST = np.uint64(1 << 63)


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of every text."""
    for _, data, offsets in chunks(column):
        words, rows = word_hashes(data, offsets, lower=True)
        ends = np.searchsorted(rows, np.arange(len(offsets) - 1), "right").tolist()
        # Runs over the words of all texts of the chunk; those that cross texts are not read.
        runs = shingle_hashes(words, size) >> HALF
        start = 0
        for end in ends:
            if end - start >= size:
                found = np.sort(runs[start:end - size + 1])
                fresh = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=fresh[1:])
                yield found[fresh]
            elif end > start:
                yield shingle_hashes(words[start:end], size) >> HALF
            else:
                yield np.zeros(0, np.uint64)
            start = end


def set_key(tokens: np.ndarray) -> int:
    return int(mixed(mixed(tokens).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def needed(percent: int, n, m):
    """Overlap that two sets of these sizes need."""
    return -(-percent * (n + m) // (100 + percent))


def in_order(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the global order; a frequent token has its top bit set and so sorts last."""
    if len(frequent) and len(tokens):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        if often.any():
            return np.concatenate([tokens[~often], tokens[often] | LAST])
    return tokens


def sketch(tokens: np.ndarray) -> bytes:
    """Tokens per range of hashes; the sum of differences never exceeds the symmetric difference of two sets."""
    return np.minimum(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def frequent_shingles(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    """The shingles that stand in more than ``FREQUENT`` prefixes, at most ``FREQUENT_ROWS``.

    Moving them brings others into the prefixes; the next pass counts those alone.
    Any choice gives a valid order; this one keeps common passages out of the prefixes.
    """

    def counter(frequent: np.ndarray, before: np.ndarray | None):
        def run(batches):
            for batch in batches:
                found = [np.zeros(0, np.uint64)]
                for tokens in sets_of(batch.column(0), size):
                    end = prefix_size(len(tokens), percent) if len(tokens) else 0
                    moved = in_order(tokens, frequent)[:end]
                    if before is not None:
                        moved = np.setdiff1d(moved, in_order(tokens, before)[:end], assume_unique=True)
                    found.append(moved[moved < LAST])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

        return run

    frequent, before = np.zeros(0, np.uint64), None
    for _ in range(PASSES):
        tokens = docs.select(whole(F.col("text")).alias("t")).mapInArrow(counter(frequent, before), "token long")
        often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FREQUENT)
        room = FREQUENT_ROWS - len(frequent)
        most = saved(often.orderBy(F.desc("n"), "token").limit(room).select("token"), "frequent-shingles")
        new = most.toArrow()["token"].to_numpy()
        before, frequent = frequent, np.union1d(frequent, new.astype(np.int64).view(np.uint64))
        if not len(new) or len(frequent) >= FREQUENT_ROWS:
            break
    return frequent


def set_classes(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(k, n, sketch, prefix, copies): one row per distinct non-empty set."""

    def run(batches):
        for batch in batches:
            keys, sizes, sketches, prefixes = [], [], [], [np.zeros(0, np.uint64)]
            for tokens in sets_of(batch.column(0), size):
                if len(tokens):
                    keys.append(set_key(tokens))
                    sizes.append(len(tokens))
                    sketches.append(sketch(tokens))
                    prefixes.append(in_order(tokens, frequent)[:prefix_size(len(tokens), percent)])
            offsets = pa.array(np.cumsum([0, *map(len, prefixes[1:])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), lists],
                ["k", "n", "sketch", "prefix"],
            )

    rows = docs.select(whole(F.col("text")).alias("t")).mapInArrow(run, "k long, n long, sketch binary, prefix array<long>")
    return rows.groupBy("k").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "prefix")], F.count(F.lit(1)).alias("copies"))


def memberships(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, k, n): the set of every document; n is 0 and k null without shingles."""

    def run(batches):
        for batch in batches:
            keys = [(set_key(t), len(t)) if len(t) else (None, 0) for t in sets_of(batch.column(1), size)]
            k, n = zip(*keys) if keys else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "k", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole(F.col("text")).alias("t")).mapInArrow(run, f"doc_id {kind}, k long, n long")


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A filter of ``BITS`` bits, whatever the number of keys; it has false positives and no false negatives."""
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1))
    words = keys.groupBy(F.shiftright(bit, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 AS int))")).alias("b")
    ).toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64, copy=False).view(np.uint64) & np.uint64(BITS - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def contested_postings(classes: DataFrame) -> DataFrame:
    """(token, k, copies) of the prefix shingles that two or more sets hold."""
    # A set holds a shingle once, so that counts are numbers of sets.
    postings = classes.select(F.explode("prefix").alias("token"))
    held = saved(postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token"), "shared-shingles")
    bits = bit_filter(held, "token")

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            tokens = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            ok = passing(bits, tokens)
            take = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[ok]), batch.column(0).take(take), batch.column(1).take(take)], ["token", "k", "copies"]
            )

    likely = classes.select("k", "copies", "prefix").mapInArrow(run, "token long, k long, copies long")
    return likely.join(held, "token")


class Trie:
    """Ordered sets; a node is a dict from token to child, a set that shares no further token is a leaf."""

    def __init__(self, percent: int):
        self.percent = percent
        self.top = Node()

    def add(self, k: int, tokens: np.ndarray) -> None:
        node, depth, n = self.top, 0, len(tokens)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if depth == n:
                node.ends.append((k, n))
                return
            t = int(tokens[depth])
            child = node.children.get(t)
            if child is None:
                node.children[t] = (k, tokens)
                return
            if isinstance(child, tuple):
                # Two sets share the path so far: the leaf becomes a node with the leaf one step further on.
                other, held = child
                child = node.children[t] = Node()
                child.low = child.high = len(held)
                if depth + 1 == len(held):
                    child.ends.append((other, len(held)))
                else:
                    child.children[int(held[depth + 1])] = (other, held)
            node, depth = child, depth + 1

    def similar(self, tokens: np.ndarray, wanted: Callable[[int], bool] = lambda k: True) -> Iterator[int]:
        """Keys of the ``wanted`` sets whose similarity with this one reaches the percentage."""
        n, order = len(tokens), tokens.tolist()
        walk = [(self.top, 0, 0, 0)]
        while walk:
            node, place, depth, overlap = walk.pop()
            if overlap + min(n - place, node.high - depth) < needed(self.percent, n, node.low):
                continue
            for k, m in node.ends:
                if overlap >= needed(self.percent, n, m) and wanted(k):
                    yield k
            for t, child in node.children.items():
                at = bisect_left(order, t, place)
                hit = at < n and order[at] == t
                if isinstance(child, tuple):
                    k, held = child
                    want = needed(self.percent, n, len(held)) - overlap - hit
                    if min(n - at - hit, len(held) - depth - 1) >= want and wanted(k):
                        if len(np.intersect1d(tokens[at + hit:], held[depth + 1:], assume_unique=True)) >= want:
                            yield k
                else:
                    walk.append((child, at + hit, depth + 1, overlap + hit))


class Node:
    """Children by token, sets that end here, and the smallest and largest set below."""

    __slots__ = ("children", "ends", "low", "high")

    def __init__(self):
        self.children: dict = {}
        self.ends: list[tuple[int, int]] = []
        self.low, self.high = 1 << 62, 0


def possible(percent: int, n, m, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether pairs with these sizes and sketches may reach the percentage; never false for a link."""
    apart = np.abs(left.astype(np.int16) - right.astype(np.int16)).sum(axis=-1, dtype=np.int64)
    return apart <= n + m - 2 * needed(percent, n, m)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def leader_pairs(rooted: DataFrame, classes: DataFrame, percent: int, seed: int) -> DataFrame:
    """(a, b) from rows (token, k, copies, root): every set with the leaders of its shingles, where they are
    in different components and both bounds allow a link."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            take = pa.array(np.flatnonzero(possible(percent, n, m, _sketches(batch.column(4)), _sketches(batch.column(5)))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    def by_hash(i: int):
        return F.min_by("k", F.xxhash64(F.lit(seed), F.lit(i), "k"))

    leaders = rooted.groupBy("token").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("k", "copies").alias("l0"), by_hash(1).alias("l1"), by_hash(2).alias("l2")
    ).filter("lo != hi").select("token", "l0", "l1", "l2")
    met = rooted.select("token", "k", "root").join(leaders, "token").select("k", "root", F.explode(F.array_distinct(F.array("l0", "l1", "l2"))).alias("b"))
    pairs = met.filter("k != b").select(F.least("k", "b").alias("a"), F.greatest("k", "b").alias("b")).distinct()
    roots = rooted.select("k", "root").distinct()
    own = classes.select(F.col("k").alias("a"), "n", "sketch").join(roots.toDF("a", "r"), "a")
    led = classes.select(F.col("k").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other")).join(roots.toDF("b", "q"), "b")
    close = (F.col("r") != F.col("q")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    rows = pairs.join(own, "a").join(led, "b").filter(close).select("a", "b", "n", "m", "sketch", "other")
    return rows.mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(k, text): a text of each set in ``keys`` (k), and of a few others."""
    bits = bit_filter(keys, "k")

    def run(batches):
        for batch in batches:
            found = np.array([set_key(t) if len(t) else 0 for t in sets_of(batch.column(0), size)], np.int64)
            take = np.flatnonzero(passing(bits, found))
            yield pa.RecordBatch.from_arrays([pa.array(found[take]), batch.column(0).take(pa.array(take))], ["k", "text"])

    return docs.select(whole(F.col("text")).alias("t")).mapInArrow(run, "k long, text string").dropDuplicates(["k"])


def parts_by(rows: DataFrame, *keys: str) -> list[Column]:
    """Conditions on ``keys`` that cut ``rows``, a saved table, into parts."""
    parts = min(PARTS, 1 + rows.count() // PART_ROWS)
    part = F.pmod(F.xxhash64(F.lit("part"), *keys), F.lit(parts))
    return [part == p for p in range(parts)]


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, found by tries of their whole sets.

    The partners of one set that arrive in a batch share a trie.
    """

    def run(batches):
        for batch in batches:
            b = batch.column(1).to_numpy()
            # The text of a set is hashed once per run of its pairs.
            opens = np.flatnonzero(np.diff(b, prepend=b[:1] - 1))
            left, right = sets_of(batch.column(2), size), sets_of(batch.column(3).take(pa.array(opens)), size)
            out_a, out_b, trie, probe = [], [], None, None
            keys = batch.column(0).to_pylist()
            for i, (k, x) in enumerate(zip(keys, left)):
                if i == 0 or b[i] != b[i - 1]:
                    trie, probe = Trie(percent), next(right)
                trie.add(k, x)
                if i + 1 == len(b) or b[i + 1] != b[i]:
                    linked = list(trie.similar(probe))
                    out_a += linked
                    out_b += [int(b[i])] * len(linked)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    texts = saved(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("k")), size), "candidate-texts")
    left = texts.select(F.col("k").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("k").alias("b"), F.col("text").alias("right_text"))
    rows = [pairs.filter(p).join(left, "a").join(right.filter(p), "b") for p in parts_by(pairs, "b")]
    links = saved_parts([r.select("a", "b", "left_text", "right_text").mapInArrow(run, "a long, b long") for r in rows], "links")
    dropped(texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """(k, root) of every linked set: the smallest key of its component.

    Each step takes the smallest root among neighbours and follows the root's own root, and is written
    to the shared folder.
    """
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("k", "peer"), "links")
    roots = saved(edges.groupBy("k").agg(F.min("peer").alias("m")).select("k", F.least("k", "m").alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("k").alias("peer"), "root"), "peer").select("k", "root")
        lower = near.union(roots.select("k", "root")).groupBy("k").agg(F.min("root").alias("root"))
        jump = roots.select(F.col("k").alias("root"), F.col("root").alias("next"))
        step = saved(
            lower.join(jump, "root", "left").select("k", F.least("root", "next").alias("root"))
            .join(roots.select("k", F.col("root").alias("was")), "k"),
            "roots",
        )
        dropped(roots)
        roots = step
        if not step.filter("root != was").limit(1).count():
            dropped(edges)
            return step


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (lo, i, j) of a sorted stream; only the cell that may go on is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(c).to_numpy() for c in range(3)])
        starts = [0, *(np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(starts, starts[1:]):
            if held and any(held[-1].column(c)[0] != batch.column(c)[start] for c in range(3)):
                yield pa.Table.from_batches(held).combine_chunks()
                held.clear()
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def allowed_pairs(percent: int, n: np.ndarray, root: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of sets of different components that both bounds allow; sets are ordered by size."""
    ends = np.searchsorted(n, 100 * n // percent, "right")
    step = 1 + PAIRS // (BUCKETS * max(len(n), 1))
    for start in range(0, len(n), step):
        own = np.arange(start, min(start + step, len(n)))
        i = np.repeat(own, ends[own] - own - 1)
        j = np.concatenate([np.arange(x + 1, ends[x]) for x in own])
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        ok = possible(percent, n[i], n[j], sketches[i], sketches[j])
        yield i[ok], j[ok]


def cell_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(lo, i, j, k, root) of the sets that have a partner in their cell by both bounds, at most the rows that came in."""

    def run(batches):
        for cell in _by_cell(batches):
            cell = cell.take(pa.array(np.argsort(cell["n"].to_numpy(), kind="stable")))
            met = np.zeros(cell.num_rows, bool)
            for a, b in allowed_pairs(percent, cell["n"].to_numpy(), cell["root"].to_numpy(), _sketches(cell["sketch"])):
                met[a] = met[b] = True
            if met.any():
                found = cell.select(["lo", "i", "j", "k", "root"]).take(pa.array(np.flatnonzero(met)))
                yield from found.combine_chunks().to_batches()

    dealt = rows.repartition("lo", "i", "j").sortWithinPartitions("lo", "i", "j")
    return dealt.select("lo", "i", "j", "k", "root", "n", "sketch").mapInArrow(run, "lo long, i int, j int, k long, root long")


class Roots:
    """Components of the sets of a cell: those known before, joined by the links found in it."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def of(self, root: int) -> int:
        while (up := self.up.get(root, root)) != root:
            self.up[root] = self.up.get(up, up)
            root = up
        return root

    def join(self, a: int, b: int) -> None:
        self.up[self.of(a)] = self.of(b)


def cell_links(percent: int, keys: list[int], roots: list[int], sets: list[np.ndarray], frequent: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join all components that the links of a cell join, at most one less than its sets.

    One trie of the cell's sets in the global order; each set walks it before it is added.
    """
    order = sorted(range(len(sets)), key=lambda x: len(sets[x]))
    n, root = np.array([len(sets[x]) for x in order]), np.array([roots[x] for x in order])
    ends = [[] for _ in order]
    for a, b in allowed_pairs(percent, n, root, np.stack([np.frombuffer(sketch(sets[x]), np.uint8) for x in order])):
        for i, j in zip(a.tolist(), b.tolist()):
            ends[j].append(i)
    trie, joined = Trie(percent), Roots()
    for place, x in enumerate(order):
        tokens = in_order(sets[x], frequent)
        partners = set(ends[place])
        if partners:
            def open_pair(other: int) -> bool:
                return other in partners and joined.of(roots[order[other]]) != joined.of(roots[x])

            for other in trie.similar(tokens, open_pair):
                joined.join(roots[order[other]], roots[x])
                yield keys[order[other]], keys[x]
        trie.add(place, tokens)


def remaining_links(docs: DataFrame, rooted: DataFrame, classes: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Links (a, b) that join every component the leaders left apart, found by one trie per cell.

    Sets meet if they share a prefix shingle of several components; shingles with the same smallest
    component form one group, so a set is sent once per group instead of once per shingle.  Groups are dealt over cells
    of two blocks, bounded in sets and in shingles.  Rows stay within the rows of the cells: first the
    sets with a possible partner, then, with their texts, a spanning set of links.
    """
    rows = rooted.select("token", "k", "root")
    open_tokens = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("token", "lo")
    members = saved(rows.join(open_tokens, "token").select("lo", "k", "root").distinct().join(classes.select("k", "n"), "k"), "cell-members")
    blocks = members.groupBy("lo").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum("n") / CELL_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "lo").withColumn("own", own).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("lo", F.least("own", "peer").alias("i"), F.greatest("own", "peer").alias("j"), "k", "root", "n")
    candidates = saved(cell_candidates(cells.join(classes.select("k", "sketch"), "k"), percent), "cell-candidates")
    dropped(members)

    def run(batches):
        for cell in _by_cell(batches):
            sets = list(sets_of(cell["text"].combine_chunks(), size))
            links = list(cell_links(percent, cell["k"].to_pylist(), cell["root"].to_pylist(), sets, frequent))
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    texts = saved(texts_of(docs, candidates.select("k"), size), "candidate-texts")
    # A cell lies in one part.
    rows = [candidates.filter(p).join(texts, "k").repartition("lo", "i", "j").sortWithinPartitions("lo", "i", "j") for p in parts_by(candidates, "lo", "i", "j")]
    links = saved_parts([r.select("lo", "i", "j", "k", "root", "text").mapInArrow(run, "a long, b long") for r in rows], "links")
    dropped(candidates, texts)
    return links


def similar_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document (doc_id, text).

    Documents link when their sets of ``size``-word shingles have a Jaccard similarity of ``percent`` or more.
    """
    docs = docs.select("doc_id", "text")
    frequent = frequent_shingles(docs, size, percent)
    classes = saved(set_classes(docs, size, percent, frequent), "shingle-sets")
    contested = saved(contested_postings(classes), "contested")
    rooted, links, roots = contested.withColumn("root", F.col("k")), None, None
    for seed in range(ROUNDS + 1):
        if seed < ROUNDS:
            pairs = saved(leader_pairs(rooted, classes, percent, seed), "leader-pairs")
            new = verified(docs, pairs, size, percent)
            dropped(pairs)
        else:
            new = remaining_links(docs, rooted, classes, size, percent, frequent)
        links = new if links is None else links.union(new)
        if roots is None or new.limit(1).count():
            roots = components(links).select("k", "root")
            rooted = contested.join(roots, "k", "left").select("token", "k", "copies", F.coalesce("root", "k").alias("root"))
    dropped(classes, contested)
    members = saved(memberships(docs, size), "shingle-members")
    rooted = members.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    # One row per component, combined before the shuffle.
    smallest = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


@register("op5_ngram_jaccard")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "documents"), 4, 85)
