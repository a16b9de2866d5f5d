"""Removal of byte strings of ``WIDTH`` bytes that occur anywhere else, by difference-cover samples of the suffixes.

Only the first ``WIDTH`` bytes of suffixes matter, so the suffix order is taken to that depth.  Names stand for strings: a
string of 24 bytes is named by a triple of 8-byte words, one of 68 bytes by a triple of such names, one of 200 by
a triple of those.

1. Sampled suffixes: positions whose remainder modulo ``PERIOD`` is in ``COVER``.  For any two positions there is one
   distance below ``PERIOD`` at which both are sampled, so two equal strings of 200 bytes hold two equal sampled strings of 68.
   The samples' names are sorted and adjacent ones compared; a name that occurs once is settled and leaves.
2. Recursion on the names: for the samples left, the names of 134 bytes to the left and to the right of them.
3. Merging the remaining suffixes: those positions whose string of 200 bytes holds such a repeated part are named by 128
   bits, sorted, and adjacent ones compared.

Steps 1 and 3 are done in rounds, each for a part of the names, which bounds the disk that a shuffle takes.

Equal texts are gathered into one first, so that a group of copies costs what one text costs; a text that occurs twice
is removed whole.  Names are dealt into shards by their value, as arrays, and sorted there.  A name that occurs more often in
one batch of texts is known to be repeated and is sent once, so that a common passage sends a row per batch, not per text.

Defined results: null text is empty; texts below 200 bytes are kept whole; rows without id or repeated rows are rows like any
other; an empty table gives an empty one; other columns are kept by ``without_repeats`` and else not read.  Two different strings
count as equal only if both 64-bit names agree.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import dropped, saved, table, whole
from talkweave.llm.tokens import chunks, mixed

# A perfect difference set, whose differences are all remainders modulo 133.
COVER = np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])
PERIOD = 133
WIDTH = 200
SAMPLE = WIDTH - PERIOD + 1
# The strings beside a sample reach so far to the left, or so much further to the right.
SIDE = (PERIOD - 1) // 2
ROUNDS = (2, 4)
# Bytes of text that are worked on at once, and names of a shard.
BATCH = 1 << 21
SHARD = 1 << 18
LEFT, RIGHT, FULL = range(3)
NEW, REPEATED, REPORTED = range(3)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_BITS = [np.uint64(x) for x in (32, 29, 31)]


class Names:
    """Names of the strings of one text that begin at given positions; ``salt`` gives other, independent names."""

    def __init__(self, raw: np.ndarray, salt: int = 0):
        self.words = np.ndarray((max(len(raw) - 7, 0),), "<u8", buffer=raw, strides=(1,)) if len(raw) > 7 else np.zeros(0, np.uint64)
        self.seed, (self.x, self.y, self.z) = np.uint64(salt), np.roll(_FACTORS, salt)[:3]

    def triple(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (a ^ self.seed) * self.x
        h ^= h >> _BITS[0]
        h += b
        h *= self.y
        h ^= h >> _BITS[1]
        h += c
        h *= self.z
        h ^= h >> _BITS[2]
        return h

    def of24(self, at: np.ndarray) -> np.ndarray:
        return self.triple(self.words[at], self.words[at + 8], self.words[at + 16])

    def of_sample(self, at: np.ndarray) -> np.ndarray:
        step = (SAMPLE - 24) // 2
        return self.triple(self.of24(at), self.of24(at + step), self.of24(at + SAMPLE - 24))

    def of_side(self, at: np.ndarray) -> np.ndarray:
        """Names of SIDE + SAMPLE bytes."""
        name = self.of_sample(at)
        return self.triple(name, self.of_sample(at + SIDE), name)

    def of_width(self, at: np.ndarray) -> np.ndarray:
        step = (WIDTH - SAMPLE) // 2
        return self.triple(self.of_sample(at), self.of_sample(at + step), self.of_sample(at + WIDTH - SAMPLE))


def pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The positions of sorted disjoint ranges [start, end), in runs of about ``BATCH``."""
    cuts = -(-(ends - starts) // BATCH)
    starts, ends = (np.repeat(x, cuts) for x in (starts, ends))
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    starts = starts + nth * BATCH
    sizes = np.minimum(ends - starts, BATCH)
    upto, at = np.cumsum(sizes), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + BATCH, "right")))
        size = sizes[at:stop]
        yield np.repeat(starts[at:stop] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        at = stop


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges [start, end) as sorted disjoint ranges that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


class Distinct:
    """Groups of equal rows of some columns: the place of the first of each group, its size, and the group of every row."""

    def __init__(self, *columns: np.ndarray):
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        self.first = order[new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.size = np.bincount(self.group, minlength=len(self.first))


class Texts:
    """Some texts side by side; positions count from the start of the first."""

    def __init__(self, rows: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        self.rows, self.raw, self.starts, self.ends = rows, raw, offsets[:-1], offsets[1:]
        self.names, self.others = Names(raw), Names(raw, 1)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def samples(self) -> Iterator[np.ndarray]:
        """Sampled positions; those of one text come together unless it is longer than a batch."""
        blocks = np.maximum(-(-(self.ends - self.starts - SAMPLE + 1) // PERIOD), 0)
        first = np.repeat(self.starts, blocks) + PERIOD * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        last = np.repeat(self.ends, blocks) - SAMPLE
        for i in range(0, len(first), BATCH // len(COVER)):
            part = slice(i, i + BATCH // len(COVER))
            at = first[part, None] + COVER
            yield at[at <= last[part, None]]

    def all_of(self, column: pa.Array, step: int = 1) -> np.ndarray:
        """The positions in a list column, where they are coded as multiples of ``step``, all texts' together."""
        return column.flatten().to_numpy() // step + np.repeat(self.starts, column.value_lengths().to_numpy())

    def lists(self, *columns: np.ndarray) -> list[pa.Array]:
        """List columns from sorted positions."""
        bounds = np.searchsorted(columns[0], np.append(self.starts, self.ends[-1:] if len(self.ends) else 0))
        own = np.repeat(self.starts, np.diff(bounds))
        return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(c - own)) for c in columns]

    def sides(self, samples: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, samples, names of the strings beside them)."""
        own = self.owner(samples)
        for kind, shift in ((LEFT, -SIDE), (RIGHT, 0)):
            at = samples[(samples + shift >= self.starts[own]) & (samples + shift + SIDE + SAMPLE <= self.ends[own])]
            yield kind, at, self.names.of_side(at + shift) + np.uint64(kind)

    def ranges(self, kinds: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of positions whose string holds the string beside a sample, from (kind, samples)."""
        at = np.concatenate([a for _, a in kinds])
        reach = np.concatenate([np.full(len(a), PERIOD - 1 if kind == LEFT else SIDE) for kind, a in kinds])
        own = self.owner(at)
        starts = np.maximum(at - reach, self.starts[own])
        # Both kinds are as wide.
        ends = np.minimum(at - reach + PERIOD - SIDE, self.ends[own] - WIDTH + 1)
        some = starts < ends
        return merged(starts[some], ends[some])

    def spans(self, starts: np.ndarray, ends: np.ndarray, single: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, starts, ends of the removed bytes) from the ranges examined and the positions in them that are not repeated."""
        repeated = np.zeros(len(self.raw) + 1, np.int8)
        np.add.at(repeated, starts, 1)
        np.add.at(repeated, ends, -1)
        repeated = np.cumsum(repeated, dtype=np.int8)
        repeated[single] = 0
        edges = np.diff(repeated, prepend=np.int8(0))
        opens, closes = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        own = self.owner(opens)
        for text in np.unique(own).tolist():
            mine = own == text
            yield text, *merged(opens[mine], closes[mine] - 1 + WIDTH)


class Shards:
    """Deals names to shards; a shard gets the arrays (name, other, row, code) of a batch of texts.

    A code is (position * 4 + kind) * 4 + state.
    """

    SCHEMA = "shard int, name array<long>, other array<long>, row array<long>, code array<long>"
    LISTS = ("name", "other", "row", "code")

    def __init__(self, count: int):
        self.count = count

    def batch(self, texts: Texts, kind: int, at: np.ndarray, names: np.ndarray, others: np.ndarray | None = None, report: bool = False) -> pa.RecordBatch:
        """With ``report``, positions of names repeated in this batch are sent along, by rows, as found."""
        own = texts.owner(at)
        others = np.zeros(len(at), np.uint64) if others is None else others
        code = ((at - texts.starts[own]) * 4 + kind) * 4
        row, known = texts.rows[own], np.zeros(len(at), bool)
        if report:
            # The first position in each text stands for all.
            alike = Distinct(names, others, own)
            names, others, row, code, known = (x[alike.first] for x in (names, others, row, code, known))
            known = alike.size > 1
        groups = Distinct(names, others)
        often = (groups.size > 1) | (np.bincount(groups.group, known, len(groups.size)) > 0)
        first = groups.first
        parts = [(names[first].view(np.int64), others[first].view(np.int64), row[first], code[first] + np.where(often, REPEATED, NEW))]
        shard = [(names[first] >> np.uint64(8)) % np.uint64(self.count)]
        if report:
            told = np.flatnonzero(often[groups.group])
            zero = np.zeros(len(told), np.int64)
            parts.append((zero, zero, row[told], code[told] + REPORTED))
            shard.append(mixed(row[told].astype(np.uint64)) % np.uint64(self.count))
        shard = np.concatenate(shard).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        bounds = pa.array(np.append(starts, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(c)[order])) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(shard[order][starts]), *lists], ["shard", *self.LISTS])


def _judged(single: bool):
    """A shard -> (row, code) of the names that occur once (``single``), or of those that do not."""

    def judge(shard: pa.Table) -> pa.Table:
        name, other, row, code = (shard[c].combine_chunks().flatten().to_numpy() for c in Shards.LISTS)
        state = code % 4
        told = np.flatnonzero(state == REPORTED)
        own = np.flatnonzero(state != REPORTED)
        groups = Distinct(name[own], other[own])
        once = groups.size[groups.group] == 1
        new = state[own] == NEW
        found = own[once & new] if single else np.concatenate([told, own[~once & new]])
        return pa.table({"row": row[found], "code": code[found] // 4})

    return judge


def _found(rows: DataFrame, single: bool) -> DataFrame:
    return rows.groupBy("shard").applyInArrow(_judged(single), "row long, code long")


def _batches(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Some rows of a batch at a time and their texts."""
    rows = batch["row"].to_numpy()
    for first, data, offsets in chunks(batch[text], BATCH):
        n = len(offsets) - 1
        yield batch.slice(first, n), Texts(rows[first:first + n], data, offsets)


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows, texts)`` for the texts of ``df``, some at a time."""

    def run(batches):
        for batch in batches:
            for rows, texts in _batches(batch):
                yield from work(rows, texts)

    return df.mapInArrow(run, schema)


def _sample_rows(texts: DataFrame, part: int, parts: int, shards: Shards) -> DataFrame:
    """The samples' names that fall to one of the rounds."""

    def work(rows, texts):
        for at in texts.samples():
            names = texts.names.of_sample(at)
            mine = names % np.uint64(parts) == part
            yield shards.batch(texts, 0, at[mine], names[mine], report=True)

    return _mapped(texts.select("row", "text"), work, Shards.SCHEMA)


def _suspects(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """(row, text, k, samples) of the texts with repeated samples; ``lists`` has the first of each (codes)."""

    def work(rows, texts):
        hits, found = texts.all_of(rows["codes"], 4), []
        for at in texts.samples():
            alike = Distinct(texts.names.of_sample(at), texts.owner(at))
            found.append(at[((alike.size > 1) | np.isin(at[alike.first], hits))[alike.group]])
        samples = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
        yield pa.RecordBatch.from_arrays([rows["row"], rows["text"], rows["k"], *texts.lists(samples)], ["row", "text", "k", "samples"])

    joined = texts.join(lists, "row").select("row", "text", "k", "codes")
    return _mapped(joined, work, "row long, text string, k string, samples array<long>")


def _side_rows(suspects: DataFrame, shards: Shards) -> DataFrame:
    """Names of the strings beside the samples."""

    def work(rows, texts):
        for kind, at, names in texts.sides(texts.all_of(rows["samples"])):
            yield shards.batch(texts, kind, at, names)

    return _mapped(suspects.select("row", "text", "samples"), work, Shards.SCHEMA)


def _known(suspects: DataFrame, single: DataFrame) -> DataFrame:
    """(row, text, k, starts, ends): the ranges of positions whose string holds a repeated string beside a sample."""

    def work(rows, texts):
        codes = rows["codes"]
        kind, at = codes.flatten().to_numpy() % 4, texts.all_of(codes, 4)
        samples = texts.all_of(rows["samples"])
        beside = [(k, a[~np.isin(a, at[kind == k])]) for k, a, _ in texts.sides(samples)]
        lists = texts.lists(*texts.ranges(beside))
        yield pa.RecordBatch.from_arrays([rows["row"], rows["text"], rows["k"], *lists], ["row", "text", "k", "starts", "ends"])

    joined = suspects.join(single, "row", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<long>")))
    every = joined.select("row", "text", "k", "samples", "codes")
    return _mapped(every, work, "row long, text string, k string, starts array<long>, ends array<long>").filter(F.size("starts") > 0)


def _ranges_of(rows: pa.RecordBatch, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    return tuple(texts.all_of(rows[c]) for c in ("starts", "ends"))


def _remaining_rows(known: DataFrame, part: int, parts: int, shards: Shards) -> DataFrame:
    """Names of the strings that may be repeated, of one part; equal strings fall to one part."""

    def work(rows, texts):
        for at in pieces(*_ranges_of(rows, texts)):
            at = at[texts.names.of24(at) % np.uint64(parts) == part]
            yield shards.batch(texts, FULL, at, texts.names.of_width(at), texts.others.of_width(at))

    return _mapped(known.select("row", "text", "starts", "ends"), work, Shards.SCHEMA)


def _cut(known: DataFrame) -> DataFrame:
    """(k, spans, kept) of the texts with repeated strings; ``codes`` has the positions of the others."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def work(rows, texts):
        codes = rows["codes"]
        keys, out = rows["k"], ([], [], [])
        for i, starts, ends in texts.spans(*_ranges_of(rows, texts), texts.all_of(codes, 4)):
            first, last = int(texts.starts[i]), int(texts.ends[i])
            out[0].append(keys[i].as_py())
            out[1].append([{"start": a - first, "end": b - first} for a, b in zip(starts.tolist(), ends.tolist())])
            out[2].append(b"".join(texts.raw[a:b].tobytes() for a, b in zip([first, *ends], [*starts, last])))
        types = (pa.string(), pa.list_(span), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["k", "spans", "kept"])

    rows = known.select("row", "text", "starts", "ends", "codes", "k")
    return _mapped(rows, work, "k string, spans array<struct<start:long,end:long>>, kept binary")


def _key(text):
    return F.sha2(whole(text), 256)


def _shards(df: DataFrame, names: int) -> int:
    """Shards for so many names: of bounded size, and at least some for every task that can run."""
    return max(1, -(-names // SHARD), min(4 * df.sparkSession.sparkContext.defaultParallelism, names // 1024))


def repeats(docs: DataFrame, text: str, rounds: tuple[int, int] = ROUNDS) -> DataFrame:
    """(k, spans, kept) of every distinct text that loses bytes: k is its SHA-256, spans are the byte ranges removed.

    ``rounds`` are the parts in which samples and remaining positions are named and sorted.
    """
    first, last = rounds
    distinct = docs.select(_key(F.col(text)).alias("k"), whole(F.col(text)).alias("text")).filter(F.octet_length("text") >= WIDTH)
    texts = saved(
        distinct.groupBy("k").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        .withColumn("row", F.monotonically_increasing_id()),
        "distinct-texts",
    )
    copied = saved(texts.filter("copies > 1").select("k", F.octet_length("text").cast("long").alias("n")), "copied-texts")
    # The first positions of repeated names, gathered per text.
    gathered = F.collect_list("code").alias("codes")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = Shards(_shards(docs, size * len(COVER) // PERIOD // first))
    found = [saved(_found(_sample_rows(texts, part, first, shards), False), "repeated-samples") for part in range(first)]
    suspects = saved(_suspects(texts, reduce(DataFrame.union, found).groupBy("row").agg(gathered)), "suspects")
    dropped(texts, *found)
    shards = Shards(_shards(docs, 2 * (suspects.agg(F.sum(F.size("samples"))).first()[0] or 0)))
    sides = saved(_found(_side_rows(suspects, shards), True), "single-sides")
    known = saved(_known(suspects, sides.groupBy("row").agg(gathered)), "known")
    dropped(suspects, sides)
    wide = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)
    shards = Shards(_shards(docs, (known.agg(F.sum(wide)).first()[0] or 0) // last))
    single = [saved(_found(_remaining_rows(known, part, last, shards), True), "single-strings") for part in range(last)]
    # Texts with copies go whole, whatever else they share.
    alone = known.join(copied.select("k"), "k", "left_anti")
    listed = alone.join(reduce(DataFrame.union, single).groupBy("row").agg(gathered), "row", "left")
    cut = saved(_cut(listed.withColumn("codes", F.coalesce("codes", F.array().cast("array<long>")))), "cut-texts")
    dropped(known, *single)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    return cut.union(copied.select("k", all_of_it, F.lit("").cast("binary")))


def without_repeats(docs: DataFrame, text: str, rounds: tuple[int, int] = ROUNDS) -> DataFrame:
    """``docs`` with ``spans`` (removed byte ranges, in order) and ``kept`` (the remaining bytes) of every row."""
    keyed = docs.withColumn("_k", _key(F.col(text)))
    lost = repeats(docs, text, rounds).toDF("_k", "spans", "kept")
    own = [c for c in docs.columns if c not in ("spans", "kept")]
    return keyed.select(*own, "_k").join(lost, "_k", "left").select(
        *own, F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
        F.coalesce("kept", whole(F.col(text)).cast("binary")).alias("kept"),
    )


@register("op12_suffix_dedup")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lengths = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    lost = repeats(docs, "text").select(
        "k", lengths.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    # What loses nothing has the digest of its text.
    keyed = docs.select("doc_id", F.octet_length(whole(F.col("text"))).cast("long").alias("n_bytes"), _key(F.col("text")).alias("k"))
    zero = F.lit(0).cast("long")
    return keyed.join(saved(lost, "removed"), "k", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "k").alias("kept_sha256"),
    )
