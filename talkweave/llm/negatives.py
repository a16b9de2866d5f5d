"""Hard negatives by residue-number-system matrix products.

Component vectors are whole numbers.  For each of several small primes the matrices of centred residues are
multiplied in float32, where every partial sum is below 2 ** 24 and so exact; as many primes are used as the
largest possible score of a block needs.  Chinese remaindering gives back the exact signed scores.

Anchors are streamed in blocks past slices of all rows (``stream_blocks``), twice: first for the positives of
each anchor, then for the negatives in the windows its positives open.  Only the best few rows of an anchor
and slice are shuffled.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import saved, table
from talkweave.operators.blocks import slice_count, stream_blocks

# Residues of these primes fit a signed byte when centred.
LARGEST_PRIME = 251
EXACT_FLOAT = 1 << 24
TILE = 2048
BLOCK = 2048
LONG = (1 << 63) - 1


@cache
def primes() -> list[int]:
    """Odd primes from ``LARGEST_PRIME`` downwards."""
    return [p for p in range(LARGEST_PRIME, 2, -2) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]


def primes_for(bound: int) -> list[int]:
    """As many primes as tell all whole numbers from ``-bound`` to ``bound`` apart."""
    chosen, product = [], 1
    for p in primes():
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    if product <= 2 * bound:
        raise ValueError("vector components are too large for the residue system")
    return chosen


def residues(whole: np.ndarray, p: int) -> np.ndarray:
    """Centred residues of whole numbers held as doubles, exact for any finite value."""
    r = np.fmod(whole, p)
    r += (r < -(p // 2)) * float(p)
    r -= (r > p // 2) * float(p)
    return r.astype(np.int8)


def product(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """``left @ right.T`` modulo p, from 0 to p - 1, of centred residues."""
    step = EXACT_FLOAT // (p // 2) ** 2
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, left.shape[1], step):
        total += left[:, at:at + step].astype(np.float32) @ right[:, at:at + step].astype(np.float32).T
        if left.shape[1] > step:
            total = np.fmod(total, np.float32(p))
    return np.mod(total, np.float32(p)).astype(np.int64)


def combined(parts: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The signed numbers with these residues, digit by digit in mixed radix (Garner).

    Numbers beyond a long become the nearest long.
    """
    modulus = 1
    for p in moduli:
        modulus *= p
    wide = modulus >= 1 << 62
    value, radix = (parts[0].astype(object) if wide else parts[0]), moduli[0]
    for r, p in zip(parts[1:], moduli[1:]):
        digit = (r - value % p) * pow(radix, -1, p) % p
        value, radix = value + digit * radix, radix * p
    value = np.where(value > modulus // 2, value - modulus, value)
    return np.clip(value, -LONG - 1, LONG).astype(np.int64) if wide else value


class Vectors:
    """Vectors of one length in order of their labels, and their residues by prime, made when first asked for.

    ``rows`` are their places in the table they came from.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, rows: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.values, self.rows = ids[order], labels[order], values[order], rows[order]
        self.largest = float(np.abs(self.values).max(initial=0))
        self._parts: dict[int, np.ndarray] = {}

    def part(self, p: int) -> np.ndarray:
        if p not in self._parts:
            self._parts[p] = residues(self.values, p)
        return self._parts[p]

    def scores(self, rows: slice, other: Vectors, others: slice) -> np.ndarray:
        """Exact inner products of two ranges of rows."""
        moduli = primes_for(int(self.largest) * int(other.largest) * self.values.shape[1])
        return combined([product(self.part(p)[rows], other.part(p)[others], p) for p in moduli], moduli)


def _by_length(rows: pa.Table) -> dict[int, Vectors]:
    """The rows of a table (vec_id, label, v) by the length of v."""
    lists = rows["v"].combine_chunks() if isinstance(rows["v"], pa.ChunkedArray) else rows["v"]
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, int)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        out[int(n)] = Vectors(ids[at], labels[at], flat.reshape(len(at), n), at)
    return out


def _first(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k (row, id, score) of every row: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], scores[keep]


def _best(anchors: Vectors, offered: Vectors, spans, windows: list[tuple[np.ndarray, np.ndarray]], k: int) -> list:
    """For each window (lowest, highest score by anchor) the first k offered rows of every anchor in it.

    ``spans`` yields (range of anchors, range of offered rows, whether those of the anchor's label count).
    """
    none = np.zeros(0, np.int64)
    best, floors = [(none, none, none)] * len(windows), [low.copy() for low, _ in windows]
    for own, others, same in spans:
        for at in range(others.start, others.stop, TILE):
            tile = slice(at, min(at + TILE, others.stop))
            scores = anchors.scores(own, offered, tile)
            allowed = anchors.ids[own, None] != offered.ids[None, tile]
            if not same:
                allowed &= anchors.labels[own, None] != offered.labels[None, tile]
            for w, (_, high) in enumerate(windows):
                fits = allowed & (scores >= floors[w][own, None]) & (scores <= high[own, None])
                if scores.shape[1] > k:
                    kth = np.partition(np.where(fits, scores, -LONG - 1), -k, axis=1)[:, -k]
                    fits &= scores >= kth[:, None]
                i, j = np.nonzero(fits)
                if not len(i):
                    continue
                new = (i + own.start, offered.ids[tile][j], scores[i, j])
                best[w] = _first(*(np.concatenate(c) for c in zip(best[w], new)), k)
                # The kth score so far is the least that can still enter.
                rows, _, found = best[w]
                last = np.searchsorted(rows, np.arange(len(anchors.ids)), "right") - 1
                full = np.bincount(rows, minlength=len(anchors.ids)) == k
                floors[w][full] = np.maximum(floors[w][full], found[last[full]])
    return best


POSITIVE = "anchor_id long, positive_id long, positive_score long"
NEGATIVE = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    names = [f.split() for f in schema.split(", ")]
    kinds = [pa.int32() if kind == "int" else pa.int64() for _, kind in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [n for n, _ in names])


def _positives(k: int):
    def match(offered: dict[int, Vectors], block: pa.Table) -> pa.RecordBatch:
        out = [np.zeros((3, 0), np.int64)]
        for n, anchors in _by_length(block).items():
            if n not in offered:
                continue
            other = offered[n]
            # Rows are in order of their labels: each label is a range on both sides.
            spans = [
                (slice(*np.searchsorted(anchors.labels, [x, x + 1])), slice(*np.searchsorted(other.labels, [x, x + 1])), True)
                for x in np.intersect1d(anchors.labels, other.labels).tolist()
            ]
            size = len(anchors.ids)
            [(rows, ids, scores)] = _best(anchors, other, spans, [(np.full(size, -LONG - 1), np.full(size, LONG))], k)
            out.append(np.stack([anchors.ids[rows], ids, scores]))
        return _batch(list(np.concatenate(out, axis=1)), POSITIVE)

    return match


def _negatives(k: int):
    def match(offered: dict[int, Vectors], block: pa.Table) -> pa.RecordBatch:
        out = [np.zeros((6, 0), np.int64)]
        found = block["positives"].combine_chunks()
        counts, starts = found.value_lengths().to_numpy(), found.offsets.to_numpy()
        positive = {n: found.values.field(n).to_numpy() for n in ("positive_id", "positive_score")}
        for n, anchors in _by_length(block).items():
            if n not in offered:
                continue
            everything = [(slice(0, len(anchors.ids)), slice(0, len(offered[n].ids)), False)]
            places, windows = [], []
            for place in range(int(counts[anchors.rows].max(initial=0))):
                has = counts[anchors.rows] > place
                at = np.where(has, starts[anchors.rows] + place, 0)
                score = positive["positive_score"][at]
                # Half of the score rounded up, and 19/20 of it rounded down; without a positive an empty window.
                low, high = -(-score // 2), score // 20 * 19 + score % 20 * 19 // 20
                windows.append((np.where(has, low, 1), np.where(has, high, 0)))
                places.append((at, score))
            for place, (rows, ids, scores) in enumerate(_best(anchors, offered[n], everything, windows, k)):
                at, score = (x[rows] for x in places[place])
                out.append(np.stack([anchors.ids[rows], np.full(len(rows), place), positive["positive_id"][at], score, ids, scores]))
        return _batch(list(np.concatenate(out, axis=1)), NEGATIVE)

    return match


def _floor(c: Column) -> Column:
    return F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c)


def hard_negatives(
    vectors: DataFrame, id_col: str, vector: str, label: Column, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3,
    slices: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale x).  An anchor's positives are its first ``positives`` other rows with its label by inner
    product, ties to the smaller id; a positive's negatives are the first ``negatives`` rows of other labels that
    score from 50 % to 95 % of it.

    Defined results: rows with a null id or label, a null or empty vector, or null or non-finite components take no part.
    Rows with the anchor's own id are never its positives or negatives, and vectors of another length are not compared.  Of
    several anchor rows with one id the first by label and vector counts; of other rows each occurrence counts.  Scores beyond a
    long count as the nearest long.  Other columns are not read.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        # Doubles hold floor(scale x) of any float exactly; from 2 ** 53 on they are whole numbers.
        F.transform(x, lambda c: _floor(c.cast("double") * scale)).alias("v"),
        is_anchor.alias("a"),
    )
    rows = clean.select("vec_id", "label", "v")
    first = F.min(F.struct("label", "v")).alias("f")
    anchors = clean.filter("a").groupBy("vec_id").agg(first).select("vec_id", "f.label", "f.v")
    if slices is None:
        count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        slices = slice_count(count, 16 * (width or 1), clean.sparkSession.sparkContext.defaultParallelism)
    near = stream_blocks(rows, anchors, slices, POSITIVE, _by_length, _positives(positives), BLOCK)
    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first_few = near.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= positives)
    windows = saved(
        first_few.groupBy(F.col("anchor_id").alias("vec_id")).agg(
            F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives")
        ),
        "positives",
    )
    found = stream_blocks(rows, anchors.join(windows, "vec_id"), slices, NEGATIVE, _by_length, _negatives(negatives), BLOCK)
    ranked = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.place <= 5 AND p.anchor_id = s.anchor_id AND NOT s.same
   AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@register("op13_hard_negatives", SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(
        table(spark, folder, "embeddings"), "vec_id", "embedding", label, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    )
