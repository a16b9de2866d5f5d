"""Exact top-k inner products by Fagin's threshold algorithm.

Queries and candidates are dealt into blocks; every pair of blocks is one task-sized cell.  A cell
sorts its candidates once per dimension, reads the lists from the end that suits the sign of the
query's component, scores what it meets, and stops when the kth score is above the best score any
unread candidate could have.  Only k rows per query and cell are shuffled to the final ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import table

BLOCK = 4096
FIRST_DEPTH = 32
EXACT = float(1 << 53)


class SortedLists:
    """One block of candidates with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.ranked = np.take_along_axis(vectors, self.order, axis=0)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best candidates but the query's own, ties to the smaller id."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        scores, met = np.zeros(n, self.vectors.dtype), np.zeros(n, bool)
        depth = min(FIRST_DEPTH, n)
        while True:
            new = np.zeros(n, bool)
            new[self.order[n - depth:, up].ravel()] = True
            new[self.order[:depth, down].ravel()] = True
            if depth == n:
                new[:] = True
            new &= ~met
            scores[new] = self.vectors[new] @ query
            met |= new
            place = np.flatnonzero(met & (self.ids != own))
            best = place[np.lexsort((self.ids[place], -scores[place]))[:k]]
            bound = self.ranked[n - depth, up] @ query[up] + self.ranked[depth - 1, down] @ query[down]
            if depth == n or (len(best) == k and scores[best[-1]] > bound):
                return best, scores[best]
            depth = min(4 * depth, n)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return schema.empty_table()
        q, v = _matrix(queries), _matrix(candidates)
        # Doubles multiply faster; they are used where every sum is exact in them.
        if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < EXACT:
            q, v = q.astype(np.float64), v.astype(np.float64)
        ids = candidates["vec_id"].to_numpy()
        lists, out = SortedLists(ids, v), []
        for own, query in zip(queries["vec_id"].to_numpy(), q):
            best, scores = lists.top(own, query, k)
            out.append((np.full(len(best), own), ids[best], scores.astype(np.int64)))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return cell


def top_k(vectors: DataFrame, id_col: str, vector: str, is_query, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` highest integer inner products.

    Components become floor(1024 x).  Vectors that are null, empty, or hold null or non-finite
    components, and rows without id, take no part; vectors of another length than the query's are not
    its candidates.  A query row that occurs twice counts once; of other rows each occurrence counts.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), is_query.alias("q"),
        F.transform(x, lambda c: F.floor(c.cast("double") * 1024).cast("long")).alias("v"), F.size(x).alias("dim"),
    )
    sizes = clean.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("long"))).first()
    rows, queries = sizes[0], sizes[1] or 0
    n_c, n_q = max(1, -(-rows // block)), max(1, -(-queries // block))
    part = F.xxhash64("vec_id", "v")
    asked = clean.filter("q").dropDuplicates(["vec_id", "v"]).select(
        "vec_id", "v", "dim", F.pmod(part, F.lit(n_q)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb")
    )
    offered = clean.select(
        "vec_id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"),
        F.pmod(part, F.lit(n_c)).cast("int").alias("cb"),
    )
    keys = ["dim", "qb", "cb"]
    local = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(
        _search(k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@register("op6_topk_search", SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), "vec_id", "embedding", F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
