"""Mixing by soft domain membership.

A multinomial classifier, fitted on the labelled table, gives every document its domain posteriors.
The document rates are the nonnegative least squares fit of the expected token total of every domain
to its target, found by accelerated projected gradient steps over all documents.  A step needs only the
residual of each domain, so an iterate is replayed from the list of residuals and no per-document state is
kept.  Steps go on until no rate is further than a tolerance from the minimum: the ridge makes the problem
strongly convex, which bounds that distance by the length of the projected gradient.

Defined results: null or wordless text has no tokens and the posteriors of an empty text; documents
without a label take part like all others; if fewer than two domains are labelled, every document has
the first domain (or the labelled one) with certainty; a target of a domain without tokens is not reachable and
is left.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import register
from talkweave.llm.common import saved, table, words

DOMAINS = ("good", "plain", "toxic")
TARGETS = {"good": 0.97, "plain": 0.03, "toxic": 0.0}
LABELLED_ROWS = 20_000  # bound of the sample the classifier is fitted on
FEATURES = 1 << 15
MAX_RATE = 4.0
RIDGE = 0.01
TOLERANCE = 1e-3  # largest root mean square distance, weighted by tokens, of the rates from the minimum


def domain(quality: Column, toxic: Column) -> Column:
    """Place in ``DOMAINS`` of a labelled document."""
    return F.when(F.coalesce(toxic, F.lit(0)) == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def _features(docs: DataFrame, text: str) -> DataFrame:
    tf = HashingTF(inputCol="_words", outputCol="_vector", numFeatures=FEATURES, binary=True)
    return tf.transform(docs.withColumn("_words", words(F.lower(F.col(text)))))


class Domains(NamedTuple):
    """The domain classifier; without a model one domain is certain."""

    model: object
    certain: int

    def posteriors(self, docs: DataFrame, text: str, out: str) -> DataFrame:
        """``docs`` with the posteriors as array column ``out``."""
        size = len(DOMAINS)
        if self.model is None:
            return docs.withColumn(out, F.array(*[F.lit(float(i == self.certain)) for i in range(size)]))
        rows = self.model.transform(_features(docs, text)).withColumn(out, vector_to_array("_p"))
        # Domains after the last labelled one are unknown to the model.
        blank = F.array_repeat(F.lit(0.0), F.lit(size) - F.size(out))
        return rows.withColumn(out, F.concat(out, blank)).drop("_words", "_vector", "_p", "rawPrediction", "prediction")


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Domains:
    """Fits on at most ``rows`` labelled documents, taken in hash order of their ids."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t")
    ).select("doc_id", domain(F.col("q"), F.col("t")).cast("double").alias("label")).filter("label IS NOT NULL")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    fitted = saved(
        _features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "text").select("label", "_vector"),
        "mixing-sample",
    )
    kinds = sorted(int(r[0]) for r in fitted.select("label").distinct().collect())
    if len(kinds) < 2:
        return Domains(None, kinds[0] if kinds else 0)
    model = LogisticRegression(
        featuresCol="_vector", labelCol="label", family="multinomial", regParam=0.002, maxIter=40, probabilityCol="_p"
    ).fit(fitted)
    return Domains(model, 0)


def momentum(ridge: float) -> float:
    """The constant weight of the last move for a problem with curvatures from ``ridge`` to 1 + ``ridge``."""
    low, high = math.sqrt(ridge), math.sqrt(1 + ridge)
    return (high - low) / (high + low)


def rates_of(residuals: np.ndarray, p: np.ndarray, ridge: float, cap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rates after all recorded steps, replayed from rate 1, and the points the next and the last step start from."""
    r = y = start = np.ones(len(p))
    for residual in residuals:
        start, before = y, r
        r = np.clip(y - (p @ residual + ridge * (y - 1)) / (1 + ridge), 0.0, cap)
        y = r + momentum(ridge) * (r - before)
    return r, y, start


def fit_rates(
    rows: DataFrame, targets: np.ndarray, ridge: float = RIDGE, cap: float = MAX_RATE, tolerance: float = TOLERANCE
) -> np.ndarray:
    """Residuals of the projected gradient steps over all ``rows`` (tokens, p).

    Minimizes the squared distance of each domain's expected token share from its target share, divided by the
    domain's present share, plus a small ridge that holds rates near 1.  The targets share the present
    number of tokens.  Each step is one pass that sums a vector of domains per task, and the squared length of
    the projected gradient at the start of the last step; the steps end when that proves the tolerance.  They
    converge geometrically, so they do end.
    """
    size = len(targets)
    names = [f"s{i}" for i in range(size + 1)]

    def totals(residuals: np.ndarray) -> tuple[np.ndarray, float]:
        def run(batches):
            for batch in batches:
                t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(t), size)
                r, y, start = rates_of(residuals, p, ridge, cap)
                moved = float(t @ (r - start) ** 2)
                sums = [*((t * y) @ p), moved]
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in sums], names)

        parts = rows.select("tokens", "p").mapInArrow(run, ", ".join(f"{n} double" for n in names))
        found = [x or 0.0 for x in parts.agg(*[F.sum(n).alias(n) for n in names]).first()]
        return np.array(found[:-1]), found[-1]

    residuals = np.zeros((0, size))
    now, _ = totals(residuals)
    total = now.sum()
    if not total:
        return residuals
    present = np.maximum(now / total, 1e-6)
    while True:
        residuals = np.vstack([residuals, (now / total - targets) / present])
        now, moved = totals(residuals)
        # The minimum lies within twice the projected gradient divided by the least curvature.
        if 2 * (1 + ridge) * math.sqrt(moved / total) <= tolerance * ridge:
            return residuals


def with_rates(rows: DataFrame, residuals: np.ndarray, p: str, out: str, ridge: float = RIDGE, cap: float = MAX_RATE) -> DataFrame:
    """``rows`` with the rate of each document, by column expressions over its posteriors."""
    if not len(residuals):
        return rows.withColumn(out, F.lit(1.0))
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in residuals])

    def moved(state: Column, residual: Column) -> Column:
        parts = [residual[i] * F.col(p)[i] for i in range(residuals.shape[1])]
        slope = reduce(lambda a, b: a + b, parts)
        y = state["r"] + momentum(ridge) * (state["r"] - state["before"])
        r = F.greatest(F.lit(0.0), F.least(F.lit(cap), y - (slope + ridge * (y - 1)) / (1 + ridge)))
        return F.struct(r.alias("r"), state["r"].alias("before"))

    first = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"))
    return rows.withColumn(out, F.aggregate(steps, first, moved, lambda state: state["r"]))


def copies(rate: Column, key: Column) -> Column:
    """Whole copies whose mean is the rate: the fraction is drawn by a hash of the key."""
    draw = F.pmod(F.xxhash64(F.lit(3), key), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + draw).cast("int")


def token_count(text: str) -> Column:
    return F.size(words(F.col(text))).cast("long")


def mixed_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, source, tokens, p, rate) of every document (doc_id, text, source)."""
    classifier = fit_classifier(docs, labels)
    rows = classifier.posteriors(docs.select("doc_id", "source", "text"), "text", "p")
    known = saved(rows.select("doc_id", "source", token_count("text").alias("tokens"), "p"), "posteriors")
    residuals = fit_rates(known, np.array([targets[d] for d in DOMAINS]))
    return with_rates(known, residuals, "p", "rate")


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with each row as often as its rate says; every column of ``docs`` stays as it is."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    classifier = fit_classifier(docs, labels)
    plain = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    scored = classifier.posteriors(plain, text, "p")
    # Written with all columns, so that no later expression scores a text again.
    known = saved(scored.select(*names, token_count(text).alias("tokens"), "p"), "posteriors")
    residuals = fit_rates(known, np.array([targets[d] for d in DOMAINS]))
    rated = with_rates(known, residuals, "p", "rate")
    times = copies(F.col("rate"), F.col(names[docs.columns.index("doc_id")]))
    repeated = rated.withColumn("_n", times).filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return repeated.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


@register("op3_source_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixed_rates(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select(
        "doc_id", "source", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate"
    )
