"""Ordered per-key operators that stay parallel when one key owns most rows.

A window over a key puts all rows of that key into one task.  The helpers here cut every key with
more than ``span`` rows into chunks of about ``span`` rows, run the window inside (key, chunk), and
carry over only what later chunks need: one summary row per chunk, or the last few rows of it.
Results do not depend on ``span``.  Keys with fewer rows are one chunk; a null key is a key.

The borders between chunks are quantiles: every ``PER_CHUNK``-th of the sampled order values of a key,
where a hash of the value decides whether it is sampled.  Such a sample merges like any aggregate and
is the same however often the plan is evaluated.  Building the plan runs no job: keys are
counted when it runs, and adaptive execution drops the joins where no key is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1_000_000
# Sampled order values per chunk: chunks differ in size by about one part in eight.
PER_CHUNK = 64
_CHUNK = "_chunk"
_LARGE = "_large"
CHUNK_COLUMNS = (_CHUNK, _LARGE)
# A border is found by halving, so a key may have up to 2 ** _STEPS chunks.
_STEPS = 24


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys where null equals null; columns of ``left``, then the others of ``right``.

    ``right`` has at most a few rows per ``span`` rows of ``left``, which statistics can't tell, and is broadcast: else ``left``
    is shuffled before it is known that no key is large.
    """
    own = F.broadcast(right.withColumnsRenamed({k: f"_r_{k}" for k in keys}))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(own, same, how).drop(*[f"_r_{k}" for k in keys])


def _chunked(
    df: DataFrame, keys: list[str], order: str, span: int, count_in: DataFrame | None = None
) -> DataFrame:
    """Adds the chunk number within the key and a mark on the rows of large keys.

    ``order`` is a number or a time; rows with one value of it, or without one, stay together.  ``count_in`` is a
    cheaper frame with the same keys and orders to count in, when ``df`` is costly to compute.
    """
    at = F.col(order).cast("double")
    counted = df if count_in is None else count_in
    per = min(PER_CHUNK, span)
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > span)
    # Values are gathered of large keys only: one that many keys share may be sampled.
    picked = _null_safe(counted.filter(F.pmod(F.xxhash64(at), F.lit(span)) < per), sizes.select(*keys), keys, "left_semi")
    sampled = picked.groupBy(*keys).agg(F.sort_array(F.collect_set(at)).alias("_values"))
    # Places per, 2 * per, ... of the sorted sample; a sample that is too small has none.
    inner = F.floor((F.size("_values") - 1) / per).cast("int")
    places = F.when(inner > 0, F.sequence(F.lit(1), inner)).otherwise(F.array().cast("array<int>"))
    borders = F.transform(places, lambda i: F.get("_values", i * per))
    large = _null_safe(sizes, sampled, keys, "left").select(*keys, F.coalesce(borders, F.array().cast("array<double>")).alias("_borders"))
    rows = _null_safe(df, large, keys, "left")
    # The number of borders up to the row's place, bit by bit.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(_STEPS))])
    below = F.aggregate(
        steps, F.lit(0), lambda found, step: F.when(F.get("_borders", found + step - 1) <= at, found + step).otherwise(found)
    )
    return rows.select(
        *df.columns,
        F.when(F.col("_borders").isNotNull(), below).otherwise(0).cast("long").alias(_CHUNK),
        F.col("_borders").isNotNull().alias(_LARGE),
    )


def _carry(df: DataFrame, keys: list[str], partial: dict[str, Column], over: dict) -> DataFrame:
    """For large keys, one row per chunk with each partial result accumulated over earlier chunks."""
    per_chunk = df.filter(_LARGE).groupBy(*keys, _CHUNK).agg(*[c.alias(n) for n, c in partial.items()])
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        *keys, _CHUNK, *[over[n](F.col(n)).over(before).alias(f"_c_{n}") for n in partial]
    )


def running_last(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column | str], span: int = SPAN,
    count_in: DataFrame | None = None, keep_chunks: bool = False,
) -> DataFrame:
    """Adds, per name, the last non-null value among earlier rows of the key.

    A value that is a column of its own is given by its name and is not copied.  With ``keep_chunks`` the columns of
    :func:`chunk_window` stay.
    """
    source = {n: v if isinstance(v, str) else f"_v_{n}" for n, v in values.items()}
    cols = [v.alias(source[n]) for n, v in values.items() if not isinstance(v, str)]
    rows = _chunked(df.select("*", *cols), keys, order, span, count_in)

    def at(n: str) -> Column:
        value = F.col(source[n])
        return F.max_by(value, F.when(value.isNotNull(), F.col(order)))

    carried = _carry(
        rows,
        keys,
        {n: at(n) for n in values},
        {n: lambda c: F.last(c, ignorenulls=True) for n in values},
    )
    before = chunk_window(keys, order)
    joined = _null_safe(rows, carried, [*keys, _CHUNK], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *([_CHUNK, _LARGE] if keep_chunks else []),
        *[
            F.coalesce(F.last(source[n], ignorenulls=True).over(before), F.col(f"_c_{n}")).alias(n)
            for n in values
        ],
    )


def chunk_window(keys: list[str], order: str):
    """The rows before a row in its chunk, for windows after a ``running_last`` that kept its chunks: they are not shuffled again."""
    return Window.partitionBy(*keys, _CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def across_chunks(rows: DataFrame, keys: list[str], group: str, values: dict[str, Column]) -> DataFrame:
    """Aggregates of the groups of rows of large keys that lie in more than one chunk.

    A group is a run of rows in order, so there is about one such group per chunk, and :func:`with_groups` broadcasts them.
    """
    found = rows.filter(_LARGE).groupBy(*keys, group).agg(
        *[c.alias(n) for n, c in values.items()], F.min(_CHUNK).alias("_lo"), F.max(_CHUNK).alias("_hi")
    )
    return found.filter("_lo < _hi").drop("_lo", "_hi").withColumn("_across", F.lit(True))


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], group: str) -> DataFrame:
    """The rows with what :func:`across_chunks` found for their group, and ``_across`` set there; without the columns of the chunks."""
    return _null_safe(rows, groups, [*keys, group], "left").drop(_CHUNK, _LARGE)


# How a running value is made: (aggregate over rows, aggregate over chunks, chunk value with row value).
_FOLDS = {
    "sum": (F.sum, F.sum, lambda c, v: F.coalesce(c, F.lit(0)) + v),
    "xor": (F.bit_xor, F.bit_xor, lambda c, v: F.coalesce(c, F.lit(0).cast("long")).bitwiseXOR(v)),
    "max": (F.max, F.max, F.greatest),
}


def running(
    df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], span: int = SPAN
) -> DataFrame:
    """Adds, per name, the running ``sum``, ``xor`` or ``max`` of a column, the row itself included.

    ``values`` maps a name to (kind, column); ``order`` has no ties within a key.
    """
    cols = [c.alias(f"_v_{n}") for n, (_, c) in values.items()]
    rows = _chunked(df.select("*", *cols), keys, order, span)
    carried = _carry(
        rows, keys, {n: _FOLDS[kind][0](f"_v_{n}") for n, (kind, _) in values.items()},
        {n: _FOLDS[kind][1] for n, (kind, _) in values.items()},
    )
    upto = Window.partitionBy(*keys, _CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _null_safe(rows, carried, [*keys, _CHUNK], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_FOLDS[kind][2](F.col(f"_c_{n}"), _FOLDS[kind][0](f"_v_{n}").over(upto)).alias(n) for n, (kind, _) in values.items()],
    )


def running_count(
    df: DataFrame, keys: list[str], order: str, name: str = "ordinal", span: int = SPAN, ties: list[str] | None = None
) -> DataFrame:
    """Adds the 1-based position of each row within its key; rows with one value of ``order`` go by ``ties``."""
    rows = _chunked(df, keys, order, span)
    carried = _carry(rows, keys, {"n": F.count(F.lit(1))}, {"n": F.sum})
    local = F.row_number().over(Window.partitionBy(*keys, _CHUNK).orderBy(order, *ties or []))
    joined = _null_safe(rows, carried, [*keys, _CHUNK], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        (local + F.coalesce(F.col("_c_n"), F.lit(0))).cast("long").alias(name),
    )


def preceding_rows(
    df: DataFrame, keys: list[str], order: str, payload: list[str], size: int,
    name: str = "before", span: int = SPAN,
) -> DataFrame:
    """Adds an array of the ``size`` rows before each row of its key, oldest first.

    The last ``size`` rows of every chunk are copied in front of the next chunk of
    the key, so no window reaches over a chunk border.
    """
    rows = _chunked(df, keys, order, span)
    item = F.struct(order, *payload)
    newest = Window.partitionBy(*keys, _CHUNK).orderBy(F.desc(order))
    tails = (
        rows.filter(_LARGE)
        .select(*keys, _CHUNK, order, *payload, F.row_number().over(newest).alias("_rn"))
        .filter(F.col("_rn") <= size)
        .drop("_rn")
    )
    in_key = Window.partitionBy(*keys).orderBy(order)
    halo = (
        tails.select(
            *keys,
            _CHUNK,
            F.collect_list(item).over(in_key.rowsBetween(-size, -1)).alias("_prior"),
            F.lag(_CHUNK).over(in_key).alias("_last_chunk"),
        )
        .filter(F.col("_last_chunk") != F.col(_CHUNK))
        .select(*keys, _CHUNK, F.explode("_prior").alias("_p"))
        .select(*keys, _CHUNK, "_p.*", F.lit(True).alias("_halo"))
    )
    both = rows.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    window = Window.partitionBy(*keys, _CHUNK).orderBy(order).rowsBetween(-size, -1)
    return (
        both.withColumn(name, F.collect_list(item).over(window))
        .filter(~F.col("_halo"))
        .select(*df.columns, name)
    )


def first_per_key(
    df: DataFrame, keys: list[str], order: list[Column | str], keep_all: Column | None = None
) -> DataFrame:
    """The first row of every key; rows with ``keep_all`` true are all kept.

    The rank filter is applied before the shuffle as well, so a hot key ships one row per input
    partition.  Kept-as-is rows get a random-looking extra key of their own, which
    spreads them over all tasks in the same pass.
    """
    if keep_all is None:
        spread = F.lit(0).cast("long")
    else:
        spread = F.when(keep_all, F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in order]))
        spread = F.coalesce(spread, F.lit(0).cast("long"))
    ranked = df.withColumn("_spread", spread)
    window = Window.partitionBy(*keys, "_spread").orderBy(*order)
    first = ranked.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1)
    return first.drop("_rn", "_spread")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of every key with their rank; cut per input partition first."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
