"""Every row of a query set against every row of a table, block by block, without replicating the table.

The table is dealt once into slices that fit a task.  The query set is written in blocks, and each slice
gets the blocks one after another: a task reads its slice, keeps it, and then streams the blocks past it.
What a slice finds for a block is reduced in the task (to the best k, say), so that only slices x queries x k
rows leave it.  A query row is sent once per slice.  The query set may be dealt into parts too: then a task has
one slice and one part, and a row of the table is sent once per part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 256 << 20
BLOCK_ROWS = 4096
_SLICE = "_slice"
_PART = "_part"
_QUERY = "_is_query"


def slice_count(rows: int, row_bytes: int, parallelism: int, slice_bytes: int = SLICE_BYTES) -> int:
    """Slices of at most ``slice_bytes``; at least one for each task that can run, if there are rows enough."""
    by_size = -(-rows * row_bytes // slice_bytes)
    return max(1, by_size, min(parallelism, -(-rows // 1024)))


def stream_blocks(
    table: DataFrame, queries: DataFrame, slices: int, schema: str,
    open_slice: Callable[[pa.Table], object], match: Callable[[object, pa.Table], pa.RecordBatch],
    block_rows: int = BLOCK_ROWS, parts: int = 1,
) -> DataFrame:
    """What ``match`` yields for every (slice of ``table``, block of ``queries``).

    ``open_slice`` turns the rows of a slice into whatever ``match`` needs and is called once per slice and
    part, also for one without rows.  Rows of a slice, and of a part, are chosen by a hash of the whole row, so no value is hot.
    """

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def one_of(count: int, columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")

    def dealt_to(df: DataFrame, place: Column, is_query: bool) -> DataFrame:
        return df.select("*", place.alias(_SLICE), F.lit(is_query).alias(_QUERY))

    copies = table.select("*", every(parts).alias(_PART))
    both = dealt_to(copies, one_of(slices, table.columns) * parts + F.col(_PART), False).drop(_PART)
    sent = queries.select("*", every(slices).alias(_PART))
    sent = dealt_to(sent, F.col(_PART) * parts + one_of(parts, queries.columns), True).drop(_PART)
    rows = both.unionByName(sent, allowMissingColumns=True)
    names, own = table.columns, queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, opened, block = None, [], None, []

        def matched() -> Iterator[pa.RecordBatch]:
            nonlocal opened, held
            if opened is None:
                opened, held = open_slice(pa.Table.from_batches(held, _part(schema_in, names))), []
            if block:
                yield match(opened, pa.Table.from_batches(block))
                block.clear()

        schema_in = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema_in = batch.schema
            place = batch.column(batch.schema.get_field_index(_SLICE)).to_pylist()
            asked = batch.column(batch.schema.get_field_index(_QUERY)).to_pylist()
            start = 0
            while start < batch.num_rows:
                stop = start + 1
                while stop < batch.num_rows and place[stop] == place[start] and asked[stop] == asked[start]:
                    stop += 1
                if place[start] != at:
                    yield from matched() if block else ()
                    at, held, opened = place[start], [], None
                part = batch.slice(start, stop - start)
                if asked[start]:
                    block.append(part.select(own))
                    if sum(b.num_rows for b in block) >= block_rows:
                        yield from matched()
                else:
                    held.append(part.select(names))
                start = stop
        if block:
            yield from matched()

    # A partition holds one slice and part, its rows before its queries.
    dealt = rows.repartitionById(slices * parts, _SLICE).sortWithinPartitions(_SLICE, _QUERY)
    return dealt.mapInArrow(run, schema)


def _part(schema: pa.Schema, names: list[str]) -> pa.Schema:
    return pa.schema([schema.field(n) for n in names])
