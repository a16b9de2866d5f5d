"""Sheet-like sources: a header row and text cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.operators.tasks import reconcile_headers


def read_sheet(spark: SparkSession, path: str, headers: list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """Text cells of CSV files with a header row.

    Short rows are padded and blank cells are '' rather than null; ``required``
    columns the sheet lacks are appended as in S12.
    """
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    filled = rows.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in headers])
    return reconcile_headers(filled, required)
