"""Every registered query against its DuckDB form at the smallest scale."""

import pathlib
import re

import oracle
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_query_has_sql():
    # Only operators that SQL cannot express have none; their tests are beside them.
    without = set(queries()) - set(oracle_sql())
    assert all(re.match("op[0-9]+_", name) or name == "pipeline" for name in without)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["query_id", "prompt"]
    assert frame.count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    frame = queries()[name](spark, FOLDER)
    sql = oracle_sql().get(name)
    if sql is None:
        assert frame.count() >= 0
    else:
        assert oracle.compare(frame, con, sql) is None


def test_confirmed_writes_ends_words_as_its_sql(spark, con, tmp_path):
    texts = ["undßpfö", "ßund", "UND", "unde", "à und", "àund", "und÷", "", None, "l'une\n", "undœ", "ÉUNE"]
    rows = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    frame = queries()["confirmed_writes"](spark, str(tmp_path))
    assert frame.filter("code = 'ok'").count() == 6
    sql = f"WITH conversations AS (SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet') {oracle_sql()['confirmed_writes']}"
    assert oracle.compare(frame, con, sql) is None
