"""The numbered operators that have SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from skyframe.llm.oracle import SQL
from skyframe.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rel = con.sql(SQL[name])
    names = list(rel.columns)
    order = [names.index(c) for c in columns]
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(str(tuple(row[i] for i in order)) for row in rel.fetchall())


def test_registered():
    import __spark_entry__ as entry

    assert {n for n in entry.queries() if n.startswith("op")} == set(QUERIES) and {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in entry.queries() and set(SQL) <= set(entry.oracle_sql())
