"""Every registered query that has SQL gives the rows that DuckDB gives."""

import re

import duckdb
import numpy as np
import pytest

from skyframe import queries_files, queries_images, queries_records  # noqa: F401
from skyframe.operators import stats as S
from skyframe.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    rel = duck.sql(SQL[name])
    names = list(rel.columns)
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in order) for row in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["catalog_rollup", "percentile_table", "percentile_scale_asinh", "tier_census", "qc_survival"])
def test_no_group_is_ranked_in_one_map(spark, data, name, capsys):
    QUERIES[name](spark, data).explain()
    assert not re.search(r"\b(percentile|median|percentile_cont)\(", capsys.readouterr().out)


def test_group_min_size_keeps_six_before_it_collects(spark, data, capsys):
    QUERIES["group_min_size"](spark, data).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_percentiles_of_small_and_large_groups(spark):
    rng = np.random.default_rng(0)
    values = {k: rng.normal(size=n) for k, n in ((None, 9), (1, 1), (2, 7), (3, 150), (4, 30_000))}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x], "k int, v double")
    shares = [0.01, 0.1, 0.5, 0.9, 0.995]
    for r in S.percentiles(df, ["k"], "v", shares).collect():
        assert np.allclose(r[1:], np.quantile(values[r.k], shares))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
