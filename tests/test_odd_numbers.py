"""Numbers that the given tables lack: missing, negative, very small and very large ones give what the SQL gives."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyframe import queries_records  # noqa: F401
from skyframe.functions import exprs as E
from skyframe.queries import QUERIES, SQL, r

VALUES = [None, 0.0, 30.0, 50.0, 60.0, 130.0, -50.0, math.nan, math.inf, -math.inf, 1e-20, 1e160, -7e8, -7e9]
# these were rounded to the other side in `restored` or `corner`
VALUES += [-230.82091649998813, -317.00376849997156, 16718.03234250001, 134008.9183734999, 181737.71436513052]


def exact(rows):
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.fixture
def events(tmp_path):
    pairs = [(v, u) for v in VALUES for u in [None, *range(12), 1499, 90_003]]
    value, user = zip(*pairs, strict=True)
    columns = {"event_id": pa.array(range(len(pairs))), "user_id": pa.array(user, pa.int64()), "event_type": pa.array([str(k % 3) for k in range(len(pairs))]), "value": pa.array(value, pa.float64())}
    pq.write_table(pa.table(columns), tmp_path / "events.parquet")
    return tmp_path


def test_more_expressions_on_odd_numbers(spark, events):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet'")
    want = con.sql(SQL["more_expressions"])
    got = QUERIES["more_expressions"](spark, str(events)).select(*want.columns)
    assert exact(got.collect()) == exact(want.fetchall())


def test_asinh_and_back(spark):
    values = [0.0, 1e-20, -1e-20, 1.0, -1.0, -1e8, -1e9, 1e160, -1e160, 1.7e308]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "x double").withColumn("y", E.asinh_stretch(F.col("x"), F.lit(1.0)))
    got = {row.x: row for row in df.withColumn("back", E.asinh_restore(F.col("y"), F.lit(1.0))).collect()}
    assert [got[x].y for x in values] == [math.asinh(x) for x in values] and got[None].y is None
    assert all(math.isclose(got[x].back, x, rel_tol=1e-12) for x in values[:-1]) and got[None].back is None
    assert spark.range(1).select(E.asinh_restore(F.lit(-800.0), F.lit(1.0))).first()[0] == -math.inf


def test_rounding_is_that_of_sql(spark):
    values = [1.005, -1.005, 2.5, 0.125, 8.345, 1.115, 0.285, 1e15 + 0.5, 72357.33587050001, math.inf, None]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 2)", [x]).fetchall()[0][0] for x in values]
    df = spark.createDataFrame(list(enumerate(values)), "k int, x double")
    assert [row.y for row in df.select("k", r(F.col("x"), 2).alias("y")).orderBy("k").collect()] == want


def test_more_expressions_on_negative_ids_and_zeros(spark, tmp_path):
    """Ids under zero, whose logarithm is undefined; zeros with a sign; values whose product with the power of ten is infinite.  Signs of zeros count."""
    pairs = [(v, u) for v in [None, -0.0, 0.0, -1e-7, -4e-7, 1.7e308, -1e305, 1e303, 12.34, -12.34] for u in [None, -1, -2, -3, -4, -1501, -(2**62) - 1, 5, 2**53 + 1]]
    value, user = zip(*pairs, strict=True)
    columns = {"event_id": pa.array(range(len(pairs))), "user_id": pa.array(user, pa.int64()), "event_type": pa.array(["0"] * len(pairs)), "value": pa.array(value, pa.float64())}
    pq.write_table(pa.table(columns), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(SQL["more_expressions"])
    got = QUERIES["more_expressions"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(map(repr, row)) for row in got.collect()) == sorted(tuple(map(repr, row)) for row in want.fetchall())


def test_rounding_of_the_largest(spark):
    values = [1.7e308, -1e305, 1e302, -math.inf, math.nan]
    df = spark.createDataFrame(list(enumerate(values)), "k int, x double").select("k", r(F.col("x")).alias("y")).orderBy("k")
    assert [repr(row.y) for row in df.collect()] == [repr(x) for x in values]
