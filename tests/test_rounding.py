"""Column expressions that must give what Python gives, digit for digit."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyframe.functions import exprs as E


@pytest.mark.parametrize("digits", [5, 2, 0])
def test_python_round(spark, digits):
    rng = random.Random(digits)
    values = [0.0, -0.0, 5e-6, 1.000005, 2.675, 1 / 64, 3 / 64, 184.698291666, math.nan, math.inf, -math.inf, None, 1e-12, 359.999995, 2.0**30 + 0.5]
    values += [k * 5e-6 for k in range(-1500, 1500)] + [round(rng.uniform(-360, 360), 5) + 5e-6 for _ in range(1500)] + [rng.randrange(-(10**6), 10**6) / 64 for _ in range(1500)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for r in df.select("x", E.python_round(F.col("x"), digits).alias("r")).collect():
        want = r.x if r.x is None or not math.isfinite(r.x) else round(r.x, digits)
        assert r.r == want or (math.isnan(want) and math.isnan(r.r)), r


def test_python_round_is_plain_arithmetic(spark):
    """No decimals, whose arithmetic took most of a large table's time."""
    plan = spark.range(1).select(E.python_round(F.col("id") * 5e-6))._jdf.queryExecution().executedPlan().toString()
    assert "decimal" not in plan.lower()
