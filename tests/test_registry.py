"""Rounding of registered results."""

import random

from pyspark.sql import functions as F

from workload.registry import rounded, tidy


def test_rounding_by_arithmetic_is_that_of_spark(spark):
    dice = random.Random(3)
    values = [dice.uniform(-1, 1) * 10.0 ** dice.randint(-8, 17) for _ in range(4000)]
    values += [k / 2 / 10**d + e for d in (3, 4, 6) for k in range(-301, 302, 2) for e in (0.0, 1e-12, -1e-12)]
    values += [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 5e-324, 1e300, 2.0**53, 1.00005, 0.99995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 4, 6):
        both = df.select("v", (rounded(F.col("v"), digits) + 0.0).alias("a"), (F.round("v", digits) + 0.0).alias("b"))
        assert both.where("NOT a <=> b").collect() == []


def test_few_values_are_written_out_in_digits(spark):
    """Rounding a value by its decimal digits took most of the time of queries with many rows."""
    plan = tidy(spark.range(3).selectExpr("id + 0.5D AS v"), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "rint(" in plan.lower()
