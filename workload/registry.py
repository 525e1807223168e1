"""Collects queries with their oracle statements."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workload.oracle_tables import compose


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of a double, which writes out the decimal digits of each value, by arithmetic where that is exact.

    Away from the middle between two results, the nearest whole number of units is beyond doubt; it and the power of ten
    are exact doubles, so their quotient is the double nearest to the rounded decimal, as ``F.round`` gives it.
    """
    power = F.lit(10.0**digits)
    units = value * power
    plain = (F.abs(units) < 1e12) & (F.abs(F.abs(units - F.rint(units)) - 0.5) > 1e-3)
    return F.when(plain, F.rint(units) / power).otherwise(F.round(value, digits))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable values: rounded doubles (never -0.0) and 64-bit integers.

    The row number the derived tables carry is left out.
    """
    columns = []
    for name, kind in df.dtypes:
        if name == "point":
            continue
        column = F.col(f"`{name}`")
        if kind in ("double", "float"):
            column = rounded(column.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("long")
        columns.append(column.alias(name))
    return df.select(*columns)


class Registry:
    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def add(self, name, sql=None, tables=None, digits=6):
        def keep(function):
            def run(spark, sf_dir):
                return tidy(function(spark, sf_dir), digits)

            run.__name__ = name
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = compose(sql, tables)
            return function

        return keep
