"""Aggregation over records whose numbers are text, pivots, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strict_number

PIVOT_FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "average": F.avg, "min": F.min, "max": F.max}
#: Upper bounds of the fixed histogram, in the unit of the values.
BUCKETS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 5000.0)


def record_sum(text: Column) -> Column:
    """Sum of what parses; NaN goes through; 0.0 for none."""
    return F.coalesce(F.sum(strict_number(text)), F.lit(0.0))


def record_avg(text: Column) -> Column:
    return F.coalesce(F.avg(strict_number(text)), F.lit(0.0))


def record_min(text: Column) -> Column:
    """Least of what parses and is a number; null for none."""
    n = strict_number(text)
    return F.min(F.when(~F.isnan(n), n))


def record_max(text: Column) -> Column:
    n = strict_number(text)
    return F.max(F.when(~F.isnan(n), n))


def grouped(df: DataFrame, field: str, value: str) -> DataFrame:
    """Per value of ``field`` (rows without it are dropped): count, sum, avg, min, max of the parsable values, 0.0 where there is none."""
    v = F.col(value)
    return df.where(F.col(field).isNotNull()).groupBy(field).agg(
        F.count(F.lit(1)).alias("n"), record_sum(v).alias("total"), record_avg(v).alias("mean"), F.coalesce(record_min(v), F.lit(0.0)).alias("least"), F.coalesce(record_max(v), F.lit(0.0)).alias("most")
    )


def pivot(df: DataFrame, rows: list[str], column: str, values: list[str], function: str, measure: str, totals: bool = True) -> DataFrame:
    """Rows by columns; with totals a row with null keys for the whole, by rollup, and a column 'total'.  ``values`` fixes the columns, so no pass looks for them."""
    f = PIVOT_FUNCTIONS[function.lower()]
    cells = [f(F.when(F.col(column) == v, F.col(measure))).alias(v) for v in values]
    grouped_by = df.rollup(*rows) if totals else df.groupBy(*rows)
    return grouped_by.agg(*cells, *([f(F.col(measure)).alias("total")] if totals else []))


def row_function(name: str, cols: list[Column]) -> Column:
    """Row-wise sum, average, min, max, product, count over number columns; nulls and NaN skipped in min and max; none gives 0 (product 1)."""
    xs = F.filter(F.array(*cols), lambda x: x.isNotNull())
    real = F.filter(xs, lambda x: ~F.isnan(x))
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return {
        "sum": total, "average": F.when(F.size(xs) == 0, 0.0).otherwise(total / F.size(xs)), "min": F.coalesce(F.array_min(real), F.lit(0.0)), "max": F.coalesce(F.array_max(real), F.lit(0.0)),
        "product": F.aggregate(xs, F.lit(1.0), lambda a, x: a * x), "count": F.size(xs).cast("double"),
    }[name]


def histogram_percentile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Upper bound of the fixed bucket where the running count reaches floor(n * share); infinity beyond the last bound."""
    edges = [*BUCKETS, float("inf")]
    counts = [F.count_if(F.col(value) <= e).alias(f"_{i}") for i, e in enumerate(edges)]
    agg = df.groupBy(*keys).agg(F.count(F.col(value)).alias("n"), *counts)
    need = F.floor(F.col("n") * share)
    bound = F.coalesce(*[F.when(F.col(f"_{i}") >= need, F.lit(e)) for i, e in enumerate(edges)])
    return agg.select(*keys, "n", bound.alias("bound"))
