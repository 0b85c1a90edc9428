"""Running sums, ranks and exact quantiles over a whole column by ranges of its values, so that no task orders all of it.

Rows are first summed up by value, which takes out hot values; ranges come from approximate quantiles and only balance the work: results are exact whatever they are.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.udf import vectorized

MOST_RANGES = 64


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys are the left's."""
    right = right.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}_right")) for k in keys], how).drop(*(f"_{k}_right" for k in keys))


def running(df: DataFrame, column: str, by: list[str] | None = None, measures: dict[str, Column] | None = None, nulls: bool = False) -> DataFrame:
    """A row for each distinct value of the column (and of `by`): each measure, a sum or count over its rows, with `_before`, over the smaller values, and `_total`, over all.

    measures: name -> aggregate, the number of rows as n by default. Rows with null are left out, or with nulls=True come before all others.
    """
    by, measures = by or [], measures or {"n": F.count("*")}
    values = (df if nulls else df.where(F.col(column).isNotNull())).groupBy(*by, column).agg(*(m.alias(k) for k, m in measures.items()))
    parts = max(2, min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = values.groupBy(*by).agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 100 * parts).alias("_bounds"))
    # one row where there are no groups
    placed = beside(values, bounds, by) if by else values.join(F.broadcast(bounds))
    placed = placed.withColumn("_range", F.when(F.col(column).isNull(), F.lit(-1)).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col(column))))).drop("_bounds")
    groups = Window.partitionBy(*by)
    above = groups.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "_range").agg(*(F.sum(k).alias(k) for k in measures))
    sums = sums.select(*by, "_range", *(F.coalesce(F.sum(k).over(above), F.lit(0)).alias(f"{k}_offset") for k in measures), *(F.sum(k).over(groups).alias(f"{k}_total") for k in measures))
    own = Window.partitionBy(*by, "_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({f"{k}_inside": F.coalesce(F.sum(k).over(own), F.lit(0)) for k in measures})
    both = beside(inside, sums, [*by, "_range"])
    return both.select(*by, column, *(c for k in measures for c in (F.col(k), (F.col(f"{k}_inside") + F.col(f"{k}_offset")).alias(f"{k}_before"), F.col(f"{k}_total"))))


def with_rank(df: DataFrame, column: str, target: str, by: list[str] | None = None, nulls: bool = False) -> DataFrame:
    """df with the rank of the column from 1, ties sharing their mean; null ranks first, or without nulls has none."""
    by = by or []
    ranks = running(df, column, by, nulls=nulls).select(*by, column, (F.col("n_before") + (F.col("n") + 1) / 2).alias(target))
    return beside(df, ranks, [*by, column], "left")


@vectorized("double")
def _fused(lo: pd.Series, hi: pd.Series, share: pd.Series) -> pd.Series:
    return pd.Series([float(Fraction(a) * Fraction(1 - w) + Fraction(b * w)) if math.isfinite(a) and math.isfinite(b) else None for a, b, w in zip(lo, hi, share)], dtype="float64")


def _between(lo: Column, hi: Column, share: Column) -> Column:
    """lo * (1 - share) + hi * share, of which the first product and the sum are rounded once, together, as DuckDB does: an edge may be a value of the column, so its last bit decides on which side all its rows are."""
    finite = (F.abs(lo) < float("inf")) & (F.abs(hi) < float("inf"))
    return F.when(finite, _fused(lo, hi, share)).otherwise(lo * (1 - share) + hi * share)


def quantiles(df: DataFrame, column: str, at: list[float], by: list[str] | None = None, target: str = "quantiles") -> DataFrame:
    """(by, quantiles): the exact quantiles at these shares, interpolated linearly between neighbouring rows; groups without a value have no row."""
    by = by or []
    values = running(df, column, by)

    def held(place: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n")), F.col(column).cast("double")))

    ends = []
    for i, q in enumerate(at):
        place = F.lit(q) * (F.col("n_total") - 1)
        ends += [held(F.floor(place)).alias(f"_lo{i}"), held(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_w{i}")]
    found = values.groupBy(*by).agg(*ends)
    return found.select(*by, F.array(*(_between(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_w{i}")) for i in range(len(at)))).alias(target))
