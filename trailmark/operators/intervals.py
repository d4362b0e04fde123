"""Means with confidence intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def t_quantile(df: int, p: float = 0.975) -> float:
    """Student's t quantile by bisection on its distribution function (Simpson's rule)."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    pdf = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)

    def cdf(x: float, n: int = 2000) -> float:
        h = x / n
        return 0.5 + h / 3 * (pdf(0) + pdf(x) + 4 * sum(pdf(h * i) for i in range(1, n, 2)) + 2 * sum(pdf(h * i) for i in range(2, n, 2)))

    lo, hi = 0.0, 700.0 / df + 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def t_table(most: int = 30) -> list[tuple[int, float]]:
    return [(d, round(t_quantile(d), 4)) for d in range(1, most + 1)]


def student(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, count and the half-width of a 95 % Student interval; a group of one has deviation and width 0."""
    table = df.sparkSession.createDataFrame(t_table(), "df int, q double")  # 30 rows
    g = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))
    g = g.join(F.broadcast(table), F.least(F.col("n") - 1, F.lit(30)) == F.col("df"), "left")
    q = F.when(F.col("n") > 31, 1.96).otherwise(F.coalesce("q", F.lit(0.0)))
    return g.select(*keys, F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n", F.round(q * F.col("std") / F.sqrt(F.col("n").cast("double")), 6).alias("half_width"))


def normal(keys: list[str], df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(1.96 * F.stddev_pop(value) / F.sqrt(F.count(value).cast("double")), 6).alias("half_width"))


def standard_error(value: str) -> Column:
    return F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))
