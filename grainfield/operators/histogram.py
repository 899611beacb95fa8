"""Exact histograms and order statistics by rank.

A histogram has at most 65,536 rows per frame and plane, whatever the number of samples: the one shuffle of
samples is the partial count, and windows run over histograms only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("frame", "plane")


def histogram(samples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return samples.where("code is not null").groupBy(*keys, "code").agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`hist` with `cum` (samples up to the code), `total`, `low` and `high` (occupied ends)."""
    by = Window.partitionBy(*keys)
    upto = by.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("*", F.sum("n").over(upto).alias("cum"), F.sum("n").over(by).alias("total"), F.min("code").over(by).alias("low"), F.max("code").over(by).alias("high"))


def at_rank(rank: Column) -> Column:
    """Aggregate over a cumulative histogram: the smallest code with more than `rank` samples up to it."""
    return F.min(F.when(F.col("cum") > F.least(rank, F.col("total") - 1), F.col("code")))


def rank_of_quantile(fraction: float) -> Column:
    f = min(1.0, max(0.0, fraction))
    return F.floor(F.lit(f) * (F.col("total") - 1))


def rank_of_tail(fraction: Column | float, high: bool) -> Column:
    count = F.floor((F.lit(fraction) if isinstance(fraction, float) else fraction) * F.col("total"))
    return F.greatest(F.lit(0), F.col("total") - 1 - count) if high else count


def quantile(fraction: float) -> Column:
    return at_rank(rank_of_quantile(fraction))


def tail_value(fraction: Column | float, high: bool) -> Column:
    return at_rank(rank_of_tail(fraction, high))


def percent_where(test: Column) -> Column:
    """Percentage of samples whose code passes, over a histogram."""
    return 100 * F.sum(F.when(test, F.col("n")).otherwise(0)) / F.sum("n")


def entropy(total: Column) -> Column:
    p = F.col("n") / total
    return -F.sum(p * F.log2(p))


def summary(cdf: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return cdf.groupBy(*keys).agg(
        F.min("code").alias("min_code"), F.max("code").alias("max_code"), F.sum("n").alias("total"), F.count("*").alias("occupied"), entropy(F.col("total")).alias("entropy_bits")
    )


# Order statistics of an array column, with the ties and sides that the operators need.


def sorted_at(values: Column, index: Column) -> Column:
    return F.get(F.array_sort(values), index.cast("int"))


def lower_fifth(values: Column) -> Column:
    return sorted_at(values, F.expr("0") + F.floor(F.size(values) / 5))


def upper_middle(values: Column) -> Column:
    return sorted_at(values, F.floor(F.size(values) / 2))


def nearer_zero_median(values: Column) -> Column:
    """The middle value; of two middle values the one nearer to zero (the lower one if they tie)."""
    n = F.size(values)
    a, b = sorted_at(values, F.floor((n - 1) / 2)), sorted_at(values, F.floor(n / 2))
    return F.when(F.abs(a) <= F.abs(b), a).otherwise(b)


def conservative_mad(values: Column, median: Column) -> Column:
    """1.4826 times the lower middle of the distances to `median`."""
    away = F.transform(values, lambda v: F.abs(v - median))
    return sorted_at(away, F.floor((F.size(values) - 1) / 2)) * 1.4826
