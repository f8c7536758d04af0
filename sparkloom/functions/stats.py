"""Paired statistics: sign test, paired counts, bootstrap intervals of ratio differences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


EXACT_PAIRS = 10_000


def binomial_tail(n: int, k: int) -> float:
    """Two-sided sign test of k against n - k (k the smaller): exact up to EXACT_PAIRS pairs, from logarithms beyond.

    The terms fall from C(n, k) downwards by factors (k - j) / (n - k + j + 1); after 5 sqrt(n) of them the rest is below
    e**-50 of the first, beyond a double's digits, so work grows with sqrt(n).
    """
    if n <= EXACT_PAIRS:
        term = tail = 1
        for i in range(k):
            term = term * (n - i) // (i + 1)
            tail += term
        return min(1.0, 2 * tail / 2**n)
    j = np.arange(min(k, math.isqrt(25 * n) + 1), dtype=float)
    terms = 1 + np.cumprod((k - j) / (n - k + j + 1)).sum()
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    return min(1.0, 2 * math.exp(first) * float(terms))


@F.pandas_udf(T.DoubleType())
def sign_test(first: pd.Series, second: pd.Series) -> pd.Series:
    """Two-sided sign test of two counts; 1 without untied pairs."""
    return pd.Series([binomial_tail(int(a + b), int(min(a, b))) for a, b in zip(first, second, strict=True)], dtype=float)


def paired_counts(a: str, b: str) -> list[Column]:
    """Units, those where A is lower (better), where B is, and ties."""
    return [F.count(F.lit(1)).alias("units"), F.count_if(F.col(a) < F.col(b)).alias("a_better"), F.count_if(F.col(a) > F.col(b)).alias("b_better"), F.count_if(F.col(a) == F.col(b)).alias("ties")]


def draw(rep: Column, k: Column, n: Column) -> Column:
    """The k-th of n draws of a resample: a hash of both, so any engine draws the same."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", rep, k)), 25, 8), 16, 10).cast("long"), n)


def bootstrap_multinomial(units: DataFrame, key: str, sums: tuple[str, str, str, str], reps: int) -> DataFrame:
    """(rep, diff): per resample, sum(a)/sum(b) - sum(c)/sum(d) over n draws of n units with replacement.

    Units are clusters, summed beforehand: there are few of them, whatever the rows. Resamples without a
    denominator are left out.
    """
    spark = units.sparkSession
    names = tuple(dict.fromkeys(sums))
    grouped = units.groupBy(key).agg(*[F.sum(s).alias(s) for s in names])
    placed = grouped.select(*names, (F.row_number().over(Window.orderBy(key)) - 1).alias("at"))
    total = grouped.agg(F.count(F.lit(1)).alias("n"))
    draws = spark.range(1, reps + 1).select(F.col("id").alias("rep")).join(F.broadcast(total)).select("rep", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    picked = draws.select("rep", draw(F.col("rep"), F.col("k"), F.col("n")).cast("int").alias("at")).groupBy("rep", "at").agg(F.count(F.lit(1)).alias("w"))
    a, b, c, d = (F.sum(F.col(s) * F.col("w")) for s in sums)
    return picked.join(placed, "at").groupBy("rep").agg((F.try_divide(a.cast("double"), b) - F.try_divide(c.cast("double"), d)).alias("diff")).where("diff is not null")


def poisson_weight(rep: Column, key: Column) -> Column:
    """A Poisson(1) weight from a hash of resample and unit, by inversion; units need no numbering."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", rep, key)), 25, 8), 16, 10).cast("double") / float(2**32)
    out, cdf = F.lit(0), 0.0
    for k in range(9):
        cdf += math.exp(-1) / math.factorial(k)
        out = out + F.when(u >= cdf, 1).otherwise(0)
    return out


def bootstrap_poisson(units: DataFrame, key: str, sums: tuple[str, str, str, str], reps: int) -> DataFrame:
    """As bootstrap_multinomial, but each unit draws its own weight: one pass, partial sums, no join."""
    wide = units.select(F.col(key).alias("_k"), *dict.fromkeys(sums), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    w = wide.withColumn("w", poisson_weight(F.col("rep"), F.col("_k"))).where("w > 0")
    a, b, c, d = (F.sum(F.col(s) * F.col("w")) for s in sums)
    return w.groupBy("rep").agg((F.try_divide(a.cast("double"), b) - F.try_divide(c.cast("double"), d)).alias("diff")).where("diff is not null")


def interval(diffs: DataFrame, diff: str = "diff") -> DataFrame:
    """95 % percentile interval (linear), standard error (n - 1; 0 for one) and number of valid resamples."""
    lo, hi = F.percentile(diff, F.lit(0.025)), F.percentile(diff, F.lit(0.975))
    return diffs.agg(F.round(lo, 9).alias("low"), F.round(hi, 9).alias("high"), F.round(F.coalesce(F.stddev_samp(diff), F.lit(0.0)), 9).alias("se"), F.count(diff).alias("valid"))


def interval_stepwise(diffs: DataFrame, diff: str = "diff") -> DataFrame:
    """The other rule: the sorted value at int(q * (n - 1)), without interpolation. Resamples are few."""
    ordered = F.array_sort(F.collect_list(diff))
    at = lambda q: F.get(ordered, (F.lit(q) * (F.size(ordered) - 1)).cast("int"))
    return diffs.agg(F.round(at(0.025), 9).alias("low"), F.round(at(0.975), 9).alias("high"))
