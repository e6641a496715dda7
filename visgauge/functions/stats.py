"""Ratios, means and tests that reports are made of, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def ratio(part: Column, whole: Column, digits: int | None = DIGITS) -> Column:
    """part / whole, or 0.0 where whole is 0 or null."""
    q = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return q if digits is None else F.round(q, digits)


def f1(precision: Column, recall: Column, digits: int | None = DIGITS) -> Column:
    return ratio(2.0 * precision * recall, precision + recall, digits)


def rounded_mean(x: Column, digits: int = DIGITS) -> Column:
    """Mean of the values that are not null, 0.0 if there are none."""
    return F.round(F.coalesce(F.avg(x), F.lit(0.0)), digits)


def exact_percentile(x: Column, share: float, digits: int = DIGITS) -> Column:
    """Percentile by linear interpolation between neighbours of the sorted values; 0.0 if there are none. Exact, so that
    each group's distinct values are counted in one buffer: round values that are as many as the rows before."""
    return F.round(F.coalesce(F.percentile(x.cast("double"), F.lit(share)), F.lit(0.0)), digits)


def _normal_tail(z: Column) -> Column:
    """The normal distribution up to z, for z <= 0: a series near 0, a continued fraction further out, in bounded steps."""
    x = -z
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    first = F.struct(x.alias("term"), x.alias("sum"))
    step = lambda acc, i: F.struct((acc["term"] * x * x / (2 * i + 1)).alias("term"), (acc["sum"] + acc["term"] * x * x / (2 * i + 1)).alias("sum"))
    near = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(60)), first, step)["sum"]
    far = density / F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda acc, i: x + i / acc)
    return F.when(x < 3, near).otherwise(F.when(x < 38, far).otherwise(0.0))


def mcnemar(only_first: Column, only_second: Column, digits: int = DIGITS, exact_up_to: int = 8192) -> Column:
    """Two-sided p-value of McNemar's test: twice the binomial tail at 1/2 up to the smaller count, at most 1.

    Up to exact_up_to discordant pairs the terms are summed relative to the greatest of them, whose logarithm is carried
    along. Beyond, the tail is that of the normal distribution with the terms of order 1/n of its expansion, which leaves
    an error below 1e-7, so that no count needs more memory than another. 1.0 where both counts are 0.
    """
    n = (only_first + only_second).cast("long")
    least = F.least(only_first, only_second).cast("long")
    start = F.struct(F.lit(0.0).alias("log_term"), F.lit(float("-inf")).alias("log_sum"))

    def step(acc: Column, i: Column) -> Column:
        term = F.when(i == 0, F.lit(0.0)).otherwise(acc["log_term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))
        top = F.greatest(acc["log_sum"], term)
        return F.struct(term.alias("log_term"), (top + F.log(F.exp(acc["log_sum"] - top) + F.exp(term - top))).alias("log_sum"))

    bounded = F.least(least, F.lit(exact_up_to).cast("long"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), bounded), start, step)["log_sum"]
    exact = F.exp(tail + F.log(F.lit(2.0)) - n * F.log(F.lit(2.0)))
    z = F.least(F.lit(0.0), (2 * least + 1 - n) / F.sqrt(n.cast("double")))
    shift = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (z * z * z - z) / (12 * n)
    p = F.when(n <= exact_up_to, exact).otherwise(F.when(2 * least + 1 >= n, F.lit(1.0)).otherwise(2 * (_normal_tail(z) + shift)))
    return F.round(F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p)), digits)


def present(flags: dict[str, Column]) -> Column:
    """The names, in order, of the flags that are true."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]), lambda x: x.isNotNull())


def weighted(terms: list[tuple[float, Column]]) -> Column:
    """The sum of weights times values; true counts 1, and null counts 0."""
    total = F.lit(0.0)
    for weight, value in terms:
        total = total + F.lit(float(weight)) * F.coalesce(value.cast("double"), F.lit(0.0))
    return total
