"""Scalar measures and aggregates with the engine's rule that nothing measured is null, not zero."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate(hits, among) -> Column:
    """Share of rows in ``among`` that are ``hits``; null if there are none. An aggregate."""
    return F.avg(F.when(_c(among), _c(hits).cast("double")))


def harmonic(error_acc, correct_acc) -> Column:
    """Harmonic mean of two accuracies: null if one is, 0 if one is 0."""
    e, c = _c(error_acc), _c(correct_acc)
    return F.when(e.isNull() | c.isNull(), None).when((e <= 0) | (c <= 0), 0.0).otherwise(2 * e * c / (e + c))


def is_clean(label) -> Column:
    return _c(label) == -1


def has_error(label) -> Column:
    return _c(label) != -1


def stage1_error(math_ok, consistency_ok) -> Column:
    return ~(_c(math_ok) & _c(consistency_ok))


def is_error(math_ok, consistency_ok, prob, threshold: float = 0.5) -> Column:
    """Flagged by the first stage, or by a score below the threshold; no score is no flag."""
    return stage1_error(math_ok, consistency_ok) | F.coalesce(_c(prob) < threshold, F.lit(False))


def gold_ok_step(gold_label, step_index) -> Column:
    """Steps before the first wrong one, or any of a clean solution."""
    return is_clean(gold_label) | (_c(step_index) < _c(gold_label))


def average_rank(value, *partition) -> Column:
    """Rank from 1 in which equal values share their average rank."""
    own = Window.partitionBy(*partition)
    return F.rank().over(own.orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2.0


def safe_corr(x, y) -> Column:
    """Pearson's correlation, 0 if one side does not vary. An aggregate."""
    flat = (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    cov = F.covar_pop(x, y)
    return F.when(flat, 0.0).otherwise(F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y)))


def mcnemar_statistic(b_only, a_only) -> Column:
    """Chi-square with continuity correction; 0 without discordant pairs."""
    b, a = _c(b_only), _c(a_only)
    return F.coalesce(F.try_divide(F.pow(F.abs(b - a) - 1, F.lit(2)), b + a), F.lit(0.0))


def chi2_p_value(statistic) -> Column:
    """erfc(sqrt(x / 2)) for chi-square with one degree of freedom, natively.

    Abramowitz and Stegun's rational form 7.1.26 refined to double precision would need a table; instead
    erfc is summed: the Maclaurin series of erf below 2, and the continued fraction of erfc from there on.
    """
    z = F.sqrt(_c(statistic) / 2)
    # erf(z) = 2/sqrt(pi) * exp(-z^2) * sum_k 2^k z^(2k+1) / (2k+1)!!
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, k: F.struct((acc["term"] * 2 * z * z / (2 * k + 1)).alias("term"), (acc["total"] + acc["term"] * 2 * z * z / (2 * k + 1)).alias("total")),
        lambda acc: acc["total"],
    )
    small = 1 - 2 / F.sqrt(F.lit(3.141592653589793)) * F.exp(-z * z) * series
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), z, lambda acc, k: z + (k / 2.0) / acc)
    large = F.exp(-z * z) / F.sqrt(F.lit(3.141592653589793)) / fraction
    return F.when(z < 2, small).otherwise(large)
