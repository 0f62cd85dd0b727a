"""Aggregations of reference and alternate tracks, losses and correlations, as aggregate expressions.

All are plain sums, means and maxima, so Spark aggregates partially before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coords import C, _c

EPSILON = 1e-8


def _d(x: C) -> Column:
    return _c(x).cast("double")


def _log2(x: Column) -> Column:
    return F.log2(x)


def variant_aggregation(kind: str, ref: C, alt: C) -> Column:
    """One of the eight aggregations over the bins of a mask; an empty mask gives 0, or the root of epsilon for distances."""
    r, a = _d(ref), _d(alt)
    zero = F.lit(0.0)
    mean, total = (lambda x: F.coalesce(F.avg(x), zero)), (lambda x: F.coalesce(F.sum(x), zero))
    return {
        "diff_mean": lambda: mean(a) - mean(r),
        "diff_sum": lambda: total(a) - total(r),
        "diff_sum_log2": lambda: total(_log2(a + 1)) - total(_log2(r + 1)),
        "diff_log2_sum": lambda: _log2(1 + total(a)) - _log2(1 + total(r)),
        "l2_diff": lambda: F.sqrt(total(F.pow(a - r, 2.0)) + EPSILON),
        "l2_diff_log1p": lambda: F.sqrt(total(F.pow(F.log1p(a) - F.log1p(r), 2.0)) + EPSILON),
        "active_mean": lambda: F.greatest(mean(a), mean(r)),
        "active_sum": lambda: F.greatest(total(a), total(r)),
    }[kind]()


AGGREGATIONS = ("diff_mean", "diff_sum", "diff_sum_log2", "diff_log2_sum", "l2_diff", "l2_diff_log1p", "active_mean", "active_sum")
SIGNED = AGGREGATIONS[:4]


def log_fold_change(ref: C, alt: C) -> Column:
    return F.ln(F.avg(_d(alt)) + 1e-3) - F.ln(F.avg(_d(ref)) + 1e-3)


def active(ref: C, alt: C) -> Column:
    return F.greatest(F.avg(_d(ref)), F.avg(_d(alt)))


def max_abs_change(ref: C, alt: C) -> Column:
    return F.max(F.abs(_d(alt) - _d(ref)))


def pearson(x: C, y: C, epsilon: float = EPSILON) -> Column:
    """Correlation from sums with ``epsilon`` in the denominator: 0 for constants, where ``corr`` has no value."""
    a, b, n = _d(x), _d(y), F.count("*")
    return F.covar_pop(a, b) * n / (F.sqrt(F.var_pop(a) * n) * F.sqrt(F.var_pop(b) * n) + epsilon)


def cosine(x: C, y: C) -> Column:
    return F.try_divide(F.sum(_d(x) * _d(y)), F.sqrt(F.sum(_d(x) * _d(x)) * F.sum(_d(y) * _d(y))))


def masked_mean(value: C, mask: C) -> Column:
    m = _c(mask).cast("double")
    return F.sum(_d(value) * m) / F.greatest(F.sum(m), F.lit(1.0))


def poisson_term(predicted: C, true: C) -> Column:
    """Poisson loss of one value less its least value over predictions; mean of these is the loss."""
    p, t = _d(predicted), F.abs(_d(true))
    low = t - t * F.ln(t + 1e-7)
    return p - t * F.ln(p + 1e-7) - low


def bce_term(logit: C, label: C) -> Column:
    """Binary cross entropy of one logit, without overflow."""
    x, y = _d(logit), _d(label)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def mse(predicted: C, true: C) -> Column:
    return F.avg(F.pow(_d(predicted) - _d(true), 2.0))
