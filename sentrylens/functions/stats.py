"""Small statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null on an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1, 0 when there is nothing to find and nothing found."""
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Rates of a confusion matrix; null on a zero denominator, F1 0."""
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": f1(tp, fp, fn),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, tp + fn),
    }


def wilson(x: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """AGG30: Wilson score interval of x successes in n trials."""
    p = ratio(x, n)
    n = n.cast("double")
    center = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (center - spread) / scale, (center + spread) / scale


def entropy_from(total: Column, sum_n_log_n: Column) -> Column:
    """Entropy in nats of counts: log N - sum(n log n) / N."""
    return F.log(total.cast("double")) - sum_n_log_n / total.cast("double")


def n_log_n(n: Column) -> Column:
    return n * F.log(n.cast("double"))
