"""Numeric expressions: safe ratios and right-closed classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as DOUBLE, NULL for a zero or missing denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def right_closed(value: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Class label for (edge, next edge]; NULL outside all classes.

    MLlib's ``Bucketizer`` closes the left edge, so it cannot be used here.
    """
    value = F.col(value) if isinstance(value, str) else value
    expr = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        expr = F.when((value > F.lit(low)) & (value <= F.lit(high)), label).otherwise(expr)
    return expr
