"""Severity class of a delay."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import SEVERITY_CLASSES


def severity(delay: Column) -> Column:
    """Label of the first class whose upper bound the delay does not exceed."""
    label = F.lit(None).cast("string")
    for name, upper in reversed(SEVERITY_CLASSES):
        if upper is None:
            label = F.lit(name)
        else:
            label = F.when(delay <= upper, F.lit(name)).otherwise(label)
    return F.when(delay.isNotNull() & ~F.isnan(delay), label)
