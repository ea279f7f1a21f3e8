"""Exporting results as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Cells are written as they were read: no trimming, blanks stay blank.
_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_csv(
    df: DataFrame, folder: str, order: str | Sequence[str] | None = None, compression: str = "none"
) -> None:
    """CSV part files; with ``order`` the parts follow each other by these columns (range-sorted), which are left out."""
    if order is not None:
        names = [order] if isinstance(order, str) else list(order)
        df = df.orderBy(*names).drop(*names)
    df.write.mode("error").options(compression=compression, **_CSV).csv(folder)
