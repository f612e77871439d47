"""Latest version per key, and helpers for dirty keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``version``, projected to ``columns``.

    Exact copies count once.  Rows with a null key have no identity and are left out; a null version is the
    oldest.  Of different rows with one version the first in the order of the remaining columns is taken, so
    that the choice doesn't depend on the partitioning.  An empty table gives an empty table.
    """
    columns = list(dict.fromkeys([key, *columns]))
    rest = [F.col(f"`{c}`").asc_nulls_last() for c in columns if c not in (key, version)]
    w = Window.partitionBy(F.col(f"`{key}`")).orderBy(F.col(f"`{version}`").desc_nulls_last(), *rest)
    return (
        df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, version])])
        .where(F.col(f"`{key}`").isNotNull())
        .withColumn("__rank", F.row_number().over(w))
        .where("__rank = 1")
        .select(*[F.col(f"`{c}`") for c in columns])
    )


def known(column: str | Column) -> Column:
    """Trimmed text, null where that is blank."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.trim(c), F.lit(""))


def valid_number(column: str | Column) -> Column:
    """True for a number that is not null, NaN, infinite or negative."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf")), F.lit(False))


def finite(column: str | Column) -> Column:
    """The number, null where it is NaN or infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
