"""References to records that do not exist.

References and parent keys are hashed on the key and sorted (one exchange each), then merged in one linear
pass: a sort-merge join.  The parent side has one row per key with its validity intervals, so that copies of
parents never meet the references.  A hot key splits: Spark cuts the reference side of the
join at run time and repeats the one parent row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validity_intervals(parents: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """One row per key with ``spans``: the distinct intervals [start, end) in which it was there.

    Of the rows with one ``end`` only the earliest ``start`` matters, so they are reduced before the shuffle.
    A null end is open; a null start never began, such a row is no parent.
    """
    per_end = (
        parents.where(F.col(start).isNotNull())
        .groupBy(*keys, F.col(end).alias("__end"))
        .agg(F.min(start).alias("__start"))
    )
    return per_end.groupBy(*keys).agg(F.collect_list(F.struct("__start", "__end")).alias("spans"))


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    key: str = "target",
    at: str = "at",
    parent_key: str = "key",
    start: str = "start",
    end: str = "end",
    kind: str | None = "kind",
) -> DataFrame:
    """The references that lead nowhere at the time of their row, with the column ``status``.

    ``references`` and ``parents`` share the column ``kind`` (which table is meant) unless that is None.
    A parent is there at time t if one of its rows has start <= t and end null or > t.  status is

    * missing: no parent row ever has that key,
    * late: parents have it, but all start after t,
    * deleted: some had started, all of those had ended by t,
    * undated: the reference has no time, so that it can't be judged (returned as an orphan).

    Null and empty keys are no references.  Other columns of ``references`` pass through (one
    named status is replaced); repeated rows stay.
    """
    on = [*([kind] if kind else []), "__key"]
    refs = references.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("__key", F.col(key))
    there = parents.select(*([kind] if kind else []), F.col(parent_key).alias("__key"), F.col(start).alias("__s"), F.col(end).alias("__e")).where(F.col("__key").isNotNull())
    spans = validity_intervals(there, on, "__s", "__e").withColumnRenamed("spans", "__spans")
    t = F.col(at)
    alive: Column = F.exists("__spans", lambda x: (x["__start"] <= t) & (x["__end"].isNull() | (x["__end"] > t)))
    started: Column = F.exists("__spans", lambda x: x["__start"] <= t)
    return (
        refs.join(spans.hint("merge"), on, "left")
        .where(F.col("__spans").isNull() | t.isNull() | ~alive)
        .withColumn("status", F.when(F.col("__spans").isNull(), "missing").when(t.isNull(), "undated").when(started, "deleted").otherwise("late"))
        .drop("__spans", "__key")
    )


def orphan_report(orphans: DataFrame, by: list[str], at: str = "at") -> DataFrame:
    """Orphans counted per ``by`` columns, month (null if undated) and status."""
    return orphans.groupBy(*by, F.date_format(at, "yyyy-MM").alias("month"), "status").agg(F.count(F.lit(1)).alias("n"))
