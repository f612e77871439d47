"""Sessions separated by inactivity gaps, built in time chunks.

Rows are spread over (key, chunk of time), where local sessions are built.  What crosses a chunk's border is
only the latest end so far; it is carried over the chunks' summaries, a row each, so that no task ever
gets all rows of a hot key.  Rows of one instant are reduced to one before the first shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(
    events: DataFrame,
    key: str,
    time: str,
    end: str | None,
    label: str,
    gap: float = 600.0,
    chunk: float = 3600.0,
) -> DataFrame:
    """Sessions (key, start, end, duration, first_label, last_label, n_items) of ``events`` per ``key``.

    Rows are ordered by (time, label).  A session starts where time is more than ``gap`` after the latest end
    so far (``end``, or time where that is null or no number).  Rows with a null key or without a finite time
    belong to no session.  Null labels count as items; they are first or last only where nothing else is.
    Repeated rows count each.  ``chunk`` only sets how the work is cut; the result doesn't depend on it.
    """
    t = F.col(time)
    e = t if end is None else F.coalesce(F.when(~F.isnan(F.col(end)), F.col(end)), t)
    rows = (
        events.where(F.col(key).isNotNull() & t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))
        .select(F.col(key).alias("k"), t.cast("double").alias("t"), e.cast("double").alias("e"), F.col(label).alias("l"))
        .groupBy("k", "t")
        .agg(F.max("e").alias("e"), F.min("l").alias("lo"), F.max("l").alias("hi"), F.count(F.lit(1)).alias("n"))
        .withColumn("c", F.floor(F.col("t") / chunk))
    )
    inside = Window.partitionBy("k", "c").orderBy("t")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)

    def starts(t: str, so_far):
        return F.when(so_far.isNull() | (F.col(t) - so_far > gap), 1).otherwise(0)

    # 1. Local sessions in each chunk.
    local = (
        rows.withColumn("reach", F.max("e").over(before))
        .withColumn("s", F.sum(starts("t", F.col("reach"))).over(upto))
        .groupBy("k", "c", "s")
        .agg(
            F.min("t").alias("t"),
            F.max("t").alias("tl"),
            F.max("e").alias("e"),
            F.min(F.struct("t", "lo")).alias("first"),
            F.max(F.struct("t", "hi")).alias("last"),
            F.sum("n").alias("n"),
        )
    )
    # 2. The latest end of all earlier chunks; one row per chunk.
    chain = Window.partitionBy("k").orderBy("c")
    carried = local.groupBy("k", "c").agg(F.max("e").alias("ce")).withColumn("reach0", F.max("ce").over(chain.rowsBetween(Window.unboundedPreceding, -1))).select("k", "c", "reach0")
    # 3. Which partial sessions go on from earlier ones; numbered over chunks by the counts of new ones.
    parts = (
        local.join(carried, ["k", "c"])
        .withColumn("new", starts("t", F.greatest("reach0", F.max("e").over(before))))
        .withColumn("in_chunk", F.sum("new").over(upto))
    )
    news = parts.groupBy("k", "c").agg(F.sum("new").alias("cn")).withColumn("base", F.coalesce(F.sum("cn").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("k", "c", "base")
    return (
        parts.join(news, ["k", "c"])
        .groupBy("k", (F.col("base") + F.col("in_chunk")).alias("session"))
        .agg(
            F.min("t").alias("start"),
            F.max(F.greatest("e", "tl")).alias("end"),
            F.min("first").getField("lo").alias("first_label"),
            F.max("last").getField("hi").alias("last_label"),
            F.sum("n").cast("bigint").alias("n_items"),
        )
        .select(F.col("k").alias(key), "session", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "first_label", "last_label", "n_items")
    )
