"""Records matched by nearest time, by joins on buckets that double in width."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsift.shared import materialize, release

FINEST = 2.0**-3


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, time: str, label: str, tolerance: float, finest: float = FINEST) -> DataFrame:
    """(``left``'s columns, near_label, near_time): for each left row the right row of equal ``key`` nearest in ``time``.

    Rows further apart than ``tolerance`` don't match; of equally near ones the least ``label`` is taken.  Left
    rows without a match are left out, repeated ones stay.  Null keys, times that are null or no finite number and null
    right labels match nothing.  A left column near_label or near_time is replaced.

    Distinct left instants are matched against distinct right instants.  In a ring of width w every instant within
    w lies in its own bucket or one of the two beside it, so a nearest one at most w away is final; the
    others go on to the next ring of double width.  In the first ring the instants of a bucket are merged in order, so that each left one sees
    the right ones next to it, however many a burst puts into the bucket.  In later rings the half of the own bucket around the left instant
    is known to be empty, and of the buckets beside it only the ends matter: one row per bucket, the ends of its instants,
    is enough.  Widths are powers of two, by which times divide exactly.  Rings carry times only; labels are joined at the end.
    """
    if math.log2(finest) % 1:
        raise ValueError("finest must be a power of two")
    ok = F.col(key).isNotNull() & F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")) & (F.abs(F.col(time).cast("double")) < float("inf"))
    cast = lambda df, *more: df.where(ok).select(F.col(key).alias("k"), F.col(time).cast("double").alias("t"), *more)
    labels = materialize(cast(right, F.col(label).alias("l")).where("l IS NOT NULL").groupBy("k", "t").agg(F.min("l").alias("l")), "instants-right")
    todo = materialize(cast(left).distinct(), "instants-left")
    bucket = lambda w: F.floor(F.col("t") / w).alias("b")
    found, width, ends = [], finest, None
    while True:
        if ends is None:
            rolled = labels.groupBy("k", bucket(width)).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
            both = todo.select("k", "t", bucket(width), F.lit(None).cast("double").alias("c")).unionByName(labels.select("k", "t", bucket(width), F.col("t").alias("c")))
            # Up and down the bucket, each in one pass.
            up, down = (Window.partitionBy("k", "b").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (["t", F.col("c").isNull()], [F.desc("t"), F.col("c").isNull().desc()]))
            merged = both.withColumn("x", F.last("c", ignorenulls=True).over(up)).withColumn("y", F.last("c", ignorenulls=True).over(down))
            seen = merged.where("c IS NULL").select("k", "t", F.explode(F.array("x", "y")).alias("c")).where("c IS NOT NULL")
        else:
            rolled = ends.groupBy("k", F.floor(F.col("b") / 2).alias("b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            seen = None
        rolled = materialize(rolled, "bucket-ends")
        release(ends)
        ends = rolled
        # What a bucket shows to the left rows of the next one, of the one before and, beyond the first ring, to its own.
        shown = [F.struct((F.col("b") + 1).alias("b"), F.col("hi").alias("c")), F.struct((F.col("b") - 1).alias("b"), F.col("lo").alias("c"))]
        if seen is None:
            shown += [F.struct(F.col("b").alias("b"), F.col(c).alias("c")) for c in ("lo", "hi")]
        beside = todo.withColumn("b", bucket(width)).join(ends.select("k", F.inline(F.array(*shown))), ["k", "b"]).select("k", "t", "c")
        near = (beside if seen is None else beside.unionByName(seen)).where(F.abs(F.col("t") - F.col("c")) <= min(width, tolerance))
        near = materialize(near.groupBy("k", "t").agg(F.max(F.when(F.col("c") <= F.col("t"), F.col("c"))).alias("x"), F.min(F.when(F.col("c") >= F.col("t"), F.col("c"))).alias("y")), "near")
        found.append(near)
        if width >= tolerance:
            break
        rest = materialize(todo.join(near.select("k", "t"), ["k", "t"], "left_anti"), "unresolved")
        release(todo)
        todo, width = rest, width * 2
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    # The nearer of the two neighbours, both where they are equally near; of their labels the least.
    gap = lambda c: F.abs(F.col("n") - c)
    best = best.withColumnRenamed("t", "n").withColumn("d", F.least(gap(F.col("x")), gap(F.col("y"))))
    best = best.select("k", "n", F.explode(F.filter(F.array_distinct(F.array("x", "y")), lambda c: c.isNotNull() & (gap(c) == F.col("d")))).alias("t")).join(labels, ["k", "t"])
    best = best.groupBy(F.col("k").alias("__k"), F.col("n").alias("__n")).agg(F.min(F.struct("l", "t")).alias("b")).select("__k", "__n", F.col("b.l").alias("near_label"), F.col("b.t").alias("near_time"))
    left = left.drop("near_label", "near_time")
    rows = left.where(ok).withColumn("__t", F.col(time).cast("double"))
    return rows.join(best, (F.col(key) == F.col("__k")) & (F.col("__t") == F.col("__n"))).drop("__t", "__k", "__n")
