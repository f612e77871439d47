"""Order over groups of any size: places, carried values and percentiles without a task that gets a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.shared import materialize


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Left and right columns equal, nulls too."""
    cond = F.lit(True)
    for a, b in keys.items():
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def place_along(rows: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """``rows`` with ``out``: 1, 2, 3 ... along ``order`` within ``by``, as row_number() gives it; nulls in ``by`` are equal.

    Rows are cut by range over (by, order) into partitions of like size, numbered in each, and the sizes of the earlier parts
    of a group are added.  Written once, since ranges are cut by a sample.
    """
    named = rows.withColumns({f"__o{i}": c for i, c in enumerate(order)})
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in by] + [F.col(f"__o{i}") for i in range(len(order))]
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = materialize(named.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).select(*[F.col(f"`{c}`").alias(f"__b{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), "__base")
    inside = Window.partitionBy(*by, "__part").orderBy(*[F.col(f"__o{i}") for i in range(len(order))])
    placed = cut.withColumn("__k", F.row_number().over(inside))
    placed = placed.join(base, null_safe(placed, base, {c: f"__b{i}" for i, c in enumerate(by)} | {"__part": "__p"}))
    return placed.withColumn(out, F.col("__base") + F.col("__k")).select(*[F.col(f"`{c}`") for c in rows.columns if c != out], out)


def carried_last(rows: DataFrame, by: list[str], order: list[Column], chunk: Column, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the last non-null ``value`` before each row along ``order`` within ``by``; null before the first one.

    ``chunk`` cuts the order into stretches, a later one never before an earlier one; it sets how the work is cut, not the result.
    Order columns ascend, nulls first.
    """
    named = rows.withColumn("__c", chunk).withColumn("__o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    ends = named.groupBy(*by, "__c").agg(F.max(F.when(F.col(value).isNotNull(), F.struct("__o", F.col(value).alias("v")))).getField("v").alias("__v"))
    earlier = Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.withColumn("__base", F.last("__v", ignorenulls=True).over(earlier)).select(*[F.col(f"`{c}`").alias(f"__b{i}") for i, c in enumerate(by)], F.col("__c").alias("__d"), "__base")
    inside = Window.partitionBy(*by, "__c").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    seen = named.withColumn("__last", F.last(value, ignorenulls=True).over(inside))
    seen = seen.join(base, null_safe(seen, base, {c: f"__b{i}" for i, c in enumerate(by)} | {"__c": "__d"}))
    return seen.withColumn(out, F.coalesce("__last", "__base")).select(*[F.col(f"`{c}`") for c in rows.columns if c != out], out)


def selected_percentile(counted: DataFrame, keys: list[str], value: str, weight: str, share: float = 0.5) -> DataFrame:
    """(keys, percentile, n) of ``counted``, whose DOUBLE ``value`` stands ``weight`` times each, as percentile() interpolates it.  Keys must not be null.

    First values are counted in cells, about a thousand to each factor e and combined before the shuffle, and the cells that hold the wanted ranks
    are found; only their values are then put in order.  So no task holds all different values of a group.
    """
    cell = F.floor(F.signum(value) * F.log1p(F.abs(F.col(value))) * 1024).cast("bigint")
    cells = counted.groupBy(*keys, cell.alias("__cell")).agg(F.sum(weight).alias("__w"))
    upto = F.sum("__w").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("__upto", upto).withColumn("__n", F.sum("__w").over(Window.partitionBy(*keys)))
    lo, hi = F.floor(F.lit(share) * (F.col("__n") - 1)), F.ceil(F.lit(share) * (F.col("__n") - 1))
    before = F.col("__upto") - F.col("__w")
    wanted = cells.where(((lo >= before) & (lo < F.col("__upto"))) | ((hi >= before) & (hi < F.col("__upto")))).select(*keys, "__cell", before.alias("__before"), "__n")
    near = counted.withColumn("__cell", cell).join(wanted, [*keys, "__cell"]).groupBy(*keys, "__cell", "__before", "__n", F.col(value).alias("__x")).agg(F.sum(weight).alias("__w"))
    inside = Window.partitionBy(*keys, "__cell").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("__to", F.col("__before") + F.sum("__w").over(inside)).withColumn("__from", F.col("__to") - F.col("__w"))
    at = lambda r: F.max(F.when((r >= F.col("__from")) & (r < F.col("__to")), F.col("__x")))
    both = ranked.groupBy(*keys, "__n").agg(at(lo).alias("a"), at(hi).alias("b"))
    part = F.lit(share) * (F.col("__n") - 1) - lo
    return both.select(*keys, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("percentile"), F.col("__n").alias("n"))
