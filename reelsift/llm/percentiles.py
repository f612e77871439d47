"""Percentiles of large numeric columns by radix selection, with states that can be combined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.shared import materialize, release

DIGIT = 16
_SIGN = -(1 << 63)


def ordered_bits(x: Column) -> Column:
    """A DOUBLE as BIGINT in the same order if compared without sign; -0.0 and 0.0 are one."""
    raw = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x + F.lit(0.0)).cast("bigint")
    return F.when(raw < 0, F.bitwise_not(raw)).otherwise(raw.bitwiseXOR(F.lit(_SIGN).cast("bigint")))


def from_ordered_bits(k: Column) -> Column:
    """The DOUBLE of :func:`ordered_bits`."""
    raw = F.when(k < 0, k.bitwiseXOR(F.lit(_SIGN).cast("bigint"))).otherwise(F.bitwise_not(k))
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def _usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def cells(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, cell, n) with a row per row of ``rows``, nothing grouped: what :func:`percentiles` selects from exactly.

    Rows whose value is null, NaN or infinite are left out.  Null keys are a group of their own.
    """
    x = F.col(value).cast("double")
    return rows.where(_usable(x)).select(*[F.col(f"`{k}`") for k in keys], ordered_bits(x).alias("cell"), F.lit(1).cast("bigint").alias("n"))


def state(rows: DataFrame, keys: list[str], value: str, digits: int = 2) -> DataFrame:
    """A histogram (keys, cell, n) of ``value`` by its first ``digits`` digits of 16 bits: one row per filled cell.

    States of several partitions or days are combined by :func:`combine`; with four digits a cell is one value.
    With fewer, a percentile is off by at most 2 ** -(16 * digits - 12) of its size.  Rows are left out as by :func:`cells`.
    """
    cell = F.col("cell")
    if digits < 4:
        cell = F.shiftleft(F.shiftrightunsigned(cell, 64 - DIGIT * digits), 64 - DIGIT * digits)
    return cells(rows, keys, value).groupBy(*[F.col(f"`{k}`") for k in keys], cell.alias("cell")).agg(F.sum("n").alias("n"))


def combine(states: list[DataFrame], keys: list[str]) -> DataFrame:
    """One state of several with the same keys and digits."""
    return reduce(DataFrame.unionByName, states).groupBy(*keys, "cell").agg(F.sum("n").alias("n"))


def percentiles(histogram: DataFrame, keys: list[str], shares: dict[str, float], digits: int = 4) -> DataFrame:
    """Per group its number of values ``n_values`` and, for each name in ``shares``, the percentile at that share.

    ``histogram`` (keys, cell, n) comes from :func:`cells`, :func:`state` or :func:`combine`.  A percentile is interpolated between the two
    values around rank 1 + share * (n - 1), as medians are.  The first round counts the first digit of every row, combined
    before the shuffle, which so carries at most 65,536 rows per group and task, however many values differ.  Each later one counts the next digit of
    those rows only whose earlier digits hold a target rank, and follows it; targets are a few rows per group.  Empty input
    gives no rows.
    """
    at, held = [f"__g{i}" for i in range(len(keys))], []
    gid = {"g": F.xxhash64(*at, *[F.col(g).isNull() for g in at]), "g2": F.xxhash64(F.lit(17), *at, *[F.col(g).isNull() for g in at])}
    digit = lambda r: F.shiftrightunsigned("cell", 64 - DIGIT * (r + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("bigint"))
    rows = materialize(histogram.select(*[F.col(f"`{k}`").alias(g) for k, g in zip(keys, at)], "cell", "n"), "cells")
    first = materialize(rows.groupBy(*at, digit(0).alias("digit")).agg(F.sum("n").alias("c")), "first-digits").withColumns(gid)
    sizes = first.groupBy("g", "g2", *at).agg(F.sum("c").alias("n_values"))
    ranks = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(up).alias("up"), (F.ceil(F.lit(float(p)) * (F.col("n_values") - 1)) if up else F.floor(F.lit(float(p)) * (F.col("n_values") - 1))).alias("rank")) for name, p in shares.items() for up in (False, True)]
    )
    targets = sizes.select("g", "g2", F.inline(ranks)).withColumn("prefix", F.lit(0).cast("bigint"))
    keyed = rows.withColumns(gid).select("g", "g2", "cell", "n")
    order = Window.partitionBy("g", "g2", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    for r in range(digits):
        if r:
            wanted = keyed.withColumn("prefix", F.shiftrightunsigned("cell", 64 - DIGIT * r)).join(targets.select("g", "g2", "prefix").distinct(), ["g", "g2", "prefix"], "left_semi")
            keyed = materialize(wanted.select("g", "g2", "cell", "n", "prefix"), "followed")
            held.append(keyed)
            counts = keyed.groupBy("g", "g2", "prefix", digit(r).alias("digit")).agg(F.sum("n").alias("c"))
        else:
            counts = first.select("g", "g2", F.lit(0).cast("bigint").alias("prefix"), "digit", "c")
        counts = counts.withColumn("upto", F.sum("c").over(order))
        followed = (
            targets.join(counts, ["g", "g2", "prefix"])
            .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
            .select("g", "g2", "name", "up", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit")).alias("prefix"))
        )
        targets = materialize(followed, f"targets{r}")
        held.append(targets)
    release(rows)
    for t in held[:-1]:
        release(t)
    value = from_ordered_bits(F.shiftleft("prefix", 64 - DIGIT * digits) if digits < 4 else F.col("prefix"))
    wide = targets.withColumn("value", value).groupBy("g", "g2").agg(*[F.max(F.when((F.col("name") == n) & (F.col("up") == up), F.col("value"))).alias(f"{n}__{int(up)}") for n in shares for up in (False, True)])
    out = sizes.join(wide, ["g", "g2"])
    parts = {}
    for name, p in shares.items():
        exact = F.lit(float(p)) * (F.col("n_values") - 1)
        lo, hi = F.col(f"{name}__0"), F.col(f"{name}__1")
        parts[name] = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (exact - F.floor(exact)))
    return out.select(*[F.col(g).alias(k) for k, g in zip(keys, at)], F.col("n_values").cast("bigint").alias("n_values"), *[c.alias(n) for n, c in parts.items()])
