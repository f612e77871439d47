"""Medians by a ladder of keys, from fine to coarse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.operators.order import selected_percentile
from reelsift.operators.similarity import block_keys
from reelsift.shared import materialize


def ladder_median(rows: DataFrame, levels: list[list[str]], metric: str | Column, min_n: int, base: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``rows`` with ``median``, ``level`` and ``n``: of the first level whose group has ``min_n`` values; else of all rows.

    Null keys are a group of their own; null and NaN metrics don't count, yet their rows get a median.  The last level,
    numbered len(levels), needs no minimum and is per ``base`` columns (a library), or over everything.  Values are grouped once into
    (keys, value, count), given a hashed key per level, and the medians of all levels are selected in one pass, see
    :func:`reelsift.operators.order.selected_percentile`; a small table per level is then joined back.
    """
    base = base or []
    m = F.col(metric) if isinstance(metric, str) else metric
    ladder = [list(dict.fromkeys([*base, *level])) for level in [*levels, []]]
    keys = list(dict.fromkeys([k for on in ladder for k in on]))
    hashed = lambda i: block_keys(ladder[i]) if ladder[i] else {"g": F.lit(0).cast("bigint"), "g2": F.lit(0).cast("bigint")}
    counted = rows.withColumn("__m", F.when(~F.isnan(m.cast("double")), m.cast("double"))).where("__m IS NOT NULL").groupBy(*keys, "__m").agg(F.count(F.lit(1)).alias("__c"))
    each = counted.select("__m", "__c", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), *[c.alias(k) for k, c in hashed(i).items()]) for i in range(len(ladder))])))
    medians = materialize(selected_percentile(each, ["i", "g", "g2"], "__m", "__c"), "medians")
    out, picks = rows.withColumns({f"__{k}{i}": c for i in range(len(ladder)) for k, c in hashed(i).items()}), []
    for i in range(len(ladder)):
        mine = medians.where(F.col("i") == i).select(F.col("g").alias(f"__g{i}"), F.col("g2").alias(f"__g2{i}"), F.col("percentile").alias(f"__med{i}"), F.col("n").alias(f"__n{i}"))
        out = out.join(mine, [f"__g{i}", f"__g2{i}"], "left")
        picks.append((i, F.col(f"__n{i}") >= (min_n if i < len(levels) else 0)))
    level = F.coalesce(*[F.when(ok, i) for i, ok in picks], F.lit(len(levels)))
    pick = lambda c: F.coalesce(*[F.when(level == i, F.col(f"{c}{i}")) for i, _ in picks])
    out = out.withColumns({f"{prefix}median": pick("__med"), f"{prefix}level": level, f"{prefix}n": F.coalesce(pick("__n"), F.lit(0))})
    return out.drop(*[f"{c}{i}" for i, _ in picks for c in ("__med", "__n", "__g", "__g2")])


PHOTO_LEVELS = [["device_key", "scene", "subtype", "zoom_bucket"], ["device_key", "scene", "subtype"], ["device_key", "subtype", "zoom_bucket"], ["device_key", "subtype"]]
VIDEO_LEVELS = [["device_key", "scene", "color_mode", "zoom_bucket"], ["device_key", "scene", "color_mode"], ["device_key", "color_mode", "zoom_bucket"], ["device_key", "color_mode"]]


def adaptive_levels(rows: DataFrame, share: float = 0.8) -> list[list[str]]:
    """The ladder for videos: with zoom levels if at least ``share`` of the rows have a zoom class.  One row is read."""
    n, z = rows.agg(F.count(F.lit(1)), F.count("zoom_bucket")).first()
    return VIDEO_LEVELS if n and z / n >= share else [level for level in VIDEO_LEVELS if "zoom_bucket" not in level]
