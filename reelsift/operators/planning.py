"""Validation of a plan, its destinations and its summary.  All rules are evaluated; any error rejects the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsift.config import DELETE_REASONS, DUPLICATE_REASON, REVIEW_PREFIX, TIER_DIRS
from reelsift.functions.media import is_proxy, is_sidecar, target_path
from reelsift.shared import materialize

REASON = "^[A-Za-z0-9一-鿿-]{1,20}$"


def validate_plan(plan: DataFrame, items: DataFrame, dups: DataFrame, orphans: DataFrame | None = None, order: list[str] | None = None, nfc=lambda c: c) -> DataFrame:
    """(rule, primary, detail): every broken rule, one row each.

    ``plan`` (primary, tier, reason, keep, ord), ``items`` (primary), ``dups`` (primary, dup_group), ``orphans`` (path).  An entry
    without a primary, of an unknown item or with an unknown tier skips the rules after it; an entry with a bad tier
    still counts as planned.  Rules: primary_missing, proxy, sidecar, unknown, repeated, tier, reason_delete, reason_review,
    reason_text, keep_missing, keep_unknown, keep_kind, keep_group, keep_deleted, not_planned.
    """
    p = plan.withColumns({"primary": nfc(F.nullif(F.col("primary"), F.lit(""))), "keep": nfc(F.nullif(F.col("keep"), F.lit(""))), "reason": F.coalesce("reason", F.lit(""))})
    known = items.where("primary IS NOT NULL").select(nfc(F.col("primary")).alias("primary")).distinct()
    groups = dups.where("dup_group IS NOT NULL").groupBy(nfc(F.col("primary")).alias("primary")).agg(F.max("dup_group").alias("dup_group"))
    nth = F.row_number().over(Window.partitionBy("primary").orderBy(*(order or ["ord"])))
    lost = orphans.select(F.col("path").alias("primary")).distinct().withColumn("lost", F.lit(True)) if orphans is not None else None
    x = p.withColumn("nth", nth).join(known.withColumn("known", F.lit(True)), "primary", "left")
    x = x.join(lost, "primary", "left") if lost is not None else x.withColumn("lost", F.lit(None).cast("boolean"))
    x = x.join(groups.withColumnRenamed("dup_group", "g1"), "primary", "left")
    kept = known.select(F.col("primary").alias("keep"), F.lit(True).alias("keep_known"))
    x = x.join(kept, "keep", "left").join(groups.select(F.col("primary").alias("keep"), F.col("dup_group").alias("g2")), "keep", "left")
    deleted = p.where("tier = '00' AND primary IS NOT NULL").select(F.col("primary").alias("keep"), F.lit(True).alias("keep_deleted")).distinct()
    x = x.join(deleted, "keep", "left")

    there = F.col("primary").isNotNull()
    listed = there & F.col("known").isNotNull()
    tier_ok = F.coalesce(F.col("tier").isin(*TIER_DIRS), F.lit(False))
    judged = listed & tier_ok
    dup = judged & (F.col("reason") == DUPLICATE_REASON)
    kept_ok = dup & F.col("keep").isNotNull() & F.col("keep_known").isNotNull()
    video = lambda g: g.startswith("VD")
    same_kind = video(F.col("g1")) == video(F.col("g2"))
    grouped = F.col("g1").isNotNull() & F.col("g2").isNotNull()
    rules = [
        ("primary_missing", ~there, F.lit("")),
        ("proxy", there & (is_proxy(F.col("primary")) | F.coalesce("lost", F.lit(False))), F.lit("")),
        ("sidecar", there & is_sidecar(F.col("primary")), F.lit("")),
        ("unknown", there & F.col("known").isNull(), F.lit("")),
        ("repeated", listed & (F.col("nth") > 1), F.lit("")),
        ("tier", listed & ~tier_ok, F.coalesce("tier", F.lit(""))),
        ("reason_delete", judged & (F.col("tier") == "00") & ~F.col("reason").isin(*DELETE_REASONS), F.col("reason")),
        ("reason_review", judged & (F.col("tier") == "01") & ~F.col("reason").startswith(REVIEW_PREFIX), F.col("reason")),
        ("reason_text", judged & (F.col("reason") != "") & ~F.col("reason").rlike(REASON), F.col("reason")),
        ("keep_missing", dup & F.col("keep").isNull(), F.lit("")),
        ("keep_unknown", dup & F.col("keep").isNotNull() & F.col("keep_known").isNull(), F.col("keep")),
        ("keep_kind", kept_ok & grouped & ~same_kind, F.col("keep")),
        ("keep_group", kept_ok & (~grouped | (grouped & same_kind & (F.col("g1") != F.col("g2")))), F.col("keep")),
        ("keep_deleted", kept_ok & F.coalesce("keep_deleted", F.lit(False)), F.col("keep")),
    ]
    hits = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.alias("detail"))) for name, cond, detail in rules]), lambda r: r.isNotNull())
    broken = x.select("primary", F.inline(hits)).select("rule", "primary", "detail")
    missing = known.join(p.where(there).select("primary").distinct(), "primary", "left_anti").select(F.lit("not_planned").alias("rule"), "primary", F.lit("").alias("detail"))
    return broken.unionByName(missing)


def missing_files(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """(primary, path): files of the catalogue that are not on disk."""
    return items.join(manifest.where("path IS NOT NULL").select("path").distinct(), "path", "left_anti").select("primary", "path")


def tier_rollup(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Per tier its entries, files and bytes; ``files`` (primary, path, size) may miss sizes."""
    per_entry = files.groupBy("primary").agg(F.count(F.lit(1)).alias("f"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"))
    joined = plan.join(per_entry, "primary", "left")
    return joined.groupBy("tier").agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"))


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows per group with ``rank`` and how many more there are (``n_more``)."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
    sizes = rows.groupBy(*group).agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("n_more"))
    cond = reduce(lambda a, b: a & b, [ranked[g].eqNullSafe(sizes[g]) for g in group])
    return ranked.join(sizes, cond).drop(*[sizes[g] for g in group])


def curated_limit(photos: DataFrame, group: list[str], order: list, few: int = 3, many: int = 5, large: int = 50) -> DataFrame:
    """The best of each scene: ``few``, or ``many`` of a scene with more than ``large`` photos."""
    w = Window.partitionBy(*group)
    return photos.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "__n": F.count(F.lit(1)).over(w)}).where(F.col("rank") <= F.when(F.col("__n") > large, many).otherwise(few)).drop("__n")


def destinations(files: DataFrame, taken: DataFrame, most: int = 50) -> DataFrame:
    """``files`` (primary, path, tier, reason) with ``suffix`` and ``dst``: the first suffix '', _2, _3 ... by which no file of the entry
    meets a path in ``taken``.

    An entry moves as one, so its files share a suffix.  Only entries that clash go on to the next suffixes, in rounds of
    ``most`` each until none is left; rounds after the first of these run only if an entry clashes with all of them.
    """
    taken = taken.where("path IS NOT NULL").select(F.col("path").alias("dst")).distinct()
    with_dst = lambda df, s: df.withColumns({"suffix": s, "dst": target_path(F.col("path"), F.col("tier"), F.col("reason"), s)})
    first = with_dst(files, F.lit(""))
    clash = first.where(F.col("dst") != F.col("path")).join(taken, "dst", "left_semi").select("primary").distinct()
    out = first.join(clash, "primary", "left_anti")
    left, low = materialize(files.join(clash, "primary", "left_semi"), "clashing"), 2
    while not left.isEmpty():
        again = left.withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(low + max(most, 1) - 1))))
        again = with_dst(again, F.concat(F.lit("_"), F.col("k").cast("string")))
        bad = again.where(F.col("dst") != F.col("path")).join(taken, "dst", "left_semi").select("primary", "k").distinct()
        chosen = materialize(again.select("primary", "k").distinct().join(bad, ["primary", "k"], "left_anti").groupBy("primary").agg(F.min("k").alias("k")), "chosen")
        out = out.unionByName(again.join(chosen, ["primary", "k"]).drop("k"))
        left, low = materialize(left.join(chosen, "primary", "left_anti"), "clashing"), low + max(most, 1)
    return out


def colliding(moves: DataFrame) -> DataFrame:
    """(dst, n): destinations that more than one planned file has."""
    return moves.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stale_plans(plans: DataFrame, runs: DataFrame, by: str) -> DataFrame:
    """(by, stale): whether any analysis of ``runs`` (by, run_at) is newer than the latest plan of ``plans`` (by, planned_at); equal times aren't."""
    latest = plans.groupBy(by).agg(F.max("planned_at").alias("planned_at"))
    return latest.join(runs.groupBy(by).agg(F.max("run_at").alias("run_at")), by, "left").select(by, F.coalesce(F.col("run_at") > F.col("planned_at"), F.lit(False)).alias("stale"))


def dup_index(sources: list[DataFrame]) -> DataFrame:
    """(primary, dup_group): groups of several reports (primary, dup_group) as one index; a later report's label replaces an earlier one's."""
    rows = [s.where("primary IS NOT NULL AND dup_group IS NOT NULL").select("primary", "dup_group", F.lit(i).alias("turn")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, rows).groupBy("primary").agg(F.max(F.struct("turn", "dup_group")).getField("dup_group").alias("dup_group"))


def is_stale(plan_mtime: float, artefact_mtimes: list[float]) -> bool:
    """Whether an analysis is newer than the plan."""
    return any(m > plan_mtime for m in artefact_mtimes)
