"""The append-only ledger of moves, folded into states.  Moving files is left to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def open_batches(log: DataFrame) -> DataFrame:
    """(batch, first_ord): batches without an undone record, by first appearance."""
    folded = log.groupBy("batch").agg(F.bool_or(F.coalesce(F.col("state") == "undone", F.lit(False))).alias("undone"), F.min("ord").alias("first_ord"))
    return folded.where(~F.col("undone")).select("batch", "first_ord")


def done_moves(log: DataFrame) -> DataFrame:
    """(batch, seq, done): per pending move whether a done record follows; one conditional aggregate instead of a self-join."""
    per = log.where("seq IS NOT NULL").groupBy("batch", "seq").agg(F.bool_or(F.col("state") == "pending").alias("pending"), F.bool_or(F.col("state") == "done").alias("done"))
    return per.where("pending").select("batch", "seq", "done")


def undo_actions(log: DataFrame, exists: DataFrame) -> DataFrame:
    """(batch, seq, src, dst, action): what undoing the open batches does with each recorded move.

    ``exists`` (path) are the files on disk.  action is restore, restore_auto, skip, conflict_both or conflict_none.  Batches go
    latest first, in each main files before shadows, later moves first: the column ``turn`` sorts so.
    """
    paths = exists.where("path IS NOT NULL").select("path").distinct()
    moves = log.where("src IS NOT NULL").join(open_batches(log), "batch")
    state = done_moves(log).select("batch", "seq", "done")
    m = moves.join(state, ["batch", "seq"], "left")
    m = m.join(paths.select(F.col("path").alias("src"), F.lit(True).alias("s")), "src", "left").join(paths.select(F.col("path").alias("dst"), F.lit(True).alias("d")), "dst", "left")
    s, d, done = (F.coalesce(c, F.lit(False)) for c in ("s", "d", "done"))
    auto = F.col("state") == "auto"
    action = (
        F.when(auto, F.when(d & ~s, "restore_auto").otherwise("skip"))
        .when(d & ~s, "restore")
        .when(done & d & s, "conflict_both")
        .when(~done & s, "skip")
        .otherwise("conflict_none")
    )
    shadow = F.substring_index("src", "/", -1).startswith("._")
    return m.select("batch", "seq", "src", "dst", action.alias("action"), F.struct((-F.col("first_ord")).alias("batch"), shadow.alias("shadow"), (-F.col("seq")).alias("seq")).alias("turn"))


def numbered_turns(actions: DataFrame) -> DataFrame:
    """(batch, seq, turn): undo actions numbered in their order; equal ones share a number.  Sorted by range, numbered over the ranges' sizes."""
    order = actions.select("batch", "seq", F.col("turn").alias("t"), F.struct(F.col("turn.batch").alias("b"), F.col("turn.shadow").alias("h"), F.col("turn.seq").alias("s")).alias("o"))
    distinct = order.select("o", F.col("o.b").alias("b")).distinct()
    sizes = distinct.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = distinct.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("o"))).join(sizes.select("b", "before"), "b")
    return order.join(inside.select("o", (F.col("before") + F.col("k")).alias("turn")), "o").select("batch", "seq", "turn")


def apply_guard(log: DataFrame, moves: DataFrame) -> DataFrame:
    """(rule, n): what forbids carrying out a plan: open batches of ``log``, and ``moves`` (from_device, to_device) between devices.  No row: nothing does."""
    open_ = open_batches(log).agg(F.lit("open_batch").alias("rule"), F.count(F.lit(1)).alias("n"))
    across = moves.where("from_device <> to_device").agg(F.lit("other_device").alias("rule"), F.count(F.lit(1)).alias("n"))
    return open_.unionByName(across).where("n > 0")


def orphan_shadows(manifest: DataFrame) -> DataFrame:
    """Shadow files ('._x') without the file x beside them."""
    name = F.substring_index("path", "/", -1)
    shadows = manifest.where(name.startswith("._")).withColumn("main", F.concat(F.substring("path", F.lit(1), F.length("path") - F.length(name)), F.substring(name, F.lit(3), F.length(name))))
    return shadows.join(manifest.select(F.col("path").alias("main")).distinct(), "main", "left_anti").select("path")


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(path, depth): folders without a file other than '.DS_Store' and shadows in them or below, deepest first by depth."""
    name = F.substring_index("path", "/", -1)
    real = files.where((name != ".DS_Store") & ~name.startswith("._"))
    parts = F.split("path", "/")
    above = real.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).where("path <> ''")
    return folders.join(above.distinct(), "path", "left_anti").select("path", F.size(parts).alias("depth"))
