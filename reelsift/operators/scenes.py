"""Scenes: a timeline cut where time or place jumps; running numbers; sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsift.config import CONFIG, Config
from reelsift.functions.media import haversine
from reelsift.operators.order import place_along
from reelsift.shared import materialize


def assign_scenes(items: DataFrame, library: list[str], cfg: Config = CONFIG, tie: str = "primary", chunk: float = 86400.0) -> DataFrame:
    """``items`` with ``scene``: 'S001' and so on along (time, seq, tie) in each ``library``.

    A scene starts more than ``scene_gap_s`` after the latest end of the scene so far, or more than ``scene_gps_m`` from the last
    known place.  Ends are ``time_end``, or ``time`` where that is null.  Rows with a null or NaN time belong to no scene.
    Places are the last non-null ``gps`` before a row and never reset, so jumps in place are found first; the latest
    end is then a running maximum within the stretches between them.

    Rows are sorted within (library, chunk of time) only.  What crosses a chunk's border is carried over the chunks' summaries, a
    row each: the last place, the latest end since the last jump, the numbers of jumps and of scenes.  ``chunk`` sets how the work is
    cut; the result doesn't depend on it.
    """
    t = F.col("time")
    timed = t.isNotNull() & ~F.isnan(t)
    idle = items.where(~timed).withColumn("scene", F.lit(None).cast("string"))
    rows = items.where(timed).withColumns({"__c": F.floor(t / chunk), "__e": F.coalesce("time_end", "time"), "__o": F.struct(t.alias("t"), F.coalesce("seq", F.lit(0)).alias("s"), F.col(tie).alias("tie"))})
    # Written twice, here and once jumps are known: each is read for its summary and for its rows.
    rows = materialize(rows, "scene-rows")
    inside = Window.partitionBy(*library, "__c").orderBy("__o")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*library, "__c")
    chain = Window.partitionBy(*library).orderBy("__c")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, to: DataFrame) -> DataFrame:
        """``to`` joined by (library, chunk), null-safe, with the other columns of ``df``."""
        df = df.withColumnsRenamed({k: f"__{k}" for k in library} | {"__c": "__cc"})
        cond = F.col("__c") == F.col("__cc")
        for k in library:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return to.join(df, cond).drop("__cc", *[f"__{k}" for k in library])

    # Jumps in place.
    last = rows.where("gps IS NOT NULL").groupBy(*library, "__c").agg(F.max(F.struct("__o", "gps")).getField("gps").alias("g"))
    chunks = rows.select(*library, "__c").distinct()
    place = carried(last, chunks).unionByName(chunks.withColumn("g", F.lit(None).cast(last.schema["g"].dataType))).groupBy(*library, "__c").agg(F.first("g", ignorenulls=True).alias("g"))
    place = place.withColumn("__place0", F.last("g", ignorenulls=True).over(earlier)).drop("g")
    rows = carried(place, rows).withColumn("__place", F.coalesce(F.last("gps", ignorenulls=True).over(before), "__place0"))
    jump = haversine(F.col("gps.lat"), F.col("gps.lon"), F.col("__place.lat"), F.col("__place.lon")) > cfg.scene_gps_m
    rows = rows.withColumn("__far", F.when(jump, 1).otherwise(0))
    # The latest end since the last jump: a chunk hands on that of its rows from its last jump on.
    rows = materialize(rows.withColumns({"__seg": F.sum("__far").over(upto), "__segs": F.sum("__far").over(whole)}).drop("__place", "__place0"), "scene-jumps")
    tails = rows.groupBy(*library, "__c").agg(F.max("__segs").alias("n"), F.max(F.when(F.col("__seg") == F.col("__segs"), F.col("__e"))).alias("e"))
    tails = tails.withColumn("to", F.sum("n").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*library, "to").orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("run", F.max("e").over(run)).withColumn("__reach0", F.lag("run").over(chain)).select(*library, "__c", "__reach0")
    rows = carried(tails, rows)
    local = F.max("__e").over(Window.partitionBy(*library, "__c", "__seg").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1))
    # greatest() skips nulls; before its first jump a chunk's rows go on from the earlier chunks.
    rows = rows.withColumn("__reach", F.when(F.col("__seg") == 0, F.greatest(local, F.col("__reach0"))).otherwise(local))
    rows = rows.withColumn("__new", F.when(F.col("__reach").isNull(), F.col("__far")).when(t - F.col("__reach") > cfg.scene_gap_s, 1).otherwise(0))
    # Numbers.
    counts = rows.groupBy(*library, "__c").agg(F.sum("__new").alias("n")).withColumn("__base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    rows = carried(counts, rows.withColumn("__k", F.sum("__new").over(upto)))
    rows = rows.withColumn("scene", F.format_string("S%03d", F.col("__base") + F.col("__k") + 1))
    return rows.select(*[c for c in items.columns if c != "scene"], "scene").unionByName(idle.select(*[c for c in items.columns if c != "scene"], "scene"))


def assign_ids(items: DataFrame, library: list[str], tie: str = "primary") -> DataFrame:
    """``items`` with ``id``: 'P0001' for stills and 'V0001' for videos along (time, seq, tie) in each ``library``."""
    video = F.coalesce(F.col("kind") == "video", F.lit(False))
    order = [F.col("time").isNull(), F.col("time"), F.coalesce("seq", F.lit(0)), F.col(tie)]
    placed = place_along(items.withColumn("__video", video), [*library, "__video"], order, "__n")
    named = F.when(F.col("__video"), F.format_string("V%04d", F.col("__n"))).otherwise(F.format_string("P%04d", F.col("__n")))
    return placed.withColumn("id", named).drop("__video", "__n")


def sheet_layout(photos: DataFrame, library: list[str], per_sheet: int = 9, tie: str = "primary") -> DataFrame:
    """``photos`` with ``sheet`` ('<scene>_<nn>') and ``sheet_pos`` (from 1): by time in each scene, ``per_sheet`` a sheet."""
    placed = place_along(photos, [*library, "scene"], [F.col("time").isNull(), F.col("time"), F.col(tie)], "__n").withColumn("__n", F.col("__n") - 1)
    sheet = F.format_string("%s_%02d", "scene", F.floor(F.col("__n") / per_sheet).cast("int") + 1)
    return placed.withColumns({"sheet": F.when(F.col("scene").isNotNull(), sheet), "sheet_pos": (F.col("__n") % per_sheet + 1).cast("int")}).drop("__n")
