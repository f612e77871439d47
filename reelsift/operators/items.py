"""From files and their tags to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.config import CONFIG, RAW_EXTS, Config
from reelsift.functions import media as m
from reelsift.functions import times
from reelsift.operators.catalog import vendor_items
from reelsift.sources.files import with_tags


def _text(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def wh_of(width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height as numbers; text that is none is null."""
    return m.tolerant_int(width).cast("int"), m.tolerant_int(height).cast("int")


def media_fields(files: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """``files`` (path and tags) with width, height, gps, focal35, zoom_ratio, device, zoom_bucket, primary_len, screenshot, pano, lens,
    shutter_count and color_transfer.  Zero focal lengths and ratios are null, as blank texts are."""
    p = F.col("path")
    w, h = wh_of(F.col("ImageWidth"), F.col("ImageHeight"))
    number = lambda c: F.nullif(m.tolerant_float(F.col(c)), F.lit(0.0))
    out = files.withColumns(
        {
            "width": w,
            "height": h,
            "gps": m.gps_point(m.tolerant_float(F.col("GPSLatitude")), m.tolerant_float(F.col("GPSLongitude"))),
            "focal35": number("FocalLengthIn35mmFormat"),
            "zoom_ratio": number("DigitalZoomRatio"),
            "device": m.device_of(p, F.col("Model"), F.col("Make")),
            "primary_len": m.tolerant_int(F.col("DirectoryItemLength")),
            "lens": _text("LensModel"),
            "shutter_count": m.tolerant_int(F.col("ShutterCount")),
            "color_transfer": F.coalesce(_text("ColorTransfer"), _text("TransferCharacteristics")),
        }
    )
    shot = m.is_screenshot(p, F.col("UserComment"), F.col("Make"))
    return out.withColumns({"zoom_bucket": m.zoom_bucket(F.col("focal35"), F.col("zoom_ratio"), F.col("device"), cfg), "screenshot": shot, "pano": m.is_pano(F.col("ProjectionType"), F.col("width"), F.col("height"))})


def build_items(files: DataFrame, tags: DataFrame, zone: Column, cfg: Config = CONFIG, clock_offsets: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, orphans): ``files`` (path, mtime) and ``tags`` (path and the tags of schema.EXIF_TAGS) as items, a row each, and files that belong to none.

    Files of one shot, see :func:`reelsift.functions.media.group_key`, are given roles by :func:`reelsift.operators.catalog.vendor_items`.
    Stills have no duration and no end; a video's end is its time and the seconds it was captured for.  Times without an offset are in
    ``zone``; ``clock_offsets`` corrects models' clocks.  Files without tags give items with nulls; rows with a null path are left out, repeated ones count once.
    """
    p = F.col("path")
    f = with_tags(files.where(p.isNotNull()).groupBy("path").agg(F.max("mtime").alias("mtime")), tags)
    g = m.group_key(p)
    f = f.withColumns({"cls": m.classify(p), "duration": m.tolerant_float(F.col("Duration")), "parent": g["parent"], "vendor": g["vendor"], "shot": g["key"]})
    roles = vendor_items(f.select("path", "cls", "duration", "parent", "vendor", "shot"), ["parent", "vendor", "shot"], cfg, F.col("vendor"))
    cls = m.classify(p)
    near = roles.where("role = 'companion'").groupBy(F.col("item").alias("path")).agg(F.array_sort(F.collect_list("path")).alias("companions"), F.max((cls == "video").cast("int")).alias("has_live"))
    mine = roles.where("role = 'item'").select("path").join(near, "path", "left").join(f, "path")
    video, still = F.col("kind") == "video", F.col("kind") != "video"
    offsets = F.create_map(*[F.lit(x) for kv in clock_offsets.items() for x in kv]) if clock_offsets else None
    clock = F.lit(0.0) if offsets is None else F.coalesce(F.try_element_at(offsets, F.coalesce(F.trim(F.col("Model")), F.lit(""))), F.lit(0.0))
    # Step by step in columns: a stamp is parsed once, however many rules look at it.
    stamps = {"__sub": "SubSecDateTimeOriginal", "__dto": "DateTimeOriginal", "__made": "CreationDate", "__new": "CreateDate", "__end": "ModifyDate"}
    rows = media_fields(mine, cfg).withColumns({k: times.parse_stamp(F.col(c)) for k, c in stamps.items()} | {"kind": F.col("cls"), "__off": times.parse_stamp(F.concat(F.trim(F.col("DateTimeOriginal")), F.trim(F.col("OffsetTimeOriginal")))), "__name": times.name_time(p, zone)})
    s = {k: F.col(k) for k in [*stamps, "__off"]}
    rows = rows.withColumn("__tag", times.tag_time_of(s["__sub"], s["__dto"], s["__made"], s["__new"], video, zone))
    tag = F.col("__tag")
    named = F.struct(F.coalesce("__name", tag["time"], F.col("mtime")).alias("time"), F.when(F.col("__name").isNotNull(), F.lit("filename")).when(tag.isNotNull(), tag["source"]).when(F.col("mtime").isNotNull(), F.lit("mtime")).alias("source"))
    other = times.other_time_of(s["__sub"], s["__dto"], s["__off"], F.col("OffsetTimeOriginal"), tag, F.col("mtime"), zone, clock)
    slow = m.slow_motion(F.col("duration"), times.seconds(s["__new"], F.lit("UTC")), times.seconds(s["__end"], F.lit("UTC")))
    rows = rows.withColumns({"when": F.when(F.col("vendor"), named).otherwise(other), "slow": F.when(video, slow)})
    embedded = still & m.is_live_embedded(F.col("MotionPhoto"))
    items = rows.select(
        p.alias("primary"),
        F.coalesce("companions", F.array().cast("array<string>")).alias("companions"),
        "kind",
        F.coalesce(m.vendor_prefix(p), F.when(video, "VID").otherwise("STILL")).alias("subtype"),
        m.vendor_seq(p).alias("seq"),
        ((F.col("kind") == "image") & (F.coalesce(F.col("has_live") == 1, F.lit(False)) | embedded)).alias("live"),
        ((F.col("kind") == "image") & embedded).alias("live_embedded"),
        "screenshot",
        "pano",
        "device",
        F.col("when.time").alias("time"),
        F.when(video, F.col("when.time") + F.col("slow.capture_s")).alias("time_end"),
        F.col("when.source").alias("time_source"),
        F.when(video, F.col("duration")).alias("duration"),
        F.col("slow.capture_s").alias("capture_s"),
        F.col("slow.slowmo_factor").alias("slowmo_factor"),
        *("width", "height", "gps", "focal35", "zoom_ratio", "zoom_bucket", "primary_len", "lens", "shutter_count", "color_transfer"),
    )
    return items, roles.where("role = 'orphan'").select("path", cls.alias("cls"))


def is_mixed(kind: Column, companions: Column) -> Column:
    """An image with a raw file among its companions."""
    return F.coalesce((kind == "image") & F.exists(F.coalesce(companions, F.array().cast("array<string>")), lambda x: m.ext_of(x).isin(*RAW_EXTS)), F.lit(False))
