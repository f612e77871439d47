"""Times of items from names, tags and files, in the order of trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelsift.functions.media import VENDOR_NAME, stem_of

_STAMP = r"^(\d{4}:\d\d:\d\d \d\d:\d\d:\d\d)(?:\.(\d{1,6}))?(Z|[+-]\d\d:?\d\d)?$"


def parse_stamp(text: Column) -> Column:
    """(local, offset_s): a tag of year:month:day, with fractions and an offset if there are any; null if it is none.

    Four layouts, as cameras write them.  Text that begins with 0000 is null.  local is in microseconds as if in UTC.
    """
    s = F.trim(text)
    ok = s.rlike(_STAMP) & ~s.startswith("0000")
    whole = F.try_to_timestamp(F.regexp_extract(s, _STAMP, 1), F.lit("yyyy:MM:dd HH:mm:ss"))
    micros = F.rpad(F.regexp_extract(s, _STAMP, 2), 6, "0").cast("bigint")
    zone = F.replace(F.regexp_extract(s, _STAMP, 3), F.lit(":"), F.lit(""))
    secs = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60
    off = F.when(zone == "Z", 0).when(zone.startswith("-"), -secs).when(zone.startswith("+"), secs)
    return F.when(ok & whole.isNotNull(), F.struct((F.unix_micros(whole) + micros).alias("local"), off.alias("offset_s")))


def seconds(stamp: Column, zone: Column) -> Column:
    """Unix seconds of a parsed stamp; without an offset of its own it is in ``zone``."""
    there = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(stamp["local"]), zone))
    return F.coalesce(stamp["local"] - stamp["offset_s"].cast("bigint") * 1_000_000, there) / 1e6


def name_time(path: Column, zone: Column) -> Column:
    """Unix seconds of the date and time in a vendor's name."""
    s = stem_of(path)
    text = F.concat(F.regexp_extract(s, VENDOR_NAME, 2), F.regexp_extract(s, VENDOR_NAME, 3))
    return F.when(s.rlike(VENDOR_NAME), F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")), zone)) / 1e6)


def _first(*found: tuple[Column, Column]) -> Column:
    return F.coalesce(*[F.when(t.isNotNull(), F.struct(t.alias("time"), tag.alias("source"))) for t, tag in found])


def tag_time(subsec: Column, original: Column, creation: Column, create: Column, is_video: Column, zone: Column) -> Column:
    """(time, source): SubSecDateTimeOriginal, DateTimeOriginal, CreationDate if it has an offset, CreateDate (UTC in videos)."""
    return tag_time_of(*(parse_stamp(x) for x in (subsec, original, creation, create)), is_video, zone)


def tag_time_of(a: Column, b: Column, c: Column, e: Column, is_video: Column, zone: Column) -> Column:
    """As :func:`tag_time`, of stamps that are parsed already; columns keep the expression small."""
    return _first(
        (seconds(a, zone), F.lit("SubSecDateTimeOriginal")),
        (seconds(b, zone), F.lit("DateTimeOriginal")),
        (F.when(c["offset_s"].isNotNull(), seconds(c, zone)), F.lit("CreationDate")),
        (seconds(e, F.when(is_video, F.lit("UTC")).otherwise(zone)), F.lit("CreateDate")),
    )


def vendor_time(path: Column, tag: Column, mtime: Column, zone: Column) -> Column:
    """(time, source) of a file with a vendor's name: name, then tags, then the file's own time."""
    return _first((name_time(path, zone), F.lit("filename")), (tag["time"], tag["source"]), (mtime, F.lit("mtime")))


def other_time(subsec: Column, original: Column, offset: Column, tag: Column, mtime: Column, zone: Column, clock_offset: Column) -> Column:
    """(time, source) of other files: SubSecDateTimeOriginal; DateTimeOriginal with its offset, or local; tags; the file's time.

    ``clock_offset`` corrects the model's clock and is added, 0 where it is null.
    """
    return other_time_of(parse_stamp(subsec), parse_stamp(original), parse_stamp(F.concat(F.trim(original), F.trim(offset))), offset, tag, mtime, zone, clock_offset)


def other_time_of(a: Column, o: Column, joined: Column, offset: Column, tag: Column, mtime: Column, zone: Column, clock_offset: Column) -> Column:
    """As :func:`other_time`, of the stamps of SubSecDateTimeOriginal, of DateTimeOriginal and of that with its offset behind it."""
    with_offset = F.coalesce(F.when(o["offset_s"].isNull(), seconds(joined, zone)), seconds(o, zone))
    named = F.when(F.coalesce(offset, F.lit("")) != "", "DateTimeOriginal+OffsetTimeOriginal").otherwise("DateTimeOriginal")
    best = _first((seconds(a, zone), F.lit("SubSecDateTimeOriginal")), (with_offset, named), (tag["time"], tag["source"]), (mtime, F.lit("mtime")))
    return F.struct((best["time"] + F.coalesce(clock_offset, F.lit(0.0))).alias("time"), best["source"].alias("source"))
