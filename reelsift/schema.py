"""Declared types of the catalogue's tables; nothing is inferred."""

from __future__ import annotations

EXIF_TAGS = (
    "SourceFile STRING, SubSecDateTimeOriginal STRING, DateTimeOriginal STRING, OffsetTimeOriginal STRING, CreationDate STRING, CreateDate STRING, Make STRING, Model STRING, "
    "ModifyDate STRING, ImageWidth STRING, ImageHeight STRING, FocalLengthIn35mmFormat STRING, DigitalZoomRatio STRING, Duration STRING, GPSLatitude STRING, GPSLongitude STRING, "
    "UserComment STRING, ContentIdentifier STRING, ProjectionType STRING, DirectoryItemLength STRING, MotionPhoto STRING, ShutterCount STRING, LensModel STRING, ColorTransfer STRING, "
    "TransferCharacteristics STRING"
)
MANIFEST = "path STRING, parent STRING, stem STRING, ext STRING, size BIGINT, mtime DOUBLE"
LEDGER = "batch STRING, seq BIGINT, src STRING, dst STRING, state STRING, time STRING, path STRING, type STRING"
PLAN = "primary STRING, tier STRING, reason STRING, keep STRING"
ITEM = (
    "id STRING, primary STRING, companions ARRAY<STRING>, kind STRING, subtype STRING, seq INT, live BOOLEAN, live_embedded BOOLEAN, screenshot BOOLEAN, pano BOOLEAN, device STRING, "
    "time DOUBLE, time_end DOUBLE, time_source STRING, duration DOUBLE, capture_s DOUBLE, slowmo_factor INT, width INT, height INT, gps ARRAY<DOUBLE>, focal35 DOUBLE, zoom_ratio DOUBLE, "
    "zoom_bucket STRING, primary_len BIGINT, scene STRING, lens STRING, shutter_count BIGINT, backup_copies ARRAY<STRING>, cross_dir BOOLEAN, color_transfer STRING"
)
PROBE = "streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: INT, height: INT, r_frame_rate: STRING, pix_fmt: STRING, color_transfer: STRING, color_primaries: STRING>>, format STRUCT<duration: STRING>"
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def report(item: str) -> str:
    """A report file: rows under ``items`` and a summary that is kept as text."""
    return f"meta STRING, items ARRAY<STRUCT<{', '.join(part.strip().replace(' ', ': ', 1) for part in _split(item))}>>"


def _split(ddl: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(ddl[last:i])
            last = i + 1
    return [*parts, ddl[last:]]
