"""Quality flags of stills and videos; each a condition, assembled in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelsift.config import CONFIG, VENDOR_DEVICE, Config


def listed(*flags: Column) -> Column:
    """An array of the flags that are not null."""
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def exposure_flags(brightness: Column, entropy: Column, clip_high: Column, clip_low: Column, screenshot: Column, hdr: Column, cfg: Config = CONFIG) -> list[Column]:
    """R1, R3-high and R3-low of a still; none for screenshots and HLG."""
    free = ~F.coalesce(screenshot, F.lit(False)) & ~F.coalesce(hdr, F.lit(False))
    bad = (brightness < cfg.dark_mean) | (brightness > cfg.bright_mean) | (entropy < cfg.entropy_min)
    return [F.when(free & bad, "R1"), F.when(free & (clip_high > cfg.clip_ratio), "R3-high"), F.when(free & (clip_low > cfg.clip_ratio), "R3-low")]


def blur_flag(sharp: Column, median: Column, screenshot: Column, cfg: Config = CONFIG) -> Column:
    """R2: sharpness (0 if null) below a share of the unrounded median."""
    return F.when(~F.coalesce(screenshot, F.lit(False)) & (F.coalesce(sharp, F.lit(0.0)) < median * cfg.blur_ratio), "R2")


def eye_flag(closed: Column, half: Column, screenshot: Column) -> Column:
    """EYE if eyes are closed, else EYE-half; none for screenshots."""
    return F.when(~F.coalesce(screenshot, F.lit(False)), F.when(closed > 0, "EYE").when(half > 0, "EYE-half"))


def relative_eye_flag(rel_closed: Column) -> Column:
    """EYE-rel; screenshots have it too."""
    return F.when(rel_closed > 0, "EYE-rel")


def frame_share(values: Column, bad) -> Column:
    """The share of frames for which ``bad`` holds; 0 without frames."""
    v = F.coalesce(values, F.array().cast("array<double>"))
    return F.size(F.filter(v, bad)) / F.greatest(F.size(v), F.lit(1))


def video_flags(
    duration: Column, brightness: Column, clip_high: Column, clip_low: Column, sharp: Column, median: Column, shake: Column, slowmo: Column, hdr: Column, mode: Column, device: Column, cfg: Config = CONFIG
) -> Column:
    """V1, V5, V4-high, V4-low, V3 and V2-hint of a video, ``median`` rounded to one decimal."""
    dim = F.coalesce(mode == "ilog", F.lit(False)) | F.coalesce(hdr, F.lit(False)) | (~F.coalesce(device == VENDOR_DEVICE, F.lit(False)) & mode.isNull())
    share = lambda v, bad: ~dim & (frame_share(v, bad) >= cfg.frame_share)
    return listed(
        F.when(duration < cfg.video_min_s, "V1"),
        F.when(share(brightness, lambda b: (b < cfg.dark_mean) | (b > cfg.bright_mean)), "V5"),
        F.when(share(clip_high, lambda x: x > cfg.clip_ratio), "V4-high"),
        F.when(share(clip_low, lambda x: x > cfg.clip_ratio), "V4-low"),
        F.when(sharp < median * cfg.blur_ratio, "V3"),
        F.when(slowmo.isNull() & (shake > cfg.shake_hint), "V2-hint"),
    )


def video_error(ext: Column, duration: Column, n_frames: Column) -> Column:
    """Why a video can't be judged: an unsupported format, no duration, no frames; null if it can."""
    return F.when(ext == ".nev", "unsupported format").when(duration.isNull() | (duration <= 0), "no duration").when(F.coalesce(n_frames, F.lit(0)) == 0, "no frames")


def probe_warning(scan_s: Column, probe_s: Column) -> Column:
    """Durations that disagree by more than a second."""
    return F.coalesce(F.abs(scan_s - probe_s) > 1, F.lit(False))


def preview_warning(long_side: Column, cfg: Config = CONFIG) -> Column:
    return F.coalesce(long_side < cfg.raw_preview_min_px, F.lit(False))


def clock_warning(name_time: Column, tag_time: Column, cfg: Config = CONFIG) -> Column:
    """The whole seconds between two clocks that disagree by more than a minute; null otherwise."""
    return F.when(F.abs(name_time - tag_time) > cfg.clock_warn_s, (tag_time - name_time).cast("bigint"))
