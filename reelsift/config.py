"""Thresholds and fixed values of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass, field

# Folder names, extensions and reasons that catalogues of this layout use.
REPORT_DIR = "99_报告"
TIER_DIRS = {"00": "00_待删除", "01": "01_待复核", "02": "02_优秀", "03": "03_普通"}
OTHER_SKIPPED_DIRS = ("_video_analysis", "NKSC_PARAM")
IMAGE_EXTS = (".heic", ".heif", ".hif", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")
RAW_EXTS = (".dng", ".cr2", ".cr3", ".nef", ".arw", ".raf", ".orf", ".rw2")
VIDEO_EXTS = (".mp4", ".mov", ".m4v", ".avi", ".mts", ".webm", ".nev")
PROXY_EXTS = (".lrv",)
SIDECAR_EXTS = (".xmp", ".aae", ".thm", ".nksc")
DELETE_REASONS = ("模糊", "过曝", "欠曝", "歪斜", "闭眼", "遮挡", "误拍", "污损", "过短", "抖动", "重复")
REVIEW_PREFIX = "复核-"
DUPLICATE_REASON = "重复"
SCREENSHOT_WORDS = ("screenshot", "screen shot", "截屏", "屏幕快照", "屏幕截图")
HDR_TRANSFERS = ("arib-std-b67", "smpte2084")
STANDARD_TRANSFERS = ("bt709", "bt.709", "iec61966-2-1", "smpte170m", "bt601", "bt.601")
VENDOR_DEVICE = "Insta360 Luna Ultra"
VENDOR_KEY = "luna"


@dataclass(frozen=True)
class Config:
    """Thresholds; every one may be changed per call."""

    # The catalogue's defaults, by which its results are defined.
    scene_gap_s: float = 600.0
    scene_gps_m: float = 500.0
    dup_bits: int = 6
    burst_gap_s: float = 3.0
    burst_bits: int = 12
    cross_gap_s: float = 5.0
    blur_ratio: float = 0.3
    min_group: int = 5
    entropy_min: float = 2.0
    clip_ratio: float = 0.40
    dark_mean: float = 10.0
    bright_mean: float = 245.0
    live_max_s: float = 4.0
    video_min_s: float = 2.0
    lenses: dict[str, float] = field(default_factory=lambda: {"w": 20.0, "t": 60.0})
    zoom_wide_max: float = 40.0
    zoom_tele_max: float = 150.0
    frame_share: float = 0.6
    analysis_px: int = 1280
    shake_hint: float = 1.0
    raw_preview_min_px: int = 1600
    clock_warn_s: float = 60.0
    loose_size: int = 6
    closed_blink: float = 0.5
    half_blink: float = 0.35
    yaw_unsure: float = 0.55
    face_min_share: float = 0.03
    subject_height: float = 0.08
    subject_area: float = 0.25
    smile_squint: float = 0.4
    rel_closed: float = 0.25
    tiny_face_px: int = 40


CONFIG = Config()
