"""Derived columns of media files: classes, names, devices, zoom, panoramas, slow motion, colour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelsift import config as c
from reelsift.config import CONFIG, Config

# Fixed value: how the vendor's cameras name files.
VENDOR_NAME = r"(?i)^(IMG|LIV|VID|LRV)_([0-9]{8})_([0-9]{6})_([0-9]+)$"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """The folder of a path; '' at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def ext_of(path: Column) -> Column:
    """The last extension in lower case with its dot; '' where there is none or the name starts with its only dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def stem_of(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]+$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1)).otherwise(name)


def is_proxy(path: Column) -> Column:
    """A low-resolution copy of a video: by extension or by the prefix of its name."""
    return ext_of(path).isin(*c.PROXY_EXTS) | F.upper(file_name(path)).startswith("LRV_")


def is_raw(path: Column) -> Column:
    return ext_of(path).isin(*c.RAW_EXTS)


def is_sidecar(path: Column) -> Column:
    return ext_of(path).isin(*c.SIDECAR_EXTS)


def classify(path: Column) -> Column:
    """proxy, sidecar, raw, video or image, by that priority."""
    e = ext_of(path)
    return F.when(is_proxy(path), "proxy").when(is_sidecar(path), "sidecar").when(e.isin(*c.RAW_EXTS), "raw").when(e.isin(*c.VIDEO_EXTS), "video").otherwise("image")


def device_key(device: Column) -> Column:
    """The trimmed device, one vendor's folded to its key; null is ''."""
    d = F.coalesce(F.trim(device), F.lit(""))
    return F.when(d == c.VENDOR_DEVICE, c.VENDOR_KEY).otherwise(d)


def device_of(path: Column, model: Column, make: Column) -> Column:
    """From the name's pattern, else the model, else the make, else null."""
    return F.when(stem_of(path).rlike(VENDOR_NAME), c.VENDOR_DEVICE).otherwise(F.coalesce(F.nullif(F.trim(model), F.lit("")), F.nullif(F.trim(make), F.lit(""))))


def vendor_prefix(path: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(stem_of(path), VENDOR_NAME, 1)), F.lit(""))


def vendor_seq(path: Column) -> Column:
    """The running number in a vendor's name, 0 for other names."""
    return F.coalesce(F.regexp_extract(stem_of(path), VENDOR_NAME, 4).try_cast("int"), F.lit(0))


def group_key(path: Column) -> Column:
    """What files of one shot have in common: folder and date, time, number of a vendor's name, else the lower stem."""
    s = stem_of(path)
    named = s.rlike(VENDOR_NAME)
    key = F.when(named, F.concat_ws("_", *[F.regexp_extract(s, VENDOR_NAME, i) for i in (2, 3, 4)])).otherwise(F.lower(s))
    return F.struct(parent_of(path).alias("parent"), named.alias("vendor"), key.alias("key"))


def cross_key(model: Column, shutter: Column, taken: Column, stem: Column) -> Column:
    """What an image and its raw file in another folder have in common: model and shutter count, else time and stem."""
    m = F.coalesce(F.trim(model), F.lit(""))
    by_count = (m != "") & shutter.isNotNull()
    return F.when(by_count, F.concat_ws("\u0001", F.lit("s"), m, shutter.cast("string"))).otherwise(F.concat_ws("\u0001", F.lit("t"), m, F.coalesce(F.trim(taken), F.lit("")), F.lower(stem)))


def zoom_bucket(focal35: Column, ratio: Column, device: Column, cfg: Config = CONFIG) -> Column:
    """The lens class; null without a focal length."""
    r = F.coalesce(F.nullif(ratio, F.lit(0.0)), F.lit(1.0))
    base = focal35 / r
    own = F.when(F.lit(False), "")
    for name, mm in cfg.lenses.items():
        own = own.when(F.abs(base - mm) <= mm * 0.1, F.when(r > 1.05, f"{name}_crop").otherwise(name))
    own = own.when(focal35 <= cfg.zoom_wide_max, "wide").when(focal35 <= cfg.zoom_tele_max, "tele").otherwise("digital")
    other = F.when(focal35 <= 40, "wide").when(focal35 <= 105, "mid").otherwise("tele")
    return F.when(focal35.isNotNull() & (focal35 != 0), F.when(device == c.VENDOR_DEVICE, own).otherwise(other))


def is_screenshot(path: Column, comment: Column, make: Column) -> Column:
    name = file_name(path)
    words = reduce(lambda a, b: a | b, [F.lower(name).contains(w) | name.contains(w) for w in c.SCREENSHOT_WORDS])
    bare_png = (ext_of(path) == ".png") & (F.coalesce(make, F.lit("")) == "")
    return words | F.coalesce(comment == "Screenshot", F.lit(False)) | bare_png


def is_pano(projection: Column, width: Column, height: Column) -> Column:
    """Equirectangular, or at least 6000 wide at about two to one."""
    long_side, short_side = F.greatest(width, height), F.least(width, height)
    shape = (width > 0) & (height > 0) & (long_side >= 6000) & F.try_divide(long_side, short_side.cast("double")).between(1.95, 2.05)
    return F.coalesce(F.lower(projection) == "equirectangular", F.lit(False)) | F.coalesce(shape, F.lit(False))


def is_live_embedded(motion: Column) -> Column:
    return F.coalesce(F.lower(motion.cast("string")).isin("1", "true"), F.lit(False))


def slow_motion(duration: Column, created: Column, modified: Column) -> Column:
    """(capture_s, slowmo_factor) from the bracket of two times; both null without a positive duration."""
    bracket = modified.cast("double") - created.cast("double")
    slow = (bracket > 0) & (F.try_divide(duration, bracket) >= 1.8)
    plain = F.struct(F.round(duration, 1).alias("capture_s"), F.lit(None).cast("int").alias("slowmo_factor"))
    fast = F.struct(F.round(bracket, 1).alias("capture_s"), F.rint(F.try_divide(duration, bracket)).cast("int").alias("slowmo_factor"))
    return F.when(duration > 0, F.when(F.coalesce(slow, F.lit(False)), fast).otherwise(plain))


def tolerant_float(text: Column) -> Column:
    """The first blank-separated token as DOUBLE, commas read as blanks; null where it is no number."""
    return F.get(F.split(F.trim(F.replace(text, F.lit(","), F.lit(" "))), " +"), F.lit(0)).try_cast("double")


def tolerant_int(text: Column) -> Column:
    return F.get(F.split(F.trim(F.replace(text, F.lit(","), F.lit(" "))), " +"), F.lit(0)).try_cast("bigint")


def rate(text: Column) -> Column:
    """'30000/1001' as a number with three decimals; null on division by zero or bad text."""
    parts = F.split(text, "/", 2)
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.instr(text, "/") > 0, F.round(F.try_divide(num, den), 3)).otherwise(text.try_cast("double"))


def mean_volume(log: Column) -> Column:
    return F.round(F.regexp_extract(log, r"mean_volume:\s*(-?[\d.]+) dB", 1).try_cast("double"), 1)


def gps_point(lat: Column, lon: Column) -> Column:
    """Both coordinates or null."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere of 12,742,000 m across."""
    a1, o1, a2, o2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(12742000.0) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def color_mode(transfer: Column, primaries: Column) -> Column:
    """hlg, nlog, standard or null, by that priority."""
    t, blob = F.lower(F.coalesce(transfer, F.lit(""))), F.lower(F.concat_ws(" ", transfer, primaries))
    hlg = t.isin(*c.HDR_TRANSFERS) | blob.contains("hlg") | blob.contains("arib-std-b67")
    nlog = blob.contains("nlog") | blob.contains("n-log") | blob.contains("n_log")
    return F.when(hlg, "hlg").when(nlog, "nlog").when(t.isin(*c.STANDARD_TRANSFERS), "standard")


def photo_hdr(path: Column, transfer: Column) -> Column:
    t = F.lower(F.coalesce(transfer, F.lit("")))
    return ext_of(path).isin(".heic", ".heif", ".hif") & (t.contains("hlg") | t.contains("arib-std-b67"))


def video_hdr(transfer: Column, mode: Column) -> Column:
    return F.coalesce(transfer.isin(*c.HDR_TRANSFERS), F.lit(False)) | F.coalesce(mode == "hlg", F.lit(False))


def image_rank(path: Column, vendor: Column) -> Column:
    """Which image of a shot is its primary: HEIC before JPG for the vendor's names, JPG before HIF for others."""
    e = ext_of(path)
    jpg, hif = e.isin(".jpg", ".jpeg"), e.isin(".heic", ".heif", ".hif")
    return F.when(vendor, F.when(hif, 0).when(jpg, 1).otherwise(2)).otherwise(F.when(jpg, 0).when(hif, 1).otherwise(2))


def source_choice(primary: Column, companions: Column) -> Column:
    """What a video is analysed from: its first proxy companion, else itself."""
    return F.coalesce(F.get(F.filter(companions, is_proxy), F.lit(0)), primary)


def frame_times(duration: Column, n: int = 6, digits: int = 2) -> Column:
    """Mid-interval sample times."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(duration * (i + 0.5) / float(n), digits))


def human_size(n: Column) -> Column:
    """A size for people; ties round to even."""
    tenth = lambda x: F.rint(x * 10) / 10
    big, small = tenth(n / float(1 << 20)), tenth(n / 1024.0)
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", big)).when(F.coalesce(n, F.lit(0)) == 0, "0 B").otherwise(F.format_string("%.1f KB", small))


def array_median(values: Column, digits: int = 1) -> Column:
    """The median of an array, rounded; null for a null or empty one."""
    s, n = F.array_sort(F.filter(values, lambda x: x.isNotNull())), F.size(F.filter(values, lambda x: x.isNotNull()))
    mid = F.floor(n / 2).cast("int")
    both = (F.get(s, mid - 1) + F.get(s, mid)) / 2
    return F.when(n > 0, F.round(F.when(n % 2 == 1, F.get(s, mid)).otherwise(both), digits))


def tier_prefix(tier: Column, reason: Column) -> Column:
    r = F.coalesce(reason, F.lit(""))
    short = F.when(F.instr(r, c.REVIEW_PREFIX) > 0, F.concat(F.substring_index(r, c.REVIEW_PREFIX, 1), F.substring(r, F.instr(r, c.REVIEW_PREFIX) + F.lit(len(c.REVIEW_PREFIX)), F.length(r)))).otherwise(r)
    return F.when(tier == "00", F.concat(r, F.lit("__"))).when(tier == "01", F.concat(short, F.lit("__"))).otherwise(F.lit(""))


def add_suffix(name: Column, suffix: Column) -> Column:
    """The suffix before the first dot; a shadow's leading '._' stays in front."""
    shadow = name.startswith("._")
    base = F.when(shadow, F.substring(name, F.lit(3), F.length(name))).otherwise(name)
    dot = F.instr(base, ".")
    whole = F.when(dot > 0, F.concat(F.substring(base, F.lit(1), dot - 1), suffix, F.substring(base, dot, F.length(base)))).otherwise(F.concat(base, suffix))
    return F.when(shadow, F.concat(F.lit("._"), whole)).otherwise(whole)


def target_path(path: Column, tier: Column, reason: Column, suffix: Column) -> Column:
    """Where a plan entry's file goes: the tier's folder, the old folder, prefix and name."""
    folder = F.create_map(*[F.lit(x) for kv in c.TIER_DIRS.items() for x in kv])[tier]
    parent = parent_of(path)
    name = file_name(path)
    shadow = name.startswith("._")
    plain = F.when(shadow, F.substring(name, F.lit(3), F.length(name))).otherwise(name)
    return F.concat(folder, F.lit("/"), F.when(parent != "", F.concat(parent, F.lit("/"))).otherwise(F.lit("")), F.when(shadow, F.lit("._")).otherwise(F.lit("")), tier_prefix(tier, reason), add_suffix(plain, suffix))
