"""Queries from files to items, and over single functions of names, tags, times, faces and reports; each with its SQL.

The tables hold finished items, not the tags they were made of, so tags are written from an item's columns first and then
read as a camera's would be; names of the vendor's cameras likewise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsift.config import CONFIG
from reelsift.functions import media as m
from reelsift.functions import times
from reelsift.operators import catalog, clusters, eyes, flags, ledger, pixels, planning
from reelsift.operators.current import current_rows, known
from reelsift.operators.items import build_items, is_mixed, wh_of
from reelsift.operators.similarity import hash_bits
from reelsift.plans import media as plans
from reelsift.plans.media import _CUR, _ITEMS, _NAME, _STILLS, _VIDEOS, _ZOOM, _cls, _ext, _parent, _stem, items, stills, videos
from reelsift.plans.more import _parsed
from reelsift.plans.tables import table
from reelsift.shared import shared_dir
from reelsift.sources import files as sources
from reelsift.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# From files to items -------------------------------------------------------------------------------------------------


def _named(spark: SparkSession, d: str) -> DataFrame:
    """(path, first, item's columns): every file of the current items, those of plain and live photos and videos named as the vendor's cameras do.

    ``first`` marks the item's primary.  Proxies get the prefix LRV, raw and sidecar files that of their item.
    """
    i = items(spark, d, "kind", "subtype", "seq", "device", "time", "duration", "width", "height", "gps", "focal35", "companions", "live", "shutter_count", "SubSecDateTimeOriginal", "CreateDate")
    f = catalog.expand_files(i).where("path IS NOT NULL")
    p = F.col("path")
    stamp = F.date_format(F.timestamp_seconds(F.floor("time")), "yyyyMMdd_HHmmss")
    prefix = F.when(F.upper(m.ext_of(p)) == ".LRV", "LRV").otherwise(F.col("subtype"))
    own = F.col("subtype").isin("IMG", "LIV", "VID") & F.col("time").isNotNull() & ~F.isnan("time")
    name = F.concat(prefix, F.lit("_"), stamp, F.lit("_"), F.coalesce("seq", F.lit(0)).cast("string"), m.ext_of(p))
    path = F.when(own, F.concat(m.parent_of(p), F.lit("/"), name)).otherwise(p)
    first = F.col("path") == F.col("primary")
    one = f.select(path.alias("path"), first.alias("first"), *[c for c in i.columns if c != "companions"])
    # Names may meet; the tags of one file stay together.
    best = F.min(F.struct((~F.col("first")).alias("no"), "primary", *[c for c in one.columns if c not in ("path", "primary")]))
    return one.groupBy("path").agg(best.alias("x")).select("path", "x.*")


_NAMED = f"""f0 AS (SELECT DISTINCT ON ("primary", path) * FROM (SELECT *, unnest(list_append(coalesce(companions, []), "primary")) AS path FROM items) WHERE path IS NOT NULL),
f1 AS (SELECT *, path = "primary" AS first, CASE WHEN subtype IN ('IMG', 'LIV', 'VID') AND "time" IS NOT NULL AND NOT isnan("time") THEN {_parent('path')} || '/' || CASE WHEN {_ext('path')} = '.lrv' THEN 'LRV' ELSE subtype END || '_' || strftime(make_timestamp(floor("time")::BIGINT * 1000000), '%Y%m%d_%H%M%S') || '_' || coalesce(seq, 0)::VARCHAR || {_ext('path')} ELSE path END AS np FROM f0),
named AS (SELECT np AS path, first, "primary" AS p, kind, device, "time" AS t, duration, width, height, gps, focal35, live, shutter_count, SubSecDateTimeOriginal AS ss, CreateDate AS cd FROM (SELECT *, row_number() OVER (PARTITION BY np ORDER BY NOT first, "primary") AS k FROM f1) WHERE k = 1)"""
_VENDOR = "'(?i)^(IMG|LIV|VID|LRV)_([0-9]{8})_([0-9]{6})_([0-9]+)$'"
_RANK = f"CASE WHEN vendor THEN CASE WHEN ext IN ('.heic', '.heif', '.hif') THEN 0 WHEN ext IN ('.jpg', '.jpeg') THEN 1 ELSE 2 END ELSE CASE WHEN ext IN ('.jpg', '.jpeg') THEN 0 WHEN ext IN ('.heic', '.heif', '.hif') THEN 1 ELSE 2 END END"
_ROLES = f"""k0 AS (SELECT *, {_cls('path')} AS cls, {_parent('path')} AS parent, {_stem('path')} AS stem, {_ext('path')} AS ext, {_NAME.format(p='path')} AS name FROM named),
k1 AS (SELECT *, regexp_matches(stem, {_VENDOR}) AS vendor, CASE WHEN regexp_matches(stem, {_VENDOR}) THEN regexp_extract(stem, {_VENDOR}, 2) || '_' || regexp_extract(stem, {_VENDOR}, 3) || '_' || regexp_extract(stem, {_VENDOR}, 4) ELSE lower(stem) END AS shot FROM k0),
g AS (SELECT parent, vendor, shot, arg_min(path, ({_RANK}, name, path)) FILTER (cls = 'image') AS image, arg_min(path, (name, path)) FILTER (cls = 'raw') AS raw FROM k1 GROUP BY ALL),
l AS (SELECT k1.*, image, raw, vendor AND cls = 'video' AND image IS NOT NULL AND first AND coalesce(duration <= 4.0, false) AS is_live FROM k1 JOIN g USING (parent, vendor, shot)),
v AS (SELECT parent, vendor, shot, arg_min(path, (name, path)) AS video FROM l WHERE cls = 'video' AND NOT is_live GROUP BY ALL),
roles AS (SELECT l.*, CASE WHEN cls IN ('image', 'raw') THEN coalesce(image, raw) WHEN is_live THEN image WHEN cls = 'video' THEN path WHEN cls = 'proxy' THEN video WHEN cls = 'sidecar' THEN coalesce(image, raw, video) END AS item FROM l LEFT JOIN v USING (parent, vendor, shot))"""


def _tags(named: DataFrame) -> DataFrame:
    """Tags of the files that are primaries, as text."""
    text = lambda c: F.col(c).cast("string")
    given = {
        "Model": F.col("device"),
        "Make": F.lit(" "),
        "SubSecDateTimeOriginal": F.col("SubSecDateTimeOriginal"),
        "CreateDate": F.col("CreateDate"),
        "ImageWidth": text("width"),
        "ImageHeight": F.concat(text("height"), F.lit(" px")),
        "FocalLengthIn35mmFormat": F.concat(text("focal35"), F.lit(" mm")),
        "Duration": F.concat(text("duration"), F.lit(" s")),
        "GPSLatitude": text("gps.lat"),
        "GPSLongitude": text("gps.lon"),
        "ShutterCount": F.concat(text("shutter_count"), F.lit(", of 99")),
        "MotionPhoto": F.when(F.col("live"), "1"),
    }
    rest = ("DateTimeOriginal", "OffsetTimeOriginal", "CreationDate", "ModifyDate", "DigitalZoomRatio", "UserComment", "ProjectionType", "DirectoryItemLength", "LensModel", "ColorTransfer", "TransferCharacteristics")
    return named.where("first").select("path", *[c.alias(k) for k, c in given.items()], *[F.lit(None).cast("string").alias(k) for k in rest])


def _built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _named(spark, d)
    return build_items(n.select("path", F.lit(None).cast("double").alias("mtime")), _tags(n), F.lit("UTC"))


_DEVICE = "CASE WHEN regexp_matches(stem, " + _VENDOR + ") THEN 'Insta360 Luna Ultra' ELSE nullif(trim(CASE WHEN first THEN device END), '') END"
_BUILT = f"""WITH {_ITEMS}, {_NAMED}, {_ROLES}, mine AS (SELECT * FROM roles WHERE item = path),
near AS (SELECT item, list_sort(list(path)) AS companions, bool_or(cls = 'video') AS has_live FROM roles WHERE item <> path GROUP BY item),
z AS (SELECT path, coalesce(companions, []) AS companions, cls AS kind, CASE WHEN vendor THEN upper(regexp_extract(stem, {_VENDOR}, 1)) WHEN cls = 'video' THEN 'VID' ELSE 'STILL' END AS subtype, CASE WHEN vendor THEN regexp_extract(stem, {_VENDOR}, 4)::INT ELSE 0 END AS seq,
  cls = 'image' AND (coalesce(has_live, false) OR (first AND coalesce(live, false))) AS live, {_DEVICE} AS device, vendor, floor(t) AS name_t,
  CASE WHEN first THEN {_parsed('ss')} END AS a, CASE WHEN first THEN {_parsed('cd')} END AS b, CASE WHEN first THEN duration END AS duration, CASE WHEN first THEN width END AS width, CASE WHEN first THEN height END AS height, CASE WHEN first AND gps.lat IS NOT NULL AND gps.lon IS NOT NULL THEN gps END AS gps,
  CASE WHEN first THEN nullif(focal35, 0) END AS focal35, CASE WHEN first THEN shutter_count END AS shutter_count FROM mine LEFT JOIN near ON near.item = path),
built AS (SELECT *, CASE WHEN vendor THEN name_t ELSE round(coalesce(a, b) / 1e6, 6) END AS time_s, CASE WHEN vendor THEN 'filename' WHEN a IS NOT NULL THEN 'SubSecDateTimeOriginal' WHEN b IS NOT NULL THEN 'CreateDate' END AS time_source,
  CASE WHEN kind = 'video' AND duration > 0 THEN round(duration, 1) END AS capture_s, {_ZOOM} AS zoom_bucket FROM z)"""


@query(
    _BUILT
    + """ SELECT path AS "primary", array_to_string(companions, '|') AS companions, kind, subtype, seq, live, device, time_s, time_source, round(CASE WHEN kind = 'video' THEN time_s + capture_s END, 6) AS time_end, CASE WHEN kind = 'video' THEN duration END AS duration, capture_s, width, height,
  gps.lat AS lat, gps.lon AS lon, focal35, zoom_bucket, shutter_count FROM built"""
)
def items_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and their tags made items, a row each."""
    i, _ = _built(spark, d)
    return i.select(
        "primary", F.array_join("companions", "|").alias("companions"), "kind", "subtype", "seq", "live", "device", F.round("time", 6).alias("time_s"), "time_source", F.round("time_end", 6).alias("time_end"), "duration", "capture_s", "width", "height",
        F.col("gps.lat").alias("lat"), F.col("gps.lon").alias("lon"), "focal35", "zoom_bucket", "shutter_count",
    )


@query(f"WITH {_ITEMS}, {_NAMED}, {_ROLES} SELECT path, cls FROM roles WHERE item IS NULL")
def orphans_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Proxies and sidecars that belong to no item."""
    return _built(spark, d)[1]


@query(f"WITH {_ITEMS}, {_NAMED}, {_ROLES} SELECT path, CASE WHEN item IS NULL THEN 'orphan' WHEN item = path THEN 'item' ELSE 'companion' END AS role, item FROM roles")
def shot_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of the files of each shot: same folder, stamp and number of a vendor's name, else same stem."""
    n = _named(spark, d)
    p, g = F.col("path"), m.group_key(F.col("path"))
    f = n.select("path", F.when(F.col("first"), F.col("duration")).alias("duration"), m.classify(p).alias("cls"), g["parent"].alias("parent"), g["vendor"].alias("vendor"), g["key"].alias("shot"))
    return catalog.vendor_items(f, ["parent", "vendor", "shot"], CONFIG, F.col("vendor")).select("path", "role", "item")


@query(f"WITH {_ITEMS}, {_NAMED}, x AS (SELECT path, {_stem('path')} AS stem, {_ext('path')} AS ext FROM named) SELECT regexp_matches(stem, {_VENDOR}) AS vendor, nullif(upper(regexp_extract(stem, {_VENDOR}, 1)), '') AS prefix, ext IN ('.dng', '.cr2', '.cr3', '.nef', '.arw', '.raf', '.orf', '.rw2') AS raw, count(*) AS n FROM x GROUP BY ALL")
def vendor_split(spark: SparkSession, d: str) -> DataFrame:
    """Files with a vendor's name and others, by prefix and by whether they are raw."""
    p = F.col("path")
    return _named(spark, d).groupBy(m.stem_of(p).rlike(m.VENDOR_NAME).alias("vendor"), m.vendor_prefix(p).alias("prefix"), m.is_raw(p).alias("raw")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ITEMS}, f AS (SELECT "primary" AS p, {_ext(plans._P)} AS ext FROM items), r AS (SELECT p, {_RANK.replace('vendor', 'true')} AS own, {_RANK.replace('vendor', 'false')} AS other FROM f) SELECT own, other, count(*) AS n FROM r GROUP BY ALL""")
def image_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Which image of a shot comes first, by either rule."""
    p = F.col("primary")
    return items(spark, d).groupBy(m.image_rank(p, F.lit(True)).alias("own"), m.image_rank(p, F.lit(False)).alias("other")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_ITEMS}, k AS (SELECT CASE WHEN trim(coalesce(device, '')) <> '' AND shutter_count IS NOT NULL THEN 's' || chr(1) || trim(device) || chr(1) || shutter_count::VARCHAR
  ELSE 't' || chr(1) || trim(coalesce(device, '')) || chr(1) || trim(coalesce(SubSecDateTimeOriginal, '')) || chr(1) || lower({_stem(plans._P)}) END AS key FROM items)
SELECT replace(key, chr(1), '|') AS key, count(*) AS n FROM k GROUP BY ALL"""
)
def cross_keys(spark: SparkSession, d: str) -> DataFrame:
    """What an image and its raw file in another folder have in common."""
    i = items(spark, d, "device", "shutter_count", "SubSecDateTimeOriginal")
    key = m.cross_key(F.col("device"), F.col("shutter_count"), F.col("SubSecDateTimeOriginal"), m.stem_of(F.col("primary")))
    return i.groupBy(F.replace(key, F.lit("\u0001"), F.lit("|")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_COPIES = f"""fm AS (SELECT path, max(size) AS size, max(md5) AS md5 FROM file_manifest WHERE path IS NOT NULL AND md5 IS NOT NULL GROUP BY path),
e AS (SELECT DISTINCT i."primary" AS p, i.kind, list_has_any(list_transform(coalesce(i.companions, []), lambda x: {_ext('x')}), ['.dng', '.cr2', '.cr3', '.nef', '.arw', '.raf', '.orf', '.rw2']) AND i.kind = 'image' AS mixed, c AS path,
  trim(coalesce(device, '')) AS model, coalesce(shutter_count::VARCHAR, trim(coalesce(SubSecDateTimeOriginal, '')) || lower({_stem('c')})) AS mark FROM (SELECT *, unnest(companions) AS c FROM items WHERE kind IN ('image', 'raw')) i),
x AS (SELECT e.*, {_ext('e.path')} AS ext, size, md5 FROM e LEFT JOIN fm ON fm.path = e.path WHERE {_cls('e.path')} <> 'sidecar')"""


@query(
    f"""WITH RECURSIVE {_ITEMS}, {_COPIES},
ed AS (SELECT DISTINCT a.p AS a, b.p AS b FROM x a JOIN x b ON a.ext = b.ext AND a.size = b.size AND a.md5 = b.md5 AND a.p <> b.p),
r AS (SELECT DISTINCT a AS p, a AS q FROM ed UNION SELECT r.p, ed.b FROM r JOIN ed ON r.q = ed.a), lab AS (SELECT p, min(q) AS l FROM r GROUP BY p),
kp AS (SELECT l, arg_min(p, (NOT mixed, kind <> 'image', p)) AS keeper FROM lab JOIN (SELECT DISTINCT p, kind, mixed FROM x) USING (p) GROUP BY l)
SELECT lab.p AS "primary", keeper, (SELECT array_to_string(list_sort(list(DISTINCT path)), '|') FROM x WHERE x.p = lab.p) AS backups FROM lab JOIN kp USING (l) WHERE lab.p <> keeper"""
)
def backup_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that are copies of another one by files of equal extension, size and MD5, and the files that go to it."""
    i = items(spark, d, "kind", "companions").where(F.col("kind").isin("image", "raw")).withColumn("mixed", is_mixed(F.col("kind"), F.col("companions")))
    sizes = table(spark, d, "file_manifest").where("path IS NOT NULL AND md5 IS NOT NULL").groupBy("path").agg(F.max("size").alias("size"), F.max("md5").alias("md5"))
    f = i.select("primary", "kind", "mixed", F.explode("companions").alias("path")).distinct().join(sizes, "path", "left").where(~m.is_sidecar(F.col("path"))).withColumn("ext", m.ext_of(F.col("path")))
    return catalog.backup_items(f, ["ext", "size"], "md5").select("primary", "keeper", F.array_join("backups", "|").alias("backups"))


@query(
    f"""WITH {_ITEMS}, {_COPIES}, s AS (SELECT model, mark, ext, size, count(DISTINCT p) AS n_items, count(DISTINCT path) AS n_files, count(DISTINCT md5) AS n_digests FROM x WHERE size IS NOT NULL GROUP BY ALL)
SELECT model, ext, count(*) AS n_signatures, count_if(n_items > 1) AS n_shared, sum(n_files)::BIGINT AS n_files, sum(n_digests)::BIGINT AS n_digests FROM s GROUP BY ALL"""
)
def backup_signatures(spark: SparkSession, d: str) -> DataFrame:
    """How many signatures (model, shutter count or time and stem, extension, size) there are, and how many several items share."""
    i = items(spark, d, "kind", "companions", "device", "shutter_count", "SubSecDateTimeOriginal").where(F.col("kind").isin("image", "raw"))
    sizes = table(spark, d, "file_manifest").where("path IS NOT NULL AND md5 IS NOT NULL").groupBy("path").agg(F.max("size").alias("size"), F.max("md5").alias("md5"))
    p = F.col("path")
    f = i.withColumn("path", F.explode("companions")).join(sizes, "path").where("size IS NOT NULL").where(~m.is_sidecar(p))
    mark = F.coalesce(F.col("shutter_count").cast("string"), F.concat(F.trim(F.coalesce("SubSecDateTimeOriginal", F.lit(""))), F.lower(m.stem_of(p))))
    s = f.groupBy(F.trim(F.coalesce("device", F.lit(""))).alias("model"), mark.alias("mark"), m.ext_of(p).alias("ext"), "size").agg(F.count_distinct("primary").alias("i"), F.count_distinct("path").alias("f"), F.count_distinct("md5").alias("h"))
    return s.groupBy("model", "ext").agg(F.count(F.lit(1)).alias("n_signatures"), F.count_if(F.col("i") > 1).alias("n_shared"), F.sum("f").alias("n_files"), F.sum("h").alias("n_digests"))


# Sources and sinks ---------------------------------------------------------------------------------------------------


@query(
    f"""WITH p AS (SELECT "primary" AS path, NULL::BIGINT AS size FROM scan WHERE "primary" IS NOT NULL UNION SELECT path, size FROM file_manifest WHERE path IS NOT NULL),
k AS (SELECT nfc_normalize(path) AS path, size, {_ext('path')} AS ext FROM p WHERE NOT list_bool_or(list_transform(string_split(path, '/'), lambda x: starts_with(x, '.') OR x IN ('00_待删除', '01_待复核', '02_优秀', '03_普通', '99_报告', '_video_analysis', 'NKSC_PARAM')))
  AND {_ext('path')} IN ({', '.join(repr(x) for x in sorted(sources.KNOWN_EXTS))}))
SELECT {_parent('path')} AS parent, ext, count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS n_bytes FROM k GROUP BY ALL"""
)
def manifest_by_folder(spark: SparkSession, d: str) -> DataFrame:
    """A manifest made of a listing by the walk's rules, counted per folder and extension."""
    listing = table(spark, d, "scan").where("primary IS NOT NULL").select(F.col("primary").alias("path"), F.lit(None).cast("bigint").alias("size")).union(table(spark, d, "file_manifest").where("path IS NOT NULL").select("path", "size")).distinct()
    rows = sources.manifest_of_listing(listing.withColumn("mtime", F.lit(0.0)))
    return rows.groupBy("parent", "ext").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


@query(plans._LOG + "SELECT state, count(*) AS n, count(sq) AS n_seq, count(DISTINCT batch) AS n_batches FROM (SELECT state, batch, CASE WHEN state <> 'undone' THEN sq END AS sq FROM log) GROUP BY state")
def ledger_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The ledger written as lines of JSON to the shared folder and read back strictly."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex[:12]}"
    sinks.as_json(plans._log(spark, d).drop("ord")).write.text(path)
    back = sources.read_log(spark, path)
    return back.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("seq").alias("n_seq"), F.count_distinct("batch").alias("n_batches"))


@query("SELECT item_id, suite, length(\"text\") AS n_chars, \"text\" = trim(\"text\") AS trimmed FROM eval_items")
def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A report, here of the fixed table of test items, written as one JSON document and read back strictly."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex[:12]}"
    rows = table(spark, d, "eval_items").select("item_id", "suite", "text")
    doc = rows.agg(F.collect_list(F.struct("*")).alias("items")).select(F.lit("{}").alias("meta"), "items")
    doc.coalesce(1).write.json(path)
    back = sources.read_report(spark, path, "item_id BIGINT, suite STRING, text STRING")
    return back.select("item_id", "suite", F.length("text").alias("n_chars"), (F.col("text") == F.trim("text")).alias("trimmed"))


@query(f"""WITH {_VIDEOS} SELECT root, count(*) AS n, count(DISTINCT scene) AS n_scenes FROM videos GROUP BY root""")
def stored_report(spark: SparkSession, d: str) -> DataFrame:
    """K1: the report of videos stored with its summary, and counted from what is stored."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex[:12]}"
    sinks.write_report(videos(spark, d, "scene"), path, {"kind": "videos"})
    return spark.read.parquet(f"{path}/items").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("scene").alias("n_scenes"))


@query(
    f"""WITH {_ITEMS} SELECT "primary", width, height, round(30000 / (1000 + coalesce(seq, 0) % 3), 3) AS fps, kind = 'video' AND live IS NOT NULL AS has_audio, duration, round(-round(coalesce(duration, 0) % 60, 2) + 0.0, 1) AS volume_db FROM items WHERE kind = 'video' AND width IS NOT NULL AND height IS NOT NULL"""
)
def probes(spark: SparkSession, d: str) -> DataFrame:
    """A probe's JSON of each video, written from its columns, read as fields; the level from a log line."""
    v = items(spark, d, "kind", "width", "height", "duration", "seq", "live").where("kind = 'video' AND width IS NOT NULL AND height IS NOT NULL")
    rate = F.concat(F.lit("30000/"), (1000 + F.pmod(F.coalesce("seq", F.lit(0)), F.lit(3))).cast("string"))
    stream = lambda kind, audio: F.struct(F.lit(kind).alias("codec_type"), F.lit("h").alias("codec_name"), F.when(F.lit(audio), F.lit(None)).otherwise(F.col("width")).alias("width"), F.when(F.lit(audio), F.lit(None)).otherwise(F.col("height")).alias("height"), F.when(F.lit(audio), F.lit("0/0")).otherwise(rate).alias("r_frame_rate"))
    text = F.to_json(F.struct(F.when(F.col("live").isNotNull(), F.array(stream("audio", True), stream("video", False))).otherwise(F.array(stream("video", False), stream("video", False))).alias("streams"), F.struct(F.col("duration").cast("string").alias("duration")).alias("format")))
    level = F.format_string("[x] mean_volume: -%s dB", F.round(F.coalesce("duration", F.lit(0.0)) % 60, 2).cast("decimal(10,2)").cast("string"))
    p = v.select("primary", sources.probe_fields(text).alias("p"), (m.mean_volume(level) + 0.0).alias("volume_db"))
    return p.select("primary", "p.width", "p.height", "p.fps", "p.has_audio", "p.duration", "volume_db")


@query("SELECT 'scan' AS tbl, 'standard' AS color_mode UNION ALL SELECT 'photo_root', 'ilog'")
def tail_modes(spark: SparkSession, d: str) -> DataFrame:
    """The colour mode by a marker in a file's last bytes, read from the files of two tables: one marker is there, one isn't."""
    out = None
    for name, marker in (("scan", b"I_Log, which no table ends with"), ("photo_root", b"PAR1")):
        paths = table(spark, d, name).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path")).distinct()
        paths = paths.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
        one = sources.tail_color_mode(paths, 4 << 20, marker).select(F.lit(name).alias("tbl"), "color_mode").distinct()
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_ITEMS}, c AS (SELECT "primary", 0 AS ord, height AS w, width AS h FROM items WHERE kind = 'raw' UNION ALL SELECT "primary", 1, width, height FROM items WHERE kind = 'raw' UNION ALL SELECT "primary", 2, width // 2, height // 2 FROM items WHERE kind = 'raw')
SELECT "primary", arg_max(ord, (greatest(w, h), -ord)) AS ord, max(greatest(w, h)) AS long_side, max(greatest(w, h)) < 1600 AS small FROM c WHERE w > 0 AND h > 0 GROUP BY "primary" """)
def raw_previews(spark: SparkSession, d: str) -> DataFrame:
    """The preview of a raw file with the longest side, the first on ties, and whether it is too small."""
    r = items(spark, d, "kind", "width", "height").where("kind = 'raw'")
    c = r.select("primary", F.inline(F.array(F.struct(F.lit(0).alias("ord"), F.col("height").alias("width"), F.col("width").alias("height")), F.struct(F.lit(1).alias("ord"), "width", "height"), F.struct(F.lit(2).alias("ord"), F.floor(F.col("width") / 2).cast("int").alias("width"), F.floor(F.col("height") / 2).cast("int").alias("height")))))
    long_side = F.greatest("width", "height")
    return sources.best_preview(c, "primary").select("primary", "ord", long_side.alias("long_side"), flags.preview_warning(long_side).alias("small"))


@query("""SELECT doc_id, md5("text") AS md5, sha256("text") AS sha256 FROM documents WHERE "text" IS NOT NULL""")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    """X11, K6: digests of contents, here of texts in UTF-8."""
    blobs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return sources.with_digests(blobs).select("doc_id", "md5", "sha256")


@query(f"""SELECT doc_id, length("text") > 400 AS used_fallback, left("text", 400) AS head, CASE WHEN length("text") > 800 THEN 'ValueError' END AS error FROM documents WHERE "text" IS NOT NULL""".replace('left("text", 400) AS head', 'CASE WHEN length("text") <= 800 THEN length(left("text", 400)) END AS head').replace('length("text") > 400 AS', 'length("text") > 400 AND length("text") <= 800 AS'))
def decoded_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Contents decoded, on failure once more from their first bytes; a decoder that takes 1,600 bytes and blobs of which half is primary."""
    blobs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-32").alias("content"), F.least(F.octet_length(F.encode("text", "utf-32")), F.when(F.length("text") <= 800, 1600).otherwise(3200)).alias("primary_len"))

    def decode(content: bytes) -> tuple:
        if len(content) > 1600:
            raise ValueError("too long")
        return (len(content) // 4,)

    return sources.decode_with_fallback(blobs, decode, "head INT").select(F.col("path").cast("bigint").alias("doc_id"), "used_fallback", "head", "error")


# Single functions ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_ITEMS} SELECT "primary", CASE WHEN duration > 0 THEN CASE WHEN capture_s > 0 AND duration / capture_s >= 1.8 THEN round(capture_s, 1) ELSE round(duration, 1) END END AS capture_s,
  CASE WHEN duration > 0 AND capture_s > 0 AND duration / capture_s >= 1.8 THEN round_even(duration / capture_s, 0)::INT END AS slowmo_factor FROM items WHERE kind = 'video'"""
)
def slow_motion(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of capture and the factor of slow motion, from duration and the bracket of two times."""
    v = items(spark, d, "kind", "duration", "capture_s").where("kind = 'video'")
    s = m.slow_motion(F.col("duration"), F.lit(0.0), F.col("capture_s"))
    return v.select("primary", s.alias("s")).select("primary", "s.capture_s", "s.slowmo_factor")


@query(
    f"""WITH {_ITEMS} SELECT "primary", width, height, focal35 AS focal, shutter_count, CASE WHEN gps.lat IS NOT NULL AND gps.lon IS NOT NULL THEN gps.lat END AS lat, coalesce(live, false) AS embedded, round(width / nullif(height, 0)::DOUBLE, 3) AS rate FROM items"""
)
def tolerant_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers out of text with units and commas, both coordinates or none, rates."""
    i = items(spark, d, "width", "height", "focal35", "shutter_count", "gps", "live")
    text = lambda c, unit: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(unit))
    w, h = wh_of(text("width", " px"), text("height", ",x"))
    gps = m.gps_point(m.tolerant_float(text("gps.lat", " N")), m.tolerant_float(text("gps.lon", " E")))
    rate = m.rate(F.concat(F.col("width").cast("string"), F.lit("/"), F.col("height").cast("string")))
    return i.select("primary", w.alias("width"), h.alias("height"), m.tolerant_float(text("focal35", " mm")).alias("focal"), m.tolerant_int(text("shutter_count", ", of 9")).alias("shutter_count"), gps["lat"].alias("lat"), m.is_live_embedded(F.when(F.col("live"), "True").otherwise("0")).alias("embedded"), rate.alias("rate"))


_HOME = """homes AS (SELECT root, min(home_zone) AS hz FROM photo_root GROUP BY root)"""
# DuckDB takes the second of a repeated local hour; the hour before is taken if it shows the same clock.
_LOCAL = "CASE WHEN timezone({z}, timezone({z}, {t}) - INTERVAL 1 HOUR) = {t} THEN epoch(timezone({z}, {t}) - INTERVAL 1 HOUR) ELSE epoch(timezone({z}, {t})) END".format


@query(
    f"""WITH {_ITEMS}, {_HOME}, x AS (SELECT "primary" AS p, kind, trim(device) AS dev, strftime(make_timestamp(floor("time")::BIGINT * 1000000), '%Y:%m:%d %H:%M:%S') AS clock, strptime(strftime(make_timestamp(floor("time")::BIGINT * 1000000), '%Y:%m:%d %H:%M:%S'), '%Y:%m:%d %H:%M:%S') AS ts, coalesce(hz, 'UTC') AS z, {_parsed('SubSecDateTimeOriginal')} AS a,
  regexp_matches(trim(SubSecDateTimeOriginal), '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') AS zoned, trim(SubSecDateTimeOriginal) AS ss FROM items LEFT JOIN homes USING (root) WHERE "time" IS NOT NULL AND NOT isnan("time")),
y AS (SELECT *, {_LOCAL(z='z', t='ts')} AS name_s, CASE WHEN zoned THEN a / 1e6 WHEN a IS NOT NULL THEN {_LOCAL(z='z', t="make_timestamp(a - a % 1000000)")} + (a % 1000000) / 1e6 END AS sub_s FROM x)
SELECT p AS "primary", round(name_s, 3) AS name_s, 'filename' AS name_source, round(coalesce(sub_s, ts_off), 3) AS tag_s, CASE WHEN sub_s IS NOT NULL THEN 'SubSecDateTimeOriginal' ELSE 'DateTimeOriginal+OffsetTimeOriginal' END AS tag_source,
  CASE WHEN abs(name_s - sub_s) > 60 THEN trunc(sub_s - name_s)::BIGINT END AS clock_off FROM (SELECT *, epoch(ts) - 3600 AS ts_off FROM y)"""
)
def item_times(spark: SparkSession, d: str) -> DataFrame:
    """The time in a vendor's name, that of tags with and without offsets in the library's zone, and clocks that disagree."""
    homes = table(spark, d, "photo_root").where("root IS NOT NULL").groupBy("root").agg(F.min("home_zone").alias("hz"))
    i = items(spark, d, "time", "SubSecDateTimeOriginal").where("time IS NOT NULL AND NOT isnan(time)").join(homes, "root", "left")
    zone = F.coalesce("hz", F.lit("UTC"))
    stamp = F.timestamp_seconds(F.floor("time"))
    path = F.concat(F.lit("d/IMG_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit("_7.jpg"))
    nothing = F.struct(F.lit(None).cast("double").alias("time"), F.lit(None).cast("string").alias("source"))
    named = times.vendor_time(path, nothing, F.lit(0.0), zone)
    other = times.other_time(F.col("SubSecDateTimeOriginal"), F.date_format(stamp, "yyyy:MM:dd HH:mm:ss"), F.lit("+01:00"), nothing, F.lit(0.0), zone, F.lit(0.0))
    sub = times.seconds(times.parse_stamp(F.col("SubSecDateTimeOriginal")), zone)
    return i.select("primary", F.round(named["time"], 3).alias("name_s"), named["source"].alias("name_source"), F.round(other["time"], 3).alias("tag_s"), other["source"].alias("tag_source"), flags.clock_warning(times.name_time(path, zone), sub).alias("clock_off"))


@query(
    f"""WITH {_VIDEOS}, t AS (SELECT "primary" AS p, CASE color_mode WHEN 'hlg' THEN 'ARIB-STD-B67' WHEN 'standard' THEN 'bt709' WHEN 'ilog' THEN 'N-Log' END AS tr, zoom_bucket AS pr FROM videos), c AS (SELECT *, CASE WHEN lower(coalesce(tr, '')) IN ('arib-std-b67', 'smpte2084') THEN 'hlg' WHEN contains(lower(coalesce(tr, '')), 'n-log') THEN 'nlog' WHEN lower(coalesce(tr, '')) IN ('bt709') THEN 'standard' END AS mode FROM t)
SELECT p AS "primary", mode, coalesce(mode = 'hlg', false) AS hdr, coalesce(tr = 'ARIB-STD-B67' AND pr = 't', false) AS photo_hdr FROM c"""
)
def color_modes(spark: SparkSession, d: str) -> DataFrame:
    """Colour mode and HDR from transfer and primaries."""
    v = videos(spark, d, "color_mode", "zoom_bucket")
    transfer = F.when(F.col("color_mode") == "hlg", "ARIB-STD-B67").when(F.col("color_mode") == "standard", "bt709").when(F.col("color_mode") == "ilog", "N-Log")
    mode = m.color_mode(transfer, F.col("zoom_bucket"))
    path = F.when(F.col("zoom_bucket") == "t", "x.HIF").otherwise("x.jpg")
    return v.select("primary", mode.alias("mode"), m.video_hdr(transfer, mode).alias("hdr"), m.photo_hdr(path, transfer).alias("photo_hdr"))


@query(
    f"""WITH v AS {_CUR.format(t='video_analysis', w='')}, {_ITEMS} SELECT v."primary", CASE WHEN {_ext('v."primary"')} = '.nev' THEN 'unsupported format' WHEN v.duration IS NULL OR v.duration <= 0 THEN 'no duration' WHEN coalesce(len(phashes), 0) = 0 THEN 'no frames' END AS error, coalesce(abs(i.duration - v.duration) > 1, false) AS disagree FROM v LEFT JOIN items i ON i."primary" = v."primary" """
)
def video_errors(spark: SparkSession, d: str) -> DataFrame:
    """why a video can't be judged, and durations of scan and probe that disagree."""
    v = current_rows(table(spark, d, "video_analysis"), "primary", "run_at", ["duration", "phashes"])
    i = items(spark, d, "duration").select("primary", F.col("duration").alias("scan_s"))
    n = F.when(F.col("phashes").isNotNull(), F.size("phashes"))
    return v.join(i, "primary", "left").select("primary", flags.video_error(m.ext_of(F.col("primary")), F.col("duration"), n).alias("error"), flags.probe_warning(F.col("scan_s"), F.col("duration")).alias("disagree"))


@query(plans._PHOTO_LADDER + 'SELECT "primary", round(CASE WHEN med > 0 THEN sharp / med END, 3) AS tile_ratio FROM lad')
def tile_ratios(spark: SparkSession, d: str) -> DataFrame:
    """A4: sharpness over the ladder's median; the table has no sharpest tile, so the 90th percentile stands in."""
    r = plans._photo_medians(spark, d)
    return r.select("primary", F.round(F.when(F.col("median") > 0, F.col("sharp") / F.col("median")), 3).alias("tile_ratio"))


@query(
    plans._VIDEO_CLUSTERS
    + """, far AS (SELECT x.root, x.grp, max(list_sum(list_transform(list_zip(x.hs, y.hs), lambda z: bit_count(xor(z[1], z[2])))) / len(x.hs)) AS far FROM clustered x JOIN clustered y ON x.root = y.root AND x.grp = y.grp AND x."primary" < y."primary" GROUP BY ALL)
SELECT root, grp AS dup_group, max(size) AS dup_size, round(coalesce(max("time") - min("time"), 0), 3) AS dup_span_s, round(coalesce(max(far.far), 0), 4) AS dup_maxdist, max(size) >= 6 OR coalesce(max(far.far), 0) > 12 AS dup_loose FROM clustered LEFT JOIN far USING (root, grp) GROUP BY root, grp"""
)
def video_spread(spark: SparkSession, d: str) -> DataFrame:
    """Span and greatest mean distance of each cluster of videos, and whether it is loose."""
    rows = plans._video_clusters(spark, d).join(videos(spark, d, "time").select("primary", "time"), "primary")
    return clusters.video_spread(rows, ["root", "dup_group"])


# Faces, landmarks, pixels: embeddings read as such --------------------------------------------------------------------


def _faces(spark: SparkSession, d: str) -> DataFrame:
    """Four faces per embedding, on a photo of its own; photos of a label are a cluster."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    x = lambda k: F.get("embedding", F.col("i") * 8 + k).cast("double")
    return e.select("label", F.col("vec_id").alias("photo"), (F.col("vec_id") * 4 + F.col("i")).alias("face"), (F.round(x(0) * 4000) + 2000).alias("cx"), (F.round(x(1) * 4000) + 2000).alias("cy"), (F.round(F.abs(x(2)) * 300) + 20).alias("h"), F.round(F.abs(x(3)), 3).alias("blink_l"), F.round(F.abs(x(4)) * 2, 3).alias("blink_r"), (x(5) > 0).alias("subject"))


_FACES = """faces AS (SELECT label, vec_id AS photo, vec_id * 4 + i AS face, round(embedding[i * 8 + 1]::DOUBLE * 4000) + 2000 AS cx, round(embedding[i * 8 + 2]::DOUBLE * 4000) + 2000 AS cy, round(abs(embedding[i * 8 + 3]::DOUBLE) * 300) + 20 AS h,
  round(abs(embedding[i * 8 + 4]::DOUBLE), 3) AS bl, round(abs(embedding[i * 8 + 5]::DOUBLE) * 2, 3) AS br, embedding[i * 8 + 6]::DOUBLE > 0 AS subject FROM embeddings, range(4) t(i)),
same AS (SELECT a.face AS a, b.face AS b FROM faces a JOIN faces b ON a.label = b.label AND a.photo <> b.photo AND a.face < b.face AND sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) < 0.25 * (a.h + b.h) AND a.h / b.h BETWEEN 0.7 AND 1.4)"""


@query(
    f"""WITH RECURSIVE {_FACES}, twice AS (SELECT a, b FROM same UNION SELECT b, a FROM same), r AS (SELECT DISTINCT a AS p, a AS q FROM twice UNION SELECT r.p, twice.b FROM r JOIN twice ON r.q = twice.a), lab AS (SELECT p AS face, min(q) AS l FROM r GROUP BY p),
s AS (SELECT photo, subject, CASE WHEN l IS NOT NULL THEN round(greatest(bl, br) - min(greatest(bl, br)) OVER (PARTITION BY l), 4) END AS rel FROM faces LEFT JOIN lab USING (face)),
n AS (SELECT photo, count_if(subject AND coalesce(rel, 0) >= 0.25)::INT AS n FROM s GROUP BY photo) SELECT photo, n AS eye_rel_closed_n, CASE WHEN n > 0 THEN 'EYE-rel' END AS flag FROM n"""
)
def relative_eyes(spark: SparkSession, d: str) -> DataFrame:
    """Photos with eyes more closed than the same person's at best."""
    _, photos = clusters.relative_blink(_faces(spark, d), ["label"])
    return photos.select("photo", "eye_rel_closed_n", flags.relative_eye_flag(F.col("eye_rel_closed_n")).alias("flag"))


@query(f"WITH {_FACES} SELECT count(*) AS n_pairs, (SELECT count(*) FROM (SELECT a FROM same UNION SELECT b FROM same)) AS n_faces FROM same")
def person_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of faces in different photos of a cluster that are one person."""
    p = clusters.same_person_pairs(_faces(spark, d), ["label"]).select(F.explode(F.array("a", "b")).alias("face"))
    return p.agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n_pairs"), F.count_distinct("face").alias("n_faces"))


@query(
    """WITH p AS (SELECT vec_id, list_transform(range(12), lambda i: round(embedding[i + 1]::DOUBLE * 100, 3)) AS x FROM embeddings), e AS (SELECT *, sqrt(pow(x[1] - x[7], 2) + pow(x[2] - x[8], 2)) AS w FROM p)
SELECT vec_id, CASE WHEN w > 1e-6 THEN round((sqrt(pow(x[3] - x[11], 2) + pow(x[4] - x[12], 2)) + sqrt(pow(x[5] - x[9], 2) + pow(x[6] - x[10], 2))) / (2 * w), 4) END AS aspect,
  CASE WHEN abs(x[5] - x[3]) / 2 > 1e-6 THEN round((x[1] - (x[3] + x[5]) / 2) / (abs(x[5] - x[3]) / 2), 3) END AS yaw, x[1] + 20 < 22 AND abs(x[2]) < 18 AS covered FROM e"""
)
def eye_geometry(spark: SparkSession, d: str) -> DataFrame:
    """An eye's aspect, a face's yaw, and dark flat patches."""
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double") * 100, 3)
    point = lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y"))
    aspect = eyes.eye_aspect(*[point(i) for i in range(6)])
    return table(spark, d, "embeddings").select("vec_id", aspect.alias("aspect"), eyes.yaw_of(point(0), point(1), point(2)).alias("yaw"), eyes.covered_eye(at(0) + 20, F.abs(at(1))).alias("covered"))


@query(
    """WITH c AS (SELECT vec_id, i AS candidate, round(embedding[i * 2 + 1]::DOUBLE * 100, 2) AS cx, round(embedding[i * 2 + 2]::DOUBLE * 100, 2) AS cy FROM embeddings, range(5) t(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cx * cx + cy * cy, candidate) AS n FROM c WHERE cx BETWEEN -10 AND 10 AND cy BETWEEN -12 AND 12) SELECT vec_id, candidate FROM k WHERE n = 1"""
)
def landmark_choice(spark: SparkSession, d: str) -> DataFrame:
    """M4: of the landmark sets inside a face's box the one nearest to the crop's centre."""
    c = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("candidate"))
    at = lambda k: F.round(F.get("embedding", F.col("candidate") * 2 + k).cast("double") * 100, 2)
    box = {"x": -10.0, "y": -12.0, "w": 20.0, "h": 24.0, "px": 0.0, "py": 0.0}
    rows = c.select("vec_id", "candidate", at(0).alias("cx"), at(1).alias("cy"), *[F.lit(v).alias(k) for k, v in box.items()])
    return eyes.best_landmarks(rows, "vec_id").select("vec_id", "candidate")


@query(
    """WITH c AS (SELECT vec_id, i AS candidate, i // 3 AS attempt, round(embedding[i * 2 + 1]::DOUBLE * 100, 2) AS cx, round(embedding[i * 2 + 2]::DOUBLE * 100, 2) AS cy FROM embeddings, range(6) t(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY attempt, cx * cx + cy * cy, candidate) AS n FROM c WHERE cx BETWEEN -5 AND 5 AND cy BETWEEN -6 AND 6),
b AS (SELECT vec_id, vec_id % 60 + 20 < 40 AS tiny, candidate, attempt FROM embeddings LEFT JOIN (SELECT * FROM k WHERE n = 1) USING (vec_id))
SELECT vec_id, CASE WHEN NOT tiny THEN candidate END AS candidate, CASE WHEN NOT tiny THEN attempt END AS attempt, CASE WHEN tiny THEN 'tiny' WHEN candidate IS NULL THEN 'no_match' END AS note FROM b"""
)
def face_matches(spark: SparkSession, d: str) -> DataFrame:
    """M3, M4: each face with the landmark set of the first crop that holds one of it; faces too small or without one are noted."""
    e = table(spark, d, "embeddings")
    at = lambda k: F.round(F.get("embedding", F.col("candidate") * 2 + k).cast("double") * 100, 2)
    c = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("candidate")).select("vec_id", "candidate", F.floor(F.col("candidate") / 3).alias("attempt"), at(0).alias("cx"), at(1).alias("cy"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))
    faces = e.select("vec_id", F.lit(-5.0).alias("x"), F.lit(-6.0).alias("y"), F.lit(10.0).alias("w"), F.lit(12.0).alias("h"), (F.pmod("vec_id", F.lit(60)) + 20).alias("h_px"))
    return eyes.match_landmarks(faces, c, "vec_id").select("vec_id", "candidate", "attempt", "note")


@query(
    """WITH RECURSIVE g AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 128)::INT % 256) AS v FROM embeddings),
p AS (SELECT vec_id, v, r, c, v[r * 8 + c + 1] AS z, v[(CASE WHEN r = 0 THEN 1 ELSE r - 1 END) * 8 + c + 1] + v[(CASE WHEN r = 7 THEN 6 ELSE r + 1 END) * 8 + c + 1] + v[r * 8 + (CASE WHEN c = 0 THEN 1 ELSE c - 1 END) + 1] + v[r * 8 + (CASE WHEN c = 7 THEN 6 ELSE c + 1 END) + 1] - 4 * v[r * 8 + c + 1] AS lap FROM g, range(8) a(r), range(8) b(c)),
q AS (SELECT vec_id, v[16 * i + 2 * j + 1] AS a, v[16 * i + 2 * j + 2] AS b, v[16 * i + 2 * j + 9] AS c, v[16 * i + 2 * j + 10] AS d FROM g, range(4) x(i), range(4) y(j)), q2 AS (SELECT vec_id, [2 * b + 2 * c - 4 * a, 2 * a + 2 * d - 4 * b, 2 * a + 2 * d - 4 * c, 2 * b + 2 * c - 4 * d] AS l FROM q),
sp AS (SELECT vec_id, quantile_cont((4 * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l)) / 16.0, 0.9) AS sharp FROM q2 GROUP BY vec_id),
h AS (SELECT vec_id, z, count(*) / 64 AS s FROM p GROUP BY ALL), en AS (SELECT vec_id, -sum(s * log2(s)) AS e FROM h GROUP BY vec_id)
SELECT vec_id, round_even((64 * sum(lap * lap) - sum(lap) * sum(lap)) / 4096.0, 1) AS blur_var, round_even(avg(z), 1) AS brightness, round(avg((z >= 250)::INT), 3) AS clip_high, round(avg((z < 5)::INT), 3) AS clip_low, round_even(max(e), 2) AS entropy, round_even(max(sharp), 1) AS sharp_p90, 0.0::DOUBLE AS sharp_tile_max FROM p JOIN en USING (vec_id) JOIN sp USING (vec_id) GROUP BY vec_id"""
)
def image_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Grey statistics of 8 x 8 images made of embeddings; tiles of their tiles are single points, which are flat."""
    measured = plans.image_measures(spark, d)
    return measured.select(F.col("path").cast("bigint").alias("vec_id"), "blur_var", "brightness", "clip_high", "clip_low", "entropy", "sharp_p90", "sharp_tile_max")


@query(
    """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 128)::INT % 256) AS v FROM embeddings), p AS (SELECT vec_id, r, c, v[r * 8 + c + 1] AS z FROM g, range(8) a(r), range(8) b(c)),
w AS (SELECT k, x, sum(cos(pi() * k * (2 * (4 * x + j) + 1) / 64)) AS f FROM range(8) a(k), range(8) b(x), range(4) c(j) GROUP BY ALL), half AS (SELECT vec_id, k, c, sum(f * z) AS s FROM p JOIN w ON r = x GROUP BY ALL),
low AS (SELECT vec_id, h.k AS a, w.k AS b, sum(f * s) AS y FROM half h JOIN w ON c = x GROUP BY ALL), mid AS (SELECT vec_id, quantile_cont(y, 0.5) AS m FROM low GROUP BY vec_id)
SELECT vec_id, format('{:016x}', sum(CASE WHEN y > m THEN 1::UBIGINT << (63 - a * 8 - b)::UBIGINT ELSE 0::UBIGINT END)::UBIGINT) AS phash FROM low JOIN mid USING (vec_id) GROUP BY vec_id"""
)
def image_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Perceptual hashes of 8 x 8 images made of embeddings."""
    return plans.image_measures(spark, d).select(F.col("path").cast("bigint").alias("vec_id"), "phash")


@query(
    """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 128)::INT % 256) AS v FROM embeddings),
p AS (SELECT vec_id, v[r * 8 + c + 1] AS z FROM g, range(1, 3 + 4) a(r), range(0, 5) b(c) WHERE vec_id % 7 <> 0)
SELECT vec_id, round(avg(z), 4) AS mean, round(stddev_pop(z), 4) AS std, coalesce(avg(z) < 22 AND stddev_pop(z) < 18, false) AS covered FROM embeddings LEFT JOIN p USING (vec_id) GROUP BY vec_id"""
)
def eye_patches(spark: SparkSession, d: str) -> DataFrame:
    """M6: mean and deviation of a patch around the eyes, and whether that is covered; every seventh image has too few landmarks."""
    images = plans.embedded_images(spark, d)
    # Landmarks from (2, 3) to (3, 5), widened by two points to each side and cut at the picture's edge.
    xs = F.when(F.pmod(F.col("path").cast("bigint"), F.lit(7)) != 0, F.array(*[F.lit(float(x)) for x in (2, 3, 2, 3, 2, 3, 2, 3)]))
    ys = F.array(*[F.lit(float(y)) for y in (3, 5, 4, 3, 5, 4, 3, 5)])
    p = pixels.eye_patches(images.withColumns({"xs": xs, "ys": ys}))
    return p.select(F.col("path").cast("bigint").alias("vec_id"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), eyes.covered_eye(F.col("mean"), F.col("std")).alias("covered"))


@query("SELECT vec_id, 3 AS n_shifts, (vec_id % 4)::DOUBLE AS dx, (vec_id // 4 % 3)::DOUBLE AS dy FROM embeddings")
def planted_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Shifts between frames by phase correlation; each video is a picture that was moved by a known shift per frame, its last frame cut short."""
    size = 64
    frames = table(spark, d, "embeddings").select("vec_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    made = frames.mapInPandas(lambda b: pixels.moved_frames(b, size), "vec_id bigint, window int, i int, data binary")
    s = pixels.shake_of_frames(made, "vec_id", size)
    return s.groupBy("vec_id").agg(F.count(F.lit(1)).cast("int").alias("n_shifts"), (F.round(F.percentile("dx", 0.5)) + 0.0).alias("dx"), (F.round(F.percentile("dy", 0.5)) + 0.0).alias("dy"))


@query(_BUILT + " SELECT time_source, kind, count(*) AS n FROM built GROUP BY ALL")
def time_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where the times of items built from files come from."""
    return _built(spark, d)[0].groupBy("time_source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ITEMS} SELECT CASE WHEN len(list_filter(coalesce(companions, []), lambda x: {_ext('x')} = '.lrv' OR upper({_NAME.format(p='x')}) LIKE 'LRV\\_%' ESCAPE '\\')) > 0 THEN 'lrv' ELSE 'source' END AS analysis_src, count(*) AS n FROM items WHERE kind = 'video' GROUP BY 1""")
def analysis_sources(spark: SparkSession, d: str) -> DataFrame:
    """How many videos are analysed from a proxy and how many from themselves."""
    v = items(spark, d, "kind", "companions").where("kind = 'video'")
    src = F.when(m.source_choice(F.col("primary"), F.col("companions")) != F.col("primary"), "lrv").otherwise("source")
    return v.groupBy(src.alias("analysis_src")).agg(F.count(F.lit(1)).alias("n"))


@query(plans._VIDEO_FLAGS + "SELECT flag, count(*) AS n FROM (SELECT unnest(fl) AS flag FROM vflagged) GROUP BY flag")
def video_flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each flag of videos is set."""
    return plans._video_flags(spark, d).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_ITEMS}, x AS (SELECT coalesce(nullif(trim(device), ''), '(unknown)') AS device, kind, coalesce(companions, []) AS c, len(list_filter(coalesce(companions, []), lambda y: {_ext('y')} IN ('.dng', '.cr2', '.cr3', '.nef', '.arw', '.raf', '.orf', '.rw2'))) > 0 AS raw, len(list_filter(coalesce(companions, []), lambda y: {_parent('y')} <> {_parent(plans._P)})) > 0 AS far FROM items)
SELECT device, count_if(kind = 'image' AND raw) AS pairs, count_if(kind IN ('image', 'raw') AND far) AS cross_dir FROM x GROUP BY device"""
)
def device_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per device its images with a raw file, and items with files in another folder."""
    i = items(spark, d, "device", "kind", "companions")
    far = F.exists(F.coalesce("companions", F.array().cast("array<string>")), lambda c: m.parent_of(c) != m.parent_of(F.col("primary")))
    photo = F.col("kind").isin("image", "raw")
    return i.groupBy(F.coalesce(known("device"), F.lit("(unknown)")).alias("device")).agg(F.count_if(is_mixed(F.col("kind"), F.col("companions"))).alias("pairs"), F.count_if(photo & far).alias("cross_dir"))


# Plans, ledgers, reports -----------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT regexp_extract("primary", '^([^/]*)/', 1) AS root, max(planned_at) AS planned_at FROM plan WHERE "primary" IS NOT NULL GROUP BY 1),
a AS (SELECT root, max(run_at) AS run_at FROM (SELECT root, run_at FROM analysis UNION ALL SELECT root, run_at FROM video_analysis) GROUP BY root) SELECT root, coalesce(run_at > planned_at, false) AS stale FROM p LEFT JOIN a USING (root)"""
)
def stale_plans(spark: SparkSession, d: str) -> DataFrame:
    """Libraries whose analysis is newer than their plan."""
    root = F.regexp_extract("primary", "^([^/]*)/", 1)
    plan = table(spark, d, "plan").where("primary IS NOT NULL").select(root.alias("root"), "planned_at")
    runs = table(spark, d, "analysis").select("root", "run_at").unionByName(table(spark, d, "video_analysis").select("root", "run_at"))
    return planning.stale_plans(plan, runs, "root")


@query(
    plans._LOG
    + """, ex AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'f/' ELSE 'to/f/' END || (event_id // 3)::VARCHAR AS path FROM events)
SELECT batch, seq, dense_rank() OVER (ORDER BY first_ord DESC, seq DESC) AS turn FROM (SELECT DISTINCT l.batch, sq AS seq, first_ord FROM log l JOIN open USING (batch) WHERE l.state = 'pending')"""
)
def undo_order(spark: SparkSession, d: str) -> DataFrame:
    """The order in which moves are undone: latest batch first, in it later moves first."""
    u = ledger.undo_actions(plans._log(spark, d), spark.createDataFrame([], "path STRING")).select("batch", "seq", "turn").distinct()
    return ledger.numbered_turns(u)


@query(
    plans._LOG
    + f""", {_ITEMS}, {plans._PLANS} SELECT 'open_batch' AS rule, count(*) AS n FROM open HAVING count(*) > 0
UNION ALL SELECT 'other_device', count(*) FROM plans JOIN items USING ("primary") WHERE regexp_extract("primary", '^([^/]*)/', 1) <> root HAVING count(*) > 0"""
)
def apply_guard(spark: SparkSession, d: str) -> DataFrame:
    """L2: what keeps a plan from being carried out: open batches, moves to another device."""
    roots = items(spark, d).select("primary", "root")
    moves = plans._plan(spark, d).join(roots, "primary").select(F.regexp_extract("primary", "^([^/]*)/", 1).alias("from_device"), F.col("root").alias("to_device"))
    return ledger.apply_guard(plans._log(spark, d), moves)


@query(
    plans._PHOTO_FLAGS.rstrip()
    + """, d AS (SELECT root, count(DISTINCT dup_group) AS n_groups FROM stills GROUP BY root)
SELECT root, count(*) AS photo_total, count_if(len(fl) > 0) AS n_flagged, count_if(list_contains(fl, 'R1')) AS n_r1, count_if(list_contains(fl, 'R2')) AS n_r2, count_if(list_contains(fl, 'EYE')) AS n_eye, count_if(level = 0) AS level_0, any_value(n_groups) AS dup_clusters FROM flagged JOIN d USING (root) GROUP BY root"""
)
def report_meta(spark: SparkSession, d: str) -> DataFrame:
    """The summary that goes with a report of stills, per library."""
    has = lambda f: F.count_if(F.array_contains("flags", f))
    r = plans._photo_flags(spark, d).groupBy("root").agg(F.count(F.lit(1)).alias("photo_total"), F.count_if(F.size("flags") > 0).alias("n_flagged"), has("R1").alias("n_r1"), has("R2").alias("n_r2"), has("EYE").alias("n_eye"), F.count_if(F.col("level") == 0).alias("level_0"))
    groups = stills(spark, d, "dup_group").groupBy("root").agg(F.count_distinct("dup_group").alias("dup_clusters"))
    return r.join(groups, "root")


@query(
    f"""WITH a AS {_CUR.format(t='analysis', w='')}, v AS {_CUR.format(t='video_analysis', w='')}, u AS (SELECT "primary" AS p, dup_group AS g, 1 AS turn FROM a UNION ALL SELECT "primary", dup_group, 2 FROM v)
SELECT p AS "primary", arg_max(g, turn) AS dup_group FROM u WHERE g IS NOT NULL GROUP BY p"""
)
def dup_index(spark: SparkSession, d: str) -> DataFrame:
    """The groups of stills and videos in one index, in which the later source counts."""
    rows = lambda t: current_rows(table(spark, d, t), "primary", "run_at", ["dup_group"])
    return planning.dup_index([rows("analysis"), rows("video_analysis")])


@query(
    f"""WITH {_VIDEOS}, b AS (SELECT CASE WHEN slowmo_factor IS NOT NULL THEN 'slow' ELSE coalesce(color_mode, '(none)') || ' @' || len(coalesce(phashes, []))::VARCHAR END AS pool, shake FROM videos WHERE shake IS NOT NULL AND NOT isnan(shake))
SELECT pool, count(*) AS n, min(shake) AS least, max(shake) AS most, round(quantile_cont(shake, 0.5), 4) AS middle FROM b GROUP BY pool"""
)
def shake_pools(spark: SparkSession, d: str) -> DataFrame:
    """Shake per colour mode and rate, slow motion pooled; the number of frames stands in for the rate."""
    v = videos(spark, d, "slowmo_factor", "color_mode", "shake", "phashes").where("shake IS NOT NULL AND NOT isnan(shake)")
    pool = F.when(F.col("slowmo_factor").isNotNull(), "slow").otherwise(F.concat(F.coalesce("color_mode", F.lit("(none)")), F.lit(" @"), F.size(F.coalesce("phashes", F.array().cast("array<string>"))).cast("string")))
    return v.groupBy(pool.alias("pool")).agg(F.count("shake").alias("n"), F.min("shake").alias("least"), F.max("shake").alias("most"), F.round(F.percentile("shake", 0.5), 4).alias("middle"))


@query(
    f"""WITH {_ITEMS}, fs AS (SELECT DISTINCT path FROM file_manifest WHERE path IS NOT NULL AND deleted_at IS NULL UNION SELECT "primary" FROM items WHERE removed_at IS NULL),
x AS (SELECT DISTINCT "primary", unnest(list_append(coalesce(companions, []), "primary")) AS path FROM items) SELECT "primary", path FROM x WHERE path NOT IN (SELECT path FROM fs) OR path IS NULL"""
)
def lost_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of items, their primaries too, that are on disk no more: not in the manifest, deleted, or removed."""
    i = items(spark, d, "companions", "removed_at")
    disk = table(spark, d, "file_manifest").where("deleted_at IS NULL").select("path").unionByName(i.where("removed_at IS NULL").select(F.col("primary").alias("path")))
    return planning.missing_files(catalog.expand_files(i), disk)
