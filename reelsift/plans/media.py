"""Queries over the media catalogue: scenes, medians, flags, clusters, pairing, planning, ledger, reports; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsift.config import CONFIG, DELETE_REASONS, DUPLICATE_REASON, VENDOR_DEVICE
from reelsift.functions import media as m
from reelsift.functions.text import nfc
from reelsift.operators import catalog, clusters, eyes, flags, ledger, pixels, planning
from reelsift.operators.components import component_labels
from reelsift.operators.baseline import PHOTO_LEVELS, adaptive_levels, ladder_median
from reelsift.operators.current import current_rows, finite, known, valid_number
from reelsift.operators.order import carried_last, selected_percentile
from reelsift.operators.scenes import assign_ids, assign_scenes, sheet_layout
from reelsift.operators.similarity import hash_bits
from reelsift.plans.tables import table

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


def items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "scan"), "primary", "run_at", ["root", *columns])


def stills(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current stills that could be read."""
    return current_rows(table(spark, d, "analysis"), "primary", "run_at", ["root", "error", *columns]).where("error IS NULL")


def videos(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current videos that could be read."""
    return current_rows(table(spark, d, "video_analysis"), "primary", "run_at", ["root", "error", *columns]).where("error IS NULL")


_CUR = '(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "primary" ORDER BY run_at DESC) AS rn FROM {t}) WHERE rn = 1{w})'
_ITEMS = "items AS " + _CUR.format(t="scan", w="")
_STILLS = "stills AS " + _CUR.format(t="analysis", w=" AND error IS NULL")
_VIDEOS = "videos AS " + _CUR.format(t="video_analysis", w=" AND error IS NULL")
_DEV = f"CASE WHEN coalesce(trim(device), '') = 'Insta360 Luna Ultra' THEN 'luna' ELSE coalesce(trim(device), '') END"
_NAME = "regexp_extract({p}, '([^/]*)$', 1)"
_P = '"primary"'


def _ext(p: str) -> str:
    return f"lower(regexp_extract({_NAME.format(p=p)}, '^.+(\\.[^.]+)$', 1))"


def _cls(p: str) -> str:
    e, name = _ext(p), _NAME.format(p=p)
    return (
        f"CASE WHEN {e} = '.lrv' OR upper({name}) LIKE 'LRV\\_%' ESCAPE '\\' THEN 'proxy' WHEN {e} IN ('.xmp', '.aae', '.thm', '.nksc') THEN 'sidecar' "
        f"WHEN {e} IN ('.dng', '.cr2', '.cr3', '.nef', '.arw', '.raf', '.orf', '.rw2') THEN 'raw' WHEN {e} IN ('.mp4', '.mov', '.m4v', '.avi', '.mts', '.webm', '.nev') THEN 'video' ELSE 'image' END"
    )


def _stem(p: str) -> str:
    name = _NAME.format(p=p)
    return f"CASE WHEN regexp_matches({name}, '^.+\\.[^.]+$') THEN regexp_extract({name}, '^(.+)\\.[^.]+$', 1) ELSE {name} END"


def _parent(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN regexp_extract({p}, '^(.*)/[^/]*$', 1) ELSE '' END"


# Scenes ------------------------------------------------------------------------------------------------------------


def _scened(spark: SparkSession, d: str) -> DataFrame:
    return assign_scenes(items(spark, d, "kind", "seq", "time", "time_end", "gps").drop("scene"), ["root"])


_FAR = "12742000.0 * asin(sqrt(pow(sin((radians(a) - radians(pa)) / 2), 2) + cos(radians(pa)) * cos(radians(a)) * pow(sin((radians(o) - radians(po)) / 2), 2)))"
_SCENES = f"""WITH {_ITEMS},
s0 AS (SELECT root, "primary" AS p, kind, coalesce(seq, 0) AS seq, "time" AS t, coalesce(time_end, "time") AS e, gps, gps.lat AS a, gps.lon AS o FROM items),
s1 AS (SELECT *, last_value(gps IGNORE NULLS) OVER (PARTITION BY root ORDER BY t NULLS LAST, seq, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lg FROM s0),
s2 AS (SELECT *, CASE WHEN {_FAR.replace('pa', 'lg.lat').replace('po)', 'lg.lon)')} > 500 THEN 1 ELSE 0 END AS far FROM s1),
s3 AS (SELECT *, sum(far) OVER (PARTITION BY root ORDER BY t NULLS LAST, seq, p ROWS UNBOUNDED PRECEDING) AS seg FROM s2),
s4 AS (SELECT *, max(e) OVER (PARTITION BY root, seg ORDER BY t NULLS LAST, seq, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s3),
s5 AS (SELECT *, CASE WHEN reach IS NULL THEN far WHEN t - reach > 600 THEN 1 ELSE 0 END AS new FROM s4),
s6 AS (SELECT *, 1 + sum(new) OVER (PARTITION BY root ORDER BY t NULLS LAST, seq, p ROWS UNBOUNDED PRECEDING) AS n FROM s5),
scened AS (SELECT *, CASE WHEN t IS NOT NULL THEN 'S' || lpad(n::BIGINT::VARCHAR, greatest(3, length(n::BIGINT::VARCHAR))::INT, '0') END AS scene FROM s6)
"""


@query(_SCENES + 'SELECT root, p AS "primary", scene FROM scened')
def scene_sessionize(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of each library by gaps in time and jumps in place."""
    return _scened(spark, d).select("root", "primary", "scene")


@query(_SCENES + "SELECT root, scene, count(*) AS n_items, min(t) AS first_s, max(e) AS last_s FROM scened WHERE scene IS NOT NULL GROUP BY root, scene")
def scene_summary(spark: SparkSession, d: str) -> DataFrame:
    """Span and size of each scene."""
    return _scened(spark, d).where("scene IS NOT NULL").groupBy("root", "scene").agg(F.count(F.lit(1)).alias("n_items"), F.min("time").alias("first_s"), F.max(F.coalesce("time_end", "time")).alias("last_s"))


# Days cut the timeline; items without a time come last.
_DAY = "coalesce(floor(time / 86400), 9223372036854775807)"


@query(_SCENES + 'SELECT p AS "primary", lg.lat AS last_lat, lg.lon AS last_lon FROM s1')
def carry_forward_place(spark: SparkSession, d: str) -> DataFrame:
    """The last known place before each item."""
    i = items(spark, d, "seq", "time", "gps")
    seen = carried_last(i, ["root"], [F.col("time").isNull(), F.col("time"), F.coalesce("seq", F.lit(0)), F.col("primary")], F.expr(_DAY), "gps", "place")
    return seen.select("primary", F.col("place.lat").alias("last_lat"), F.col("place.lon").alias("last_lon"))


@query(
    f"""WITH {_ITEMS} SELECT root, "primary", CASE WHEN kind = 'video' THEN 'V' ELSE 'P' END || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS id FROM (
  SELECT root, "primary", kind, row_number() OVER (PARTITION BY root, coalesce(kind = 'video', false) ORDER BY "time" NULLS LAST, coalesce(seq, 0), "primary") AS n FROM items)"""
)
def per_kind_ids(spark: SparkSession, d: str) -> DataFrame:
    """Running ids of stills and videos per library."""
    return assign_ids(items(spark, d, "kind", "seq", "time"), ["root"]).select("root", "primary", "id")


@query(
    f"""WITH {_STILLS}, x AS (SELECT root, scene, "primary", row_number() OVER (PARTITION BY root, scene ORDER BY "time" NULLS LAST, "primary") - 1 AS n FROM stills WHERE scene IS NOT NULL)
SELECT root, "primary", scene || '_' || lpad((n // 9 + 1)::VARCHAR, greatest(2, length((n // 9 + 1)::VARCHAR))::INT, '0') AS sheet, (n % 9 + 1)::INT AS sheet_pos FROM x"""
)
def sheet_pages(spark: SparkSession, d: str) -> DataFrame:
    """Contact sheets of nine per scene."""
    return sheet_layout(stills(spark, d, "scene", "time").where("scene IS NOT NULL"), ["root"]).select("root", "primary", "sheet", "sheet_pos")


@query(f"""WITH {_STILLS} SELECT "primary", '#' || coalesce(try_cast(substr(id, 2) AS INT), 0)::VARCHAR || ' ' || CASE WHEN len(coalesce(flags, [])) > 0 THEN array_to_string(flags, ',') ELSE '-' END || ' ' || coalesce(dup_group, '-') AS label FROM stills""")
def sheet_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of photos on sheets."""
    number = F.coalesce(F.substring("id", 2, 12).try_cast("int"), F.lit(0)).cast("string")
    named = F.when(F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0, F.array_join("flags", ",")).otherwise("-")
    return stills(spark, d, "id", "flags", "dup_group").select("primary", F.concat(F.lit("#"), number, F.lit(" "), named, F.lit(" "), F.coalesce("dup_group", F.lit("-"))).alias("label"))


@query(
    f"""WITH {_VIDEOS} SELECT "primary", coalesce(scene, '') || '_' || coalesce(id, '') || CASE WHEN color_mode = 'ilog' THEN '_LOG' WHEN hdr THEN '_HDR' ELSE '' END || CASE WHEN slowmo_factor IS NOT NULL THEN '_SLOW' ELSE '' END || '.jpg' AS sheet FROM videos"""
)
def video_sheet_names(spark: SparkSession, d: str) -> DataFrame:
    """Y2: file names of video sheets."""
    mark = F.when(F.col("color_mode") == "ilog", "_LOG").when(F.col("hdr"), "_HDR").otherwise("")
    slow = F.when(F.col("slowmo_factor").isNotNull(), "_SLOW").otherwise("")
    return videos(spark, d, "id", "scene", "color_mode", "hdr", "slowmo_factor").select("primary", F.concat(F.coalesce("scene", F.lit("")), F.lit("_"), F.coalesce("id", F.lit("")), mark, slow, F.lit(".jpg")).alias("sheet"))


# Medians and flags --------------------------------------------------------------------------------------------------


def _photo_medians(spark: SparkSession, d: str) -> DataFrame:
    rows = stills(spark, d, "device", "scene", "subtype", "zoom_bucket", "sharp_p90", "brightness", "clip_high", "clip_low", "entropy", "screenshot", "hdr", "eyes_closed_n", "subject_open_n", "time", "phash")
    rows = rows.withColumns({"device_key": m.device_key(F.col("device")), "sharp": F.when(valid_number("sharp_p90"), F.col("sharp_p90"))})
    return ladder_median(rows, PHOTO_LEVELS, "sharp", CONFIG.min_group, base=["root"])


def _ladder_sql(source: str, keys: list[str], value: str) -> str:
    levels = [f"root, {k}" for k in keys] + ["root"]
    windows = ", ".join(f"quantile_cont({value}, 0.5) OVER (PARTITION BY {k}) AS m{i}, count({value}) OVER (PARTITION BY {k}) AS n{i}" for i, k in enumerate(levels))
    last = len(keys)
    case = lambda c: "CASE " + " ".join(f"WHEN n{i} >= 5 THEN {c}{i}" for i in range(last)) + f" ELSE {c}{last} END"
    level = "CASE " + " ".join(f"WHEN n{i} >= 5 THEN {i}" for i in range(last)) + f" ELSE {last} END"
    return f"lad0 AS (SELECT *, {windows} FROM {source}), lad AS (SELECT *, {case('m')} AS med, {level} AS level, {case('n')} AS n FROM lad0)"


_OKNUM = "CASE WHEN {c} >= 0 AND NOT isnan({c}) AND NOT isinf({c}) THEN {c} END"
_PHOTO_LADDER = f"""WITH {_STILLS}, src AS (SELECT *, {_DEV} AS dk, {_OKNUM.format(c='sharp_p90')} AS sharp FROM stills),
{_ladder_sql('src', ['dk, scene, subtype, zoom_bucket', 'dk, scene, subtype', 'dk, subtype, zoom_bucket', 'dk, subtype'], 'sharp')}
"""


@query(_PHOTO_LADDER + 'SELECT "primary", round(med, 6) AS r2_median, level AS r2_level, n AS r2_n FROM lad')
def photo_medians(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2: each still's median of sharpness from the finest group of at least five."""
    return _photo_medians(spark, d).select("primary", F.round("median", 6).alias("r2_median"), F.col("level").alias("r2_level"), F.col("n").alias("r2_n"))


@query(_PHOTO_LADDER + "SELECT level AS r2_level, count(*) AS n FROM lad GROUP BY level")
def level_distribution(spark: SparkSession, d: str) -> DataFrame:
    """How often each level of the ladder is used."""
    return _photo_medians(spark, d).groupBy(F.col("level").alias("r2_level")).agg(F.count(F.lit(1)).alias("n"))


def _video_medians(spark: SparkSession, d: str) -> DataFrame:
    rows = videos(spark, d, "device", "scene", "color_mode", "zoom_bucket", "slowmo_factor", "median_sharp", "duration", "brightness", "clip_high", "clip_low", "shake", "hdr", "phashes")
    rows = rows.withColumns({"device_key": m.device_key(F.col("device")), "sharp": F.when(valid_number("median_sharp"), F.col("median_sharp"))})
    metric = F.when(F.col("slowmo_factor").isNull(), F.col("sharp"))
    return ladder_median(rows, adaptive_levels(rows), metric, CONFIG.min_group, base=["root"]).withColumn("v3_median", F.round("median", 1))


_V_SRC = f"vsrc AS (SELECT *, {_DEV} AS dk, {_OKNUM.format(c='median_sharp')} AS sharp, CASE WHEN slowmo_factor IS NULL THEN {_OKNUM.format(c='median_sharp')} END AS metric FROM videos), zs AS (SELECT count(zoom_bucket) >= 0.8 * count(*) AS z FROM vsrc), vz AS (SELECT * FROM vsrc, zs)"
# With few zoom classes the levels that use them are skipped: their counts are set to zero, their numbers close up.
_VIDEO_LADDER = f"""WITH {_VIDEOS}, {_V_SRC},
lad0 AS (SELECT *, {', '.join(f"quantile_cont(metric, 0.5) OVER (PARTITION BY root{k}) AS m{i}, count(metric) OVER (PARTITION BY root{k}) AS n{i}" for i, k in enumerate([', dk, scene, color_mode, zoom_bucket', ', dk, scene, color_mode', ', dk, color_mode, zoom_bucket', ', dk, color_mode', '']))} FROM vz),
lad AS (SELECT *, CASE WHEN z AND n0 >= 5 THEN m0 WHEN n1 >= 5 THEN m1 WHEN z AND n2 >= 5 THEN m2 WHEN n3 >= 5 THEN m3 ELSE m4 END AS med,
  CASE WHEN z AND n0 >= 5 THEN 0 WHEN n1 >= 5 THEN CASE WHEN z THEN 1 ELSE 0 END WHEN z AND n2 >= 5 THEN 2 WHEN n3 >= 5 THEN CASE WHEN z THEN 3 ELSE 1 END ELSE CASE WHEN z THEN 4 ELSE 2 END END AS level FROM lad0)
"""


@query(_VIDEO_LADDER + 'SELECT "primary", round(med, 1) AS v3_median, level AS v3_level FROM lad')
def video_medians(spark: SparkSession, d: str) -> DataFrame:
    """A3: medians of videos; slow motion doesn't count in them but gets one."""
    return _video_medians(spark, d).select("primary", "v3_median", F.col("level").alias("v3_level"))


def _photo_flags(spark: SparkSession, d: str) -> DataFrame:
    r = _photo_medians(spark, d)
    exposure = flags.exposure_flags(F.col("brightness"), F.col("entropy"), F.col("clip_high"), F.col("clip_low"), F.col("screenshot"), F.col("hdr"))
    blur = flags.blur_flag(F.col("sharp"), F.col("median"), F.col("screenshot"))
    return r.withColumn("flags", flags.listed(*exposure, blur, flags.eye_flag(F.col("eyes_closed_n"), F.lit(None).cast("int"), F.col("screenshot"))))


_PHOTO_FLAGS = _PHOTO_LADDER.rstrip() + """, flagged AS (SELECT *, list_filter([
  CASE WHEN NOT coalesce(screenshot, false) AND NOT coalesce(hdr, false) AND (brightness < 10 OR brightness > 245 OR entropy < 2.0) THEN 'R1' END,
  CASE WHEN NOT coalesce(screenshot, false) AND NOT coalesce(hdr, false) AND clip_high > 0.4 THEN 'R3-high' END,
  CASE WHEN NOT coalesce(screenshot, false) AND NOT coalesce(hdr, false) AND clip_low > 0.4 THEN 'R3-low' END,
  CASE WHEN NOT coalesce(screenshot, false) AND coalesce(sharp, 0) < med * 0.3 THEN 'R2' END,
  CASE WHEN NOT coalesce(screenshot, false) AND eyes_closed_n > 0 THEN 'EYE' END], lambda x: x IS NOT NULL) AS fl FROM lad)
"""


@query(_PHOTO_FLAGS + """SELECT "primary", array_to_string(fl, ',') AS flags FROM flagged""")
def photo_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of stills in their fixed order."""
    return _photo_flags(spark, d).select("primary", F.array_join("flags", ",").alias("flags"))


@query(_PHOTO_FLAGS + "SELECT flag, count(*) AS n FROM (SELECT unnest(fl) AS flag FROM flagged) GROUP BY flag")
def flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each flag is set."""
    return _photo_flags(spark, d).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_STILLS}, x AS (SELECT "primary" AS p, NOT coalesce(screenshot, false) AS free, eyes_closed_n AS c, CASE WHEN subject_open_n = 0 THEN 1 ELSE 0 END AS h, coalesce(eyes_closed_n, 0) + coalesce(subject_open_n, 0) > 2 AS rel FROM stills)
SELECT p AS "primary", array_to_string(list_filter([CASE WHEN free AND c > 0 THEN 'EYE' WHEN free AND h > 0 THEN 'EYE-half' END, CASE WHEN rel THEN 'EYE-rel' END], lambda f: f IS NOT NULL), ',') AS flags FROM x"""
)
def eye_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of eyes; the table has no half-closed eyes, so photos without an open one stand in, and none relative, so the number of faces does."""
    r = stills(spark, d, "screenshot", "eyes_closed_n", "subject_open_n")
    half = F.when(F.col("subject_open_n") == 0, 1).otherwise(0)
    many = F.when(F.coalesce("eyes_closed_n", F.lit(0)) + F.coalesce("subject_open_n", F.lit(0)) > 2, 1).otherwise(0)
    return r.select("primary", F.array_join(flags.listed(flags.eye_flag(F.col("eyes_closed_n"), half, F.col("screenshot")), flags.relative_eye_flag(many)), ",").alias("flags"))


def _video_flags(spark: SparkSession, d: str) -> DataFrame:
    r = _video_medians(spark, d)
    return r.withColumn("flags", flags.video_flags(*[F.col(c) for c in ("duration", "brightness", "clip_high", "clip_low", "sharp", "v3_median", "shake", "slowmo_factor", "hdr", "color_mode", "device")]))


_SHARE = "NOT dim AND len(list_filter(coalesce({c}, []), lambda x: {p})) / greatest(len(coalesce({c}, [])), 1) >= 0.6"
_VIDEO_FLAGS = _VIDEO_LADDER.rstrip() + f""", dimmed AS (SELECT *, coalesce(color_mode = 'ilog', false) OR coalesce(hdr, false) OR (NOT coalesce(device = 'Insta360 Luna Ultra', false) AND color_mode IS NULL) AS dim FROM lad),
vflagged AS (SELECT *, list_filter([CASE WHEN duration < 2.0 THEN 'V1' END,
  CASE WHEN {_SHARE.format(c='brightness', p='x < 10 OR x > 245')} THEN 'V5' END,
  CASE WHEN {_SHARE.format(c='clip_high', p='x > 0.4')} THEN 'V4-high' END,
  CASE WHEN {_SHARE.format(c='clip_low', p='x > 0.4')} THEN 'V4-low' END,
  CASE WHEN sharp < round(med, 1) * 0.3 THEN 'V3' END,
  CASE WHEN slowmo_factor IS NULL AND shake > 1.0 THEN 'V2-hint' END], lambda x: x IS NOT NULL) AS fl FROM dimmed)
"""


@query(_VIDEO_FLAGS + """SELECT "primary", array_to_string(fl, ',') AS flags FROM vflagged""")
def video_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of videos."""
    return _video_flags(spark, d).select("primary", F.array_join("flags", ",").alias("flags"))


# Clusters -----------------------------------------------------------------------------------------------------------

_BAD_PHOTO, _BAD_VIDEO = ["R1", "R3-high", "R3-low"], ["V1", "V3", "V4-high", "V4-low", "V5"]


def _photo_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = stills(spark, d, "device", "scene", "subtype", "time", "phash", "flags", "subject_open_n", "eyes_closed_n", "sharp_p90")
    rows = rows.withColumns({"device_key": m.device_key(F.col("device")), "bits": hash_bits(F.col("phash")), "node": F.col("primary")})
    components = component_labels(clusters.photo_edges(rows, ["root"]))
    labelled = clusters.label_clusters(rows, components, ["root"], ["device_key", "subtype"], "D")
    sharp = F.when(valid_number("sharp_p90"), F.col("sharp_p90")).otherwise(0.0)
    order = [-F.coalesce("subject_open_n", F.lit(0)), F.coalesce("eyes_closed_n", F.lit(0)), -sharp, F.col("time").isNull(), F.col("time")]
    return clusters.keeper(labelled, ["root", "dup_group"], _BAD_PHOTO, order)


_PHOTO_CLUSTERS = f"""WITH RECURSIVE {_STILLS}, ph AS (SELECT *, {_DEV} AS dk, ('0x' || lower(phash))::UBIGINT AS h FROM stills WHERE phash IS NOT NULL),
edges AS (SELECT a."primary" AS a, b."primary" AS b FROM ph a JOIN ph b ON a.root = b.root AND a.dk = b.dk AND a.subtype = b.subtype AND a."primary" <> b."primary"
  WHERE bit_count(xor(a.h, b.h)) <= 6 OR (a.scene IS NOT DISTINCT FROM b.scene AND abs(a."time" - b."time") < 3 AND bit_count(xor(a.h, b.h)) <= 12)),
reach AS (SELECT DISTINCT a AS p, a AS q FROM edges UNION SELECT r.p, e.b FROM reach r JOIN edges e ON r.q = e.a),
comp AS (SELECT p, min(q) AS label FROM reach GROUP BY p),
lab AS (SELECT label, root, dk, subtype, count(*) AS dup_size FROM comp JOIN ph ON p = "primary" GROUP BY ALL),
named AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY dk, subtype, label) AS k FROM lab),
clustered AS (SELECT ph.*, 'D' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INT, '0') AS grp, n.dup_size AS size FROM comp JOIN ph ON p = ph."primary" JOIN named n USING (label)),
kept AS (SELECT root, grp, "primary" AS keep FROM (SELECT root, grp, "primary", row_number() OVER (PARTITION BY root, grp ORDER BY coalesce(list_has_any(flags, ['R1', 'R3-high', 'R3-low']), false),
  coalesce(subject_open_n, 0) DESC, coalesce(eyes_closed_n, 0), coalesce({_OKNUM.format(c='sharp_p90')}, 0) DESC, "time" NULLS LAST, "primary") AS k FROM clustered) WHERE k = 1)
"""


@query(_PHOTO_CLUSTERS + 'SELECT root, "primary", grp AS dup_group, size AS dup_size, keep AS suggested_keep FROM clustered JOIN kept USING (root, grp)')
def photo_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate stills, their labels and suggested keepers."""
    return _photo_clusters(spark, d).select("root", "primary", "dup_group", "dup_size", "suggested_keep")


@query(
    _PHOTO_CLUSTERS
    + """SELECT root, grp AS dup_group, max(size) AS dup_size, round(coalesce(max("time") - min("time"), 0), 3) AS dup_span_s,
  coalesce((SELECT max(bit_count(xor(x.h, y.h))) FROM clustered x JOIN clustered y ON x.root = y.root AND x.grp = y.grp WHERE x.root = c.root AND x.grp = c.grp), 0) AS dup_maxdist,
  max(size) >= 6 OR coalesce((SELECT max(bit_count(xor(x.h, y.h))) FROM clustered x JOIN clustered y ON x.root = y.root AND x.grp = y.grp WHERE x.root = c.root AND x.grp = c.grp), 0) > 12 AS dup_loose
FROM clustered c GROUP BY root, grp"""
)
def cluster_spread(spark: SparkSession, d: str) -> DataFrame:
    """Span and greatest distance of each cluster, and whether it is loose."""
    return clusters.cluster_spread(_photo_clusters(spark, d), ["root", "dup_group"])


def _video_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = _video_flags(spark, d).withColumns({"node": F.col("primary"), "bits": F.transform("phashes", lambda x: hash_bits(x))})
    components = component_labels(clusters.video_edges(rows, ["root"]))
    labelled = clusters.label_clusters(rows, components, ["root"], [], "VD")
    order = [-F.coalesce("sharp", F.lit(0.0)), -F.coalesce("duration", F.lit(0.0))]
    return clusters.keeper(labelled, ["root", "dup_group"], _BAD_VIDEO, order)


_VIDEO_CLUSTERS = _VIDEO_FLAGS.replace("WITH videos", "WITH RECURSIVE videos").rstrip() + f""", vh AS (SELECT *, list_transform(phashes, lambda x: ('0x' || lower(x))::UBIGINT) AS hs FROM vflagged WHERE len(phashes) > 0),
edges AS (SELECT a."primary" AS a, b."primary" AS b FROM vh a JOIN vh b ON a.root = b.root AND len(a.hs) = len(b.hs) AND a."primary" <> b."primary"
  WHERE abs(a.duration - b.duration) <= 0.2 * greatest(a.duration, b.duration) AND list_sum(list_transform(list_zip(a.hs, b.hs), lambda z: bit_count(xor(z[1], z[2])))) <= 6 * len(a.hs)),
reach AS (SELECT DISTINCT a AS p, a AS q FROM edges UNION SELECT r.p, e.b FROM reach r JOIN edges e ON r.q = e.a),
comp AS (SELECT p, min(q) AS label FROM reach GROUP BY p),
lab AS (SELECT label, root, count(*) AS dup_size FROM comp JOIN vh ON p = "primary" GROUP BY ALL),
named AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY label) AS k FROM lab),
clustered AS (SELECT vh.*, 'VD' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INT, '0') AS grp, n.dup_size AS size FROM comp JOIN vh ON p = vh."primary" JOIN named n USING (label)),
kept AS (SELECT root, grp, "primary" AS keep FROM (SELECT root, grp, "primary", row_number() OVER (PARTITION BY root, grp ORDER BY coalesce(list_has_any(fl, ['V1', 'V3', 'V4-high', 'V4-low', 'V5']), false),
  coalesce(sharp, 0) DESC, coalesce(duration, 0) DESC, "primary") AS k FROM clustered) WHERE k = 1)
"""


@query(_VIDEO_CLUSTERS + 'SELECT root, "primary", grp AS dup_group, size AS dup_size, keep AS suggested_keep FROM clustered JOIN kept USING (root, grp)')
def video_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate videos."""
    return _video_clusters(spark, d).select("root", "primary", "dup_group", "dup_size", "suggested_keep")


_CROSS = f"""WITH {_STILLS}, ph AS (SELECT *, ('0x' || lower(phash))::UBIGINT AS h FROM stills WHERE phash IS NOT NULL AND "time" IS NOT NULL),
pairs AS (SELECT a."primary" AS a, b."primary" AS b FROM ph a JOIN ph b ON a.root = b.root AND a.scene IS NOT DISTINCT FROM b.scene AND a.subtype = 'IMG' AND b.subtype = 'LIV'
  WHERE abs(a."time" - b."time") <= 5 AND bit_count(xor(a.h, b.h)) <= 12)
"""


def _cross(spark: SparkSession, d: str) -> DataFrame:
    rows = stills(spark, d, "scene", "subtype", "time", "phash").withColumn("bits", hash_bits(F.col("phash")))
    return clusters.cross_similar(rows, ["root"])


@query(_CROSS + """SELECT p AS "primary", array_to_string(list_sort(list(o)), '|') AS similar_cross FROM (SELECT a AS p, b AS o FROM pairs UNION SELECT b, a FROM pairs) GROUP BY p""")
def cross_similar(spark: SparkSession, d: str) -> DataFrame:
    """Plain and live photos of one moment, noted on both sides."""
    return clusters.similar_lists(_cross(spark, d)).select("primary", F.array_join("similar_cross", "|").alias("similar_cross"))


@query(_CROSS + "SELECT count(*) AS n_pairs FROM pairs")
def cross_pair_count(spark: SparkSession, d: str) -> DataFrame:
    """The number of such pairs, half the sum of the lists' sizes."""
    lists = clusters.similar_lists(_cross(spark, d))
    return lists.agg((F.coalesce(F.sum(F.size("similar_cross")), F.lit(0)) / 2).cast("bigint").alias("n_pairs"))


# Files --------------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    """All known files once: primaries of scan and paths of the manifest."""
    paths = table(spark, d, "scan").select(F.col("primary").alias("path")).unionByName(table(spark, d, "file_manifest").select("path"))
    return catalog.with_keys(paths.where("path IS NOT NULL").distinct())


_FILES = f"""WITH paths AS (SELECT "primary" AS path FROM scan WHERE "primary" IS NOT NULL UNION SELECT path FROM file_manifest WHERE path IS NOT NULL),
files AS (SELECT path, {_cls('path')} AS cls, {_ext('path')} AS ext, {_stem('path')} AS stem, {_parent('path')} AS parent FROM paths)
"""


@query(_FILES + "SELECT path, cls, ext, stem, parent FROM files")
def classify_files(spark: SparkSession, d: str) -> DataFrame:
    """Class, extension, stem and folder of every file."""
    p = F.col("path")
    return _files(spark, d).select("path", "cls", m.ext_of(p).alias("ext"), m.stem_of(p).alias("stem"), "parent")


@query(_FILES + "SELECT cls, ext, count(*) AS n FROM files GROUP BY cls, ext")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files per class and extension."""
    return _files(spark, d).groupBy("cls", m.ext_of(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _FILES
    + """SELECT parent, lower(stem) AS stem_l, count_if(cls = 'image') AS n_images, count_if(cls = 'raw') AS n_raws,
  CASE WHEN count_if(cls = 'image') > 0 AND count_if(cls = 'raw') > 0 THEN 'mixed' WHEN count_if(cls = 'image') > 0 THEN 'image_only' ELSE 'raw_only' END AS shape
FROM files WHERE cls IN ('image', 'raw') GROUP BY ALL"""
)
def folder_groups(spark: SparkSession, d: str) -> DataFrame:
    """Images and raw files of one stem in one folder."""
    return catalog.folder_groups(_files(spark, d), [])


@query(_FILES + """, prim AS (SELECT parent, lower(stem) AS s, min(path) AS p FROM files WHERE cls IN ('image', 'raw', 'video') GROUP BY ALL)
SELECT f.path, p AS "primary", CASE WHEN p IS NULL THEN 'orphan' ELSE 'companion' END AS role FROM files f LEFT JOIN prim ON f.parent = prim.parent AND lower(f.stem) = prim.s WHERE cls IN ('sidecar', 'proxy')""")
def companions_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Sidecars and proxies given to the file of their stem; the rest are orphans."""
    f = _files(spark, d)
    held, lost = catalog.attach(f.where(F.col("cls").isin("image", "raw", "video")), f.where(F.col("cls").isin("sidecar", "proxy")), ["parent", "stem_l"])
    return held.select("path", "primary", F.lit("companion").alias("role")).unionByName(lost.select("path", F.lit(None).cast("string").alias("primary"), F.lit("orphan").alias("role")))


@query(
    f"""WITH {_ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY root, device, scene ORDER BY "primary") AS k FROM items WHERE subtype = 'IMG'),
b AS (SELECT *, row_number() OVER (PARTITION BY root, device, scene ORDER BY "primary") AS k FROM items WHERE subtype = 'LIV')
SELECT a."primary" AS img, b."primary" AS liv FROM a JOIN b ON a.root = b.root AND a.device IS NOT DISTINCT FROM b.device AND a.scene IS NOT DISTINCT FROM b.scene AND a.k = b.k"""
)
def greedy_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """The k-th plain photo of a device and scene with its k-th live photo."""
    i = items(spark, d, "device", "scene", "subtype")
    got = catalog.greedy_match(i.where("subtype = 'IMG'"), i.where("subtype = 'LIV'"), ["root", "device", "scene"], ["primary"], ["primary"])
    return got.select(F.col("primary").alias("img"), F.col("match.primary").alias("liv"))


@query(
    f"""WITH f AS (SELECT DISTINCT path, {_ext('path')} AS ext, size, md5, {_cls('path')} <> 'image' AS raw FROM file_manifest WHERE path IS NOT NULL AND size IS NOT NULL AND md5 IS NOT NULL)
SELECT ext, size, md5, arg_min(path, (raw, path)) AS keeper, count(*) AS n_copies FROM f GROUP BY ext, size, md5 HAVING count(*) > 1"""
)
def backup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Files of equal extension, size and MD5, and which one stays."""
    f = table(spark, d, "file_manifest").where("path IS NOT NULL").select("path", m.ext_of(F.col("path")).alias("ext"), "size", "md5").distinct()
    return catalog.backup_groups(f.withColumns({"cls": m.classify(F.col("path")), "mixed": F.lit(False)}), ["ext", "size"], "md5")


@query(
    """WITH RECURSIVE f AS (SELECT DISTINCT parent || '/' || lower(stem) AS g, md5 FROM file_manifest WHERE parent IS NOT NULL AND stem IS NOT NULL),
e AS (SELECT DISTINCT a.g AS a, b.g AS b FROM f a JOIN f b ON a.md5 = b.md5 AND a.md5 <> ''),
r AS (SELECT g AS p, g AS q FROM f UNION SELECT r.p, e.b FROM r JOIN e ON r.q = e.a)
SELECT p AS grp, min(q) AS merged FROM r GROUP BY p"""
)
def merged_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of files that share content, merged transitively."""
    f = table(spark, d, "file_manifest").where("parent IS NOT NULL AND stem IS NOT NULL").select(F.concat("parent", F.lit("/"), F.lower("stem")).alias("grp"), "md5")
    return catalog.merge_by_shared_id(f, "grp", "md5")


@query(f"""WITH {_ITEMS} SELECT root, count(*) AS n_files FROM (SELECT DISTINCT root, "primary", unnest(list_append(coalesce(companions, []), "primary")) AS path FROM items) GROUP BY root""")
def physical_files(spark: SparkSession, d: str) -> DataFrame:
    """Physical files per library: primaries and companions, each once per item."""
    return catalog.expand_files(items(spark, d, "companions")).groupBy("root").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"""WITH {_ITEMS} SELECT "primary", path FROM (SELECT DISTINCT "primary", unnest(list_append(coalesce(companions, []), "primary")) AS path FROM items) WHERE path NOT IN (SELECT path FROM file_manifest WHERE path IS NOT NULL UNION SELECT "primary" FROM scan) OR path IS NULL""")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of items that neither the manifest nor the scan knows."""
    return planning.missing_files(catalog.expand_files(items(spark, d, "companions")), _files(spark, d))


@query(f"""WITH {_ITEMS} SELECT "primary", coalesce(list_filter(companions, lambda x: {_ext('x')} = '.lrv' OR upper({_NAME.format(p='x')}) LIKE 'LRV\\_%' ESCAPE '\\')[1], "primary") AS source,
  array_to_string(list_transform(range(6), lambda i: (round(duration * (i + 0.5) / 6.0, 4))::DECIMAL(18, 4)::VARCHAR), ' ') AS frames_s FROM items WHERE kind = 'video' AND duration > 0""")
def video_sources(spark: SparkSession, d: str) -> DataFrame:
    """What each video is analysed from, and at which seconds."""
    v = items(spark, d, "kind", "companions", "duration").where("kind = 'video' AND duration > 0")
    times = F.array_join(F.transform(m.frame_times(F.col("duration"), digits=4), lambda x: x.cast("decimal(18,4)").cast("string")), " ")
    return v.select("primary", m.source_choice(F.col("primary"), F.col("companions")).alias("source"), times.alias("frames_s"))


_ZOOM = "CASE WHEN focal35 IS NOT NULL AND focal35 <> 0 THEN CASE WHEN device = 'Insta360 Luna Ultra' THEN CASE WHEN abs(focal35 - 20) <= 2 THEN 'w' WHEN abs(focal35 - 60) <= 6 THEN 't' WHEN focal35 <= 40 THEN 'wide' WHEN focal35 <= 150 THEN 'tele' ELSE 'digital' END WHEN focal35 <= 40 THEN 'wide' WHEN focal35 <= 105 THEN 'mid' ELSE 'tele' END END"


@query(
    f"""WITH {_ITEMS}, z AS (SELECT "primary", focal35, CASE WHEN seq % 2 = 0 THEN 'Insta360 Luna Ultra' ELSE device END AS device, CASE seq % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 0.0 END AS ratio FROM items), b AS (SELECT *, coalesce(nullif(ratio, 0), 1.0) AS r, focal35 / coalesce(nullif(ratio, 0), 1.0) AS base FROM z)
SELECT "primary", CASE WHEN focal35 <> 0 THEN CASE WHEN device = 'Insta360 Luna Ultra' THEN CASE WHEN abs(base - 20) <= 2 THEN CASE WHEN r > 1.05 THEN 'w_crop' ELSE 'w' END WHEN abs(base - 60) <= 6 THEN CASE WHEN r > 1.05 THEN 't_crop' ELSE 't' END WHEN focal35 <= 40 THEN 'wide' WHEN focal35 <= 150 THEN 'tele' ELSE 'digital' END
  WHEN focal35 <= 40 THEN 'wide' WHEN focal35 <= 105 THEN 'mid' ELSE 'tele' END END AS zoom FROM b"""
)
def zoom_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Lens classes by focal length, ratio and camera; every second item is taken as the vendor's, ratios go by the item's number."""
    ratio = F.when(F.pmod("seq", F.lit(3)) == 0, 2.0).when(F.pmod("seq", F.lit(3)) == 1, 0.0)
    device = F.when(F.pmod("seq", F.lit(2)) == 0, VENDOR_DEVICE).otherwise(F.col("device"))
    return items(spark, d, "focal35", "device", "seq").select("primary", m.zoom_bucket(F.col("focal35"), ratio, device).alias("zoom"))


@query(
    f"""WITH {_ITEMS}, n AS (SELECT "primary" AS p, seq, width, ['x.jpg', 'a_SCREENSHOT.jpg', 'Screen Shot 1.tif', '截屏1.jpg', '屏幕快照.jpg', '屏幕截图2.jpg', 'y.PNG', 'z.heic'][seq % 8 + 1] AS name, seq % 5 = 0 AS noted, seq % 3 = 0 AS bare FROM items WHERE seq >= 0)
SELECT p AS "primary", contains(lower(name), 'screenshot') OR contains(lower(name), 'screen shot') OR contains(name, '截屏') OR contains(name, '屏幕快照') OR contains(name, '屏幕截图') OR noted OR (name = 'y.PNG' AND bare) AS shot, seq % 11 = 0 OR (coalesce(width, 0) > 0 AND seq % 2 = 0) AS pano FROM n"""
)
def special_photos(spark: SparkSession, d: str) -> DataFrame:
    """Screenshots by each of their rules and panoramas by either, on names and tags that go by the item's number."""
    i = items(spark, d, "seq", "width").where("seq >= 0")
    names = F.array(*[F.lit(x) for x in ("x.jpg", "a_SCREENSHOT.jpg", "Screen Shot 1.tif", "截屏1.jpg", "屏幕快照.jpg", "屏幕截图2.jpg", "y.PNG", "z.heic")])
    by = lambda n: F.pmod("seq", F.lit(n))
    shot = m.is_screenshot(F.get(names, by(8)), F.when(by(5) == 0, "Screenshot").otherwise("none"), F.when(by(3) == 0, "").otherwise("maker"))
    side = F.when(F.coalesce(F.col("width"), F.lit(0)) > 0, F.when(by(2) == 0, 8000).otherwise(5998))
    return i.select("primary", shot.alias("shot"), m.is_pano(F.when(by(11) == 0, "Equirectangular"), side, F.floor(side / 2).cast("int")).alias("pano"))


@query(
    f"""WITH {_ITEMS} SELECT "primary", width IS NOT NULL AND height IS NOT NULL AND least(width, height) > 0 AND greatest(width, height) >= 6000 AND greatest(width, height) / least(width, height) BETWEEN 1.95 AND 2.05 AS pano,
  coalesce(lower({_NAME.format(p=_P)}) LIKE '%screenshot%', false) AS shot FROM items"""
)
def panoramas_screenshots(spark: SparkSession, d: str) -> DataFrame:
    """Panoramas by shape, screenshots by name."""
    none = F.lit(None).cast("string")
    return items(spark, d, "width", "height").select("primary", m.is_pano(none, F.col("width"), F.col("height")).alias("pano"), m.is_screenshot(F.col("primary"), none, F.lit("known")).alias("shot"))


@query(
    f"""WITH {_ITEMS}, o AS (SELECT root, "primary", gps.lat AS a, gps.lon AS o, lag(gps.lat) OVER w AS pa, lag(gps.lon) OVER w AS po FROM items WHERE gps IS NOT NULL AND "time" IS NOT NULL WINDOW w AS (PARTITION BY root ORDER BY "time", "primary"))
SELECT "primary", round({_FAR}, 1) AS moved_m FROM o WHERE pa IS NOT NULL"""
)
def moved_metres(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle distance from the item before."""
    rows = items(spark, d, "gps", "time").where("gps IS NOT NULL AND time IS NOT NULL")
    rows = carried_last(rows, ["root"], [F.col("time"), F.col("primary")], F.expr(_DAY), "gps", "before").where("before IS NOT NULL")
    return rows.select("primary", F.round(m.haversine(F.col("gps.lat"), F.col("gps.lon"), F.col("before.lat"), F.col("before.lon")), 1).alias("moved_m"))


# Planning -----------------------------------------------------------------------------------------------------------


def _plan(spark: SparkSession, d: str) -> DataFrame:
    """The latest revision of each entry, numbered."""
    return current_rows(table(spark, d, "plan"), "primary", "planned_at", ["tier", "reason", "keep"]).withColumn("ord", F.col("primary"))


def _dups(spark: SparkSession, d: str) -> DataFrame:
    return planning.dup_index([current_rows(table(spark, d, t), "primary", "run_at", ["dup_group"]) for t in ("analysis", "video_analysis")])


_PLAN_SQL = f"""WITH plans AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "primary" ORDER BY planned_at DESC, keep, reason, tier) AS rn FROM plan WHERE "primary" IS NOT NULL) WHERE rn = 1),
known AS (SELECT DISTINCT nfc_normalize("primary") AS k FROM scan),
dups AS (SELECT k, max(g) AS g FROM (SELECT nfc_normalize("primary") AS k, dup_group AS g FROM {_CUR.format(t='analysis', w='')} UNION ALL SELECT nfc_normalize("primary"), dup_group FROM {_CUR.format(t='video_analysis', w='')}) WHERE g IS NOT NULL GROUP BY k),
lost AS (SELECT path FROM (SELECT DISTINCT path FROM (SELECT "primary" AS path FROM scan UNION ALL SELECT path FROM file_manifest) WHERE path IS NOT NULL) f WHERE {_cls('path')} IN ('sidecar', 'proxy')
  AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {_parent('q')} AS a, lower({_stem('q')}) AS b FROM (SELECT "primary" AS q FROM scan UNION ALL SELECT path FROM file_manifest) WHERE q IS NOT NULL AND {_cls('q')} IN ('image', 'raw', 'video')) k WHERE k.a = {_parent('f.path')} AND k.b = lower({_stem('f.path')}))),
pl AS (SELECT nfc_normalize("primary") AS p, tier, coalesce(reason, '') AS reason, nullif(nfc_normalize(keep), '') AS keep, row_number() OVER (PARTITION BY nfc_normalize("primary") ORDER BY "primary") AS nth FROM plans),
x AS (SELECT pl.*, k1.k IS NOT NULL AS known, k2.k IS NOT NULL AS keep_known, d1.g AS g1, d2.g AS g2, coalesce(tier IN ('00', '01', '02', '03'), false) AS tier_ok,
  keep IN (SELECT p FROM pl WHERE tier = '00') AS keep_deleted
  FROM pl LEFT JOIN known k1 ON p = k1.k LEFT JOIN known k2 ON keep = k2.k LEFT JOIN dups d1 ON p = d1.k LEFT JOIN dups d2 ON keep = d2.k),
broken AS (
  SELECT 'proxy' AS rule, p, '' AS detail FROM x WHERE {_cls('p')} = 'proxy' OR p IN (SELECT path FROM lost)
  UNION ALL SELECT 'primary_missing', NULL, '' FROM plan WHERE "primary" IS NULL OR nfc_normalize("primary") = ''
  UNION ALL SELECT 'sidecar', p, '' FROM x WHERE {_ext('p')} IN ('.xmp', '.aae', '.thm', '.nksc')
  UNION ALL SELECT 'unknown', p, '' FROM x WHERE NOT known
  UNION ALL SELECT 'repeated', p, '' FROM x WHERE known AND nth > 1
  UNION ALL SELECT 'tier', p, coalesce(tier, '') FROM x WHERE known AND NOT tier_ok
  UNION ALL SELECT 'reason_delete', p, reason FROM x WHERE known AND tier = '00' AND reason NOT IN ({', '.join(repr(r) for r in DELETE_REASONS)})
  UNION ALL SELECT 'reason_review', p, reason FROM x WHERE known AND tier = '01' AND NOT starts_with(reason, '复核-')
  UNION ALL SELECT 'reason_text', p, reason FROM x WHERE known AND tier_ok AND reason <> '' AND NOT regexp_full_match(reason, '[A-Za-z0-9一-鿿-]{{1,20}}')
  UNION ALL SELECT 'keep_missing', p, '' FROM x WHERE known AND tier_ok AND reason = '{DUPLICATE_REASON}' AND keep IS NULL
  UNION ALL SELECT 'keep_unknown', p, keep FROM x WHERE known AND tier_ok AND reason = '{DUPLICATE_REASON}' AND keep IS NOT NULL AND NOT keep_known
  UNION ALL SELECT 'keep_kind', p, keep FROM x WHERE known AND tier_ok AND reason = '{DUPLICATE_REASON}' AND keep_known AND starts_with(g1, 'VD') <> starts_with(g2, 'VD')
  UNION ALL SELECT 'keep_group', p, keep FROM x WHERE known AND tier_ok AND reason = '{DUPLICATE_REASON}' AND keep_known AND (g1 IS NULL OR g2 IS NULL OR (starts_with(g1, 'VD') = starts_with(g2, 'VD') AND g1 <> g2))
  UNION ALL SELECT 'keep_deleted', p, keep FROM x WHERE known AND tier_ok AND reason = '{DUPLICATE_REASON}' AND keep_known AND keep_deleted
  UNION ALL SELECT 'not_planned', k, '' FROM known WHERE k NOT IN (SELECT p FROM pl))
"""


def _broken(spark: SparkSession, d: str) -> DataFrame:
    scan = table(spark, d, "scan").select("primary")
    # Entries without a primary have no revisions; each is judged.
    nameless = table(spark, d, "plan").where("primary IS NULL").select("primary", "tier", "reason", "keep").withColumn("ord", F.lit(None).cast("string"))
    f = _files(spark, d)
    _, lost = catalog.attach(f.where(F.col("cls").isin("image", "raw", "video")), f.where(F.col("cls").isin("sidecar", "proxy")), ["parent", "stem_l"])
    plan = _plan(spark, d).select("primary", "tier", "reason", "keep", "ord").unionByName(nameless)
    return planning.validate_plan(plan, scan, _dups(spark, d), orphans=lost, order=["ord"], nfc=nfc)


@query(_PLAN_SQL + 'SELECT rule, p AS "primary", detail FROM broken')
def validate_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every broken rule of the plan."""
    return _broken(spark, d)


@query(_PLAN_SQL + "SELECT rule, count(*) AS n FROM broken GROUP BY rule")
def broken_rules(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule is broken."""
    return _broken(spark, d).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_PLANS = """plans AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "primary" ORDER BY planned_at DESC, keep, reason, tier) AS rn FROM plan WHERE "primary" IS NOT NULL) WHERE rn = 1)"""
_FILE_SIZES = f"""fs AS (SELECT path, max(size) AS size FROM file_manifest WHERE path IS NOT NULL GROUP BY path), ex AS (SELECT DISTINCT "primary" AS p, unnest(list_append(coalesce(companions, []), "primary")) AS path FROM items), exs AS (SELECT p, count(*) AS f, coalesce(sum(size), 0) AS b FROM ex LEFT JOIN fs USING (path) GROUP BY p)"""


@query(f"""WITH {_ITEMS}, {_PLANS}, {_FILE_SIZES} SELECT tier, count(*) AS n_entries, coalesce(sum(f), 0)::BIGINT AS n_files, coalesce(sum(b), 0)::BIGINT AS n_bytes FROM plans LEFT JOIN exs ON p = "primary" GROUP BY tier""")
def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Entries, files and bytes per tier."""
    sizes = table(spark, d, "file_manifest").where("path IS NOT NULL").groupBy("path").agg(F.max("size").alias("size"))
    files = catalog.expand_files(items(spark, d, "companions")).select("primary", "path").join(sizes, "path", "left")
    return planning.tier_rollup(_plan(spark, d), files)


@query(f"WITH {_PLANS} SELECT tier, reason, count(*) AS n FROM plans WHERE reason IS NOT NULL GROUP BY tier, reason")
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Reasons per tier."""
    return _plan(spark, d).where("reason IS NOT NULL").groupBy("tier", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_PLANS}, r AS (SELECT tier, "primary", row_number() OVER (PARTITION BY tier ORDER BY "primary") AS rank, count(*) OVER (PARTITION BY tier) AS c FROM plans)
SELECT tier, "primary", rank, greatest(c - 10, 0) AS n_more FROM r WHERE rank <= 10"""
)
def top10_per_tier(spark: SparkSession, d: str) -> DataFrame:
    """O3: the first ten entries of each tier, and how many more there are."""
    return planning.top_per_group(_plan(spark, d), ["tier"], ["primary"], 10).select("tier", "primary", "rank", "n_more")


@query(
    f"""WITH {_STILLS}, r AS (SELECT root, scene, "primary", row_number() OVER (PARTITION BY root, scene ORDER BY coalesce({_OKNUM.format(c='sharp_p90')}, 0) DESC, "primary") AS rank, count(*) OVER (PARTITION BY root, scene) AS c FROM stills WHERE scene IS NOT NULL)
SELECT root, scene, "primary", rank FROM r WHERE rank <= CASE WHEN c > 50 THEN 5 ELSE 3 END"""
)
def curated_per_scene(spark: SparkSession, d: str) -> DataFrame:
    """The three sharpest of each scene, five of a large one."""
    r = stills(spark, d, "scene", "sharp_p90").where("scene IS NOT NULL").withColumn("sharp", F.when(valid_number("sharp_p90"), F.col("sharp_p90")).otherwise(0.0))
    return planning.curated_limit(r, ["root", "scene"], [F.col("sharp").desc(), "primary"]).select("root", "scene", "primary", "rank")


def _moves(spark: SparkSession, d: str) -> DataFrame:
    known = catalog.expand_files(items(spark, d, "companions")).select("primary", "path")
    plan = _plan(spark, d).where(F.col("tier").isin("00", "01", "02", "03")).select("primary", "tier", "reason")
    return planning.destinations(catalog.with_shadows(known.join(plan, "primary"), table(spark, d, "file_manifest")), _files(spark, d))


_DST = """CASE tier WHEN '00' THEN '00_待删除' WHEN '01' THEN '01_待复核' WHEN '02' THEN '02_优秀' ELSE '03_普通' END || '/' || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' ELSE '' END
  || CASE tier WHEN '00' THEN coalesce(reason, '') || '__' WHEN '01' THEN regexp_replace(coalesce(reason, ''), '复核-', '') || '__' ELSE '' END || regexp_extract(path, '([^/]*)$', 1)"""


@query(f"""WITH {_ITEMS}, {_PLANS}, ex AS (SELECT DISTINCT "primary", unnest(list_append(coalesce(companions, []), "primary")) AS path FROM items) SELECT e."primary", path, '' AS suffix, {_DST} AS dst FROM ex e JOIN plans USING ("primary") WHERE tier IN ('00', '01', '02', '03') AND path IS NOT NULL""")
def planned_moves(spark: SparkSession, d: str) -> DataFrame:
    """Where each file of a planned item goes (no target exists yet, so no suffix is needed)."""
    return _moves(spark, d).where("path IS NOT NULL").select("primary", "path", "suffix", "dst")


@query(f"""WITH {_ITEMS}, {_PLANS}, ex AS (SELECT DISTINCT "primary", unnest(list_append(coalesce(companions, []), "primary")) AS path FROM items), mv AS (SELECT {_DST} AS dst FROM ex e JOIN plans USING ("primary") WHERE tier IN ('00', '01', '02', '03') AND path IS NOT NULL) SELECT dst, count(*) AS n FROM mv GROUP BY dst HAVING count(*) > 1""")
def colliding_moves(spark: SparkSession, d: str) -> DataFrame:
    """Destinations that more than one planned file has."""
    return planning.colliding(_moves(spark, d).where("path IS NOT NULL"))


# Ledger: events read as a log of moves -----------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    """One batch per user and day, a move per event; its type sets the record's state."""
    e = table(spark, d, "events")
    day = F.date_format("ts", "yyyyMMdd")
    state = F.when(F.pmod("event_id", F.lit(97)) == 0, "undone").when(F.pmod("event_id", F.lit(3)) == 0, "done").otherwise("pending")
    seq = F.floor(F.col("event_id") / 3)
    path = F.concat(F.lit("f/"), seq.cast("string"))
    moved = state == "pending"
    return e.select(F.concat_ws("-", F.pmod("user_id", F.lit(50)).cast("string"), day).alias("batch"), F.when(state != "undone", seq).alias("seq"), F.when(moved, path).alias("src"), F.when(moved, F.concat(F.lit("to/"), path)).alias("dst"), state.alias("state"), F.col("event_id").alias("ord"))


_LOG = """WITH log AS (SELECT (user_id % 50)::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS batch, CASE WHEN event_id % 97 = 0 THEN 'undone' WHEN event_id % 3 = 0 THEN 'done' ELSE 'pending' END AS state, event_id // 3 AS sq, event_id AS ord FROM events),
open AS (SELECT batch, min(ord) AS first_ord FROM log GROUP BY batch HAVING NOT bool_or(state = 'undone'))
"""


@query(_LOG + "SELECT batch, first_ord FROM open")
def open_batches(spark: SparkSession, d: str) -> DataFrame:
    """L1: batches that weren't undone."""
    return ledger.open_batches(_log(spark, d))


@query(
    _LOG
    + """, ex AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'f/' ELSE 'to/f/' END || (event_id // 3)::VARCHAR AS path FROM events),
mv AS (SELECT l.batch, sq AS seq, 'f/' || sq::VARCHAR AS src, 'to/f/' || sq::VARCHAR AS dst, EXISTS (SELECT 1 FROM log x WHERE x.batch = l.batch AND x.sq = l.sq AND x.state = 'done') AS done FROM log l JOIN open USING (batch) WHERE l.state = 'pending'),
ac AS (SELECT *, src IN (SELECT path FROM ex) AS s, dst IN (SELECT path FROM ex) AS d FROM mv)
SELECT batch, seq, src, dst, CASE WHEN d AND NOT s THEN 'restore' WHEN done AND d AND s THEN 'conflict_both' WHEN NOT done AND s THEN 'skip' ELSE 'conflict_none' END AS action FROM ac"""
)
def undo_actions(spark: SparkSession, d: str) -> DataFrame:
    """What undoing does with each recorded move."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 3).cast("string").alias("k"), F.pmod("event_id", F.lit(2)).alias("odd"))
    exists = e.select(F.concat(F.when(F.col("odd") == 0, "f/").otherwise("to/f/"), "k").alias("path"))
    return ledger.undo_actions(_log(spark, d), exists).select("batch", "seq", "src", "dst", "action")


@query(_FILES + """, fol AS (SELECT DISTINCT parent FROM files WHERE parent <> '') SELECT parent AS path, len(string_split(parent, '/')) AS depth FROM fol WHERE parent NOT IN (SELECT parent FROM files WHERE cls = 'image') AND NOT EXISTS (SELECT 1 FROM files f WHERE cls = 'image' AND starts_with(f.parent, fol.parent || '/'))""")
def folders_without_images(spark: SparkSession, d: str) -> DataFrame:
    """Folders that would be empty without their images' neighbours, with their depth."""
    f = _files(spark, d)
    return ledger.empty_folders(f.where("parent <> ''").select(F.col("parent").alias("path")).distinct(), f.where("cls = 'image'").select("path"))


# Reports ------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_ITEMS} SELECT root, count_if(kind IN ('image', 'raw')) AS photos, count_if(kind = 'image' AND live) AS live, count_if(kind = 'raw') AS raw_only, count_if(kind IN ('image', 'raw') AND screenshot) AS screenshots,
  count_if(kind = 'video') AS videos, count_if(kind = 'video' AND slowmo_factor IS NOT NULL) AS slow_motion, min("time") AS first_s, max("time") AS last_s, count(DISTINCT scene) AS scenes FROM items GROUP BY root"""
)
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts, span and scenes per library."""
    photo = F.col("kind").isin("image", "raw")
    return items(spark, d, "kind", "live", "screenshot", "slowmo_factor", "time", "scene").groupBy("root").agg(
        F.count_if(photo).alias("photos"),
        F.count_if((F.col("kind") == "image") & F.col("live")).alias("live"),
        F.count_if(F.col("kind") == "raw").alias("raw_only"),
        F.count_if(photo & F.col("screenshot")).alias("screenshots"),
        F.count_if(F.col("kind") == "video").alias("videos"),
        F.count_if((F.col("kind") == "video") & F.col("slowmo_factor").isNotNull()).alias("slow_motion"),
        F.min("time").alias("first_s"),
        F.max("time").alias("last_s"),
        F.count_distinct("scene").alias("scenes"),
    )


@query(
    f"""WITH {_ITEMS} SELECT coalesce(nullif(trim(device), ''), '(unknown)') AS device, count_if(kind IN ('image', 'raw')) AS photos, count_if(kind = 'raw') AS raw_only, coalesce(sum(len(companions)), 0)::BIGINT AS companions, min("time") AS first_s, max("time") AS last_s FROM items GROUP BY 1"""
)
def device_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts and span per device."""
    return items(spark, d, "device", "kind", "companions", "time").groupBy(F.coalesce(known("device"), F.lit("(unknown)")).alias("device")).agg(
        F.count_if(F.col("kind").isin("image", "raw")).alias("photos"), F.count_if(F.col("kind") == "raw").alias("raw_only"), F.coalesce(F.sum(F.size("companions")), F.lit(0)).alias("companions"), F.min("time").alias("first_s"), F.max("time").alias("last_s")
    )


@query(f"""WITH {_ITEMS} SELECT {_parent(_P)} AS folder, count(DISTINCT coalesce(nullif(trim(device), ''), '(unknown)')) AS n_devices FROM items WHERE kind IN ('image', 'raw') GROUP BY 1 HAVING count(DISTINCT coalesce(nullif(trim(device), ''), '(unknown)')) > 1""")
def multi_device_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders with photos of more than one device."""
    photos = items(spark, d, "kind", "device").where(F.col("kind").isin("image", "raw"))
    return photos.groupBy(m.parent_of(F.col("primary")).alias("folder")).agg(F.count_distinct(F.coalesce(known("device"), F.lit("(unknown)"))).alias("n_devices")).where("n_devices > 1")


@query(f"""WITH {_ITEMS} SELECT zoom_bucket, count(*) AS n FROM items WHERE kind IN ('image', 'raw') AND zoom_bucket <> '' GROUP BY zoom_bucket ORDER BY n DESC, zoom_bucket""")
def zoom_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Lens classes by frequency."""
    photos = items(spark, d, "kind", "zoom_bucket").where(F.col("kind").isin("image", "raw") & (F.col("zoom_bucket") != ""))
    return photos.groupBy("zoom_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "zoom_bucket")


@query(f"""WITH {_ITEMS} SELECT min(focal35) AS least, quantile_cont(focal35, 0.5) AS middle, max(focal35) AS most, count_if(focal35 IS NULL) AS n_null FROM items WHERE kind IN ('image', 'raw')""")
def focal_stats(spark: SparkSession, d: str) -> DataFrame:
    """Focal lengths."""
    photos = items(spark, d, "kind", "focal35").where(F.col("kind").isin("image", "raw"))
    return photos.agg(F.min("focal35").alias("least"), F.percentile("focal35", 0.5).alias("middle"), F.max("focal35").alias("most"), F.count_if(F.col("focal35").isNull()).alias("n_null"))


@query(
    f"""WITH {_ITEMS}, b AS (SELECT root, round_even(("time" - epoch(run_at)) / 900.0, 0) * 900 AS off FROM items WHERE "time" IS NOT NULL AND abs("time" - epoch(run_at)) > 60), c AS (SELECT root, off, count(*) AS n FROM b GROUP BY ALL)
SELECT root, sum(n)::BIGINT AS n_warnings, sum(n) >= 3 AND max(n) >= 0.8 * sum(n) AS zone_hint FROM c GROUP BY root"""
)
def offset_mode_share(spark: SparkSession, d: str) -> DataFrame:
    """Whether most clock differences of a library fall on one quarter of an hour."""
    off = F.col("time") - F.unix_micros("run_at") / 1e6
    b = current_rows(table(spark, d, "scan"), "primary", "run_at", ["root", "time", "run_at"]).where(F.col("time").isNotNull() & (F.abs(off) > CONFIG.clock_warn_s)).groupBy("root", (F.rint(off / 900.0) * 900).alias("off")).agg(F.count(F.lit(1)).alias("n"))
    return b.groupBy("root").agg(F.sum("n").alias("n_warnings"), ((F.sum("n") >= 3) & (F.max("n") >= 0.8 * F.sum("n"))).alias("zone_hint"))


@query(f"""WITH {_VIDEOS} SELECT CASE WHEN slowmo_factor IS NOT NULL THEN 'slow' ELSE coalesce(color_mode, '(none)') END AS pool, count(shake) AS n, min(shake) AS least, max(shake) AS most, round(quantile_cont(shake, 0.5), 4) AS middle FROM videos WHERE shake IS NOT NULL AND NOT isnan(shake) GROUP BY 1""")
def shake_stats(spark: SparkSession, d: str) -> DataFrame:
    """Shake per colour mode, slow motion pooled."""
    pool = F.when(F.col("slowmo_factor").isNotNull(), "slow").otherwise(F.coalesce("color_mode", F.lit("(none)")))
    v = videos(spark, d, "slowmo_factor", "color_mode", "shake").where(F.col("shake").isNotNull() & ~F.isnan("shake")).groupBy(pool.alias("pool"), "shake").agg(F.count(F.lit(1)).alias("c"))
    middle = selected_percentile(v, ["pool"], "shake", "c").select("pool", F.round("percentile", 4).alias("middle"))
    return v.groupBy("pool").agg(F.sum("c").alias("n"), F.min("shake").alias("least"), F.max("shake").alias("most")).join(middle, "pool")


@query(f"WITH {_VIDEOS} SELECT color_mode, hdr, count(*) AS n FROM videos GROUP BY color_mode, hdr")
def video_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Colour modes and HDR."""
    return videos(spark, d, "color_mode", "hdr").groupBy("color_mode", "hdr").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_VIDEOS} SELECT "primary", round(list_aggregate(brightness, 'median'), 1) AS middle FROM videos WHERE len(brightness) > 0""")
def frame_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median brightness over a video's frames."""
    return videos(spark, d, "brightness").where(F.size("brightness") > 0).select("primary", m.array_median(F.col("brightness")).alias("middle"))


@query(f"""WITH {_VIDEOS} SELECT "primary", round(quantile_cont(b, 0.9), 4) AS p90 FROM (SELECT "primary", unnest(brightness) AS b FROM videos) GROUP BY "primary" """)
def frame_p90(spark: SparkSession, d: str) -> DataFrame:
    """The interpolated 90th percentile over frames."""
    return videos(spark, d, "brightness").select("primary", F.explode("brightness").alias("b")).groupBy("primary").agg(F.round(F.percentile("b", 0.9), 4).alias("p90"))


@query(f"""WITH {_ITEMS}, c AS (SELECT root, coalesce(zoom_bucket, '') AS z, count(*) AS n FROM items GROUP BY ALL), s AS (SELECT root, n / sum(n) OVER (PARTITION BY root) AS p FROM c) SELECT root, round(-sum(p * log2(p)), 6) + 0.0 AS bits FROM s GROUP BY root""")
def shannon_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the lens classes of each library."""
    c = items(spark, d, "zoom_bucket").groupBy("root", F.coalesce("zoom_bucket", F.lit("")).alias("z")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("root"))
    return c.withColumn("p", p).groupBy("root").agg((F.round(-F.sum(F.col("p") * F.log2("p")), 6) + 0.0).alias("bits"))


@query("SELECT path, CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0) WHEN size = 0 THEN '0 B' ELSE printf('%.1f KB', size / 1024.0) END AS human FROM (SELECT DISTINCT path, size FROM file_manifest WHERE size IS NOT NULL)")
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes for people."""
    return table(spark, d, "file_manifest").where("size IS NOT NULL").select("path", "size").distinct().select("path", m.human_size(F.col("size")).alias("human"))


@query(f"""WITH {_ITEMS}, w AS (SELECT root, min(width) AS least FROM items WHERE kind = 'video' AND width > 0 GROUP BY root) SELECT "primary", least(1280, coalesce(least, 1280)) AS width FROM items LEFT JOIN w USING (root) WHERE kind = 'video'""")
def analysis_width(spark: SparkSession, d: str) -> DataFrame:
    """One analysis width per library, the least of its videos'."""
    v = items(spark, d, "kind", "width").where("kind = 'video'")
    least = v.groupBy(F.col("root").alias("of")).agg(F.min(F.when(F.col("width") > 0, F.col("width"))).alias("least"))
    return v.join(least, F.col("root").eqNullSafe(F.col("of"))).select("primary", F.least(F.lit(CONFIG.analysis_px), F.coalesce("least", F.lit(CONFIG.analysis_px))).alias("width"))


# Pixels and eyes: embeddings read as scores and grey levels --------------------------------------------------------


@query(
    """WITH e AS (SELECT vec_id, abs(embedding[1])::DOUBLE * 3 AS l, abs(embedding[2])::DOUBLE * 3 AS r, abs(embedding[3])::DOUBLE * 4 AS sq, abs(embedding[4])::DOUBLE * 4 AS sm, embedding[5]::DOUBLE * 2 AS yaw FROM embeddings),
s AS (SELECT *, CASE WHEN abs(yaw) > 0.55 OR vec_id % 50 + 20 < 30 OR vec_id % 17 = 0 THEN 'unsure' WHEN l >= 0.5 AND r >= 0.5 THEN 'closed' WHEN l >= 0.5 OR r >= 0.5 OR (l >= 0.35 AND r >= 0.35) THEN 'half' ELSE 'open' END AS raw FROM e)
SELECT vec_id, CASE WHEN raw = 'closed' AND sm >= 0.4 AND sq >= 0.4 THEN 'half' WHEN raw = 'half' AND sm >= 0.4 AND sq >= 0.4 THEN 'open' ELSE raw END AS eye_state FROM s"""
)
def eye_states(spark: SparkSession, d: str) -> DataFrame:
    """M7: eye states decided on scores."""
    x = lambda i, k: F.abs(F.col("embedding")[i].cast("double")) * k
    state = eyes.eye_state(x(0, 3), x(1, 3), x(2, 4), x(3, 4), F.col("embedding")[4].cast("double") * 2, F.pmod("vec_id", F.lit(50)) + 20, F.lit(1000.0), F.pmod("vec_id", F.lit(17)) == 0)
    return table(spark, d, "embeddings").select("vec_id", state.getField("eye_state").alias("eye_state"))


def embedded_images(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 images made of embeddings."""
    levels = F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod(F.floor((x.cast("double") + 1) * 128).cast("bigint"), F.lit(256))), 2, "0"))
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.array_join(levels, "")).alias("data"))


def image_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures of such images, for image_statistics and image_hashes."""
    return pixels.image_measures(embedded_images(spark, d))


@query(
    """WITH s AS (SELECT vec_id, w, i, embedding[w * 20 + i + 1]::DOUBLE AS dx, embedding[w * 20 + i + 2]::DOUBLE AS dy FROM embeddings, range(3) t(w), range(20) u(i)),
a AS (SELECT vec_id, w, dx - lag(dx) OVER (PARTITION BY vec_id, w ORDER BY i) AS ax, dy - lag(dy) OVER (PARTITION BY vec_id, w ORDER BY i) AS ay FROM s),
m AS (SELECT vec_id, w, avg(sqrt(ax * ax + ay * ay)) AS v FROM a GROUP BY ALL) SELECT vec_id AS video, round(quantile_cont(v, 0.5), 3) AS shake FROM m GROUP BY vec_id"""
)
def shake_scores(spark: SparkSession, d: str) -> DataFrame:
    """Shake from shifts."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("video"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("window")).select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    at = F.col("window") * 20 + F.col("i")
    return pixels.shake_score(e.select("video", "window", "i", F.get("embedding", at).cast("double").alias("dx"), F.get("embedding", at + 1).cast("double").alias("dy")))
