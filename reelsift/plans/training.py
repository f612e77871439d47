"""Queries p4, p5 and p6: orphan references, sessions, instants; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.functions.text import nfc
from reelsift.operators.current import current_rows, finite, known
from reelsift.operators.instants import instant_dictionary, known_zone, normalise_instants, offset_zone
from reelsift.operators.references import orphan_references, orphan_report
from reelsift.operators.sessions import sessions
from reelsift.plans.tables import table
from reelsift.shared import shared_dir

GAP_S = 600.0
SLACK_S = 2.0


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    plan, scan, files = (table(spark, d, n) for n in ("plan", "scan", "file_manifest"))
    fields = F.inline(
        F.array(
            F.struct(F.lit("primary").alias("field"), F.col("primary").alias("target")),
            F.struct(F.lit("keep").alias("field"), F.col("keep").alias("target")),
        )
    )
    of_plan = plan.select(F.lit("plan").alias("tbl"), "primary", F.col("planned_at").alias("at"), fields)
    of_scan = scan.select(F.lit("scan").alias("tbl"), "primary", F.col("run_at").alias("at"), F.lit("companions").alias("field"), F.explode("companions").alias("target"))
    refs = (
        of_plan.unionByName(of_scan)
        .where((F.col("target") != "") & F.col("target").isNotNull())
        .withColumns({"target": nfc(F.col("target")), "primary": nfc(F.col("primary"))})
        .withColumn("kind", F.when(F.col("field") == "companions", "file").otherwise("item"))
    )
    parents = scan.select(F.lit("item").alias("kind"), nfc(F.col("primary")).alias("key"), F.col("run_at").alias("start"), F.col("removed_at").alias("end")).unionByName(
        files.select(F.lit("file").alias("kind"), nfc(F.col("path")).alias("key"), F.col("seen_at").alias("start"), F.col("deleted_at").alias("end"))
    )
    return orphan_references(refs, parents)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references that lead nowhere at the time of their row."""
    return _orphans(spark, d).select("tbl", "field", "primary", "target").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, month and status: missing, late or deleted."""
    return orphan_report(_orphans(spark, d), ["tbl", "field"])


_NFC = "nfc_normalize({})".format
_P4_SQL = f"""
WITH refs AS (
  SELECT 'plan' AS tbl, 'primary' AS field, {_NFC('"primary"')} AS "primary", {_NFC('"primary"')} AS target, planned_at AS "at", 'item' AS kind FROM plan WHERE "primary" <> ''
  UNION ALL SELECT 'plan', 'keep', {_NFC('"primary"')}, {_NFC('keep')}, planned_at, 'item' FROM plan WHERE keep <> ''
  UNION ALL SELECT 'scan', 'companions', {_NFC('"primary"')}, {_NFC('c')}, run_at, 'file'
    FROM (SELECT "primary", run_at, unnest(companions) AS c FROM scan) WHERE c <> ''),
parents AS (
  SELECT DISTINCT 'item' AS kind, {_NFC('"primary"')} AS k, run_at AS s, removed_at AS e FROM scan
  UNION SELECT DISTINCT 'file', {_NFC('path')}, seen_at, deleted_at FROM file_manifest),
judged AS (
  SELECT r.*, (SELECT count(*) FROM parents p WHERE p.kind = r.kind AND p.k = r.target) AS n_any,
    (SELECT count(*) FROM parents p WHERE p.kind = r.kind AND p.k = r.target AND p.s <= r."at") AS n_before,
    (SELECT count(*) FROM parents p WHERE p.kind = r.kind AND p.k = r.target AND p.s <= r."at" AND (p.e IS NULL OR p.e > r."at")) AS n_there
  FROM refs r),
orphans AS (SELECT *, CASE WHEN n_any = 0 THEN 'missing' WHEN n_before > 0 THEN 'deleted' ELSE 'late' END AS status FROM judged WHERE n_there = 0)
"""


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Shooting sessions per device with start, end, duration and number of items."""
    cur = current_rows(table(spark, d, "scan"), "primary", "run_at", ["device", "time", "time_end"])
    s = sessions(cur.withColumn("device", known("device")), "device", "time", "time_end", "primary", gap=GAP_S)
    return s.select("device", F.col("start").alias("start_s"), F.col("end").alias("end_s"), F.round("duration", 3).alias("duration_s"), F.col("first_label").alias("first_primary"), F.col("last_label").alias("last_primary"), "n_items")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by their first and last item."""
    return p5_sessions(spark, d).select("device", "first_primary", "last_primary", "n_items")


_CURRENT_SCAN = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "primary" ORDER BY run_at DESC) AS rn FROM scan) WHERE rn = 1)"""
_P5_SQL = f"""
WITH {_CURRENT_SCAN},
x AS (SELECT trim(device) AS device, "primary" AS p, "time" AS t, coalesce(time_end, "time") AS e FROM cur WHERE trim(device) <> '' AND "time" IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY device ORDER BY t, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
z AS (SELECT *, sum(CASE WHEN reach IS NULL OR t - reach > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY t, p ROWS UNBOUNDED PRECEDING) AS s FROM y)
SELECT device, min(t) AS start_s, max(greatest(e, t)) AS end_s, round(max(greatest(e, t)) - min(t), 3) AS duration_s,
  first(p ORDER BY t, p) AS first_primary, last(p ORDER BY t, p) AS last_primary, count(*) AS n_items
FROM z GROUP BY device, s
"""


def instants_of_scan(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """Current rows of scan with ``instant_us``, the UTC instant of their time tags in microseconds; the dictionary is kept at ``path``, if that is given."""
    cur = current_rows(table(spark, d, "scan"), "primary", "run_at", ["root", "kind", "time", "SubSecDateTimeOriginal", "OffsetTimeOriginal", "CreateDate"])
    homes = table(spark, d, "photo_root").where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.col("home_zone")).alias("home_zone"))
    cur = cur.join(homes, "root", "left").withColumn("home", known_zone(spark, F.col("home_zone")))
    return normalise_instants(
        cur,
        [
            ("SubSecDateTimeOriginal", F.col("SubSecDateTimeOriginal"), F.coalesce(offset_zone(F.col("OffsetTimeOriginal")), F.col("home"))),
            ("CreateDate", F.col("CreateDate"), F.when(F.col("kind") == "video", F.lit("UTC")).otherwise(F.col("home"))),
        ],
        path=path,
    )


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every current item with the Unix seconds of its UTC instant (null where no tag is valid) and the difference from its time."""
    i = instants_of_scan(spark, d)
    return i.select("primary", (F.col("instant_us") / 1e6).alias("instant_s"), (F.col("instant_us") / 1e6 - F.col("time")).alias("off_s"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose time is more than two seconds away from the instant of their tags."""
    i = instants_of_scan(spark, d).where(finite("time").isNotNull() & (F.abs(F.col("instant_us") / 1e6 - F.col("time")) > SLACK_S))
    return i.select("primary", F.floor(F.col("instant_us") / 1_000_000).cast("bigint").alias("utc_s"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """As p6_instants, from a dictionary that is kept: a first run has seen half of the tags, of libraries in UTC; the second one parses only what is new."""
    path = f"{shared_dir(spark)}/dictionary-{uuid.uuid4().hex[:12]}"
    tags = table(spark, d, "scan").where("SubSecDateTimeOriginal IS NOT NULL").select(F.lit("SubSecDateTimeOriginal").alias("source"), F.trim("SubSecDateTimeOriginal").alias("raw"), F.lit("UTC").alias("zone"))
    instant_dictionary(tags.where(F.pmod(F.xxhash64("raw"), F.lit(2)) == 0), path)
    return instants_of_scan(spark, d, path).select("primary", (F.col("instant_us") / 1e6).alias("instant_s"))


_ZONE_RE = r"(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|Z|UTC|GMT"


def _offset(text: str) -> str:
    """SQL: the seconds of an offset, null where it is none."""
    o = f"upper(trim({text}))"
    pattern = r"'^(?:UTC|GMT)?([+-])(\d{1,2}?)(?::?(\d{2}))?$'"
    size = f"(regexp_extract({o}, {pattern}, 2)::INT * 3600 + coalesce(try_cast(regexp_extract({o}, {pattern}, 3) AS INT), 0) * 60)"
    return f"CASE WHEN {o} IN ('Z', 'UTC', 'GMT') THEN 0 WHEN regexp_matches({o}, {pattern}) THEN CASE regexp_extract({o}, {pattern}, 1) WHEN '-' THEN -{size} ELSE {size} END END"


# DuckDB takes the second of a repeated local hour, so the hour before is tried and taken if it shows the same clock.
_P6_SQL = rf"""
WITH {_CURRENT_SCAN}, homes AS (SELECT root, min(home_zone) AS hz FROM photo_root GROUP BY root),
c AS (SELECT "primary", "time", 1 AS ord, trim(SubSecDateTimeOriginal) AS s, {_offset('OffsetTimeOriginal')} AS fallback, coalesce(hz, 'UTC') AS z FROM cur LEFT JOIN homes USING (root)
  UNION ALL SELECT "primary", "time", 2, trim(CreateDate), NULL, CASE WHEN kind = 'video' THEN 'UTC' ELSE coalesce(hz, 'UTC') END FROM cur LEFT JOIN homes USING (root)),
t AS (SELECT *, CASE WHEN regexp_matches(s, '^\d{{1,2}} [A-Za-z]{{3}} \d{{4}} ') THEN strftime(try_strptime(regexp_extract(s, '^(\d{{1,2}} [A-Za-z]{{3}} \d{{4}})', 1), '%d %b %Y'), '%Y:%m:%d') || ' ' || regexp_extract(s, '^\d{{1,2}} [A-Za-z]{{3}} \d{{4}} (.*)$', 1)
  ELSE regexp_replace(regexp_replace(s, '^(\d{{4}})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)', '\1:\2:\3 \4:\5:\6'), '^(\d{{4}})-(\d\d)-(\d\d)[T ]', '\1:\2:\3 ') END AS x FROM c),
p AS (SELECT *, CASE WHEN regexp_matches(x, '^\d{{4}}:\d\d:\d\d \d\d:\d\d:[0-5]\d(\.\d+)?\s*({_ZONE_RE})?$') THEN try_strptime(substr(x, 1, 19), '%Y:%m:%d %H:%M:%S') END AS ts,
  rpad(substr(regexp_extract(x, '^.{{19}}\.(\d+)', 1), 1, 6), 6, '0')::BIGINT AS us, {_offset(f"nullif(regexp_extract(x, '^.{{{{19}}}}(?:[.][0-9]+)?[ ]*({_ZONE_RE})$', 1), '')".replace('{{', '{').replace('}}', '}'))} AS own,
  CASE WHEN regexp_matches(s, '^-?\d{{1,17}}(\.\d+)?$') THEN s::DECIMAL(30, 9) END AS num FROM t),
u AS (SELECT *, timezone(z, ts) AS there FROM p),
i AS (SELECT "primary", "time", ord, coalesce(CASE WHEN coalesce(own, fallback) IS NOT NULL THEN epoch_us(ts) - coalesce(own, fallback)::BIGINT * 1000000
    WHEN timezone(z, there - INTERVAL 1 HOUR) = ts THEN epoch_us(there - INTERVAL 1 HOUR) ELSE epoch_us(there) END + us,
  floor(CASE WHEN abs(num) >= 100000000000 THEN num * 1000 ELSE num * 1000000 END)::BIGINT) AS m FROM u),
best AS (SELECT "primary", any_value("time") AS t, arg_min(m, ord) FILTER (m IS NOT NULL) AS m FROM i GROUP BY "primary")
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_sessions": p5_sessions, "p6_found": p6_found, "p6_instants": p6_instants, "p6_kept": p6_kept}

SQL = {
    "p4_found": _P4_SQL + 'SELECT DISTINCT tbl, field, "primary", target FROM orphans',
    "p4_report": _P4_SQL + """SELECT tbl, field, strftime("at" AT TIME ZONE 'UTC', '%Y-%m') AS month, status, count(*) AS n FROM orphans GROUP BY ALL""",
    "p5_found": f"SELECT device, first_primary, last_primary, n_items FROM ({_P5_SQL})",
    "p5_sessions": _P5_SQL,
    "p6_found": _P6_SQL + """SELECT "primary", floor(m / 1e6)::BIGINT AS utc_s FROM best WHERE t IS NOT NULL AND abs(m / 1e6 - t) > 2""",
    "p6_kept": _P6_SQL + """SELECT "primary", m / 1e6 AS instant_s FROM best""",
    "p6_instants": _P6_SQL + """SELECT "primary", m / 1e6 AS instant_s, m / 1e6 - t AS off_s FROM best""",
}
