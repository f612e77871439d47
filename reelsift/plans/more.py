"""Further queries: times of tags, vendor groups, streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift import schema
from reelsift.functions import media as m
from reelsift.functions import times
from reelsift.operators import catalog, eyes
from reelsift.plans.media import _ITEMS, _cls, _ext, _NAME, _parent, _stem, items
from reelsift.plans.tables import table
from reelsift.shared import shared_dir
from reelsift.streaming.sessions import stream_sessions as sessions_of

_STAMP = "'^([0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})(?:\\.([0-9]{1,6}))?(Z|[+-][0-9]{2}:?[0-9]{2})?$'"


def _parsed(c: str) -> str:
    s = f"trim({c})"
    zone = f"replace(regexp_extract({s}, {_STAMP}, 3), ':', '')"
    secs = f"(substr({zone}, 2, 2)::INT * 3600 + substr({zone}, 4, 2)::INT * 60)"
    off = f"CASE WHEN {zone} IN ('', 'Z') THEN 0 WHEN {zone}[1] = '-' THEN -{secs} ELSE {secs} END"
    return f"CASE WHEN regexp_matches({s}, {_STAMP}) AND NOT starts_with({s}, '0000') THEN epoch_us(try_strptime(regexp_extract({s}, {_STAMP}, 1), '%Y:%m:%d %H:%M:%S')) + rpad(regexp_extract({s}, {_STAMP}, 2), 6, '0')::BIGINT - ({off})::BIGINT * 1000000 END"


def tag_times(spark: SparkSession, d: str) -> DataFrame:
    """The time of the first tag that a camera's layouts fit, and which tag it was; local times taken as UTC."""
    i = items(spark, d, "kind", "SubSecDateTimeOriginal", "CreateDate")
    none = F.lit(None).cast("string")
    t = times.tag_time(F.col("SubSecDateTimeOriginal"), none, none, F.col("CreateDate"), F.col("kind") == "video", F.lit("UTC"))
    return i.select("primary", t.alias("t")).select("primary", F.round(F.col("t.time"), 6).alias("time_s"), F.col("t.source").alias("source"))


def group_keys(spark: SparkSession, d: str) -> DataFrame:
    """What files of one shot have in common, with the size of each group."""
    i = items(spark, d, "companions")
    f = catalog.expand_files(i).where("path IS NOT NULL").select("path").distinct()
    k = m.group_key(F.col("path"))
    return f.groupBy(k.getField("parent").alias("parent"), k.getField("key").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def face_counts(spark: SparkSession, d: str) -> DataFrame:
    """Roll-up of faces; embeddings are read as four faces each."""
    e = table(spark, d, "embeddings")
    side = lambda k: F.abs(F.get("embedding", k)) * 1000 + 5
    faces = e.select("vec_id", "embedding", F.posexplode(F.sequence(F.lit(0), F.lit(3))).alias("i", "f")).select("vec_id", "i", side(F.col("i") * 3).alias("w"), side(F.col("i") * 3 + 1).alias("h"), F.lit(1000.0).alias("short_side"), F.abs(F.get("embedding", F.col("i") * 3 + 2)).alias("blink"))
    judged = eyes.subjects(faces, "vec_id").withColumn("eye_state", F.when(F.col("blink") > 0.2, "closed").when(F.col("blink") > 0.1, "half").otherwise("open"))
    per = judged.groupBy("vec_id").agg(F.collect_list(F.struct("eye_state", "subject")).alias("faces"))
    # Every tenth photo's detector failed: it has no list of faces, which is not an empty one.
    failed = F.pmod("vec_id", F.lit(10)) == 0
    return per.select("vec_id", eyes.face_rollup(F.when(~failed, F.col("faces"))).alias("r")).select("vec_id", "r.*")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions of events as a stream that ends, those that closed before the last event's time."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    # A stream reads folders; a table of one file is picked out of its folder by name.
    path = f"{d}/events.parquet"
    source = spark.readStream.schema(schema.EVENTS).option("recursiveFileLookup", True)
    stream = source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", os.path.basename(path)).parquet(d)
    s = sessions_of(stream.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    q = s.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(s.schema).parquet(f"{folder}/out")
    return out.select("user_id", "first_ts", "last_ts", "n_events")


_DURATIONS = f"""WITH {_ITEMS}, ex AS (SELECT "primary" AS p, duration, unnest(list_append(coalesce(companions, []), "primary")) AS path FROM items)"""

QUERIES = {"tag_times": tag_times, "group_keys": group_keys, "face_counts": face_counts, "stream_sessions": stream_sessions}

_VENDOR = "'(?i)^(IMG|LIV|VID|LRV)_([0-9]{8})_([0-9]{6})_([0-9]+)$'"

SQL = {
    "group_keys": f"""{_DURATIONS}, f AS (SELECT DISTINCT path, {_parent('path')} AS parent, {_stem('path')} AS stem FROM ex WHERE path IS NOT NULL)
SELECT parent, CASE WHEN regexp_matches(stem, {_VENDOR}) THEN regexp_extract(stem, {_VENDOR}, 2) || '_' || regexp_extract(stem, {_VENDOR}, 3) || '_' || regexp_extract(stem, {_VENDOR}, 4) ELSE lower(stem) END AS key, count(*) AS n FROM f GROUP BY ALL""",
    "tag_times": f"""WITH {_ITEMS}, t AS (SELECT "primary", {_parsed('SubSecDateTimeOriginal')} AS a, {_parsed('CreateDate')} AS b FROM items)
SELECT "primary", round(coalesce(a, b) / 1e6, 6) AS time_s, CASE WHEN a IS NOT NULL THEN 'SubSecDateTimeOriginal' WHEN b IS NOT NULL THEN 'CreateDate' END AS source FROM t""",
    "face_counts": """WITH f AS (SELECT vec_id, i, abs(embedding[i * 3 + 1])::DOUBLE AS a, abs(embedding[i * 3 + 2])::DOUBLE AS b, abs(embedding[i * 3 + 3])::FLOAT AS c FROM embeddings, range(4) t(i)),
g AS (SELECT vec_id, (abs(a)::FLOAT * 1000::FLOAT + 5::FLOAT) AS w, (abs(b)::FLOAT * 1000::FLOAT + 5::FLOAT) AS h, CASE WHEN c::DOUBLE > 0.2 THEN 'closed' WHEN c::DOUBLE > 0.1 THEN 'half' ELSE 'open' END AS s FROM f),
j AS (SELECT *, w * h >= 0.25 * max(w * h) OVER (PARTITION BY vec_id) OR h >= 0.08 * 1000.0 AS subject FROM g)
SELECT vec_id, CASE WHEN vec_id % 10 <> 0 THEN count(*)::INT END AS faces_n, CASE WHEN vec_id % 10 <> 0 THEN count_if(subject)::INT END AS subject_faces_n, CASE WHEN vec_id % 10 <> 0 THEN count_if(subject AND s = 'closed')::INT END AS eyes_closed_n, CASE WHEN vec_id % 10 <> 0 THEN count_if(subject AND s = 'half')::INT END AS eyes_half_n, CASE WHEN vec_id % 10 <> 0 THEN count_if(subject AND s = 'open')::INT END AS subject_open_n FROM j GROUP BY vec_id""",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS pts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(CASE WHEN pts IS NULL OR ts - pts > INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
g AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM s GROUP BY user_id, k)
SELECT user_id, first_ts, last_ts, n_events FROM g WHERE last_ts + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events)""",
}

