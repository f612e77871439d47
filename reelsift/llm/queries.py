"""Queries p1, p2, p3, p7, p8, p9 and p10, each with its SQL where SQL can do it over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.llm import leaks, lookalikes, mixture, nearest, percentiles, spans, survivor
from reelsift.operators.current import current_rows, finite, known, valid_number
from reelsift.plans.tables import table


def _stills(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return current_rows(table(spark, d, "analysis"), "primary", "run_at", columns)


def _videos(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return current_rows(table(spark, d, "video_analysis"), "primary", "run_at", columns)


# p1 ---------------------------------------------------------------------------------------------------------------


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of look-alike stills and of look-alike videos."""
    return lookalikes.lookalike_groups(_stills(spark, d, ["root", "device", "subtype", "phash"]), _videos(spark, d, ["root", "duration", "phashes", "error"]))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size of each group, by its key."""
    return p1_found(spark, d).groupBy("group_key").agg(F.count(F.lit(1)).alias("n_records"))


_CURRENT = """{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "primary" ORDER BY run_at DESC) AS rn FROM {table}) WHERE rn = 1)"""
_STILLS, _VIDEOS, _ITEMS = (_CURRENT.format(name=n, table=t) for n, t in (("stills", "analysis"), ("videos", "video_analysis"), ("items", "scan")))

# Labels spread along edges until they don't change: recursion over (record, least label so far) with UNION.
_P1_SQL = f"""
WITH RECURSIVE {_STILLS}, {_VIDEOS},
s AS (SELECT "primary" AS p, root, coalesce(nullif(trim(device), ''), '') AS dev, subtype, ('0x' || lower(phash))::UBIGINT AS h FROM stills WHERE phash IS NOT NULL),
v AS (SELECT "primary" AS p, root, duration, list_transform(phashes, lambda x: ('0x' || lower(x))::UBIGINT) AS hs FROM videos WHERE error IS NULL AND len(phashes) > 0),
edges AS (
  SELECT a.p AS a, b.p AS b FROM s a JOIN s b ON a.root = b.root AND a.dev = b.dev AND a.subtype = b.subtype AND a.p <> b.p AND bit_count(xor(a.h, b.h)) <= 6
  UNION ALL SELECT a.p, b.p FROM v a JOIN v b ON a.root = b.root AND len(a.hs) = len(b.hs) AND a.p <> b.p
    AND abs(a.duration - b.duration) <= 0.2 * greatest(a.duration, b.duration)
    AND list_sum(list_transform(list_zip(a.hs, b.hs), lambda z: bit_count(xor(z[1], z[2])))) <= 6 * len(a.hs)),
reach AS (SELECT DISTINCT a AS p, a AS q FROM edges UNION SELECT r.p, e.b FROM reach r JOIN edges e ON r.q = e.a),
found AS (SELECT min(q) AS group_key, p AS "primary" FROM reach GROUP BY p)
"""


# p2 ---------------------------------------------------------------------------------------------------------------

SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
LEAST_GROUP, OFF = 25, 0.2
_GROUP = ["tbl", "device", "grp"]


def _measures(spark: SparkSession, d: str) -> DataFrame:
    stills = _stills(spark, d, ["device", "subtype", "sharp_p90", "r2_median", "run_at"]).select(F.lit("analysis").alias("tbl"), known("device").alias("device"), F.col("subtype").alias("grp"), F.col("sharp_p90").alias("x"), F.col("r2_median").alias("stored"), "run_at")
    videos = (
        _videos(spark, d, ["device", "color_mode", "slowmo_factor", "median_sharp", "v3_median", "run_at"])
        .where("slowmo_factor IS NULL AND color_mode IS NOT NULL")
        .select(F.lit("video_analysis").alias("tbl"), known("device").alias("device"), F.col("color_mode").alias("grp"), F.col("median_sharp").alias("x"), F.col("v3_median").alias("stored"), "run_at")
    )
    return stills.unionByName(videos).where(F.col("device").isNotNull() & valid_number("x"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at least 25 values whose stored median is off by more than 20 % of the true one."""
    rows = _measures(spark, d)
    true = percentiles.percentiles(percentiles.cells(rows, _GROUP, "x"), _GROUP, {"p50": 0.5})
    stored = rows.where("stored IS NOT NULL").groupBy(*_GROUP).agg(F.max("stored").alias("stored"))
    both = true.where(F.col("n_values") >= LEAST_GROUP).join(stored, _GROUP)
    return both.where(F.abs(F.col("stored") - F.col("p50")) > OFF * F.abs(F.col("p50"))).select(*_GROUP)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of sharpness per group."""
    exact = percentiles.percentiles(percentiles.cells(_measures(spark, d), _GROUP, "x"), _GROUP, SHARES)
    return exact.select(*_GROUP, "n_values", *[F.round(n, 6).alias(n) for n in SHARES])


def p2_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from states of months, made apart with cells of 32 bits and combined, held against the exact ones.

    within_bound: each is off by at most 2 ** -20 of its size.
    """
    rows = _measures(spark, d)
    states = [percentiles.state(rows.where(F.pmod(F.coalesce(F.month("run_at"), F.lit(0)), F.lit(3)) == part), _GROUP, "x", digits=2) for part in range(3)]
    near = percentiles.percentiles(percentiles.combine(states, _GROUP), _GROUP, SHARES, digits=2)
    exact = percentiles.percentiles(percentiles.cells(rows, _GROUP, "x"), _GROUP, SHARES).select(*_GROUP, *[F.col(n).alias(f"{n}_exact") for n in SHARES])
    off = [F.abs(F.col(n) - F.col(f"{n}_exact")) <= F.col(f"{n}_exact") * 2.0**-20 for n in SHARES]
    ok = off[0]
    for o in off[1:]:
        ok = ok & o
    # Cells are binary fractions, so that some stand just between two decimals.
    return near.join(exact, _GROUP).select(*_GROUP, "n_values", *[F.round(F.col(n) + 1e-8, 6).alias(n) for n in SHARES], ok.alias("within_bound"))


_P2_SQL = f"""
WITH {_STILLS}, {_VIDEOS},
x AS (SELECT 'analysis' AS tbl, nullif(trim(device), '') AS device, subtype AS grp, sharp_p90 AS x, r2_median AS stored FROM stills
  UNION ALL SELECT 'video_analysis', nullif(trim(device), ''), color_mode, median_sharp, v3_median FROM videos WHERE slowmo_factor IS NULL AND color_mode IS NOT NULL),
ok AS (SELECT * FROM x WHERE device IS NOT NULL AND x >= 0 AND NOT isnan(x) AND NOT isinf(x))
"""


# p3 ---------------------------------------------------------------------------------------------------------------

TOLERANCE_S = 5.0


def _pairs_in_time(spark: SparkSession, d: str) -> DataFrame:
    plain = _stills(spark, d, ["device", "subtype", "time"]).where("subtype = 'IMG'").select("primary", known("device").alias("device"), "time")
    live = current_rows(table(spark, d, "scan"), "primary", "run_at", ["device", "subtype", "time"]).where("subtype = 'LIV'").select("primary", known("device").alias("device"), "time")
    return nearest.nearest_in_time(plain, live, "device", "time", "primary", TOLERANCE_S)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Plain photos with the live photo of the device nearest in time."""
    return _pairs_in_time(spark, d).select(F.least("primary", "near_label").alias("primary_a"), F.greatest("primary", "near_label").alias("primary_b"))


def p3_distances(spark: SparkSession, d: str) -> DataFrame:
    """How far apart the matched photos are: matches per tenth of a second."""
    return _pairs_in_time(spark, d).groupBy(F.floor(F.abs(F.col("time") - F.col("near_time")) * 10).alias("tenths")).agg(F.count(F.lit(1)).alias("n"))


_P3_SQL = f"""
WITH {_STILLS}, {_ITEMS},
a AS (SELECT "primary" AS p, trim(device) AS dev, "time" AS t FROM stills WHERE subtype = 'IMG' AND trim(device) <> '' AND "time" IS NOT NULL),
b AS (SELECT "primary" AS q, trim(device) AS dev, "time" AS t FROM items WHERE subtype = 'LIV' AND trim(device) <> '' AND "time" IS NOT NULL),
near AS (SELECT p, q, abs(a.t - b.t) AS dt, row_number() OVER (PARTITION BY p ORDER BY abs(a.t - b.t), q) AS k FROM a JOIN b ON a.dev = b.dev AND b.t BETWEEN a.t - 6 AND a.t + 6 WHERE abs(a.t - b.t) <= 5)
"""


# p7 ---------------------------------------------------------------------------------------------------------------


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The record of each stored group most worth keeping."""
    rows = _stills(spark, d, ["root", "dup_group", "flags", "subject_open_n", "eyes_closed_n", "sharp_p90", "time"])
    dirty = F.coalesce(F.arrays_overlap("flags", F.array(*[F.lit(f) for f in ("R1", "R3-high", "R3-low")])), F.lit(False))
    sharp = F.when(valid_number("sharp_p90"), F.col("sharp_p90")).otherwise(0.0)
    time = finite("time")
    order = [dirty, -F.coalesce("subject_open_n", F.lit(0)), F.coalesce("eyes_closed_n", F.lit(0)), -sharp, time.isNull(), time]
    return survivor.survivors(rows, ["root", "dup_group"], order, "primary").select("root", "dup_group", F.col("survivor").alias("primary"))


FUSED = {"scene": "string", "zoom_bucket": "string", "hdr": "boolean", "eyes_closed_n": "int", "sharp_p90": "double", "suggested_keep": "string"}


def p7_fused(spark: SparkSession, d: str) -> DataFrame:
    """Field values of each stored group fused over its records, each of which is a source; n_sources: records of the group.

    sharp_p90 counts where it is a valid number.  A group whose records have no value of a field gets null there.
    """
    rows = _stills(spark, d, ["root", "dup_group", "time", *FUSED]).where("root IS NOT NULL AND dup_group IS NOT NULL")
    rows = rows.withColumn("sharp_p90", F.when(valid_number("sharp_p90"), F.col("sharp_p90")))
    claims = rows.select(F.to_json(F.array("root", "dup_group")).alias("object"), F.col("primary").alias("source"), finite("time").alias("at"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FUSED])))
    fused = survivor.fuse(claims)
    wide = fused.groupBy("object").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).cast(t).alias(f) for f, t in FUSED.items()], F.round(F.min("posterior"), 6).alias("least_posterior"))
    groups = rows.groupBy("root", "dup_group").agg(F.count(F.lit(1)).alias("n_sources")).withColumn("object", F.to_json(F.array("root", "dup_group")))
    return groups.join(wide, "object", "left").select("root", "dup_group", *FUSED, "least_posterior", "n_sources")


_P7_SQL = f"""
WITH {_STILLS},
r AS (SELECT root, dup_group, "primary", count(*) OVER (PARTITION BY root, dup_group) AS n, row_number() OVER (PARTITION BY root, dup_group ORDER BY
    coalesce(list_has_any(flags, ['R1', 'R3-high', 'R3-low']), false), coalesce(subject_open_n, 0) DESC, coalesce(eyes_closed_n, 0),
    CASE WHEN sharp_p90 >= 0 AND NOT isnan(sharp_p90) AND NOT isinf(sharp_p90) THEN sharp_p90 ELSE 0 END DESC, "time" NULLS LAST, "primary") AS k
  FROM stills WHERE root IS NOT NULL AND dup_group IS NOT NULL)
SELECT root, dup_group, "primary" FROM r WHERE n >= 2 AND k = 1
"""


def _fusion_sql(rounds: int = 4, rare: int = 50) -> str:
    """The rounds of :func:`reelsift.llm.survivor.fuse` with its default rates, one after the other."""
    held = "exp(greatest(least({}, 500.0), -500.0))".format
    likely = lambda x, y: f"(1 / (1 + 9.0 / (0.5 * {held(x)} + 0.5 * {held(y)})))"
    agree = "ln((0.8 + 0.644 * 0.2) / 0.644)"
    parts = [
        f"""{_STILLS}, r AS MATERIALIZED (SELECT *, root || chr(1) || dup_group AS object, CASE WHEN NOT isnan("time") AND NOT isinf("time") THEN "time" END AS tm, CASE WHEN sharp_p90 >= 0 AND NOT isnan(sharp_p90) AND NOT isinf(sharp_p90) THEN sharp_p90 END AS sharp FROM stills WHERE root IS NOT NULL AND dup_group IS NOT NULL),
cl AS MATERIALIZED (SELECT object, "primary" AS source, tm, f.field, f.value FROM (SELECT *, unnest([{", ".join(f"{{'field': {f!r}, 'value': {'sharp' if f == 'sharp_p90' else f}::VARCHAR}}" for f in FUSED)}]) AS f FROM r) WHERE f.value IS NOT NULL),
sg AS (SELECT source, object || chr(2) || string_agg(field || '=' || value, chr(1) ORDER BY field) AS sig FROM cl GROUP BY source, object),
cs AS (SELECT source, min(source) OVER (PARTITION BY sig) AS c FROM sg),
votes AS MATERIALIZED (SELECT object, field, value, c, count(*) AS n, min((tm IS NULL, coalesce(tm, 0), source)) AS late FROM cl JOIN cs USING (source) GROUP BY ALL),
few AS (SELECT object, field, value FROM votes GROUP BY ALL HAVING count(*) BETWEEN 2 AND {rare}),
near AS (SELECT object, field, value, c FROM votes SEMI JOIN few USING (object, field, value)),
pr AS (SELECT DISTINCT x.c AS a, y.c AS b FROM near x JOIN near y USING (object, field, value) WHERE x.c < y.c),
cmp AS MATERIALIZED (SELECT a, b, x.object, x.field, x.value AS va, y.value AS vb, x.late > y.late AS later, x.n AS na, y.n AS nb FROM pr JOIN votes x ON x.c = a JOIN votes y ON y.c = b AND y.object = x.object AND y.field = x.field),
ov AS MATERIALIZED (SELECT a, b, count_if(va = vb) AS ks, count_if(va <> vb) AS kd FROM cmp GROUP BY a, b),
sh AS MATERIALIZED (SELECT object, field, va AS value, a, b, CASE WHEN later THEN a ELSE b END AS c, CASE WHEN later THEN nb ELSE na END AS earlier FROM cmp WHERE va = vb),
dep0 AS MATERIALIZED (SELECT a, b, {likely(f"ks * {agree} + kd * ln(0.2)", f"ks * {agree} + kd * ln(0.2)")} AS dep FROM ov),
src0 AS MATERIALIZED (SELECT c, max(n) AS size, {likely(f"count(*) * {agree}", f"count(*) * {agree}")} AS own, 0.8 AS acc FROM votes GROUP BY c)"""
    ]
    ratio = lambda o: f"(kt * ln(({o} * 0.8 + p * q * 0.2) / (p * q)) + greatest(ks - kt, 0) * ln(((1 - {o}) * 0.8 + (1 - p) * (1 - q) / 10 * 0.2) / ((1 - p) * (1 - q) / 10)))"
    for t in range(rounds):
        parts.append(
            f"""fr{t} AS (SELECT object, field, value, c, exp(sum(earlier * ln(1 - 0.8 * dep))) AS free FROM sh JOIN dep{t} USING (a, b) GROUP BY ALL),
sc{t} AS MATERIALIZED (SELECT object, field, value, round(sum(ln(10 * acc / (1 - acc)) * CASE WHEN size = 1 THEN 1 ELSE (1 - pow(1 - 0.8 * own, size)) / (0.8 * own) END * coalesce(free, 1)), 9) AS score FROM votes JOIN src{t} USING (c) LEFT JOIN fr{t} USING (object, field, value, c) GROUP BY ALL),
tp{t} AS (SELECT object, field, max(score) AS most, count(*) AS k FROM sc{t} GROUP BY ALL),
po{t} AS MATERIALIZED (SELECT object, field, value, exp(score - most) / (sum(exp(score - most)) OVER (PARTITION BY object, field) + greatest(11 - k, 0) * exp(-most)) AS post FROM sc{t} JOIN tp{t} USING (object, field))"""
        )
        if t < rounds - 1:
            parts.append(
                f"""al{t} AS (SELECT c, max(n) AS size, sum(post) AS kt, count(*) AS ks, least(greatest((sum(post) + 1.6) / (count(*) + 2), 0.01), 0.99) AS p FROM votes JOIN po{t} USING (object, field, value) GROUP BY c),
src{t + 1} AS MATERIALIZED (SELECT c, size, {likely(ratio("p"), ratio("p"))} AS own, p AS acc FROM (SELECT *, p AS q FROM al{t})),
bl{t} AS (SELECT a, b, sum(post) AS kt FROM sh JOIN po{t} USING (object, field, value) GROUP BY a, b),
dep{t + 1} AS MATERIALIZED (SELECT a, b, {likely(ratio("p") + " + kd * ln(0.2)", ratio("q") + " + kd * ln(0.2)")} AS dep FROM (SELECT ov.*, bl{t}.kt, x.p, y.p AS q FROM ov JOIN bl{t} USING (a, b) JOIN al{t} x ON x.c = a JOIN al{t} y ON y.c = b))"""
            )
    last = rounds - 1
    # Posteriors within rounding of each other tie.
    parts.append(f"best AS (SELECT object, field, min(value) AS value, max(post) AS post FROM (SELECT *, max(post) OVER (PARTITION BY object, field) AS top FROM po{last}) WHERE post >= top - 1e-12 GROUP BY ALL)")
    wide = ", ".join(f"max(value) FILTER (field = {f!r})::{'DOUBLE' if t == 'double' else t.upper()} AS {f}" for f, t in FUSED.items())
    parts.append(f"wide AS (SELECT object, {wide}, round(min(post), 6) AS least_posterior FROM best GROUP BY object)")
    return "WITH " + ",\n".join(parts) + f" SELECT root, dup_group, {', '.join(f'w.{f}' for f in FUSED)}, least_posterior, n_sources FROM (SELECT root, dup_group, object, count(*) AS n_sources FROM r GROUP BY ALL) g LEFT JOIN wide w USING (object)"


# p8 ---------------------------------------------------------------------------------------------------------------

LEAK_WORDS = 12


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and test items that share at least 12 words in a row."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), window=LEAK_WORDS).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked test items with the number of documents that hold a passage of them, up to two words of twelve edited; shorter items whole."""
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), window=LEAK_WORDS, most_edits=2, recall=0.95, whole_short=True)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("longest").alias("longest_words"), F.sum(F.when(F.col("edits") == 0, 1).otherwise(0)).alias("n_exact"))


_P8_SQL = r"""
WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower("text"), '[\p{L}\p{Nd}]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower("text"), '[\p{L}\p{Nd}]+') FROM eval_items),
g AS (SELECT DISTINCT k, id, array_to_string(ws[p:p + 11], ' ') AS gram FROM (SELECT k, id, ws, unnest(range(1, len(ws) - 10)) AS p FROM w WHERE len(ws) >= 12))
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM g a JOIN g b ON a.gram = b.gram AND a.k = 'd' AND b.k = 'i'
"""


# p9 ---------------------------------------------------------------------------------------------------------------


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: each use of a document with its position in the training run."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached per source."""
    got, plan = mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixture.shares(got, plan)


def _by_chars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), size=F.length("text"))


def p9_mixture_chars(spark: SparkSession, d: str) -> DataFrame:
    """The mixture with sizes in code points, which SQL can count; everything else is as in p9_mixture."""
    return _by_chars(spark, d)[0].withColumn("position", F.round("position", 6))


def p9_shares_chars(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached with sizes in code points."""
    return mixture.shares(*_by_chars(spark, d)).withColumns({"goal_share": F.round("goal_share", 9), "actual_share": F.round("actual_share", 9)})


def p9_scheduled(spark: SparkSession, d: str) -> DataFrame:
    """Shares per tenth of a run whose largest source fades out by the middle, in code points."""
    fading = {"tarnstack": [(0.0, 1.0), (0.5, 0.0), (1.0, 0.0)]}
    got = mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), size=F.length("text"), schedule=fading)[0]
    return got.groupBy(F.least(F.floor(F.round("position", 9) * 10), F.lit(9)).cast("int").alias("tenth"), "source").agg(F.count(F.lit(1)).alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))


_P9_SQL = """
WITH goals AS (SELECT lower(trim(source)) AS source, max(target_share) AS target_share, max(max_repeat) AS max_repeat FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
docs AS (SELECT doc_id, lower(trim(source)) AS source, length("text") AS n, ('0x' || substr(md5('11:' || doc_id::VARCHAR), 1, 15))::BIGINT AS o FROM documents WHERE doc_id IS NOT NULL AND length("text") > 0),
tot AS (SELECT source, sum(n)::BIGINT AS tokens FROM docs JOIN goals USING (source) GROUP BY source),
lv AS (SELECT g.*, coalesce(tokens, 0) AS tokens, coalesce(tokens, 0) > 0 AND target_share > 0 AND max_repeat > 0 AS live FROM goals g LEFT JOIN tot USING (source)),
w AS (SELECT sum(target_share) AS whole, min(max_repeat * tokens / target_share) AS per, sum(target_share * max_repeat) / sum(target_share) AS mean FROM lv WHERE live),
m AS (SELECT max(abs(mean - max_repeat)) AS most FROM lv, w WHERE live),
plans AS (SELECT lv.*, CASE WHEN live THEN target_share / whole ELSE 0 END AS goal_share, CASE WHEN live THEN target_share / whole ELSE 0 END * per * whole AS demand, CASE WHEN live AND most > 0 THEN 0.5 * (mean - max_repeat) / most ELSE 0 END AS slope FROM lv, w, m),
pre AS (SELECT d.*, p.*, coalesce(sum(n) OVER (PARTITION BY d.source ORDER BY o % 1024, o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM docs d JOIN plans p ON d.source = p.source),
cp AS (SELECT *, least(max_repeat, floor((demand - start - n + 1e-6) / tokens) + 1)::BIGINT AS copies FROM pre WHERE demand > 0),
mixed AS (SELECT doc_id, source, n, c AS copy, least((start + (c - 1) * tokens) / demand, 1) AS y, slope FROM (SELECT *, unnest(range(1, copies + 1)) AS c FROM cp WHERE copies >= 1)),
placed AS (SELECT *, CASE WHEN {fade} THEN CASE WHEN y < 1 THEN (1 - sqrt(1 - y)) / 2 ELSE 0.5 END ELSE 2 * y / nullif(1 + slope + sqrt(greatest(pow(1 + slope, 2) - 4 * slope * y, 0)), 0) END AS position FROM mixed)
"""


# p10 --------------------------------------------------------------------------------------------------------------

SPAN = 300
# For whole spans long seeds do, which fewer texts share by chance; edits need short ones.
LONG_SEED = 96


def _spans(spark: SparkSession, d: str, seed: int = LONG_SEED) -> spans.SharedSpans:
    return spans.SharedSpans(table(spark, d, "documents"), span=SPAN, seed=seed)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a span of at least 300 code points that another document holds letter by letter."""
    return _spans(spark, d).found()


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands in such spans."""
    return _spans(spark, d).coverage()


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages that two texts share but for small edits, chained from seeds and aligned; p10_copies has the members of a text."""
    p = _spans(spark, d, spans.K).fuzzy_passages()
    return p.select(F.col("d").alias("doc_id"), F.col("other").alias("other_id"), "from_at", "to_at", "other_from", "other_to", "matched", "longest")


def p10_copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text another one repeats, with the one that stands for them in p10_passages."""
    return _spans(spark, d).copies()


_P10_SQL = """
WITH g AS (SELECT doc_id, p, "text"[p:p + 299] AS gram FROM (SELECT doc_id, "text", unnest(range(1, length("text") - 298)) AS p FROM documents WHERE length("text") >= 300)),
hot AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
places AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM g WHERE gram IN (SELECT gram FROM hot))
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_percentiles": p2_percentiles,
    "p2_combined": p2_combined,
    "p3_found": p3_found,
    "p3_distances": p3_distances,
    "p7_found": p7_found,
    "p7_fused": p7_fused,
    "p8_found": p8_found,
    "p8_leaked_items": p8_leaked_items,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_mixture_chars": p9_mixture_chars,
    "p9_shares_chars": p9_shares_chars,
    "p9_scheduled": p9_scheduled,
    "p10_found": p10_found,
    "p10_coverage": p10_coverage,
    "p10_passages": p10_passages,
    "p10_copies": p10_copies,
}

SQL = {
    "p1_found": _P1_SQL + "SELECT * FROM found",
    "p1_groups": _P1_SQL + "SELECT group_key, count(*) AS n_records FROM found GROUP BY group_key",
    "p2_found": _P2_SQL + "SELECT tbl, device, grp FROM ok GROUP BY ALL HAVING count(*) >= 25 AND abs(max(stored) - median(x)) > 0.2 * median(x)",
    "p2_percentiles": _P2_SQL + "SELECT tbl, device, grp, count(*) AS n_values, " + ", ".join(f"round(quantile_cont(x, {p}), 6) AS {n}" for n, p in SHARES.items()) + " FROM ok GROUP BY ALL",
    # A cell of 32 bits is the value with 20 bits after the first of its mantissa.
    "p2_combined": _P2_SQL
    + ", low AS (SELECT *, CASE WHEN x > 0 THEN floor(x * pow(2, 20 - floor(log2(x)))) * pow(2, floor(log2(x)) - 20) ELSE 0 END AS y FROM ok), q AS (SELECT tbl, device, grp, count(*) AS n_values, "
    + ", ".join(f"quantile_cont(y, {p}) AS {n}, quantile_cont(x, {p}) AS {n}_exact" for n, p in SHARES.items())
    + " FROM low GROUP BY ALL) SELECT tbl, device, grp, n_values, "
    + ", ".join(f"round({n} + 1e-8, 6) AS {n}" for n in SHARES)
    + ", "
    + " AND ".join(f"abs({n} - {n}_exact) <= {n}_exact * pow(2, -20)" for n in SHARES)
    + " AS within_bound FROM q",
    "p3_found": _P3_SQL + "SELECT least(p, q) AS primary_a, greatest(p, q) AS primary_b FROM near WHERE k = 1",
    "p3_distances": _P3_SQL + "SELECT floor(dt * 10)::BIGINT AS tenths, count(*) AS n FROM near WHERE k = 1 GROUP BY 1",
    "p7_found": _P7_SQL,
    "p7_fused": _fusion_sql(),
    "p8_found": _P8_SQL,
    "p9_mixture_chars": _P9_SQL.replace("{fade}", "false") + "SELECT doc_id, source, copy::INT AS copy, n AS n_tokens, round(coalesce(position, 0), 6) AS position FROM placed",
    "p9_shares_chars": _P9_SQL.replace("{fade}", "false")
    + """SELECT p.source, target_share, round(goal_share, 9) AS goal_share, round(coalesce(u / sum(u) OVER (), 0), 9) AS actual_share, coalesce(u, 0)::BIGINT AS used_tokens, coalesce(uses, 0) AS uses, coalesce(nd, 0) AS n_docs, coalesce(most, 0)::INT AS most_repeat, max_repeat
FROM plans p LEFT JOIN (SELECT source, sum(n) AS u, count(*) AS uses, count(DISTINCT doc_id) AS nd, max(copy) AS most FROM placed GROUP BY source) g USING (source)""",
    "p9_scheduled": _P9_SQL.replace("{fade}", "source = 'tarnstack'") + "SELECT least(floor(round(coalesce(position, 0), 9) * 10), 9)::INT AS tenth, source, count(*) AS n_uses, sum(n)::BIGINT AS n_tokens FROM placed GROUP BY ALL",
    "p10_copies": """SELECT doc_id, min(doc_id) OVER (PARTITION BY "text") AS text_id FROM documents WHERE doc_id IS NOT NULL AND length("text") >= 100 QUALIFY count(*) OVER (PARTITION BY "text") > 1""",
    "p10_found": _P10_SQL + "SELECT DISTINCT doc_id FROM places",
    "p10_coverage": _P10_SQL + """SELECT doc_id, n_chars, shared_chars, round(shared_chars / n_chars, 6) AS share FROM (
  SELECT doc_id, max(length(d."text")) AS n_chars, sum(least(coalesce(nxt - p, 300), 300))::BIGINT AS shared_chars FROM places JOIN documents d USING (doc_id) GROUP BY doc_id)""",
}
