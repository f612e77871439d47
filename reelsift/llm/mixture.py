"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsift.shared import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 1024


def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER, pattern: str = PATTERN) -> Column:
    """Number of tokens of a text, 0 for a null one.  The vocabulary is read once per task."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(path, pattern)
        for s in batches:
            yield s.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


Schedule = dict[str, list[tuple[float, float]]]


def segments_of(points: list[tuple[float, float]]) -> tuple[list[tuple[float, float, float, float]], float]:
    """((at, weight, rise, before) ..., whole) of a weight that runs straight between ``points`` (progress, weight).

    before is the integral up to a segment's start, whole that over the run.  Before its first and behind its last point a weight stays.
    Weights below 0 and a weight that is 0 throughout are errors.
    """
    points = sorted(((min(max(float(u), 0.0), 1.0), float(w)) for u, w in points), key=lambda x: x[0])
    if not points or any(w < 0 or w != w for _, w in points):
        raise ValueError("a schedule needs points with weights of at least 0")
    points = [(0.0, points[0][1]), *points, (1.0, points[-1][1])]
    out, before = [], 0.0
    for (u, w), (v, x) in zip(points, points[1:]):
        if v > u:
            out.append((u, w, (x - w) / (v - u), before))
            before += (v - u) * (w + x) / 2
    if before <= 0:
        raise ValueError("a schedule's weights must not all be 0")
    return out, before


def mixture_plan(spark: SparkSession, totals: DataFrame, targets: DataFrame, tilt: float, budget: float | None, schedule: Schedule | None = None, most_sources: int = 100_000) -> DataFrame:
    """Per source of ``targets`` its tokens, goal share, demand and curriculum, see :func:`mix`.

    Sources are normalised already.  A source without tokens can't have a share: its goal is 0, and the other goals
    are raised in proportion.  The total is the greatest that all caps allow, or ``budget`` if that is less.
    Targets, one row per source, are computed on the driver; more than ``most_sources`` are an error.
    """
    rows = [r.asDict() for r in targets.join(totals, "source", "left").select("source", "target_share", "max_repeat", F.coalesce("tokens", F.lit(0)).alias("tokens")).limit(most_sources + 1).collect()]
    if len(rows) > most_sources:
        raise ValueError("too many sources in the targets")
    live = [r for r in rows if r["tokens"] > 0 and (r["target_share"] or 0) > 0 and (r["max_repeat"] or 0) > 0]
    whole = sum(r["target_share"] for r in live)
    total = min((r["max_repeat"] * r["tokens"] * whole / r["target_share"] for r in live), default=0.0)
    total = min(total, budget) if budget is not None else total
    mean = sum(r["target_share"] / whole * r["max_repeat"] for r in live) if live else 0.0
    most = max((abs(mean - r["max_repeat"]) for r in live), default=0.0)
    out = []
    for r in sorted(rows, key=lambda r: r["source"]):
        goal = r["target_share"] / whole if r in live else 0.0
        slope = tilt * (mean - r["max_repeat"]) / most if r in live and most else 0.0
        segments, area = segments_of((schedule or {}).get(r["source"]) or [(0.0, 1 + slope), (1.0, 1 - slope)])
        out.append((r["source"], float(r["target_share"] or 0), int(r["max_repeat"] or 0), int(r["tokens"]), goal, goal * total, segments, area))
    return spark.createDataFrame(out, "source string, target_share double, max_repeat int, tokens bigint, goal_share double, demand double, segments array<struct<at: double, weight: double, rise: double, before: double>>, area double")


def random_order(doc_id: Column, seed: int) -> Column:
    """A number of 60 bits by which documents stand in a fixed random order; SQL can compute it, too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), 1, 15), 16, 10).cast("bigint")


def mix(
    documents: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    tilt: float = 0.5,
    budget: float | None = None,
    seed: int = 11,
    tokenizer: str = TOKENIZER,
    pattern: str = PATTERN,
    schedule: Schedule | None = None,
    size: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, plan): which documents are used how often and at which position of the training run.

    mixture has (doc_id, source, copy, n_tokens, position), sorted by position; plan see :func:`mixture_plan`.
    Sources compare trimmed, in lower case; documents of other sources, of a null one, with a null id or without
    tokens aren't used.  ``targets`` (source, target_share, max_repeat): repeated rows of a source count once, the greatest
    share holds.

    A document's size is its number of tokens, or ``size`` if that is given.  A source's documents stand in a fixed random order, epoch after epoch up to
    max_repeat; the prefix whose tokens fit its demand is used, so its share is off by less than one document.

    The curriculum: at progress u of the run a source weighs goal * w(u), and its documents take the positions at which the integral of that has
    grown by as much as their tokens.  ``schedule`` gives w by points (u, w) per normalised source, straight between them; only its course counts, as
    the integral over the run is scaled to the demand.  A source without points has w = 1 + slope * (1 - 2u), where slopes, whose mean over the goals
    is 0, bring sources with few repeats early and those that repeat late; ``tilt`` in [0, 1] is the greatest slope.  The integral is
    inverted in closed form, piece by piece.

    Offsets are prefix sums in two steps, within a random bucket and over the buckets, so that no task gets a whole source.
    """
    norm = F.lower(F.trim(F.col(source)))
    goals = targets.select(norm.alias("source"), "target_share", "max_repeat").where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    used = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), norm.alias("source"), F.col(text).alias("text") if size is None else size.cast("bigint").alias("n_tokens")).join(goals.select("source"), "source", "left_semi")
    sized = materialize(used.select("doc_id", "source", F.col("n_tokens") if size is not None else token_count(F.col("text"), tokenizer, pattern).alias("n_tokens")).where("n_tokens > 0"), "sized")
    spark = documents.sparkSession
    plan = mixture_plan(spark, sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), goals, tilt, budget, schedule)
    keyed = sized.withColumn("o", random_order(F.col("doc_id"), seed)).withColumn("bucket", F.pmod("o", F.lit(BUCKETS)))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).select("source", "bucket", "base")
    inside = Window.partitionBy("source", "bucket").orderBy("o", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, ["source", "bucket"]).join(F.broadcast(plan), "source")
    start = F.col("base") + F.col("inner")
    room = F.floor((F.col("demand") - start - F.col("n_tokens") + 1e-6) / F.col("tokens")) + 1
    copies = F.least(F.col("max_repeat").cast("bigint"), room)
    # How much of the weight's integral is used up at a copy's start; the segment that it falls into; the root of its quadratic, in the form that is stable for small rises.
    r = F.least(F.col("c") / F.col("demand"), F.lit(1.0)) * F.col("area")
    piece = F.element_at(F.filter("segments", lambda x: x["before"] <= F.col("r")), -1)
    left = F.col("r") - F.col("p.before")
    position = F.col("p.at") + F.coalesce(F.try_divide(2 * left, F.col("p.weight") + F.sqrt(F.greatest(F.pow(F.col("p.weight"), 2) + 2 * F.col("p.rise") * left, F.lit(0.0)))), F.lit(0.0))
    mixture = (
        placed.withColumns({"start": start, "copies": copies})
        .where("demand > 0 AND copies >= 1")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .withColumn("c", F.col("start") + (F.col("copy") - 1) * F.col("tokens"))
        .withColumn("r", r)
        .withColumn("p", piece)
        .select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens", F.least(position, F.lit(1.0)).alias("position"))
        .orderBy("position", "doc_id", "copy")
    )
    return mixture, plan


def shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of the plan its target, the share reached, tokens, uses, distinct documents and most repeats."""
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy").alias("most_repeat"), F.sum(F.when(F.col("copy") == 1, 1).otherwise(0)).alias("n_docs"))
    whole = Window.partitionBy()
    out = plan.join(got, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    return out.select(
        "source",
        "target_share",
        "goal_share",
        F.coalesce(F.try_divide("used_tokens", F.sum("used_tokens").over(whole)), F.lit(0.0)).alias("actual_share"),
        "used_tokens",
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("most_repeat", F.lit(0)).alias("most_repeat"),
        "max_repeat",
    )
