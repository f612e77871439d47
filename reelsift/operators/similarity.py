"""Links between alike records, by equal buckets instead of a cross join.

Rows begin in one bucket per block.  Buckets of up to ``HOT_BUCKET`` rows are packed, a row each, and compared inside;
a larger one is cut by bands of the hashes: with threshold t a hash has t + 1 bands, and hashes at most t bits
apart agree in one band at least.  Buckets that are still large are cut again by bands of the remaining bits, so that a hot bucket
becomes many small ones and no link is lost.

What comes out are links, not all pairs: a row is linked to the first row of its bucket that it matches, and to others only where they
don't match that one.  So every matching pair is connected, and a dense group of n rows has n - 1 links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.shared import materialize

HOT_BUCKET = 256


def hash_bits(hex_text: Column) -> Column:
    """A hash of 16 hex digits in any letter case as BIGINT; null for other text."""
    ok = hex_text.rlike("^[0-9a-fA-F]{16}$")
    return F.when(ok, F.conv(hex_text, 16, -10)).try_cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Number of different bits of two BIGINTs."""
    return F.bit_count(a.bitwiseXOR(b))


def band_layout(bits: int, bands: int) -> list[tuple[int, int]]:
    """(shift, width) of each of ``bands`` bands over ``bits`` bits, widths as equal as can be."""
    out, at = [], 0
    for i in range(bands):
        width = bits // bands + (i < bits % bands)
        out.append((at, width))
        at += width
    return out


def band(value: str | Column, shift: int, width: int) -> Column:
    """The bits [shift, shift + width) of a BIGINT."""
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def without_band(value: Column, shift: int, width: int) -> Column:
    """The other bits of a BIGINT, moved together."""
    low = value.bitwiseAND(F.lit((1 << shift) - 1).cast("bigint"))
    high = F.shiftleft(F.shiftrightunsigned(value, shift + width), shift) if shift + width < 64 else F.lit(0).cast("bigint")
    return high.bitwiseOR(low)


Match = Callable[[Column, Column], Column]


def block_keys(block: list[str]) -> dict[str, Column]:
    """Two hashes ``g`` and ``g2`` of the block's columns, 128 bits together; nulls are equal to each other."""
    whole = [*[F.col(f"`{c}`") for c in block], *[F.col(f"`{c}`").isNull() for c in block]]
    return {"g": F.xxhash64(*whole), "g2": F.xxhash64(F.lit(17), *whole)}


def bucket_links(rows: DataFrame, bucket: list[str], payload: list[str], match: Match) -> DataFrame:
    """(a, b) inside buckets of bounded size, a < b by ``n``: see the module's text for which of the matching pairs come out."""
    packed = rows.groupBy(*bucket).agg(F.array_sort(F.collect_list(F.struct("n", *payload))).alias("rows")).where(F.size("rows") > 1)
    earlier = lambda y: F.filter("rows", lambda x: (x["n"] < y["n"]) & match(x, y))
    # Wrapped into an array, so that the matches of a row are found once.
    kept = lambda y: F.flatten(F.transform(F.array(earlier(y)), lambda m: F.filter(m, lambda x: (x["n"] == F.get(m, F.lit(0))["n"]) | ~match(x, F.get(m, F.lit(0))))))
    return packed.select(F.inline(F.flatten(F.transform("rows", lambda y: F.transform(kept(y), lambda x: F.struct(x["n"].alias("a"), y["n"].alias("b")))))))


def _crowd_links(rows: DataFrame, bucket: list[str], payload: list[str], match: Match) -> DataFrame:
    """(a, b) of buckets that no cut made small: all rows against the bucket's first one, the rows that don't match it against all."""
    heads = rows.groupBy(*bucket).agg(F.min(F.struct("n", *payload)).alias("head"))
    x = F.struct("n", *payload)
    judged = materialize(rows.join(heads, bucket).select(*bucket, x.alias("x"), F.col("head.n").alias("first"), match(x, F.col("head")).alias("near")), "crowd")
    near = judged.where("near AND x.n <> first").select(F.col("first").alias("a"), F.col("x.n").alias("b"))
    far = judged.where("NOT near").select(*bucket, F.col("x").alias("y"))
    rest = far.join(judged.select(*bucket, "x", "near"), bucket).where((F.col("near") | (F.col("x.n") < F.col("y.n"))) & match(F.col("x"), F.col("y")))
    return near.unionByName(rest.select(F.least("x.n", "y.n").alias("a"), F.greatest("x.n", "y.n").alias("b")))


def links(rows: DataFrame, payload: list[str], match: Match, cuts: list[Callable[[DataFrame], DataFrame]], hot: int) -> DataFrame:
    """(a, b): links between matching rows of one bucket, enough to connect every matching pair; a pair may repeat.

    ``rows`` has n (unique within a bucket), key, g, g2, ``payload`` and whatever the cuts need; a bucket is (key, g, g2).  ``match`` is
    symmetric, over structs of n and payload.  Each of ``cuts`` gives rows of crowded buckets finer keys, such that matching rows
    still meet in one bucket.  ``hot`` is the size from which a bucket is cut; the connected groups don't depend on it.
    """
    bucket, out = ["key", "g", "g2"], None
    for cut in [*cuts, None]:
        crowded = materialize(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select(*bucket), "crowded")
        none = crowded.isEmpty()
        calm = bucket_links(rows if none else rows.join(crowded, bucket, "left_anti"), bucket, payload, match)
        out = calm if out is None else out.unionByName(calm)
        if none:
            return out
        rows = rows.join(crowded, bucket, "left_semi")
        if cut:
            rows = cut(rows)
    return out.unionByName(_crowd_links(rows, bucket, payload, match))


def band_cuts(threshold: int, times: int = 2) -> list[Callable[[DataFrame], DataFrame]]:
    """Cuts of rows with a BIGINT ``rest`` (the hash at first) into bands, one after the other, each by the bits that are left."""

    def cut(width: int) -> Callable[[DataFrame], DataFrame]:
        layout = band_layout(width, threshold + 1)

        def finer(df: DataFrame) -> DataFrame:
            pieces = F.array(*[F.struct(F.xxhash64("key", F.lit(i), band("rest", s, w)).alias("key"), without_band(F.col("rest"), s, w).alias("rest")) for i, (s, w) in enumerate(layout)])
            return df.select(*[c for c in df.columns if c not in ("key", "rest")], F.inline(pieces))

        return finer

    out, width = [], 64
    for _ in range(times):
        out.append(cut(width))
        # What is left of the bits less the narrowest band, so that one layout serves the rests of all bands.
        width -= min(w for _, w in band_layout(width, threshold + 1))
    return out


def hamming_links(nodes: DataFrame, block: list[str], bits: str, node: str, threshold: int, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): links of ``node`` values a < b within ``block`` whose BIGINT ``bits`` differ in at most ``threshold`` bits.

    Enough of them to connect every matching pair, see :func:`links`.  ``nodes`` must be unique in ``node``; nulls in a
    block column are equal to each other.  A null in ``bits`` matches nothing.  Exact copies should be reduced to one node first.
    """
    base = nodes.where(F.col(bits).isNotNull()).select(F.col(node).alias("n"), F.col(bits).alias("h"), F.col(bits).alias("rest"), F.lit(0).cast("bigint").alias("key"), *[c.alias(k) for k, c in block_keys(block).items()])
    return links(base, ["h"], lambda x, y: hamming(x["h"], y["h"]) <= threshold, band_cuts(threshold), hot)


def frame_runs(videos: DataFrame, share: float) -> DataFrame:
    """(g, g2, bits, duration, run, n): distinct durations of videos (g, g2, bits, duration) with the same hashes, cut where neighbours
    differ by more than ``share``.

    Videos of one (g, g2, bits, run) are linked anyway, through chains of durations; n counts the videos.
    """
    same = Window.partitionBy("g", "g2", "bits").orderBy("duration")
    prev = F.lag("duration").over(same)
    lengths = videos.groupBy("g", "g2", "bits", "duration").agg(F.count(F.lit(1)).alias("n"))
    gap = F.when(prev.isNull() | ((F.col("duration") - prev) > share * F.col("duration")), 1).otherwise(0)
    return lengths.withColumn("gap", gap).withColumn("run", F.sum("gap").over(same.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")


def frame_links(nodes: DataFrame, threshold: int, share: float, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): links between runs of videos (node, g, g2, bits, lo, hi) that hold a matching pair.

    Two match if they have as many frames, the mean of the bit differences frame by frame is at most ``threshold``, and the
    durations, which fill lo to hi without a gap beyond ``share``, hold two that differ by at most ``share`` of the longer.

    One frame at least of a pair differs in no more than the mean, so a crowded block is cut by the bands of each frame.  A
    bucket that is crowded still, such as of black frames, is cut by the bands of another frame, one of which differs in at most
    threshold * L / (L - 1) bits; with a single frame by the bits that are left.
    """
    base = nodes.select(F.col("node").alias("n"), "bits", "lo", "hi", F.size("bits").alias("L"), "g", "g2", F.size("bits").cast("bigint").alias("key"))
    near = lambda x, y: ((x["lo"] - y["hi"]) <= share * x["lo"]) & ((y["lo"] - x["hi"]) <= share * y["lo"])
    total = lambda x, y: F.aggregate(F.zip_with(x["bits"], y["bits"], hamming), F.lit(0), lambda s, d: s + d)
    first = band_layout(64, threshold + 1)

    def by_frame(df: DataFrame) -> DataFrame:
        pieces = F.flatten(F.transform("bits", lambda h, j: F.array(*[F.struct(j.alias("j"), F.xxhash64("key", j, F.lit(i), band(h, s, w)).alias("key"), without_band(h, s, w).alias("rest")) for i, (s, w) in enumerate(first)])))
        return df.withColumn("x", F.explode(pieces)).select(*[c for c in df.columns if c != "key"], "x.j", "x.key", "x.rest")

    left = 64 - min(w for _, w in first)
    layouts = [band_layout(64, threshold * n // (n - 1) + 1) for n in (2, 3, 4)]

    def by_other_frame(df: DataFrame) -> DataFrame:
        bands = lambda h, k, layout: F.array(*[F.xxhash64("key", k, F.lit(i), band(h, s, w)) for i, (s, w) in enumerate(layout)])
        again = lambda h, k: F.when(k == F.col("j"), F.array().cast("array<bigint>")).when(F.col("L") == 2, bands(h, k, layouts[0])).when(F.col("L") == 3, bands(h, k, layouts[1])).otherwise(bands(h, k, layouts[2]))
        alone = F.array(*[F.xxhash64("key", F.lit(i), band("rest", s, w)) for i, (s, w) in enumerate(band_layout(left, threshold + 1))])
        return df.withColumn("key", F.explode(F.when(F.col("L") == 1, alone).otherwise(F.flatten(F.transform("bits", again)))))

    return links(base, ["bits", "lo", "hi"], lambda x, y: near(x, y) & (total(x, y) <= threshold * F.size(x["bits"])), [by_frame, by_other_frame], hot)
