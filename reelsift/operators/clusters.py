"""Near-duplicate clusters: edges, components, labels, diagnostics and suggested keepers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.config import CONFIG, Config
from reelsift.operators.components import component_labels
from reelsift.operators.order import place_along
from reelsift.operators.similarity import HOT_BUCKET, band, band_cuts, band_layout, block_keys, frame_links, frame_runs, hamming, hamming_links, links
from reelsift.shared import materialize


def _with_least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rep``: the least node of equal keys, nulls equal too.  Reduced before the shuffle, joined back, so a hot key is split."""
    least = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("node").alias("rep"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(least, cond)


def photo_edges(photos: DataFrame, library: list[str], cfg: Config = CONFIG, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b) of stills that are near duplicates, between representatives of equal records.

    ``photos`` has node, device_key, subtype, scene, time and bits, one row per record.  Within (library, device_key, subtype)
    two match if their hashes differ in at most ``dup_bits``, or in at most ``burst_bits`` if they are of one scene and less
    than ``burst_gap_s`` apart.  Links come out, enough to connect every matching pair; records with the same hash are linked to
    the least of them.

    Shots of a burst meet in slots of twice the gap, laid over time twice, half a slot apart.  A slot that holds too many, as of
    a camera whose clock stands, is cut by the hashes' bands.
    """
    block = [*library, "device_key", "subtype"]
    reps = _with_least(photos.where("bits IS NOT NULL"), [*block, "bits"])
    reps = materialize(reps.select("node", "rep", *block, "scene", "time", "bits"), "photo-reps")
    equal = reps.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    close = hamming_links(reps.where("node = rep"), block, "bits", "node", cfg.dup_bits, hot)
    shots = reps.where("time IS NOT NULL").groupBy(*block, "scene", "time", "bits").agg(F.min("node").alias("n"))
    slots = F.array(*[F.xxhash64(F.lit(i), F.floor((F.col("time") + i * cfg.burst_gap_s) / (2 * cfg.burst_gap_s))) for i in (0, 1)])
    shots = shots.select("n", F.col("time").alias("t"), F.col("bits").alias("h"), F.col("bits").alias("rest"), *[c.alias(k) for k, c in block_keys([*block, "scene"]).items()], F.explode(slots).alias("key"))
    near = lambda x, y: (F.abs(x["t"] - y["t"]) < cfg.burst_gap_s) & (hamming(x["h"], y["h"]) <= cfg.burst_bits)
    burst = links(shots, ["t", "h"], near, band_cuts(cfg.burst_bits), hot)
    return equal.unionByName(close).unionByName(burst).distinct()


def label_clusters(records: DataFrame, components: DataFrame, library: list[str], order: list[str], letter: str) -> DataFrame:
    """``records`` (with node) of components of more than one, with ``dup_group``, ``dup_size``.

    Labels count along ``order`` and the least member, in each library: D001, D002 and so on.
    """
    of = records.join(components, "node")
    first = of.groupBy(*library, "label").agg(*[F.min(c).alias(f"__{c}") for c in order], F.count(F.lit(1)).alias("dup_size"))
    first = place_along(first, library, [*[F.col(f"__{c}") for c in order], F.col("label")], "__rank")
    first = first.withColumn("dup_group", F.format_string(f"{letter}%03d", F.col("__rank"))).select(*[F.col(c).alias(f"__k{c}") for c in library], F.col("label").alias("__label"), "dup_group", "dup_size")
    cond = F.col("label") == F.col("__label")
    for c in library:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k{c}"))
    return of.join(first, cond).drop("label", "__label", *[f"__k{c}" for c in library])


def keeper(records: DataFrame, group: list[str], bad_flags: list[str], order: list, label: str = "primary") -> DataFrame:
    """``records`` with ``suggested_keep``: per group the first by ``order``, those without bad flags before all others.

    The minimum is combined before the shuffle.
    """
    dirty = F.coalesce(F.arrays_overlap("flags", F.array(*[F.lit(f) for f in bad_flags])), F.lit(False))
    key = F.struct(dirty.alias("d"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(label).alias("keep"))
    best = records.groupBy(*group).agg(F.min(key).getField("keep").alias("suggested_keep"))
    return records.join(best, group)


def _centre(bits: str) -> Column:
    """The hash that has, in each bit, what most of a group's hashes have."""
    most = [F.when(F.sum(band(bits, i, 1)) * 2 > F.count(F.lit(1)), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")) for i in range(64)]
    out = most[0]
    for m in most[1:]:
        out = out.bitwiseOR(m)
    return out


def farthest(hashes: DataFrame, group: list[str], few: int = 64) -> DataFrame:
    """(group, far): the greatest distance between two of a group's distinct ``bits``; groups of one hash are left out.

    Groups of up to ``few`` are compared in pairs.  In larger ones each hash has its distance r from the group's centre, and no pair is further apart than its
    two r together; the distances from the hash with the greatest r give a bound from below.  Only pairs that may exceed it
    are compared, among the hashes that have such a partner.
    """
    sizes = materialize(hashes.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), _centre("bits").alias("__m")).where("__n > 1"), "centres")
    a, b = hashes.select(*group, F.col("bits").alias("ha")), hashes.select(*group, F.col("bits").alias("hb"))
    pairs = lambda of, x, y: x.join(of, group, "left_semi").join(y, group).where("ha < hb")
    plain = pairs(sizes.where(F.col("__n") <= few), a, b).groupBy(*group).agg(F.max(hamming(F.col("ha"), F.col("hb"))).alias("far"))
    big = sizes.where(F.col("__n") > few)
    if big.isEmpty():
        return plain
    rings = materialize(hashes.join(big, group).select(*group, "bits", hamming(F.col("bits"), F.col("__m")).alias("r")), "rings")
    edge = rings.groupBy(*group).agg(F.max(F.struct("r", "bits")).alias("e"))
    low = materialize(rings.join(edge, group).groupBy(*group).agg(F.max(hamming(F.col("bits"), F.col("e.bits"))).alias("low"), F.max("e.r").alias("most")), "bounds")
    live = materialize(rings.join(low, group).where(F.col("r") + F.col("most") > F.col("low")).select(*group, "bits", "r", "low"), "outer")
    x, y = live.select(*group, F.col("bits").alias("ha"), F.col("r").alias("ra"), "low"), live.select(*group, F.col("bits").alias("hb"), F.col("r").alias("rb"))
    far = x.join(y, group).where((F.col("ha") < F.col("hb")) & (F.col("ra") + F.col("rb") > F.col("low"))).groupBy(*group).agg(F.max(hamming(F.col("ha"), F.col("hb"))).alias("far"))
    outer = low.join(far, group, "left").select(*group, F.greatest("low", F.coalesce("far", F.lit(0))).alias("far"))
    return plain.unionByName(outer)


def cluster_spread(records: DataFrame, group: list[str], loose_size: int = CONFIG.loose_size, loose_bits: int = CONFIG.burst_bits, few: int = 64) -> DataFrame:
    """Per group its size, time span, greatest distance over all pairs (``dup_maxdist``) and whether it is loose.

    ``records`` have bits and time; the greatest distance is exact, see :func:`farthest`.
    """
    size = records.groupBy(*group).agg(F.count(F.lit(1)).alias("dup_size"), F.round(F.coalesce(F.max("time") - F.min("time"), F.lit(0.0)), 3).alias("dup_span_s"))
    far = farthest(materialize(records.where("bits IS NOT NULL").select(*group, "bits").distinct(), "hashes"), group, few)
    out = size.join(far, group, "left").withColumn("dup_maxdist", F.coalesce("far", F.lit(0))).drop("far")
    return out.withColumn("dup_loose", (F.col("dup_size") >= loose_size) | (F.col("dup_maxdist") > loose_bits))


def video_spread(records: DataFrame, group: list[str], loose_size: int = CONFIG.loose_size, loose_bits: int = CONFIG.burst_bits) -> DataFrame:
    """As :func:`cluster_spread` for videos, whose bits are arrays of frame hashes: distances are means over the frames."""
    size = records.groupBy(*group).agg(F.count(F.lit(1)).alias("dup_size"), F.round(F.coalesce(F.max("time") - F.min("time"), F.lit(0.0)), 3).alias("dup_span_s"))
    hashes = records.where(F.size("bits") > 0).select(*group, "bits").distinct()
    pairs = hashes.withColumnRenamed("bits", "ha").join(hashes.withColumnRenamed("bits", "hb"), group).where("ha < hb")
    total = F.aggregate(F.zip_with("ha", "hb", hamming), F.lit(0), lambda s, d: s + d)
    far = pairs.groupBy(*group).agg(F.round(F.max(total / F.size("ha")), 4).alias("far"))
    out = size.join(far, group, "left").withColumn("dup_maxdist", F.coalesce("far", F.lit(0.0))).drop("far")
    return out.withColumn("dup_loose", (F.col("dup_size") >= loose_size) | (F.col("dup_maxdist") > loose_bits))


def cross_similar(photos: DataFrame, library: list[str], cfg: Config = CONFIG, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b) of an IMG and a LIV of one scene at most ``cross_gap_s`` apart whose hashes differ in at most ``burst_bits``.

    Slots are as wide as the tolerance, so partners lie in the same or a neighbouring slot.  Slots with more than ``hot`` photos are
    cut by the hashes' bands, in one of which partners agree.  Every pair comes out once, for the lists of both.
    """
    ok = photos.where("bits IS NOT NULL AND time IS NOT NULL").withColumn("slot", F.floor(F.col("time") / cfg.cross_gap_s))
    key = F.struct(*library, F.coalesce("scene", F.lit("\u0001")).alias("scene"))
    a = ok.where("subtype = 'IMG'").select(key.alias("k"), "slot", F.col("primary").alias("a"), F.col("time").alias("ta"), F.col("bits").alias("ha"))
    b = ok.where("subtype = 'LIV'").select(key.alias("k"), F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"), F.col("primary").alias("b"), F.col("time").alias("tb"), F.col("bits").alias("hb"))
    near = (F.abs(F.col("ta") - F.col("tb")) <= cfg.cross_gap_s) & (hamming(F.col("ha"), F.col("hb")) <= cfg.burst_bits)
    crowded = materialize(a.select("k", "slot").unionByName(b.select("k", "slot")).groupBy("k", "slot").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("k", "slot"), "crowded")
    if crowded.isEmpty():
        return a.join(b, ["k", "slot"]).where(near).select("a", "b")
    layout = list(enumerate(band_layout(64, cfg.burst_bits + 1)))
    cut = lambda df, h: df.join(crowded, ["k", "slot"], "left_semi").withColumn("band", F.explode(F.array(*[F.xxhash64(F.lit(i), band(h, s, w)) for i, (s, w) in layout])))
    calm = a.join(crowded, ["k", "slot"], "left_anti").join(b, ["k", "slot"]).where(near).select("a", "b")
    hot_pairs = cut(a, "ha").join(cut(b, "hb"), ["k", "slot", "band"]).where(near).select("a", "b").distinct()
    return calm.unionByName(hot_pairs)


def similar_lists(pairs: DataFrame) -> DataFrame:
    """(primary, similar_cross): the partners of each record, on both sides, in order."""
    both = pairs.select(F.col("a").alias("primary"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("primary"), F.col("a").alias("other")))
    return both.groupBy("primary").agg(F.array_sort(F.collect_set("other")).alias("similar_cross"))


def same_person_pairs(faces: DataFrame, group: list[str]) -> DataFrame:
    """(a, b) of faces in different photos of a cluster that are one person by place and height.

    ``faces`` has face (unique), photo, cx, cy, h.  Centres are closer than half the mean height, heights within 0.7 to 1.4.  A face
    meets only faces of its cluster in neighbouring cells of twice its own height class.
    """
    cell = F.lit(64.0) * F.pow(F.lit(2.0), F.floor(F.log2(F.col("h") / 64.0)))
    ok = faces.where("h > 0").withColumn("c", cell)
    a = ok.select(*group, F.col("face").alias("a"), F.col("photo").alias("pa"), F.col("cx").alias("xa"), F.col("cy").alias("ya"), F.col("h").alias("ha"), F.col("c").alias("size"), F.floor(F.col("cx") / (2 * F.col("c"))).alias("gx"), F.floor(F.col("cy") / (2 * F.col("c"))).alias("gy"))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    b = ok.select("*", F.explode(F.array(F.col("c") / 2, F.col("c"), F.col("c") * 2)).alias("size")).select("*", F.explode(near).alias("dx")).select("*", F.explode(near).alias("dy"))
    b = b.select(*group, F.col("face").alias("b"), F.col("photo").alias("pb"), F.col("cx").alias("xb"), F.col("cy").alias("yb"), F.col("h").alias("hb"), "size", (F.floor(F.col("cx") / (2 * F.col("size"))) + F.col("dx")).alias("gx"), (F.floor(F.col("cy") / (2 * F.col("size"))) + F.col("dy")).alias("gy"))
    close = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)) < 0.25 * (F.col("ha") + F.col("hb"))
    return a.join(b, [*group, "size", "gx", "gy"]).where((F.col("pa") != F.col("pb")) & (F.col("a") < F.col("b")) & close & (F.col("ha") / F.col("hb")).between(0.7, 1.4)).select("a", "b").distinct()


def relative_blink(faces: DataFrame, group: list[str], threshold: float = CONFIG.rel_closed) -> tuple[DataFrame, DataFrame]:
    """(faces with rel_blink, photos with eye_rel_closed_n): how far each face blinks more than the same person at best.

    Persons are the components of :func:`same_person_pairs`; a face without a partner or without a score has none.
    ``faces`` has face, photo, cx, cy, h, blink_l, blink_r, subject.
    """
    person = component_labels(same_person_pairs(faces, group)).select(F.col("node").alias("face"), F.col("label").alias("__person"))
    most = F.greatest(F.coalesce("blink_l", F.lit(0.0)), F.coalesce("blink_r", F.lit(0.0)))
    scored = faces.join(person, "face", "left").withColumn("__blink", F.when(F.col("__person").isNotNull() & (F.col("blink_l").isNotNull() | F.col("blink_r").isNotNull()), most))
    least = scored.where("__person IS NOT NULL").groupBy(F.col("__person").alias("__p")).agg(F.min("__blink").alias("__least"))
    scored = scored.join(least, F.col("__person") == F.col("__p"), "left")
    scored = scored.withColumn("rel_blink", F.round(F.col("__blink") - F.col("__least"), 4)).drop("__blink", "__least", "__person", "__p")
    closed = F.sum(F.when(F.coalesce("subject", F.lit(False)) & (F.coalesce("rel_blink", F.lit(0.0)) >= threshold), 1).otherwise(0))
    return scored, scored.groupBy("photo").agg(closed.cast("int").alias("eye_rel_closed_n"))


def video_edges(videos: DataFrame, library: list[str], cfg: Config = CONFIG, share: float = 0.2, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b) of videos that are near duplicates: links, enough to connect every matching pair.

    ``videos`` has node, bits (ARRAY<BIGINT>) and duration.  Two match if both have as many frame hashes, durations differ by at
    most ``share`` of the longer and the mean distance frame by frame is at most ``dup_bits``; see
    :func:`reelsift.operators.similarity.frame_links` for how they meet.
    """
    ok = videos.where((F.size("bits") > 0) & ~F.exists("bits", lambda x: x.isNull()) & (F.col("duration") > 0) & (F.col("duration") < float("inf")))
    keyed = ok.select("node", *[c.alias(k) for k, c in block_keys(library).items()], "bits", "duration")
    of_run = keyed.join(frame_runs(keyed, share), ["g", "g2", "bits", "duration"]).select("node", "g", "g2", "bits", "duration", "run")
    of_run = materialize(of_run, "video-runs")
    runs = materialize(of_run.groupBy("g", "g2", "bits", "run").agg(F.min("node").alias("rep"), F.min("duration").alias("lo"), F.max("duration").alias("hi")), "video-reps")
    equal = of_run.join(runs, ["g", "g2", "bits", "run"]).where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return equal.unionByName(frame_links(runs.withColumnRenamed("rep", "node"), cfg.dup_bits, share, hot)).distinct()
