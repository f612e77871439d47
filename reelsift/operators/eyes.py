"""Faces and eyes: decisions on detector scores.  Detectors are an outer boundary; their outputs arrive as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.config import CONFIG, Config


def eye_state(blink_l: Column, blink_r: Column, squint: Column, smile: Column, yaw: Column, height: Column, short_side: Column, covered: Column, cfg: Config = CONFIG) -> Column:
    """(state, note): unsure, closed, half or open; a smile with a squint softens closed to half and half to open.

    A face that is too small, turned away, covered or without scores is unsure.
    """
    unsure = blink_l.isNull() | blink_r.isNull() | F.coalesce(covered, F.lit(False)) | F.coalesce(height < cfg.face_min_share * short_side, F.lit(True)) | F.coalesce(F.abs(yaw) > cfg.yaw_unsure, F.lit(True))
    both_closed = (blink_l >= cfg.closed_blink) & (blink_r >= cfg.closed_blink)
    one_closed = (blink_l >= cfg.closed_blink) | (blink_r >= cfg.closed_blink)
    both_half = (blink_l >= cfg.half_blink) & (blink_r >= cfg.half_blink)
    raw = F.when(unsure, "unsure").when(both_closed, "closed").when(one_closed | both_half, "half").otherwise("open")
    soft = raw.isin("closed", "half") & F.coalesce((smile >= cfg.smile_squint) & (squint >= cfg.smile_squint), F.lit(False))
    state = F.when(soft & (raw == "closed"), "half").when(soft & (raw == "half"), "open").otherwise(raw)
    return F.struct(state.alias("eye_state"), F.when(soft, "smile_squint").alias("note"))


def eye_aspect(p1: Column, p2: Column, p3: Column, p4: Column, p5: Column, p6: Column) -> Column:
    """Height over width of an eye of six landmarks (x, y): corners p1 and p4, lids p2, p3 over p6, p5; null for no width."""
    d = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    return F.when(d(p1, p4) > 1e-6, F.round(F.try_divide(d(p2, p6) + d(p3, p5), 2 * d(p1, p4)), 4))


def yaw_of(nose: Column, left: Column, right: Column) -> Column:
    """How far the nose is off the middle of the eyes' outer corners, in half their distance; null for no distance."""
    half = F.abs(right["x"] - left["x"]) / 2
    return F.when(half > 1e-6, F.round(F.try_divide(nose["x"] - (left["x"] + right["x"]) / 2, half), 3))


def subjects(faces: DataFrame, photo: str, short_side: str = "short_side", cfg: Config = CONFIG) -> DataFrame:
    """``faces`` with ``subject``: at least a quarter of the photo's largest area, or high against its short side."""
    area = F.col("w") * F.col("h")
    largest = F.max(area).over(Window.partitionBy(photo))
    return faces.withColumn("subject", F.coalesce((area >= cfg.subject_area * largest) | (F.col("h") >= cfg.subject_height * F.col(short_side)), F.lit(False)))


def face_rollup(faces: Column) -> Column:
    """Counts over an array of faces (eye_state, subject): faces_n, subject_faces_n, eyes_closed_n, eyes_half_n, subject_open_n.

    A null array (no detector, or it failed) gives nulls, an empty one zeros.
    """
    of = lambda s: F.size(F.filter(faces, lambda f: F.coalesce(f["subject"], F.lit(False)) & (f["eye_state"] == s)))
    return F.when(
        faces.isNotNull(),
        F.struct(
            F.size(faces).alias("faces_n"),
            F.size(F.filter(faces, lambda f: F.coalesce(f["subject"], F.lit(False)))).alias("subject_faces_n"),
            of("closed").alias("eyes_closed_n"),
            of("half").alias("eyes_half_n"),
            of("open").alias("subject_open_n"),
        ),
    )


def best_landmarks(candidates: DataFrame, face: str) -> DataFrame:
    """Per face the landmark set (cx, cy) inside its box (x, y, w, h) nearest to the crop's centre (px, py)."""
    inside = F.col("cx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("h"))
    far = F.hypot(F.col("cx") - F.col("px"), F.col("cy") - F.col("py"))
    w = Window.partitionBy(face).orderBy(far, "candidate")
    return candidates.where(inside).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def covered_eye(mean: Column, std: Column) -> Column:
    """A dark and flat eye patch."""
    return F.coalesce((mean < 22) & (std < 18), F.lit(False))


def match_landmarks(faces: DataFrame, candidates: DataFrame, face: str, cfg: Config = CONFIG) -> DataFrame:
    """``faces`` (face, x, y, w, h, h_px) with ``candidate``, ``attempt`` and ``note`` of the landmark set that is theirs.

    ``candidates`` (face, attempt, candidate, cx, cy, px, py): centres of the sets found in a face's crops, attempt 0 in the first crop, 1 in the wider one
    that is tried next.  The first attempt with a set inside the face's box counts, in it the set nearest to the crop's centre.  A face lower than
    ``tiny_face_px`` isn't tried ('tiny'); one without a set is 'no_match'.
    """
    boxed = candidates.join(faces.select(face, "x", "y", "w", "h"), face)
    inside = F.col("cx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("h"))
    far = F.hypot(F.col("cx") - F.col("px"), F.col("cy") - F.col("py"))
    best = boxed.where(inside).groupBy(face).agg(F.min(F.struct("attempt", far.alias("far"), "candidate")).alias("__best"))
    tiny = F.col("h_px") < cfg.tiny_face_px
    out = faces.join(best, face, "left").withColumns({"candidate": F.when(~tiny, F.col("__best.candidate")), "attempt": F.when(~tiny, F.col("__best.attempt"))})
    return out.withColumn("note", F.when(tiny, "tiny").when(F.col("candidate").isNull(), "no_match")).drop("__best")
