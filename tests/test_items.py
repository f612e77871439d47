"""From files to items, copies, shadows, moves; edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.operators import catalog, eyes, ledger, planning
from reelsift.operators.items import build_items
from reelsift.operators.pixels import oriented, reduced
from reelsift.schema import EXIF_TAGS
from reelsift.sources.moves import carry_out


def tags(spark, rows):
    names = [part.strip().split()[0] for part in EXIF_TAGS.split(",")]
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, EXIF_TAGS).withColumnRenamed("SourceFile", "path")


def test_items_of_a_vendor_and_of_others(spark):
    stamp = "20240102_030405_7"
    paths = [f"d/IMG_{stamp}.heic", f"d/IMG_{stamp}.jpg", f"d/LIV_{stamp}.mov", f"d/VID_{stamp}.mov", f"d/LRV_{stamp}.mp4", "e/a.JPG", "e/A.nef", "e/a.xmp", "e/b.mov", "e/lost.lrv", None]
    files = spark.createDataFrame([(p, 5.0) for p in paths] + [("e/a.JPG", 4.0)], "path string, mtime double").withColumn("role", F.lit("clash"))
    given = [
        {"SourceFile": f"d/LIV_{stamp}.mov", "Duration": "3.5 s"},
        {"SourceFile": f"d/VID_{stamp}.mov", "Duration": "20.04 s", "CreateDate": "2024:01:02 03:00:00", "ModifyDate": "2024:01:02 03:00:10", "ImageWidth": "1,920"},
        {"SourceFile": "e/a.JPG", "Model": " cam ", "DateTimeOriginal": "2024:01:01 00:00:00", "OffsetTimeOriginal": "+01:00", "FocalLengthIn35mmFormat": "0", "GPSLatitude": "1.5", "LensModel": " ", "UserComment": "Screenshot"},
    ]
    items, orphans = build_items(files, tags(spark, given), F.lit("UTC"), clock_offsets={"cam": -60.0})
    got = {r["primary"]: r for r in items.collect()}
    assert set(got) == {f"d/IMG_{stamp}.heic", f"d/VID_{stamp}.mov", "e/a.JPG", "e/b.mov"}
    photo, video, other = got[f"d/IMG_{stamp}.heic"], got[f"d/VID_{stamp}.mov"], got["e/a.JPG"]
    assert photo.companions == [f"d/IMG_{stamp}.jpg", f"d/LIV_{stamp}.mov"] and photo.live and photo.subtype == "IMG" and photo.seq == 7 and photo.time_source == "filename"
    assert (video.capture_s, video.slowmo_factor, video.time_end - video.time, video.companions) == (10.0, 2, 10.0, [f"d/LRV_{stamp}.mp4"]) and video.width == 1
    assert other.companions == ["e/A.nef", "e/a.xmp"] and other.time == 1704063600.0 - 60 and other.time_source == "DateTimeOriginal+OffsetTimeOriginal"
    assert other.focal35 is None and other.gps is None and other.lens is None and other.screenshot and other.device == "cam" and other.duration is None
    assert got["e/b.mov"].time == 5.0 and got["e/b.mov"].duration is None and got["e/b.mov"].time_source == "mtime"
    assert [tuple(r) for r in orphans.collect()] == [("e/lost.lrv", "proxy")]
    assert build_items(files.limit(0), tags(spark, []), F.lit("UTC"))[0].count() == 0


def test_copies_go_to_one_keeper(spark):
    rows = [("a", "raw", False, "a1", 1, "x"), ("b", "image", False, "b1", 1, "x"), ("c", "image", True, "c1", 2, "y"), ("b", "image", False, "b2", 2, "y"), ("d", "image", False, "d1", 1, "z"), ("e", "image", False, "e1", None, "x"), ("f", "image", False, "f1", 1, None)]
    df = spark.createDataFrame(rows, "primary string, kind string, mixed boolean, path string, size int, md5 string")
    assert sorted((r["primary"], r.keeper, tuple(r.backups)) for r in catalog.backup_items(df, ["size"], "md5").collect()) == [("a", "c", ("a1",)), ("b", "c", ("b1", "b2"))]
    assert catalog.backup_items(df.limit(0), ["size"], "md5").count() == 0


def test_shadows_and_suffixes(spark):
    files = spark.createDataFrame([("e", "d/a.jpg", "02", None), ("e", "a.mov", "02", None)], "primary string, path string, tier string, reason string")
    disk = spark.createDataFrame([("d/._a.jpg",), ("._b.mov",), (None,), ("d/._a.jpg",)], "path string")
    got = catalog.with_shadows(files, disk)
    assert sorted(r.path for r in got.collect()) == ["a.mov", "d/._a.jpg", "d/a.jpg"]
    taken = spark.createDataFrame([("02_优秀/d/._a.jpg",)] + [(f"02_优秀/a_{k}.mov",) for k in range(2, 62)], "path string")
    assert {r.path: r.dst for r in planning.destinations(got, taken).collect()} == {"d/a.jpg": "02_优秀/d/a_62.jpg", "d/._a.jpg": "02_优秀/d/._a_62.jpg", "a.mov": "02_优秀/a_62.mov"}


def test_moves_are_logged_ahead(tmp_path):
    root, log = tmp_path / "root", str(tmp_path / "log" / "moves.jsonl")
    root.mkdir()
    for name in ("a.jpg", "b.jpg", "._c.jpg"):
        (root / name).write_text(name)
    (root / "t").mkdir()
    (root / "t" / "._a.jpg").write_text("shadow")
    assert carry_out(str(root), [("a.jpg", "t/a.jpg"), ("._a.jpg", "t/._a.jpg"), ("._x.jpg", "t/._x.jpg"), ("._c.jpg", "t/._c.jpg")], log, "B1") == 2
    states = [(r["seq"], r["state"]) for r in map(json.loads, open(log))]
    assert states == [(1, "pending"), (1, "done"), (2, "auto"), (4, "pending"), (4, "done")]
    with pytest.raises(FileExistsError):
        carry_out(str(root), [("b.jpg", "t/a.jpg")], log, "B2")
    assert (root / "b.jpg").exists() and (root / "t" / "a.jpg").read_text() == "a.jpg"


def test_turns_index_and_landmarks(spark):
    u = spark.createDataFrame([("x", 1, -5, False), ("x", 2, -5, False), ("x", 3, -5, True), ("y", 1, -9, False)], "batch string, seq int, b int, h boolean")
    u = u.select("batch", "seq", F.struct(F.col("b").alias("batch"), F.col("h").alias("shadow"), (-F.col("seq")).alias("seq")).alias("turn"))
    assert sorted((r.turn, r.batch, r.seq) for r in ledger.numbered_turns(u).collect()) == [(1, "y", 1), (2, "x", 2), (3, "x", 1), (4, "x", 3)]
    a = spark.createDataFrame([("p", "D001"), ("q", None), ("r", "D002")], "primary string, dup_group string")
    b = spark.createDataFrame([("p", "VD001"), ("r", None)], "primary string, dup_group string")
    assert {r["primary"]: r.dup_group for r in planning.dup_index([a, b]).collect()} == {"p": "VD001", "r": "D002"}
    faces = spark.createDataFrame([("f", 0.0, 0.0, 10.0, 10.0, 50), ("g", 0.0, 0.0, 10.0, 10.0, 39), ("h", 0.0, 0.0, 10.0, 10.0, None)], "face string, x double, y double, w double, h double, h_px int")
    sets = spark.createDataFrame([("f", 0, 1, 20.0, 1.0), ("f", 1, 2, 1.0, 1.0), ("f", 1, 3, 5.0, 5.0), ("g", 0, 4, 1.0, 1.0)], "face string, attempt int, candidate int, cx double, cy double").withColumns({"px": F.lit(5.0), "py": F.lit(5.0)})
    assert {r.face: (r.candidate, r.attempt, r.note) for r in eyes.match_landmarks(faces, sets, "face").collect()} == {"f": (3, 1, None), "g": (None, None, "tiny"), "h": (None, None, "no_match")}


def test_pictures_are_turned_and_reduced():
    a = np.arange(6).reshape(2, 3)
    turned = {1: a, 2: a[:, ::-1], 3: np.rot90(a, 2), 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a), 9: a}
    for tag, want in turned.items():
        assert oriented(a, tag).tolist() == want.tolist(), tag
    assert reduced(np.full((10, 4000, 3), 7, np.uint8), 1600).shape == (3, 1333, 3) and reduced(a, 1600) is a
    assert reduced(np.array([[0, 2], [4, 6]], np.uint8), 1).tolist() == [[3]] and reduced(np.ones((1, 9), np.uint8), 2).shape == (1, 1)
