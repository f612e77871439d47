"""Boundary cases of the catalogue's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.config import CONFIG, DUPLICATE_REASON, VENDOR_DEVICE
from reelsift.functions import media as m
from reelsift.functions import times
from reelsift.operators import catalog, clusters, eyes, flags, ledger, pixels, planning
from reelsift.operators.baseline import ladder_median
from reelsift.operators.components import component_labels
from reelsift.operators.scenes import assign_ids, assign_scenes, sheet_layout
from reelsift.operators.similarity import hamming_links, hash_bits

ITEM = "primary string, kind string, time double, time_end double, seq int, gps struct<lat: double, lon: double>"


def col(spark, schema, rows, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def scenes(spark, rows, chunk=86400.0):
    df = spark.createDataFrame([(lib, *r) for r in rows for lib in ("lib", None)], f"root string, {ITEM}").withColumn("n", F.lit("clash"))
    got = assign_scenes(df, ["root"], chunk=chunk).collect()
    assert sorted((r.primary, r.scene or "") for r in got if r.root) == sorted((r.primary, r.scene or "") for r in got if not r.root)
    return {r.primary: r.scene for r in got}


def test_scene_gap_is_strict(spark):
    got = scenes(spark, [("a", "image", 0.0, None, 0, None), ("b", "image", 600.0, None, 0, None), ("c", "image", 1200.001, None, 0, None), ("d", "image", None, None, 0, None)])
    assert got == {"a": "S001", "b": "S001", "c": "S002", "d": None}


def test_a_jump_resets_the_running_end_and_nulls_carry_the_last_place(spark):
    here, away = (10.0, 20.0), (11.0, 20.0)
    rows = [("a", "video", 0.0, 5000.0, 0, here), ("b", "image", 100.0, None, 0, away), ("c", "image", 800.0, None, 0, None), ("d", "image", 900.0, None, 0, here)]
    assert scenes(spark, rows) == {"a": "S001", "b": "S002", "c": "S003", "d": "S004"}


def test_scenes_match_a_fold(spark):
    rnd = np.random.default_rng(3)
    rows, t = [], 0.0
    for i in range(400):
        t += float(rnd.choice([0, 5, 300, 601]))
        end = t + float(rnd.choice([0, 2000])) if rnd.random() < 0.2 else None
        gps = (float(rnd.choice([0.0, 0.001, 0.02])), 0.0) if rnd.random() < 0.5 else None
        rows.append((f"p{i:04d}", "image", t, end, 0, gps))
    n, last_end, place, want = 1, None, None, {}
    for p, _, t, e, _, g in rows:
        new = last_end is not None and (t - last_end > 600 or bool(g and place and abs(g[0] - place[0]) * 111195 > 500))
        n += new
        want[p] = f"S{n:03d}"
        end = e if e is not None else t
        last_end = end if last_end is None or new else max(last_end, end)
        place = g or place
    for chunk in (86400.0, 700.0, 1e9):
        assert scenes(spark, rows, chunk) == want


def test_ids_and_sheets(spark):
    df = spark.createDataFrame([("lib", f"p{i:02d}", "video" if i == 3 else "image", float(i), None, 0, None) for i in range(11)], f"root string, {ITEM}")
    ids = {r.primary: r.id for r in assign_ids(df, ["root"]).collect()}
    assert ids["p03"] == "V0001" and ids["p00"] == "P0001" and ids["p04"] == "P0004"
    sheets = {r.primary: (r.sheet, r.sheet_pos) for r in sheet_layout(df.withColumn("scene", F.lit("S001")), ["root"]).collect()}
    assert sheets["p08"] == ("S001_01", 9) and sheets["p09"] == ("S001_02", 1)


def test_zoom(spark):
    rows = [(20.0, 1.0, VENDOR_DEVICE, "w"), (40.0, 2.0, VENDOR_DEVICE, "w_crop"), (30.0, 1.0, VENDOR_DEVICE, "wide"), (200.0, 1.0, VENDOR_DEVICE, "digital"), (40.0, None, "x", "wide"), (105.0, None, "x", "mid"), (106.0, None, None, "tele"), (0.0, None, "x", None), (None, 1.0, "x", None)]
    for got, want in col(spark, "f double, r double, d string, want string", rows, m.zoom_bucket(F.col("f"), F.col("r"), F.col("d")), "want"):
        assert got == want


def test_names(spark):
    rows = [("a/LRV_1.mp4", "proxy"), ("a/x.LRV", "proxy"), ("x.XMP", "sidecar"), ("x.nef", "raw"), ("x.MOV", "video"), ("x.jpg", "image"), ("noext", "image")]
    assert all(g == w for g, w in col(spark, "p string, w string", rows, m.classify(F.col("p")), "w"))
    p = F.col("p")
    assert col(spark, "p string", [("a/b/c.d.JPG",), ("x",), (".hidden",)], m.parent_of(p), m.stem_of(p), m.ext_of(p)) == [("a/b", "c.d", ".jpg"), ("", "x", ""), ("", ".hidden", "")]
    assert col(spark, "p string", [("d/IMG_20240102_030405_7.jpg",), ("d/Foo.jpg",)], m.vendor_prefix(p), m.vendor_seq(p), m.device_of(p, F.lit(" "), F.lit("Make"))) == [("IMG", 7, VENDOR_DEVICE), (None, 0, "Make")]
    assert col(spark, "d string", [(f" {VENDOR_DEVICE} ",), (None,), (" cam ",)], m.device_key(F.col("d"))) == [("luna",), ("",), ("cam",)]


def test_slow_motion_pano_numbers(spark):
    rows = [(80.0, 10.0), (10.0, 10.0), (0.0, 5.0), (None, 5.0), (10.0, None), (18.0, 10.0)]
    got = col(spark, "d double, b double", rows, m.slow_motion(F.col("d"), F.lit(0.0), F.col("b")))
    assert [g[0] and tuple(g[0]) for g in got] == [(10.0, 8), (10.0, None), None, None, (10.0, None), (10.0, 2)]
    assert col(spark, "w int, h int", [(6000, 3000), (5999, 3000), (3000, 6000), (0, 0), (None, 1)], m.is_pano(F.lit(None).cast("string"), F.col("w"), F.col("h"))) == [(True,), (False,), (True,), (False,), (False,)]
    assert col(spark, "s string", [("1,234 foo",), ("  ",), ("x",), (None,), ("2.5",)], m.tolerant_float(F.col("s"))) == [(1.0,), (None,), (None,), (None,), (2.5,)]
    assert col(spark, "s string", [("30000/1001",), ("1/0",), ("25",), ("",)], m.rate(F.col("s"))) == [(29.97,), (None,), (25.0,), (None,)]
    assert col(spark, "s string", [("x mean_volume: -23.45 dB",), ("none",)], m.mean_volume(F.col("s"))) == [(-23.5,), (None,)]
    assert col(spark, "n bigint", [(0,), (512,), (3 << 20,)], m.human_size(F.col("n"))) == [("0 B",), ("0.5 KB",), ("3.0 MB",)]


def test_target_paths(spark):
    p = F.col("p")
    rows = [("d/a.b.jpg", "00", "模糊", "_2"), ("._a.jpg", "02", None, "_2"), ("a.jpg", "01", "复核-眼", "")]
    assert [r[0] for r in col(spark, "p string, t string, r string, s string", rows, m.target_path(p, F.col("t"), F.col("r"), F.col("s")))] == ["00_待删除/d/模糊__a_2.b.jpg", "02_优秀/._a_2.jpg", "01_待复核/眼__a.jpg"]


def test_times(spark):
    a = F.col("a")
    assert col(spark, "a string", [("2024:01:01 00:00:00.5+01:00",), ("0000:01:01 00:00:00",), ("2024:01:01 00:00:00",), ("nope",), (None,)], times.seconds(times.parse_stamp(a), F.lit("Asia/Kolkata"))) == [(1704063600.5,), (None,), (1704047400.0,), (None,), (None,)]
    none = F.lit(None).cast("string")
    tag = times.tag_time(none, none, F.lit("2024:01:01 00:00:00"), a, F.lit(True), F.lit("Asia/Kolkata"))
    assert [tuple(r[0]) for r in col(spark, "a string", [("2024:01:01 00:00:00",)], tag)] == [(1704067200.0, "CreateDate")]
    other = times.other_time(none, F.lit("2024:01:01 00:00:00"), F.lit("+01:00"), tag, F.lit(5.0), F.lit("UTC"), F.lit(-120.0))
    assert [tuple(r[0]) for r in col(spark, "a string", [("x",)], other)] == [(1704063480.0, "DateTimeOriginal+OffsetTimeOriginal")]
    vendor = times.vendor_time(F.lit("IMG_20240101_000000_1.jpg"), tag, F.lit(5.0), F.lit("UTC"))
    assert [tuple(r[0]) for r in col(spark, "a string", [("x",)], vendor)] == [(1704067200.0, "filename")]


def test_ladder(spark):
    rows = [("a", "x", 1.0)] * 4 + [("a", "y", 9.0)] * 2 + [("b", None, None), ("c", "z", 5.0)]
    df = spark.createDataFrame(rows, "k string, l string, v double")
    got = {(r.k, r.l): (r["median"], r.level, r.n) for r in ladder_median(df, [["k", "l"], ["k"]], "v", 5).collect()}
    assert got[("a", "x")] == (1.0, 1, 6) and got[("c", "z")] == (1.0, 2, 7) and got[("b", None)] == (1.0, 2, 7)
    assert ladder_median(df.limit(0), [["k"]], "v", 5).count() == 0


def test_flags(spark):
    lit = F.lit
    r2 = flags.blur_flag(F.col("s"), lit(10.0), F.col("shot"))
    assert col(spark, "s double, shot boolean", [(3.0, False), (2.9, False), (None, None), (1.0, True)], r2) == [(None,), ("R2",), ("R2",), (None,)]
    v = flags.video_flags(lit(1.9), F.col("b"), lit(None).cast("array<double>"), F.array().cast("array<double>"), lit(3.0), lit(10.0), lit(1.5), lit(None).cast("int"), lit(False), lit("standard"), lit("x"))
    dark, fine = 1.0, 100.0
    assert col(spark, "b array<double>", [([dark] * 3 + [fine] * 2,), ([dark] * 3 + [fine] * 3,), (None,)], v) == [(["V1", "V5", "V2-hint"],), (["V1", "V2-hint"],), (["V1", "V2-hint"],)]
    assert col(spark, "c int, h int, s boolean", [(1, 1, False), (0, 1, False), (1, 0, True), (None, None, None)], flags.eye_flag(F.col("c"), F.col("h"), F.col("s"))) == [("EYE",), ("EYE-half",), (None,), (None,)]
    assert col(spark, "a double, b double", [(0.0, 61.5), (0.0, 60.0)], flags.clock_warning(F.col("a"), F.col("b"))) == [(61,), (None,)]


PHOTO = "node string, primary string, root string, device_key string, subtype string, scene string, time double, phash string"


def test_photo_edges_at_their_limits(spark):
    h = lambda bits: f"{(1 << bits) - 1:016x}"
    rows = [("a", "IMG", "S1", 0.0, h(0)), ("b", "IMG", "S2", 1000.0, h(6)), ("c", "IMG", "S3", 2000.0, h(13)), ("d", "LIV", "S1", 0.0, h(0)), ("e", "IMG", "S4", 10.0, "ff" * 8), ("f", "IMG", "S4", 12.9, "000fffffffffffff"), ("g", "IMG", "S4", 15.9, "ffffffffff000fff"), ("a2", "IMG", "S9", None, h(0))]
    df = spark.createDataFrame([(p, p, "r", "cam", s, sc, t, x) for p, s, sc, t, x in rows], PHOTO).withColumn("bits", hash_bits(F.col("phash")))
    assert sorted(map(tuple, clusters.photo_edges(df, ["root"]).collect())) == [("a", "a2"), ("a", "b"), ("e", "f")]


def test_labels_reach_the_least_node_whatever_the_order(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 3), (7, 7), (200, 200), (5, 4), (5, 4)], "a long, b long")
    got = {r.node: r.label for r in component_labels(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert component_labels(df.limit(0)).count() == 0
    # A shuffled chain, one of bit-reversed order, and a star whose hub is the greatest.
    names = np.random.default_rng(1).permutation(10_000).tolist()
    chain = list(zip(names, names[1:]))
    turned = [20_000 + int(f"{i:010b}"[::-1], 2) for i in range(1024)]
    star = [(40_000, 30_000 + i) for i in range(500)]
    df = spark.createDataFrame(chain + list(zip(turned, turned[1:])) + star, "a long, b long")
    got = component_labels(df).groupBy("label").count().collect()
    assert sorted(map(tuple, got)) == [(0, 10_000), (20_000, 1024), (30_000, 501)]


def test_links_connect_what_pairs_connect(spark):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**62, 12)
    rows = []
    for i in range(400):
        h = int(base[int(rnd.integers(12))])
        for bit in rnd.integers(0, 64, int(rnd.integers(0, 6))):
            h ^= 1 << int(bit)
        rows.append((i, "r" if i % 5 else None, h - (1 << 64) if h >= 1 << 63 else h))
    df = spark.createDataFrame(list({(r, h): (i, r, h) for i, r, h in rows}.values()), "node long, root string, h long")
    kept = [tuple(r) for r in df.collect()]
    near = [(a, b) for a, ra, ha in kept for b, rb, hb in kept if a < b and ra == rb and ((ha ^ hb) & (2**64 - 1)).bit_count() <= 6]
    label = {a: a for a, _, _ in kept}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        label[y] = x
    want = {a: top(a) for p in near for a in p}
    for hot in (256, 20, 3):
        edges = hamming_links(df, ["root"], "h", "node", 6, hot)
        assert {tuple(r) for r in edges.collect()} <= set(near)
        assert {r.node: r.label for r in component_labels(edges).collect()} == want


def test_a_stopped_clock_is_cut(spark):
    rows = [(f"p{i:03d}", "r", "cam", "IMG", None, 5.0, (1 << (i % 60)) if i % 7 else i * 0x9E3779B97F4A7C15 % 2**63) for i in range(300)]
    df = spark.createDataFrame(rows, "node string, root string, device_key string, subtype string, scene string, time double, bits long")
    calm, cut = (sorted(map(tuple, component_labels(clusters.photo_edges(df, ["root"], hot=hot)).collect())) for hot in (1000, 10))
    assert calm == cut and len(calm) > 250
    x = df.withColumn("primary", F.col("node")).withColumn("subtype", F.when(F.substring("node", 4, 1) < "5", "IMG").otherwise("LIV"))
    assert sorted(map(tuple, clusters.cross_similar(x, ["root"], hot=1000).collect())) == sorted(map(tuple, clusters.cross_similar(x, ["root"], hot=10).collect()))


def test_spread(spark):
    rows = [("g", f"{i:x}" * 16, float(i)) for i in (0, 0, 0, 0, 0, 0)] + [("h", "0" * 16, 0.0), ("h", "0" * 12 + "1fff", 2.5)]
    df = spark.createDataFrame(rows, "g string, phash string, time double").withColumn("bits", hash_bits(F.col("phash")))
    got = {r.g: (r.dup_size, r.dup_span_s, r.dup_maxdist, r.dup_loose) for r in clusters.cluster_spread(df, ["g"]).collect()}
    assert got == {"g": (6, 0.0, 0, True), "h": (2, 2.5, 13, True)}


def test_cross_similar_is_inclusive(spark):
    rows = [("a", "IMG", 0.0), ("b", "LIV", 5.0), ("c", "LIV", 5.1)]
    df = spark.createDataFrame([(p, p, "r", "cam", s, None, t, "0" * 16) for p, s, t in rows], PHOTO).withColumn("bits", hash_bits(F.col("phash")))
    pairs = clusters.cross_similar(df, ["root"])
    assert {r.primary: r.similar_cross for r in clusters.similar_lists(pairs).collect()} == {"a": ["b"], "b": ["a"]}


def test_relative_blink(spark):
    rows = [("f1", "p1", 100.0, 100.0, 50.0, 0.1, 0.1, True), ("f2", "p2", 105.0, 100.0, 52.0, 0.5, 0.2, True), ("f3", "p2", 400.0, 100.0, 50.0, 0.9, 0.9, True), ("f4", "p1", 100.0, 100.0, 0.0, 0.9, 0.9, True)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, face string, photo string, cx double, cy double, h double, blink_l double, blink_r double, subject boolean")
    scored, photos = clusters.relative_blink(df, ["g"])
    assert {r.face: r.rel_blink for r in scored.collect()} == {"f1": 0.0, "f2": 0.4, "f3": None, "f4": None}
    assert {r.photo: r.eye_rel_closed_n for r in photos.collect()} == {"p1": 0, "p2": 1}


def test_greedy_and_merge(spark):
    left = spark.createDataFrame([("k", "i1"), ("k", "i2"), (None, "i3")], "key string, id string")
    right = spark.createDataFrame([("k", "r1"), (None, "r2")], "key string, id string")
    assert sorted((r.id, r.match.id) for r in catalog.greedy_match(left, right, ["key"], ["id"], ["id"]).collect()) == [("i1", "r1"), ("i3", "r2")]
    groups = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", None), ("e", "")], "g string, cid string")
    assert {r.g: r.merged for r in catalog.merge_by_shared_id(groups, "g", "cid").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_vendor_roles(spark):
    rows = [("1", "d/IMG.jpg", "image", None), ("1", "d/IMG.heic", "image", None), ("1", "d/s.mov", "video", 4.0), ("1", "d/l.mov", "video", 4.1), ("1", "d/p.lrv", "proxy", None), ("1", "d/x.xmp", "sidecar", None), ("2", "d/p2.lrv", "proxy", None), ("3", "d/v.mov", "video", 1.0), ("3", "d/v.xmp", "sidecar", None)]
    df = spark.createDataFrame(rows, "g string, path string, cls string, duration double")
    got = {r.path: (r.role, r.item) for r in catalog.vendor_items(df, ["g"], CONFIG).collect()}
    assert got["d/IMG.heic"] == ("item", "d/IMG.heic") and got["d/IMG.jpg"] == ("companion", "d/IMG.heic")
    assert got["d/s.mov"] == ("companion", "d/IMG.heic") and got["d/l.mov"] == ("item", "d/l.mov") and got["d/p.lrv"] == ("companion", "d/l.mov")
    assert got["d/x.xmp"][1] == "d/IMG.heic" and got["d/p2.lrv"] == ("orphan", None) and got["d/v.mov"][0] == "item" and got["d/v.xmp"] == ("companion", "d/v.mov")


def test_plan_rules(spark):
    plan = [("a", "00", "模糊", None), ("b", "00", "nonsense", None), ("c", "01", "x", None), ("d", "09", None, None), ("zz", "03", None, None), (None, "03", None, None), ("e", "03", DUPLICATE_REASON, "a"), ("f", "03", DUPLICATE_REASON, None), ("g", "03", DUPLICATE_REASON, "nowhere"), ("h", "03", "bad reason!", None), ("a", "02", None, None), ("p.lrv", "03", None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(plan)], "primary string, tier string, reason string, keep string, ord int")
    items = spark.createDataFrame([(x,) for x in "abcdefghij"], "primary string")
    dups = spark.createDataFrame([("a", "D001"), ("e", "D002"), ("f", "VD001")], "primary string, dup_group string")
    got = sorted((r.rule, r.primary or "") for r in planning.validate_plan(df, items, dups).collect())
    assert got == sorted([("reason_delete", "b"), ("reason_review", "c"), ("tier", "d"), ("unknown", "zz"), ("primary_missing", ""), ("keep_group", "e"), ("keep_deleted", "e"), ("keep_missing", "f"), ("keep_unknown", "g"), ("reason_text", "h"), ("repeated", "a"), ("proxy", "p.lrv"), ("unknown", "p.lrv"), ("not_planned", "i"), ("not_planned", "j")])


def test_destinations_and_collisions(spark):
    files = spark.createDataFrame([("e1", "a.jpg", "02", None), ("e1", "a.mov", "02", None), ("e2", "b.jpg", "02", None)], "primary string, path string, tier string, reason string")
    taken = spark.createDataFrame([("02_优秀/a.mov",), ("02_优秀/a_2.jpg",)], "path string")
    got = planning.destinations(files, taken)
    assert {r.path: r.dst for r in got.collect()} == {"a.jpg": "02_优秀/a_3.jpg", "a.mov": "02_优秀/a_3.mov", "b.jpg": "02_优秀/b.jpg"}
    assert planning.colliding(got).count() == 0
    assert planning.is_stale(1.0, [1.0, 1.5]) and not planning.is_stale(1.0, [1.0])


def test_destinations_go_on_until_no_entry_clashes(spark):
    files = spark.createDataFrame([("e1", "a.jpg", "02", None), ("e1", "a.mov", "02", None), ("e2", "b.jpg", "02", None), ("e3", "c.jpg", "02", None)], "primary string, path string, tier string, reason string")
    taken = spark.createDataFrame([("02_优秀/a.mov",), *((f"02_优秀/a_{k}.jpg",) for k in range(2, 121)), ("02_优秀/c.jpg",)], "path string")
    want = {"a.jpg": "02_优秀/a_121.jpg", "a.mov": "02_优秀/a_121.mov", "b.jpg": "02_优秀/b.jpg", "c.jpg": "02_优秀/c_2.jpg"}
    assert {r.path: r.dst for r in planning.destinations(files, taken).collect()} == want


def test_ledger(spark):
    log = [("B1", 1, "a", "t/a", "pending"), ("B1", 1, None, None, "done"), ("B1", None, None, None, "undone"), ("B2", 1, "a", "t/a", "pending"), ("B2", 1, None, None, "done"), ("B2", 2, "b", "t/b", "pending"), ("B2", 3, "c", "t/c", "pending"), ("B2", 3, None, None, "done"), ("B2", 4, "._d", "t/._d", "auto"), ("B2", 5, "e", "t/e", "pending"), ("B2", 5, None, None, "done")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(log)], "batch string, seq long, src string, dst string, state string, ord long")
    assert [r.batch for r in ledger.open_batches(df).collect()] == ["B2"]
    exists = spark.createDataFrame([("t/a",), ("b",), ("c",), ("t/c",), ("t/._d",)], "path string")
    rows = ledger.undo_actions(df, exists).orderBy("turn").collect()
    assert [(r.seq, r.action) for r in rows] == [(5, "conflict_none"), (3, "conflict_both"), (2, "skip"), (1, "restore"), (4, "restore_auto")]
    m2 = spark.createDataFrame([("d/._x.jpg",), ("d/x.jpg",), ("._y",)], "path string")
    assert [r.path for r in ledger.orphan_shadows(m2).collect()] == ["._y"]
    folders = spark.createDataFrame([("d",), ("e",), ("e/f",)], "path string")
    files = spark.createDataFrame([("d/x.jpg",), ("e/f/.DS_Store",), ("e/._z",)], "path string")
    assert sorted(map(tuple, ledger.empty_folders(folders, files).collect())) == [("e", 1), ("e/f", 2)]


def test_eye_states(spark):
    rows = [(0.5, 0.5, 0, 0, "closed", None), (0.5, 0.1, 0, 0, "half", None), (0.35, 0.35, 0, 0, "half", None), (0.34, 0.35, 0, 0, "open", None), (0.6, 0.6, 0.4, 0.4, "half", "smile_squint"), (None, 0.1, 0, 0, "unsure", None)]
    s = eyes.eye_state(F.col("l"), F.col("r"), F.col("sq"), F.col("sm"), F.lit(0.0), F.lit(300.0), F.lit(1000.0), F.lit(False))
    df = [(l, r, float(sq), float(sm), st, n) for l, r, sq, sm, st, n in rows]
    assert all((g["eye_state"], g["note"]) == (st, n) for g, st, n in col(spark, "l double, r double, sq double, sm double, st string, n string", df, s, "st", "n"))


def test_pixels(spark):
    flat = np.full((64, 64), 128, np.uint8)
    blur, sharp, _, bright, _, _, ent, _ = pixels.gray_measures(flat)
    assert (blur, sharp, bright, ent) == (0.0, 0.0, 128.0, 0.0)
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 256, (256, 256)).astype(np.uint8)
    smooth = np.kron(rnd.integers(0, 256, (16, 16)), np.ones((16, 16))).astype(np.uint8)
    noisy = np.clip(smooth + rnd.normal(0, 3, smooth.shape), 0, 255).astype(np.uint8)
    distance = lambda x, y: bin(int(pixels.perceptual_hash(x), 16) ^ int(pixels.perceptual_hash(y), 16)).count("1")
    assert distance(smooth, noisy) <= 6 < distance(smooth, a)
    dx, dy = pixels.phase_shift(a.astype(float), np.roll(a, (3, 5), (0, 1)).astype(float))
    assert dx == pytest.approx(5, abs=0.5) and dy == pytest.approx(3, abs=0.5)
    frames = [("v", w, i, np.roll(a, (0, 3 * i * i), (0, 1)).tobytes()) for w in range(2) for i in range(5)] + [("short", 0, 0, a.tobytes()), ("short", 0, 1, b"x")]
    df = spark.createDataFrame(frames, "video string, window int, i int, data binary")
    got = {r.video: r.shake for r in pixels.shake_score(pixels.shake_of_frames(df)).collect()}
    assert set(got) == {"v"} and got["v"] == pytest.approx(6, abs=0.5)
    images = spark.createDataFrame([("a", 64, 64, 1, flat.tobytes()), ("bad", 64, 64, 1, b"x"), ("none", None, None, None, None)], pixels.IMAGE_TYPE)
    assert {r.path: r.error is None for r in pixels.image_measures(images).collect()} == {"a": True, "bad": False, "none": False}
