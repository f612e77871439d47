"""Readers, writers and streams on small files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift import schema
from reelsift.sources import files, sinks
from reelsift.streaming.sessions import stream_sessions


def test_walk_skips_hidden_and_tier_folders_but_not_underscores(spark, tmp_path):
    for p in ("_X0001.JPG", "._X0001.JPG", ".h/x.jpg", "99_报告/x.jpg", "03_普通/y.jpg", "a/é.heic", "a/notes.txt", "a/B.NEF"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"abc")
    m = files.manifest(spark, str(tmp_path))
    rows = {r.path: r for r in m.collect()}
    assert set(rows) == {"_X0001.JPG", "a/é.heic", "a/B.NEF"}
    assert rows["a/B.NEF"].ext == ".nef" and rows["a/B.NEF"].parent == "a" and rows["a/B.NEF"].size == 3
    listing = spark.createDataFrame([(p, 3, 0.0) for p in ("_X0001.JPG", ".h/x.jpg", "03_普通/y.jpg", "a/é.heic", "n.txt", None)], "path string, size bigint, mtime double")
    assert sorted(r.path for r in files.manifest_of_listing(listing).collect()) == ["_X0001.JPG", "a/é.heic"]
    assert files.count_files(m) == 3


def test_tags_keep_the_last_row_of_a_file(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps([{"SourceFile": "a.jpg", "Model": "x"}, {"SourceFile": "a.jpg", "Model": "y", "ShutterCount": 7}, {"Model": "none"}]))
    got = files.read_tags(spark, str(p))
    assert [(r.path, r.Model, r.ShutterCount) for r in got.collect()] == [("a.jpg", "y", "7")]
    f = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "path string")
    assert {r.path: r.Model for r in files.with_tags(f, got).collect()} == {"a.jpg": "y", "b.jpg": None}


def test_reports_and_logs(spark, tmp_path):
    r = tmp_path / "scan.json"
    r.write_text(json.dumps({"meta": {"n": 1}, "items": [{"id": "P0001", "primary": "a.jpg", "companions": ["a.mov"], "gps": [1.0, 2.0]}]}, indent=2))
    row = files.read_report(spark, str(r)).first()
    assert (row.id, row.companions, row.gps, row.scene) == ("P0001", ["a.mov"], [1.0, 2.0], None)
    r.write_text("{broken")
    with pytest.raises(Exception):
        files.read_report(spark, str(r)).collect()
    log = str(tmp_path / "log.jsonl")
    assert files.read_log(spark, log).count() == 0
    sinks.append_log(log, {"batch": "B1", "seq": 1, "src": "a", "dst": "b", "state": "pending"})
    sinks.append_log(log, {"batch": "B1", "seq": 1, "state": "done"})
    with open(log, "a") as f:
        f.write("\n")
    assert [(x.seq, x.state) for x in files.read_log(spark, log).orderBy("ord").collect()] == [(1, "pending"), (1, "done")]
    with open(log, "a") as f:
        f.write("{nope\n")
    with pytest.raises(Exception):
        files.read_log(spark, log).collect()
    sinks.write_report(spark.createDataFrame([("a",)], "primary string"), str(tmp_path / "out"), {"k": 1})
    assert spark.read.parquet(str(tmp_path / "out/items")).count() == 1
    assert json.loads(sinks.as_json(spark.createDataFrame([("a",)], "primary string")).first()[0]) == {"primary": "a"}


def test_images_sheets_and_fallbacks(spark, tmp_path):
    picture = np.zeros((40, 80, 3), np.uint8)
    picture[:, 40:] = 255
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.png").write_bytes(sinks.png(picture))
    (tmp_path / "i/bad.png").write_bytes(b"no image")
    rows = {os.path.basename(r.path): r for r in files.read_images(spark, str(tmp_path / "i")).collect()}
    assert rows["a.png"].width == 80 and rows["a.png"].height == 40 and rows["bad.png"].data is None
    sheet = sinks.contact_sheet([picture] * 4, cols=3, cell=50)
    assert sheet.shape == (100, 150, 3)

    def decode(b):
        if not bytes(b).endswith(b"ok"):
            raise ValueError
        return (len(b),)

    blobs = spark.createDataFrame([("a", b"xxok", None), ("b", b"xxokjunk", 4), ("c", b"junk", 2), ("d", b"junk", None)], "path string, content binary, primary_len bigint")
    got = {r.path: (r.n, r.used_fallback, r.error) for r in files.decode_with_fallback(blobs, decode, "n int").collect()}
    assert got == {"a": (4, False, None), "b": (4, True, None), "c": (None, False, "ValueError"), "d": (None, False, "ValueError")}
    c = spark.createDataFrame([("r", 0, 100, 50), ("r", 1, 200, 10), ("r", 2, 10, 200), ("r", 3, 0, 0)], "path string, ord int, width int, height int")
    assert [r.ord for r in files.best_preview(c).collect()] == [1]


def test_probe_and_tail(spark, tmp_path):
    text = json.dumps({"streams": [{"codec_type": "data"}, {"codec_type": "video", "width": 10, "height": 5, "r_frame_rate": "30000/1001", "codec_name": "hevc"}, {"codec_type": "audio"}], "format": {"duration": "12.5"}})
    df = spark.createDataFrame([(text,), ("{}",), ("not json",), (None,)], "j string")
    got = [r[0] for r in df.select(files.probe_fields(F.col("j"))).collect()]
    assert (got[0].width, got[0].fps, got[0].has_audio, got[0].duration) == (10, 29.97, True, 12.5)
    assert all(g.width is None and not g.has_audio for g in got[1:])
    (tmp_path / "v1").write_bytes(b"x" * 100 + b"I_Log" + b"y" * 20)
    (tmp_path / "v2").write_bytes(b"I_Log" + b"x" * 100)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("v1", "v2", "gone")], "path string")
    assert [r.color_mode for r in files.tail_color_mode(paths, n_bytes=60).collect()] == ["ilog", "standard", None]


def test_a_stored_scan_is_rebuilt_only_when_files_change(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, 1.0)], "path string, size bigint, mtime double")
    built = []

    def build(n):
        built.append(n)
        return spark.createDataFrame([(n,)], "n int")

    store = str(tmp_path / "scan")
    assert files.ensure_scan(spark, m, store, lambda: build(1)).first().n == 1
    assert files.ensure_scan(spark, m, store, lambda: build(2)).first().n == 1
    assert files.ensure_scan(spark, m.withColumn("size", F.lit(2).cast("bigint")), store, lambda: build(3)).first().n == 3
    assert built == [1, 3]


def test_stream_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7), (2, "2024-01-01 00:10:00", 7), (3, "2024-01-01 00:30:00", 7), (4, "2024-01-01 05:00:00", 8), (5, None, 8)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, "user_id", "ts").writeStream.format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.n_events) for r in spark.table("sess").collect()) == [(7, 1), (7, 2)]


def test_schema_of_a_report():
    assert "gps: ARRAY<DOUBLE>" in schema.report(schema.ITEM)
