"""Orphan references, sessions and instants: defined edge cases and sequential models."""

import os
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from reelsift.functions.text import nfc
from reelsift.operators.current import current_rows
from reelsift.shared import materialize, scope
from reelsift.operators.instants import instant_dictionary, known_zone, normalise_instants, offset_zone, parse_instants
from reelsift.operators.references import orphan_references, orphan_report
from reelsift.operators.sessions import sessions

T0 = datetime(2024, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


def test_current_rows_counts_copies_once_and_ignores_null_keys(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 3, "z"), ("b", None, "q")]
    df = spark.createDataFrame(rows, "k string, v int, x string").withColumn("__rank", F.lit(9))
    assert sorted(map(tuple, current_rows(df, "k", "v", ["x"]).collect())) == [("a", "y"), ("b", "q")]
    assert current_rows(df.limit(0), "k", "v", ["x"]).count() == 0


def test_orphans_by_status(spark):
    parents = spark.createDataFrame(
        [("item", "a", day(1), day(5)), ("item", "b", day(3), None), ("item", "back", day(1), day(2)), ("item", "back", day(6), None), ("item", None, day(1), None), ("item", "never", None, None)],
        "kind string, key string, start timestamp, end timestamp",
    )
    refs = [("r1", "a", day(2)), ("r2", "a", day(5)), ("r3", "b", day(2)), ("r4", "none", day(2)), ("r5", "", day(2)), ("r6", None, day(2)), ("r7", "back", day(4)), ("r8", "back", day(7)), ("r9", "b", None), ("r4", "none", day(2)), ("r10", "never", day(9))]
    df = spark.createDataFrame([("item", *r) for r in refs], "kind string, id string, target string, at timestamp").withColumn("spans", F.lit(1))
    got = orphan_references(df, parents)
    assert sorted((r.id, r.status) for r in got.collect()) == sorted([("r2", "deleted"), ("r3", "late"), ("r4", "missing"), ("r4", "missing"), ("r7", "deleted"), ("r9", "undated"), ("r10", "missing")])
    report = {(r.month, r.status): r.n for r in orphan_report(got, ["kind"]).collect()}
    assert report[("2024-01", "missing")] == 3 and report[(None, "undated")] == 1
    assert orphan_references(df.limit(0), parents).count() == 0
    assert orphan_references(df, parents.limit(0)).where("status = 'missing'").count() == 9


def test_nfc(spark):
    df = spark.createDataFrame([("é",), ("plain",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(nfc(F.col("s"))).collect()] == ["é", "plain", None, ""]


def model_sessions(rows, gap):
    out = {}
    by = {}
    for k, t, e, label in rows:
        if k is not None and t is not None and t == t and abs(t) != float("inf"):
            by.setdefault(k, []).append((t, label or "", e if e is not None and e == e else t))
    for k, items in by.items():
        reach, cur = None, None
        for t, label, e in sorted(items):
            if reach is None or t - reach > gap:
                cur = out.setdefault(k, [])
                cur.append([t, label, label, 0])
            s = out[k][-1]
            s[2], s[3] = label, s[3] + 1
            reach = e if reach is None else max(reach, e)
    return sorted((k, s[1], s[2], s[3]) for k, v in out.items() for s in v)


def test_sessions_match_a_sequential_model_however_chunks_are_cut(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(1500):
        k = rnd.choice(["hot"] * 4 + ["b", "c", None])
        t = rnd.choice([rnd.uniform(0, 60_000), float(rnd.randrange(0, 60_000, 600)), None, float("nan")])
        e = None if t is None or rnd.random() < 0.6 else t + rnd.choice([1.0, 700.0, 5000.0])
        rows.append((k, t, e, f"p{i:05d}"))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k string, t double, e double, label string").withColumn("n", F.lit("clash"))
    want = model_sessions(rows, 600.0)
    for chunk in (3600.0, 100.0, 1e9):
        got = sessions(df, "k", "t", "e", "label", 600.0, chunk)
        assert sorted((r.k, r.first_label, r.last_label, r.n_items) for r in got.collect()) == want
    assert sessions(df.limit(0), "k", "t", "e", "label").count() == 0


def test_a_gap_of_exactly_the_limit_stays_together(spark):
    df = spark.createDataFrame([("d", 0.0, None, "a"), ("d", 600.0, None, "b"), ("d", 1200.001, None, "c")], "k string, t double, e double, l string")
    assert sorted(r.n_items for r in sessions(df, "k", "t", "e", "l", 600.0).collect()) == [1, 2]


def us(y, mo, d, h=0, mi=0, s=0, u=0, tz=timezone.utc):
    return int(round(datetime(y, mo, d, h, mi, s, tzinfo=tz).timestamp())) * 1_000_000 + u


def test_layouts(spark):
    cases = [
        ("2024:06:26 10:14:09.588+01:00", "UTC", us(2024, 6, 26, 9, 14, 9, 588000)),
        ("  2024:06:06 20:23:54 ", "Asia/Kolkata", us(2024, 6, 6, 14, 53, 54)),
        ("2024-05-23T02:34:51.901417Z", "Asia/Kolkata", us(2024, 5, 23, 2, 34, 51, 901417)),
        ("20240804T065322.712+0100", "UTC", us(2024, 8, 4, 5, 53, 22, 712000)),
        ("2024-06-03 10:28:03 -0700", "UTC", us(2024, 6, 3, 17, 28, 3)),
        ("1 Jan 2025 16:24:14 +08:00", "UTC", us(2025, 1, 1, 8, 24, 14)),
        ("26 jun 2024 10:14:07", "+05:30", us(2024, 6, 26, 4, 44, 7)),
        ("1716431654.548", "Asia/Kolkata", 1716431654548000),
        ("1719376787928", "UTC", 1719376787928000),
        ("unknown", "UTC", None),
        ("    :  :     :  :  ", "UTC", None),
        ("0000:00:00 00:00:00", "UTC", None),
        ("2024:13:01 00:00:00", "UTC", None),
        ("2023:02:29 10:00:00", "UTC", None),
        ("2024:02:29 25:00:00", "UTC", None),
        ("31 Foo 2024 10:00:00", "UTC", None),
        ("", "UTC", None),
        (None, "UTC", None),
        ("x" * 5000 + "1", "UTC", None),
        # A repeated hour: the first; a skipped one: forward by the gap.
        ("2024:10:27 02:30:00", "Europe/Berlin", us(2024, 10, 27, 0, 30)),
        ("2024:03:31 02:30:00", "Europe/Berlin", us(2024, 3, 31, 1, 30)),
        ("2025:04:06 02:15:00", "Australia/Sydney", us(2025, 4, 5, 15, 15)),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, raw string, zone string, want long")
    for r in parse_instants(df).collect():
        assert r.micros == r.want, r


def test_local_times_agree_with_zoneinfo(spark):
    rnd = random.Random(2)
    zones = ["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Sydney", "UTC"]
    rows = []
    for i in range(400):
        z = rnd.choice(zones)
        t = datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(2 * 365 * 86400))
        rows.append((i, t.strftime("%Y:%m:%d %H:%M:%S"), z, int(t.replace(tzinfo=ZoneInfo(z), fold=0).timestamp()) * 1_000_000))
    df = spark.createDataFrame(rows, "i int, raw string, zone string, want long")
    assert parse_instants(df).where("micros <> want OR micros IS NULL").count() == 0


def test_offsets(spark):
    cases = {"+1": "+01:00", "-7": "-07:00", "+0530": "+05:30", "-08:00": "-08:00", "UTC+05:45": "+05:45", "Z": "+00:00", " +05:30 ": "+05:30", "": None, "abc": None, "+19:00": None, "+05:75": None, "5": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "o string, want string")
    for r in df.select("o", "want", offset_zone(F.col("o")).alias("got")).collect():
        assert r.got == r.want, r


def test_first_valid_source_counts_and_rows_stay(spark):
    rows = [("a", "bad", "2024:01:01 00:00:00"), ("a", "bad", "2024:01:01 00:00:00"), ("b", "2024:01:02 00:00:00", "2024:01:01 00:00:00"), ("c", None, ""), ("d", "0000:00:00 00:00:00", None), (None, None, None)]
    df = spark.createDataFrame(rows, "id string, x string, y string").withColumn("raw", F.lit(1)).withColumn("micros", F.lit("m"))
    got = normalise_instants(df, [("x", F.col("x"), F.lit("UTC")), ("y", F.col("y"), F.lit("UTC"))])
    assert got.columns == [*df.columns, "instant_us"]
    assert sorted((r.id or "", r.instant_us or 0) for r in got.collect()) == sorted([("a", us(2024, 1, 1)), ("a", us(2024, 1, 1)), ("b", us(2024, 1, 2)), ("c", 0), ("d", 0), ("", 0)])
    assert normalise_instants(df.limit(0), [("x", F.col("x"), F.lit("UTC"))]).count() == 0


def test_dictionary_grows(spark, tmp_path):
    path = str(tmp_path / "dict")
    keys = spark.createDataFrame([("s", "2024:01:01 00:00:00", "UTC"), ("s", "2024:01:01 00:00:00", "UTC"), ("s", None, "UTC")], "source string, raw string, zone string")
    assert instant_dictionary(keys, path).count() == 1
    more = keys.unionByName(spark.createDataFrame([("s", "zzz", "UTC")], "source string, raw string, zone string"))
    assert sorted((r.raw, r.micros) for r in instant_dictionary(more, path).collect()) == [("2024:01:01 00:00:00", us(2024, 1, 1)), ("zzz", None)]
    # Two writers at once: the file holds a key twice, the dictionary doesn't.
    spark.read.parquet(path).limit(1).write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 3 and instant_dictionary(more, path).count() == 2


def test_unknown_zones_are_utc(spark):
    df = spark.createDataFrame([("Europe/Berlin",), ("Mars/Phobos",), (None,), ("",)], "z string")
    assert [r[0] for r in df.select(known_zone(spark, F.col("z"))).collect()] == ["Europe/Berlin", "UTC", "UTC", "UTC"]


def test_scopes_delete_what_they_wrote(spark):
    df = spark.range(3)
    kept = materialize(df, "kept")
    with scope():
        inner = materialize(df, "inner")
        with scope():
            innermost = materialize(df, "innermost")
        assert inner.count() == 3 and not os.path.exists(innermost._reelsift_path)
    assert not os.path.exists(inner._reelsift_path) and kept.count() == 3
