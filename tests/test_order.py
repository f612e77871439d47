"""Places, carried values, percentiles and farthest pairs against plain models, with one group that holds most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.operators.clusters import farthest
from reelsift.operators.order import carried_last, place_along, selected_percentile


def groups(rnd, n):
    return [("hot", None, "b")[0 if rnd.random() < 0.7 else int(rnd.integers(1, 3))] for _ in range(n)]


def test_places_count_along_an_order(spark):
    rnd = np.random.default_rng(1)
    rows = [(g, float(rnd.integers(0, 40)) if i % 9 else None, f"p{i:04d}") for i, g in enumerate(groups(rnd, 600))]
    df = spark.createDataFrame(rows, "root string, time double, id string").withColumn("n", F.lit("clash"))
    got = {r.id: r.n for r in place_along(df, ["root"], [F.col("time").isNull(), F.col("time"), F.col("id")], "n").collect()}
    want = {}
    for g in ("hot", None, "b"):
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2])), 1):
            want[r[2]] = k
    assert got == want
    assert place_along(df.limit(0), ["root"], [F.col("id")], "n").count() == 0


def test_values_are_carried_over_chunks(spark):
    rnd = np.random.default_rng(2)
    rows = [(g, int(rnd.integers(0, 300)), i, int(rnd.integers(100)) if rnd.random() < 0.2 else None) for i, g in enumerate(groups(rnd, 500))]
    df = spark.createDataFrame(rows, "root string, t int, id int, v int")
    want = {}
    for g in ("hot", None, "b"):
        last = None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            want[r[2]] = last
            last = r[3] if r[3] is not None else last
    for width in (1, 17, 1000):
        got = carried_last(df, ["root"], [F.col("t"), F.col("id")], F.floor(F.col("t") / width), "v", "before")
        assert {r.id: r.before for r in got.collect()} == want
    assert carried_last(df.limit(0), ["root"], [F.col("t")], F.lit(0), "v", "before").count() == 0


def test_percentiles_are_selected(spark):
    rnd = np.random.default_rng(3)
    values = np.concatenate([rnd.normal(0, 50, 300), -(10.0 ** rnd.uniform(-300, 300, 50)), [0.0, 5.0] * 40])
    rows = [("hot" if i % 4 else "b", float(x), int(rnd.integers(1, 5))) for i, x in enumerate(values)] + [("one", 7.0, 1), ("two", 1.0, 1), ("two", 2.0, 1)]
    df = spark.createDataFrame(rows, "k string, x double, w int")
    for share in (0.0, 0.5, 0.9, 1.0):
        got = {r.k: (r.percentile, r.n) for r in selected_percentile(df, ["k"], "x", "w", share).collect()}
        for k in ("hot", "b", "one", "two"):
            all_ = np.repeat([x for g, x, _ in rows if g == k], [w for g, _, w in rows if g == k])
            assert got[k] == (pytest.approx(float(np.quantile(all_, share)), rel=1e-9, abs=1e-9), len(all_))
    assert selected_percentile(df.limit(0), ["k"], "x", "w").count() == 0


def test_farthest_pairs_of_large_groups(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for g, spread in (("ball", 4), ("wide", 30), ("pair", 3), ("single", 0)):
        centre = int(rnd.integers(0, 2**63))
        n = {"pair": 2, "single": 1}.get(g, 150)
        hashes = set()
        while len(hashes) < n:
            h = centre
            for bit in rnd.integers(0, 64, int(rnd.integers(0, spread + 1))):
                h ^= 1 << int(bit)
            hashes.add(h)
        rows += [(g, h - (1 << 64) if h >= 1 << 63 else h) for h in hashes]
    df = spark.createDataFrame(rows, "g string, bits long")
    want = {g: max(((a ^ b) & (2**64 - 1)).bit_count() for k, a in rows if k == g for j, b in rows if j == g) for g in ("ball", "wide", "pair")}
    for few in (1, 64, 1000):
        assert {r.g: r.far for r in farthest(df, ["g"], few).collect()} == want
    assert farthest(df.limit(0), ["g"]).count() == 0
