"""The operators against brute force, with their defined edge cases."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelsift.llm import leaks, lookalikes, mixture, nearest, percentiles, queries, spans, survivor
from reelsift.llm.components import connected_components


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("a000", f"s{i:03d}") for i in range(80)]
    noise = [(f"n{rnd.randrange(150):03d}", f"n{rnd.randrange(150):03d}") for _ in range(90)]
    pairs = [*chain, *star, *noise, ("x", "x"), ("y", "z"), ("z", "y"), ("y", "z")]
    rnd.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, "q"), ("q", None)], "a string, b string")
    assert {r.node: r.component for r in connected_components(df).collect()} == union_find(pairs)
    assert connected_components(df.limit(0)).count() == 0


def test_stills_match_all_pairs_also_in_hot_buckets(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(260):
        base = rnd.choice([0, (1 << 64) - 1, rnd.getrandbits(64)]) if i < 120 else int(rows[rnd.randrange(len(rows))][4] or "0", 16)
        for b in rnd.sample(range(64), rnd.randrange(0, 8)):
            base ^= 1 << b
        hex_ = f"{base:016x}"
        rows.append((f"p{i:04d}", rnd.choice(["r1", "r2", None]), rnd.choice([" cam ", "cam", "", None, "other"]), rnd.choice(["IMG", None]), hex_.upper() if i % 3 else hex_))
    rows += [("bad1", "r1", "cam", "IMG", "xyz"), ("bad2", "r1", "cam", "IMG", None), ("bad3", "r1", "cam", "IMG", "")]
    key = lambda r: (r[1], (r[2] or "").strip() or None, r[3])
    good = [r for r in rows if not r[0].startswith("bad")]
    pairs = [(a[0], b[0]) for a, b in combinations(good, 2) if key(a) == key(b) and bin(int(a[4], 16) ^ int(b[4], 16)).count("1") <= 6]
    want = sorted((g, p) for p, g in union_find(pairs).items())
    df = spark.createDataFrame(rows, "primary string, root string, device string, subtype string, phash string").withColumn("node", F.lit("clash"))
    for hot in (256, 3):
        assert sorted(map(tuple, lookalikes.still_graph(df, hot=hot).groups().collect())) == want
    assert lookalikes.still_graph(df.limit(0)).groups().count() == 0


def test_videos_match_all_pairs_also_in_hot_buckets(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(150):
        if rows and rnd.random() < 0.7:
            frames = [int(x, 16) for x in rows[rnd.randrange(len(rows))][3]]
            for _ in range(rnd.randrange(0, 9 * len(frames))):
                frames[rnd.randrange(len(frames))] ^= 1 << rnd.randrange(64)
        else:
            frames = [rnd.choice([0, rnd.getrandbits(64)]) for _ in range(rnd.choice([1, 2, 3, 5, 6]))]
        rows.append((f"v{i:04d}", rnd.choice(["r1", None]), rnd.choice([10.0, 8.0, 7.9, 12.5, 30.0, 36.0, 0.0]), [f"{x:016x}" for x in frames], None))
    odd = [("o1", "r1", 10.0, [], None), ("o2", "r1", 10.0, None, None), ("o3", "r1", None, rows[0][3], None), ("o4", "r1", float("nan"), rows[0][3], None), ("o5", rows[0][1], rows[0][2], rows[0][3], "unreadable"), ("o6", "r1", 10.0, [None], None)]

    def match(a, b):
        if a[1] != b[1] or len(a[3]) != len(b[3]) or abs(a[2] - b[2]) > 0.2 * max(a[2], b[2]):
            return False
        return sum(bin(int(x, 16) ^ int(y, 16)).count("1") for x, y in zip(a[3], b[3])) <= 6 * len(a[3])

    want = sorted((g, p) for p, g in union_find([(a[0], b[0]) for a, b in combinations(rows, 2) if match(a, b)]).items())
    df = spark.createDataFrame(rows + odd, "primary string, root string, duration double, phashes array<string>, error string")
    for hot in (256, 3):
        assert sorted(map(tuple, lookalikes.video_graph(df, hot=hot).groups().collect())) == want


def test_percentiles_are_exact_and_states_combine(spark):
    rnd = np.random.default_rng(1)
    values = np.concatenate([rnd.normal(0, 1e3, 400), -rnd.random(50) * 1e-300, [0.0, -0.0, 1e308, 5e-324] * 3])
    rows = [(rnd.choice(["a", "b"]) if i % 7 else None, float(v)) for i, v in enumerate(values)]
    rows += [("a", None), ("a", float("nan")), ("a", float("inf")), ("only", None)]
    df = spark.createDataFrame(rows, "g string, x double").withColumn("cell", F.lit(1))
    shares = {"lo": 0.0, "p33": 0.33, "mid": 0.5, "hi": 1.0}
    got = {r.g: r for r in percentiles.percentiles(percentiles.cells(df, ["g"], "x"), ["g"], shares).collect()}
    for g in ("a", "b", None):
        xs = [v for k, v in rows if k == g and v is not None and np.isfinite(v)]
        assert got[g].n_values == len(xs)
        for name, p in shares.items():
            assert got[g][name] == pytest.approx(float(np.quantile(xs, p)), rel=1e-9, abs=1e-320)
    assert "only" not in got
    parts = [percentiles.state(df.where(F.pmod(F.hash("x"), F.lit(3)) == i), ["g"], "x", digits=2) for i in range(3)]
    near = {r.g: r for r in percentiles.percentiles(percentiles.combine(parts, ["g"]), ["g"], shares, digits=2).collect()}
    for g in ("a", "b", None):
        for name in ("p33", "mid", "hi"):
            assert abs(near[g][name] - got[g][name]) <= max(abs(got[g][name]) * 2.0**-19, 1e-200)
    assert percentiles.percentiles(percentiles.cells(df.limit(0), ["g"], "x"), ["g"], shares).count() == 0


def test_nearest_matches_brute_force(spark):
    rnd = random.Random(8)
    t0 = 1_720_000_000.0
    draw = lambda: rnd.choice([t0 + rnd.uniform(0, 400), t0 + rnd.randrange(0, 400), t0 + rnd.randrange(0, 3200) / 8, None, float("nan"), float("inf")])
    left = [(f"l{i:04d}", rnd.choice(["a", "a", "b", None]), draw()) for i in range(300)]
    right = [(f"r{i:04d}" if i % 40 else None, rnd.choice(["a", "a", "b", None]), draw()) for i in range(120)]
    left += left[:5]
    usable = lambda k, t: k is not None and t is not None and abs(t) < float("inf")
    want = []
    for name, k, t in left:
        if usable(k, t):
            near = [(abs(t - u), r) for r, j, u in right if r is not None and usable(j, u) and j == k and abs(t - u) <= 5]
            if near:
                want.append((name, min(near)[1]))
    schema = "id string, key string, time double"
    ldf, rdf = spark.createDataFrame(left, schema).withColumn("near_label", F.lit("clash")), spark.createDataFrame(right, schema)
    # 2048.0: everything in one bucket.
    for finest in (0.125, 2.0, 8.0, 2048.0):
        got = nearest.nearest_in_time(ldf, rdf, "key", "time", "id", 5.0, finest)
        assert sorted((r.id, r.near_label) for r in got.collect()) == sorted(want)
    assert nearest.nearest_in_time(ldf.limit(0), rdf, "key", "time", "id", 5.0).count() == 0
    assert nearest.nearest_in_time(ldf, rdf.limit(0), "key", "time", "id", 5.0).count() == 0


def test_survivors_order_ties_and_nulls(spark):
    rows = [("r", "D1", "b", False, 2), ("r", "D1", "a", False, 2), ("r", "D1", "c", True, 9), ("r", "D2", "only", False, 1), ("r", None, "x", False, 1), (None, "D1", "x", False, 1), ("r", "D3", "p", True, None), ("r", "D3", "q", True, 1)]
    df = spark.createDataFrame(rows, "root string, g string, id string, dirty boolean, open int")
    got = survivor.survivors(df, ["root", "g"], [F.col("dirty"), -F.coalesce("open", F.lit(0))], "id")
    assert sorted(map(tuple, got.collect())) == [("r", "D1", "a", 3), ("r", "D3", "q", 2)]


def test_fusion_trusts_accurate_sources_and_discounts_copies(spark):
    rnd = random.Random(9)
    rows = []
    for o in range(60):
        truth = f"t{o}"
        for s, p in (("good1", 0.95), ("good2", 0.9), ("good3", 0.9)):
            rows.append((f"o{o}", "f", s, truth if rnd.random() < p else f"w{rnd.randrange(9)}", 5.0))
        lie = truth if rnd.random() < 0.3 else f"lie{o % 7}"
        for s in ("bad", "copy1", "copy2", "copy3"):
            rows.append((f"o{o}", "f", s, lie, 1.0 if s == "bad" else 2.0))
    rows += [("o1", "f", None, "x", 1.0), ("o1", None, "good1", "x", 1.0), ("o1", "f", "good1", None, 1.0), (None, "f", "good1", "x", 1.0)]
    df = spark.createDataFrame(rows, "object string, field string, source string, value string, at double")
    got = {r.object: r.value for r in survivor.fuse(df, rounds=4).collect()}
    right = sum(got[f"o{o}"] == f"t{o}" for o in range(60))
    votes = 0
    for o in range(60):
        vs = [r[3] for r in rows if r[0] == f"o{o}" and r[3]]
        votes += max(set(vs), key=vs.count) == f"t{o}"
    assert right > 50 > votes
    assert survivor.fuse(df.limit(0)).count() == 0


def test_copies_among_later_sources_are_discounted(spark):
    rnd = random.Random(24)
    rows = []
    for o in range(60):
        truth, lie = f"t{o}", f"t{o}" if rnd.random() < 0.3 else f"lie{o % 7}"
        for s, p, at in (("good1", 0.95, 1.0), ("good2", 0.9, 2.0), ("good3", 0.9, 2.0)):
            rows.append((f"o{o}", "f", s, truth if rnd.random() < p else f"w{rnd.randrange(9)}", at))
        rows += [(f"o{o}", "f", s, lie, at) for s, at in (("bad", 3.0), ("copy1", 4.0), ("copy2", 4.0), ("copy3", 4.0))]
    df = spark.createDataFrame(rows, "object string, field string, source string, value string, at double")
    got = {r.object: r.value for r in survivor.fuse(df).collect()}
    assert sum(got[f"o{o}"] == f"t{o}" for o in range(60)) > 50


def test_a_crowd_of_identical_sources_is_one_class(spark):
    rnd = random.Random(25)
    rows = []
    for o in range(40):
        truth, lie = f"t{o}", f"t{o}" if rnd.random() < 0.3 else f"lie{o % 7}"
        rows += [(f"o{o}", "f", s, truth if rnd.random() < 0.9 else f"w{rnd.randrange(9)}", 1.0) for s in ("good1", "good2", "good3")]
        rows += [(f"o{o}", "f", f"copy{i:03d}", lie, 2.0) for i in range(200)]
    # An object with thousands of sources, all of one common value, each with one of its own: no pair of them is compared.
    rows += [(f"big", f, f"s{i:04d}", v, None) for i in range(4000) for f, v in (("f", "same"), ("g", f"own{i}"))]
    df = spark.createDataFrame(rows, "object string, field string, source string, value string, at double")
    got = {(r.object, r.field): r for r in survivor.fuse(df).collect()}
    assert sum(got[f"o{o}", "f"].value == f"t{o}" for o in range(40)) > 33
    assert (got["big", "f"].value, got["big", "f"].n_sources) == ("same", 4000) and got["big", "g"].n_sources == 1


def fused_by_hand(rows, rounds=4):
    """The rounds over all pairs of sources with different claims, one after the other; a source has one value of a field."""
    copy, false, likely = 0.8, 10, lambda x, y: 1 / (1 + 9 / (0.5 * math.exp(max(min(x, 500), -500)) + 0.5 * math.exp(max(min(y, 500), -500))))
    claims, late, classes = {}, {}, {}
    for o, f, s, v, at in rows:
        claims.setdefault(s, {})[o, f] = v
        late[o, f, s] = (at is None, at or 0, s)
    for s, c in claims.items():
        classes.setdefault(tuple(sorted(c.items())), []).append(s)
    members = {min(m): m for m in classes.values()}
    first = {(g, c): min(late[(*g, s)] for s in m) for c, m in members.items() for g in claims[c]}
    votes = {}
    for c in members:
        for g, v in claims[c].items():
            votes.setdefault(g, {}).setdefault(v, []).append(c)
    both = {(a, b): [g for g in claims[a] if claims[b].get(g) == claims[a][g]] for a, b in combinations(sorted(members), 2)}
    both = {p: gs for p, gs in both.items() if gs}
    apart = {(a, b): len(claims[a].keys() & claims[b].keys()) - len(gs) for (a, b), gs in both.items()}
    agree = math.log((copy + 0.644 * 0.2) / 0.644)
    dep = {p: likely(*[len(gs) * agree + apart[p] * math.log(0.2)] * 2) for p, gs in both.items()}
    own, acc = {c: likely(*[len(claims[c]) * agree] * 2) for c in members}, dict.fromkeys(members, 0.8)
    for _ in range(rounds):
        post = {}
        for g, by in votes.items():
            score = {}
            for v, cs in by.items():
                score[v] = 0
                for c in cs:
                    free = math.prod((1 - copy * dep[min(c, x), max(c, x)]) ** len(members[x]) for x in cs if first[g, x] < first[g, c])
                    n = len(members[c])
                    score[v] += math.log(false * acc[c] / (1 - acc[c])) * (1 if n == 1 else (1 - (1 - copy * own[c]) ** n) / (copy * own[c])) * free
            score, most = {v: round(x, 9) for v, x in score.items()}, round(max(score.values()), 9)
            mass = sum(math.exp(x - most) for x in score.values()) + max(false + 1 - len(score), 0) * math.exp(-most)
            post |= {(g, v): math.exp(x - most) / mass for v, x in score.items()}
        acc = {c: min(max((sum(post[gv] for gv in claims[c].items()) + 1.6) / (len(claims[c]) + 2), 0.01), 0.99) for c in members}

        def ratio(o, p, q, kt, ks):
            pt, pf = p * q, (1 - p) * (1 - q) / false
            return kt * math.log((o * copy + pt * 0.2) / pt) + max(ks - kt, 0) * math.log(((1 - o) * copy + pf * 0.2) / pf)

        own = {c: likely(*[ratio(acc[c], acc[c], acc[c], sum(post[gv] for gv in claims[c].items()), len(claims[c]))] * 2) for c in members}
        dep = {(a, b): likely(*[ratio(x, acc[a], acc[b], sum(post[g, claims[a][g]] for g in gs), len(gs)) + apart[a, b] * math.log(0.2) for x in (acc[a], acc[b])]) for (a, b), gs in both.items()}
    best = {g: max(post[g, v] for v in by) for g, by in votes.items()}
    won = {g: min(v for v in by if post[g, v] == best[g]) for g, by in votes.items()}
    return {g: (v, round(best[g], 6), sum(len(members[c]) for c in votes[g][v])) for g, v in won.items()}


def fused(spark, rows):
    df = spark.createDataFrame(rows, "object string, field string, source string, value string, at double")
    return {(r.object, r.field): (r.value, round(r.posterior, 6), r.n_sources) for r in survivor.fuse(df).collect()}


def test_copies_are_discounted_however_many_share_a_value(spark):
    rnd = random.Random(26)
    rows = []
    for o in range(40):
        truth, lie = f"t{o}", f"t{o}" if rnd.random() < 0.3 else f"lie{o % 7}"
        rows += [(f"o{o:02d}", "f", f"good{i}", truth if rnd.random() < 0.9 else f"w{rnd.randrange(9)}", 1.0) for i in range(4)]
        # Copies are of one class nowhere: each has a value of its own, or one of a few others, in some place.
        rows += [(f"o{o:02d}", "f", f"copy{i:02d}", f"own{i}" if i % 40 == o else "slip" if i * 7 % 40 == o else lie, 2.0) for i in range(60)]
    got = fused(spark, rows)
    assert sum(v[0] == f"t{int(g[0][1:])}" for g, v in got.items()) > 33
    assert got == fused_by_hand(rows)


def test_rounds_match_all_pairs_in_groups_of_many_records(spark):
    rnd = random.Random(27)
    rows = []
    for o, n in enumerate((150, 90, 60, 12, 3, 1)):
        for i in range(n):
            at = rnd.choice([None, rnd.randrange(40) / 4])
            values = {"scene": rnd.choice("AAAAB"), "hdr": rnd.choice("tf"), "eyes": rnd.choice(["0"] * 20 + ["1", "2"]), "sharp": str(rnd.randrange(n * n // 2 + 1))}
            rows += [(f"o{o}", f, f"s{o}-{i:03d}", v, at) for f, v in values.items() if rnd.random() < 0.9]
            # Some repeat the one before.
            rows += [(f"o{o}", f, f"s{o}-{i:03d}-again", v, at) for f, v in values.items() if i % 30 == 0]
    assert fused(spark, rows) == fused_by_hand(rows)


def test_fused_groups_have_their_records_as_sources(spark, tmp_path):
    # (primary, dup_group, device, scene, eyes_closed_n, sharp_p90, suggested_keep)
    rows = [("a", "D1", "cam", "S1", 1, 5.0, "a"), ("b", "D1", "cam", "S1", 1, 5.0, "a"), ("c", "D1", "cam", "S9", 0, 9.0, "c")]
    rows += [("e", "D2", None, "S2", 2, float("nan"), None), ("f", "D2", " ", "S2", 2, 7.0, "f"), ("g", "D3", None, None, None, -1.0, None)]
    schema = "primary string, dup_group string, device string, scene string, eyes_closed_n int, sharp_p90 double, suggested_keep string"
    df = spark.createDataFrame(rows, schema).withColumns({"root": F.lit("r"), "zoom_bucket": F.lit(None).cast("string"), "hdr": F.col("primary") != "c", "time": F.lit(1.0), "run_at": F.lit("2024-01-01").cast("timestamp")})
    df.write.parquet(f"{tmp_path}/analysis.parquet")
    got = {r.dup_group: r for r in queries.p7_fused(spark, str(tmp_path)).collect()}
    values = {g: (r.scene, r.zoom_bucket, r.hdr, r.eyes_closed_n, r.sharp_p90, r.suggested_keep, r.n_sources) for g, r in got.items()}
    assert values == {"D1": ("S1", None, True, 1, 5.0, "a", 3), "D2": ("S2", None, True, 2, 7.0, "f", 2), "D3": (None, None, True, None, None, None, 1)}


def test_words():
    assert leaks.words_of("Größe_a1, x²—Ünï 3.5") == ["größe", "a1", "x", "ünï", "3", "5"]
    assert leaks.words_of(None) == [] and leaks.words_of("") == []


def ngrams(text, n):
    w = leaks.words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_exact_leaks_match_brute_force(spark):
    rnd = random.Random(10)
    vocab = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.randrange(5, 40))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for d in range(200):
        words = text(rnd.randrange(0, 60)).split()
        if d % 3 == 0:
            src = leaks.words_of(rnd.choice(items[:30])[1])
            n = rnd.choice([11, 12, 13, 40])
            at = rnd.randrange(0, max(1, len(src) - n))
            words[len(words) // 2 : len(words) // 2] = src[at : at + n]
        docs.append((d, " ,\n".join(words).upper()))
    docs += [(500, None), (501, ""), (502, "word " * 60_000 + items[0][1] + " end"), docs[0]]
    want = sorted({(d, i) for d, t in docs for i, u in items if ngrams(t, 12) & ngrams(u, 12)})
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (128_000_000, 20_000):
        assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(ddf, idf, block_bytes=block).collect()) == want
    short = {(d, i) for d, t in docs for i, u in items for n in [len(leaks.words_of(u))] if 0 < n < 12 and ngrams(t, n) & ngrams(u, n)}
    assert short and sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(ddf, idf, whole_short=True).collect()) == sorted(short.union(want))
    assert leaks.find_leaks(ddf.limit(0), idf).count() == 0 and leaks.find_leaks(ddf, idf.limit(0)).count() == 0


def test_edits_of_pairs_match_the_plain_distance():
    rnd = random.Random(17)
    a = [[rnd.randrange(6) for _ in range(12)] for _ in range(300)]
    b = [list(x) if rnd.random() < 0.3 else x[1:] + [rnd.randrange(6)] if rnd.random() < 0.5 else [rnd.randrange(6) for _ in range(12)] for x in a]
    got = leaks.edits_of_pairs(np.array(a, np.uint64), np.array(b, np.uint64)).tolist()
    assert got == [leaks.edits(x, y, 99) for x, y in zip(a, b)]


def test_edited_leaks_reach_recall(spark):
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(12))) for i in range(200)]
    docs = []
    for i, t in items:
        w = t.split()
        for _ in range(2):
            k, at = rnd.choice("srd"), rnd.randrange(len(w))
            w = w[:at] + ([rnd.choice(vocab)] if k == "s" else [w[at], rnd.choice(vocab)] if k == "r" else []) + w[at + 1 :]
        docs.append((i, " ".join([*(rnd.choice(vocab) for _ in range(8)), *w, *(rnd.choice(vocab) for _ in range(8))])))
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in leaks.find_leaks(ddf, idf, most_edits=2, recall=0.95).collect()}
    true = {(d, i) for (d, t), (i, u) in zip(docs, items) if any(leaks.edits(leaks.words_of(t)[p : p + 12], u.split(), 2) <= 2 for p in range(len(t.split()) - 11))}
    assert len(true) > 80 and len(true & set(got)) >= 0.9 * len(true)
    assert all(e <= 2 for e in got.values())


def test_recall_over_all_planted_edits(spark):
    rnd = random.Random(22)
    vocab = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(12))) for i in range(600)]
    docs = []
    for i, t in items:
        w = t.split()
        for _ in range(2):
            k, at = rnd.choice("srd"), rnd.randrange(len(w))
            w = w[:at] + ([rnd.choice(vocab)] if k == "s" else [w[at], rnd.choice(vocab)] if k == "r" else []) + w[at + 1 :]
        # A third of the documents are the edited passage alone: some have ten words.
        around = 8 if i % 3 else 0
        docs.append((i, " ".join([*(rnd.choice(vocab) for _ in range(around)), *w, *(rnd.choice(vocab) for _ in range(around))])))
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    nine = spark.createDataFrame([(1000, "an item of nine words stands whole in here")], "item_id long, text string")
    ddf = ddf.unionByName(spark.createDataFrame([(1000, "So an item of nine words stands whole in here, too.")], ddf.schema))
    got = {(r.doc_id, r.item_id): r for r in leaks.find_leaks(ddf, idf.unionByName(nine), most_edits=2, recall=0.95, whole_short=True).collect()}
    assert tuple(got.pop((1000, 1000)))[2:] == (1, 9, 0)
    assert all(d == i and r.edits <= 2 for (d, i), r in got.items())
    assert len(got) >= 0.9 * len(items)


def test_edits_to_best_end_match_the_plain_distance():
    rnd = random.Random(23)
    a = [[rnd.randrange(6) for _ in range(12)] for _ in range(200)]
    b = [x[:4] + [9] * rnd.randrange(3) + x[4 + rnd.randrange(3) :] + [8] * 6 for x in a]
    b = [x[:14] for x in b]
    got, words = leaks.edits_to_best_end(np.array(a, np.uint64), np.array(b, np.uint64), 2)
    for x, y, e, n in zip(a, b, got.tolist(), words.tolist()):
        assert e == min(leaks.edits(x, y[:k], 99) for k in range(10, 15)) == leaks.edits(x, y[:n], 99)


def test_mixture_meets_shares_and_caps(spark):
    rnd = random.Random(13)
    docs = [(i, rnd.choice(["big"] * 6 + [" Small ", "SMALL", "mid", "none", None]), "word " * rnd.randrange(1, 60)) for i in range(1500)]
    docs += [(9001, "big", None), (9002, "big", ""), (None, "big", "text"), (9003, "mid", "long " * 20_000)]
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.15, 2), ("empty", 0.05, 2)]
    ddf = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("bucket", F.lit(1))
    tdf = spark.createDataFrame(targets, "source string, target_share double, max_repeat int")
    got, plan = mixture.mix(ddf, tdf)
    rows = got.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    assert max(r["copy"] for r in rows if r.source == "small") <= 3 and max(r["copy"] for r in rows if r.source == "big") == 1
    assert len({(r.doc_id, r["copy"]) for r in rows}) == len(rows)
    out = {r.source: r for r in mixture.shares(got, plan).collect()}
    assert set(out) == {"big", "small", "mid", "empty"} and out["empty"].actual_share == 0
    plans = {r.source: r for r in plan.collect()}
    sizes = ddf.where("text IS NOT NULL").select(F.lower(F.trim("source")).alias("s"), mixture.token_count(F.col("text")).alias("n"))
    longest = {r.s: r.n for r in sizes.groupBy("s").agg(F.max("n").alias("n")).collect()}
    for s, _, _ in targets[:3]:
        assert 0 <= plans[s].demand - out[s].used_tokens < longest[s]
    assert mixture.mix(ddf.limit(0), tdf)[0].count() == 0 and mixture.mix(ddf, tdf.limit(0))[0].count() == 0


def test_curriculum_weights_change_over_the_run(spark):
    docs = [(i, "a" if i % 2 else "b", "some words here") for i in range(4000)]
    tdf = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], "source string, target_share double, max_repeat int")
    rows = mixture.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), tdf, tilt=1.0)[0].collect()
    early = [r for r in rows if r.position < 0.5]
    assert sum(r.source == "a" for r in early) > 2 * sum(r.source == "b" for r in early)


def test_a_schedule_is_followed(spark):
    docs = [(i, " A" if i % 2 else "b", "some words here") for i in range(4000)]
    ddf, tdf = spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame([("a", 0.5, 1), ("B", 0.5, 1)], "source string, target_share double, max_repeat int")
    rows = mixture.mix(ddf, tdf, tilt=0.0, schedule={"a": [(0.2, 0.0), (0.6, 1.0), (0.6, 0.0)]}, size=F.length("text"))[0].collect()
    a = sorted(r.position for r in rows if r.source == "a")
    # Nothing before 0.2 or behind 0.6; between them the weight rises, so that a share of x ** 2 is used up at 0.2 + 0.4 * x.
    assert 0.2 <= a[0] and a[-1] <= 0.6
    assert all(p == pytest.approx(0.2 + 0.4 * (i / len(a)) ** 0.5, abs=1e-6) for i, p in enumerate(a))
    b = sorted(r.position for r in rows if r.source == "b")
    assert all(p == pytest.approx(i / len(b), abs=1e-6) for i, p in enumerate(b))
    for bad in ([], [(0.0, -1.0)], [(0.0, 0.0)]):
        with pytest.raises(ValueError):
            mixture.segments_of(bad)


def test_gram_hashes_equal_just_for_equal_substrings():
    text = spans.code_points("abcabcabd" * 40)
    for n in (1, 2, 3, 7, 32, 300):
        h = spans.gram_hashes(text, n)
        assert len(h) == len(text) - n + 1
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(x, bytes(text[i : i + n])) == bytes(text[i : i + n])
        assert len(seen) == len({bytes(text[i : i + n]) for i in range(len(h))})
    assert len(spans.gram_hashes(text[:5], 32)) == 0


def texts_with_shared_spans(rnd):
    letters = "abcdefghij é中😀"
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    docs, n = [], 0
    pool = [text(k) for k in (299, 300, 301, 450, 1200)]
    for i in range(60):
        t = text(rnd.randrange(0, 700))
        if i % 2:
            p = rnd.choice(pool)
            cut = rnd.randrange(0, max(1, len(p) - 299)) if len(p) > 301 else 0
            at = rnd.randrange(0, len(t) + 1)
            t = t[:at] + p[cut:] + t[at:]
        docs.append((i, t))
    docs += [(100, docs[1][1]), (101, docs[1][1]), (102, "short"), (103, "short"), (104, None), (105, ""), (None, docs[1][1]), (106, "ab" * 4000), (107, "x" + "ab" * 300)]
    return docs


def test_spans_match_brute_force(spark):
    docs = texts_with_shared_spans(random.Random(14))
    live = [(d, t) for d, t in docs if d is not None and t]
    where = {}
    for d, t in live:
        for p in range(len(t) - 299):
            where.setdefault(t[p : p + 300], set()).add(d)
    want = {}
    for d, t in live:
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - 299):
            if len(where[t[p : p + 300]]) > 1:
                hit[p : p + 300] = True
        if hit.any():
            want[d] = int(hit.sum())
    s = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)))
    assert sorted(r.doc_id for r in s.found().collect()) == sorted(want)
    assert {r.doc_id: r.shared_chars for r in s.coverage().collect()} == want
    assert all(r.longest >= 300 for r in s.passages().collect())
    assert spans.SharedSpans(spark.createDataFrame([], "doc_id long, text string")).found().count() == 0


def test_fuzzy_passages_bridge_edits(spark):
    rnd = random.Random(15)
    letters = "abcdefghijklmnop "
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    a = text(2000)
    b = a[:700] + "!!" + a[705:1300] + "?" + a[1300:]
    docs = [(1, text(100) + a + text(100)), (2, text(333) + b), (3, text(2000))]
    rows = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string")).fuzzy_passages().collect()
    best = max(rows, key=lambda r: r.to_at - r.from_at)
    assert {best.d, best.other} == {1, 2} and best.to_at - best.from_at > 1700 and len({r.d for r in rows} | {r.other for r in rows}) == 2


def test_chains_match_a_quadratic_model():
    rnd = random.Random(16)
    for _ in range(60):
        runs = sorted((rnd.randrange(300), rnd.randrange(300), rnd.randrange(1, 30)) for _ in range(rnd.randrange(1, 25)))
        score = []
        for j, (x, y, n) in enumerate(runs):
            best = 0.0
            for i, (u, v, k) in enumerate(runs):
                if u + k <= x and v + k <= y and i < j:
                    best = max(best, score[i] - 0.1 * (x - u - k + y - v - k))
            score.append(n + best)
        got = spans.chains_of(runs, 0.1, 10**9)
        top = got[0]
        value = sum(n for *_, n in top) - 0.1 * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(top, top[1:]))
        assert value == pytest.approx(max(score))
        assert sorted(r for c in got for r in c) == runs


def test_passages_between_all_texts_and_at_all_places(spark):
    rnd = random.Random(19)
    letters = "abcdefghijklmnop "
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    parts = [text(230) for _ in range(4)]
    # Earlier texts hold one piece each; 8 and 9 share the whole, and 9 holds it twice.
    docs = [(i, text(300) + p + text(300)) for i, p in enumerate(parts)]
    docs += [(8, text(300) + "".join(parts) + text(300)), (9, text(300) + "".join(parts) + text(400) + "".join(parts))]
    rows = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string")).fuzzy_passages().collect()
    both = sorted((r.from_at, r.to_at) for r in rows if (r.d, r.other) == (9, 8))
    assert len(both) == 2 and all(to - at > 700 for at, to in both)
    assert {(r.d, r.other) for r in rows} == {(9, 8), *((d, o) for d in (8, 9) for o in range(4))}


def test_recall_of_passages_with_planted_edits(spark):
    rnd = random.Random(26)
    letters = "abcdefghijklmnop "
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    docs, want = [], {}
    for i in range(0, 300, 2):
        # Two to eight points of 400 replaced, inserted or left out, at places of their own.
        piece, parts, last = text(400), [], 0
        for at in sorted(rnd.sample(range(400), rnd.randrange(2, 9))):
            parts.append(piece[last:at] + rnd.choice(["#", "#" + piece[at], ""]))
            last = at + 1
        before, other = text(rnd.randrange(300)), text(rnd.randrange(300))
        docs += [(i, other + piece + text(200)), (i + 1, before + "".join(parts) + piece[last:] + text(200))]
        want[i + 1, i] = len(other)
    found = {}
    for r in spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string")).fuzzy_passages().collect():
        found[r.d, r.other] = found.get((r.d, r.other), 0) + r.matched
    assert set(found) <= set(want)
    # Found is a pair of which at least four fifths of the points are matched.
    assert sum(found.get(pair, 0) >= 320 for pair in want) >= 0.9 * len(want)
    print("planted", len(want), "found", len(found), "whole", sum(found.get(pair, 0) >= 320 for pair in want))


def test_short_exact_stretches_and_short_texts_are_passages(spark):
    rnd = random.Random(20)
    letters = "abcdefghijklmnop "
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    docs, want = [], {}
    for i in range(0, 60, 2):
        piece, at, other = text(120), rnd.randrange(1, 300), rnd.randrange(1, 300)
        docs += [(i, text(other) + piece + text(200)), (i + 1, text(at) + piece + text(200))]
        want[i + 1, i] = (at, other)
    body = text(220)
    docs += [(100, body), (101, body), (102, text(20) + body[:110] + "!" + body[110:])]
    s = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {(r.d, r.other): r for r in s.fuzzy_passages().collect()}
    assert set(rows) == {*want, (102, 100)}
    for pair, (at, other) in want.items():
        r = rows[pair]
        assert r.matched >= 120 and r.longest >= 120 and r.from_at <= at and r.to_at >= at + 120 and r.other_from <= other and r.other_to >= other + 120
    r = rows[102, 100]
    assert (r.from_at, r.to_at, r.other_from, r.other_to, r.matched) == (20, 241, 0, 220, 220)
    assert sorted(map(tuple, s.copies().collect())) == [(100, 100), (101, 100)]
    assert sorted(r.doc_id for r in s.found().collect()) == []


def test_extension_matches_a_full_table():
    rnd = random.Random(21)
    pairs = []
    for _ in range(200):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(0, 40))]
        b = list(a)
        for _ in range(rnd.randrange(0, 4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = [rnd.randrange(4)] * rnd.randrange(2)
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    a, n = spans._padded([x for x, _ in pairs])
    b, m = spans._padded([y for _, y in pairs])
    matched, in_a, in_b, _ = spans.extended(a, n, b, m)
    for k, (x, y) in enumerate(pairs):
        cells = {(0, 0): 0}
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                if i or j:
                    cells[i, j] = max(cells.get((i - 1, j - 1), -99) + (1 if i and j and x[i - 1] == y[j - 1] else -2), cells.get((i - 1, j), -99) - 2, cells.get((i, j - 1), -99) - 2)
        assert cells[in_a[k], in_b[k]] == max(cells.values()) and matched[k] >= max(cells.values())


def chains_value(chain):
    return sum(n for *_, n in chain) - 0.1 * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(chain, chain[1:]))


def test_long_matches_hide_no_nearer_ones():
    seeds = [(1800 + 50 * i, 1800 + 50 * i, 32) for i in range(10)]
    got = spans.chains_of([(0, 0, 1500), *seeds], 0.1, 200)
    assert sorted(got, key=len) == [[(0, 0, 1500)], seeds]


def test_chains_with_a_greatest_gap_match_a_quadratic_model():
    rnd = random.Random(18)
    for _ in range(200):
        runs = sorted((rnd.randrange(300), rnd.randrange(300), rnd.randrange(1, 30)) for _ in range(rnd.randrange(1, 25)))
        score = []
        for j, (x, y, n) in enumerate(runs):
            near = [score[i] - 0.1 * (x - u - k + y - v - k) for i, (u, v, k) in enumerate(runs[:j]) if 0 <= x - u - k <= 40 and 0 <= y - v - k <= 40]
            score.append(n + max([0.0, *near]))
        got = spans.chains_of(runs, 0.1, 40)
        assert chains_value(got[0]) == pytest.approx(max(score))
        assert all(0 <= b[i] - a[i] - a[2] <= 40 for c in got for a, b in zip(c, c[1:]) for i in (0, 1))
        assert sorted(r for c in got for r in c) == runs


def test_token_counts_match_the_public_file(spark):
    texts = ["Hello world's 3 tests", "", None, "naïve 中文 😀", "x" * 3000]
    enc = mixture._encoder(mixture.TOKENIZER, mixture.PATTERN)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixture.token_count(F.col("t"))).collect()] == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
    assert pd is not None
