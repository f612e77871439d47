"""The best representative of each group of duplicates.

Two parts: :func:`survivors` chooses a record by a fixed order of criteria, :func:`fuse` builds field values by
Bayesian fusion with copy detection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.shared import materialize, release


def survivors(records: DataFrame, groups: list[str], order: list[Column], label: str, least: int = 2) -> DataFrame:
    """(groups, survivor, n_records): per group of at least ``least`` records the ``label`` of the first by ``order``.

    Each column of ``order`` is ascending, nulls first; ties go to the least label.  The minimum is combined
    before the shuffle, so that a hot group costs one row per task.  Rows with a null group column are in no group;
    a null label never survives.
    """
    ok = F.lit(True)
    for g in groups:
        ok = ok & F.col(g).isNotNull()
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(label).alias("label"))
    best = records.where(ok & F.col(label).isNotNull()).groupBy(*groups).agg(F.min(key).getField("label").alias("survivor"), F.count(F.lit(1)).alias("n_records"))
    return best.where(F.col("n_records") >= least)


def fuse(claims: DataFrame, rounds: int = 4, copy_rate: float = 0.8, prior: float = 0.1, false_values: int = 10) -> DataFrame:
    """(object, field, value, posterior, n_sources): per object and field the value of the greatest posterior.

    ``claims`` (object, field, source, value, at) are text but for ``at``, any time.  A source claims one value of a
    field: its most frequent, then latest, then least.  Claims with a null in object, field, source or value are none,
    so that a missing value never beats a given one.

    Round by round a source's accuracy is the mean posterior of its values, and sources are compared in pairs: shared values that are likely
    false, more than chance allows, make it likely that one copies the other (Bayes, either may be the copier; ``copy_rate`` is
    the share a copier copies, ``prior`` the chance of dependence), values that differ make it unlikely.  Before the first round, when
    nothing is known to be true, only agreement counts.  The vote of a source for a value is
    discounted once for every source that claimed the value before it (earlier, then lesser) and on which it depends.

    Sources that claim the very same are one class, whose members are discounted against each other in closed form, however many they are.
    Classes of one size that differ only in values which no other class claims are one kind: whatever the rounds find is the same for
    each of them, but for who came first.  Kinds are compared, every two that share a value and each with itself, over all that they
    claim; for a vote it counts how many sources of each kind claimed the value before.  So every pair of sources counts, and the work
    of a value grows with its classes times its kinds: with the claims where sources differ in values of their own, with the square
    of the classes where each has its own choice of shared values.
    """
    counted = claims.where("object IS NOT NULL AND field IS NOT NULL AND source IS NOT NULL AND value IS NOT NULL").groupBy("object", "field", "source", "value").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
    # Of a source's values: most frequent, latest, least (the least text is found among equals in a second step).
    top = counted.groupBy("object", "field", "source").agg(F.max(F.struct("n", "at")).alias("top"))
    single = counted.join(top, ["object", "field", "source"]).where((F.col("n") == F.col("top.n")) & F.col("at").eqNullSafe(F.col("top.at"))).groupBy("object", "field", "source").agg(F.min("value").alias("value"), F.min("at").alias("at"))
    single = materialize(single, "claims")
    marks = [F.sum(F.xxhash64(F.lit(i), "object", "field", "value").cast("decimal(38,0)")).alias(f"m{i}") for i in (1, 2)]
    signed = single.groupBy("source").agg(*marks, F.count(F.lit(1)).alias("k"))
    # Numbers stand for an object's field, for a value of it and for a class; names are joined once, here and at the end.
    number = lambda df, c: materialize(df.withColumn(c, F.monotonically_increasing_id()), c)
    heads = number(signed.groupBy("m1", "m2", "k").agg(F.min("source").alias("first")), "c")
    slots = number(single.select("object", "field").distinct(), "g")
    names = number(single.select("object", "field", "value").distinct().join(slots, ["object", "field"]), "v")
    classes = signed.join(heads, ["m1", "m2", "k"]).select("source", "c")
    late = F.struct(F.col("at").isNull().alias("no"), "at", "source")
    # Votes for a value in the order of time: place 1 to k.
    of_value = Window.partitionBy("v")
    votes = single.join(names, ["object", "field", "value"]).join(classes, "source").groupBy("g", "v", "c").agg(F.count(F.lit(1)).alias("n"), F.min(late).alias("late"))
    votes = materialize(votes.select("g", "v", "c", "n", F.row_number().over(of_value.orderBy("late")).alias("place"), F.count(F.lit(1)).over(of_value).cast("int").alias("k")), "votes")
    release(single)

    held_by_more = F.when(F.col("k") > 1, F.col("v")).otherwise(F.lit(-1))
    marks = [F.sum(F.xxhash64(F.lit(i), "g", held_by_more).cast("decimal(38,0)")).alias(f"m{i}") for i in (1, 2)]
    shaped = votes.groupBy("c").agg(*marks, F.count(F.lit(1)).alias("slots"), F.max("n").alias("size"))
    kinds = number(shaped.groupBy("m1", "m2", "slots", "size").agg(F.count(F.lit(1)).alias("m")), "kind")
    placed = materialize(votes.join(shaped.join(kinds, ["m1", "m2", "slots", "size"]).select("c", "kind", "m", "size"), "c").drop("c", "n"), "placed")
    release(votes)
    # What a kind claims: values that its m classes share, and of the m values that each has alone the first, in place of all.
    ballots = materialize(placed.groupBy("kind", "g", "m", "size").agg(F.min("v").alias("v"), (F.max("k") > 1).alias("common")), "ballots")
    stands = materialize(placed.where("place = 1").join(ballots.select("kind", "g", F.col("v").alias("first")), ["kind", "g"]).select("v", "first"), "stands")
    one, two = (ballots.select("g", F.col("kind").alias(c), F.col("v").alias(f"v{c}"), "common") for c in ("a", "b"))
    near = ballots.where("common").select("v", "kind", "m")
    # Each shared value once for every two kinds that claim it, and for a kind of several classes.
    shared = materialize(near.withColumnRenamed("kind", "a").join(near.select("v", F.col("kind").alias("b")), "v").where("a < b OR a = b AND m > 1").select("v", "a", "b"), "shared")
    compared = shared.select("a", "b").distinct().join(one, "a").join(two.drop("common"), ["b", "g"])
    same = F.col("common") & (F.col("va") == F.col("vb"))
    overlap = materialize(compared.groupBy("a", "b").agg(F.count_if(same).alias("ks"), F.count_if(~same).alias("kd")), "overlap")
    # For each vote and kind the sources of that kind that claimed the value before: they stay as many up to its next vote.
    of_kind = Window.partitionBy("v", "kind").orderBy("place")
    steps = placed.where("k > 1").select("v", "kind", "place", F.sum("size").over(of_kind).alias("earlier"), F.coalesce(F.lead("place").over(of_kind), "k").alias("until")).where("until > place")
    steps = steps.select("v", F.col("kind").alias("a"), "earlier", F.explode(F.sequence(F.col("place") + 1, F.col("until"))).alias("place"))
    before = steps.join(placed.select("v", "place", "kind"), ["v", "place"]).select("v", "place", "kind", F.least("a", "kind").alias("a"), F.greatest("a", "kind").alias("b"), "earlier")
    before = materialize(before, "before")
    release(placed)
    clip = lambda c: F.least(F.greatest(c, F.lit(0.01)), F.lit(0.99))
    held = lambda c: F.exp(F.greatest(F.least(c, F.lit(500.0)), F.lit(-500.0)))
    # Likelihood of copying over that of independence, from its logarithms for either direction.
    likely = lambda r1, r2: 1 / (1 + (1 - prior) / prior / (0.5 * held(r1) + 0.5 * held(r2)))
    chance = 0.8 * 0.8 + 0.2 * 0.2 / false_values
    agree = math.log((copy_rate + chance * (1 - copy_rate)) / chance)
    apart = F.col("kd") * math.log(1 - copy_rate)
    agnostic = F.col("ks") * agree + apart
    dependence = materialize(overlap.select("a", "b", likely(agnostic, agnostic).alias("dep")), "dependence")
    own = F.count(F.lit(1)) * agree
    sources = materialize(ballots.groupBy("kind").agg(likely(own, own).alias("own")).withColumn("accuracy", F.lit(0.8)), "sources")
    for turn in range(rounds):
        free = before.join(dependence, ["a", "b"]).groupBy("v", "kind", "place").agg(F.exp(F.sum(F.col("earlier") * F.log(1 - copy_rate * F.col("dep")))).alias("free"))
        copied = free.groupBy("v", "kind").agg(F.sum("free").alias("free"), F.count(F.lit(1)).alias("later"))
        weighed = ballots.join(sources, "kind").join(copied, ["v", "kind"], "left")
        many = F.when(F.col("size") == 1, F.lit(1.0)).otherwise((1 - F.pow(1 - copy_rate * F.col("own"), F.col("size"))) / (copy_rate * F.col("own")))
        # The first vote for a value has nothing before it.
        full = F.when(F.col("common"), F.col("m") - F.coalesce("later", F.lit(0)) + F.coalesce("free", F.lit(0.0))).otherwise(1.0)
        score = F.sum(F.log(false_values * F.col("accuracy") / (1 - F.col("accuracy"))) * many * full)
        # Rounded, so that equal votes tie in whatever order they are summed.
        scores = weighed.groupBy("g", "v").agg(F.round(score, 9).alias("score"), F.sum(F.when(F.col("common"), F.col("m")).otherwise(1) * F.col("size")).alias("n_sources"), F.max(F.when(F.col("common"), 1).otherwise(F.col("m"))).alias("times"))
        tops = scores.groupBy("g").agg(F.max("score").alias("most"), F.sum("times").alias("k"))
        both = scores.join(tops, "g")
        mass = both.groupBy("g").agg(F.sum(F.col("times") * F.exp(F.col("score") - F.col("most"))).alias("mass"), F.first("most").alias("most"), F.first("k").alias("k"))
        # Values that nobody claims hold a score of 0 each.
        unseen = F.greatest(F.lit(false_values + 1) - F.col("k"), F.lit(0)) * F.exp(-F.col("most"))
        posterior = scores.join(mass, "g").select("g", "v", "n_sources", (F.exp(F.col("score") - F.col("most")) / (F.col("mass") + unseen)).alias("posterior"))
        posterior = materialize(posterior, f"posterior{turn}")
        if turn == rounds - 1:
            break
        judged = ballots.join(posterior.select("v", "posterior"), "v")
        accuracy = clip((F.sum("posterior") + 1.6) / (F.count(F.lit(1)) + 2))
        pt, pf = F.col("p") * F.col("q"), (1 - F.col("p")) * (1 - F.col("q")) / false_values
        kt, kf = F.col("kt"), F.greatest(F.col("ks") - F.col("kt"), F.lit(0.0))
        # Over true, false and differing values, with the accuracy of the one that is copied.
        ratio = lambda o: kt * F.log((o * copy_rate + pt * (1 - copy_rate)) / pt) + kf * F.log(((1 - o) * copy_rate + pf * (1 - copy_rate)) / pf)
        alone = judged.groupBy("kind").agg(F.sum("posterior").alias("kt"), F.count(F.lit(1)).alias("ks"), accuracy.alias("accuracy")).withColumns({"p": F.col("accuracy"), "q": F.col("accuracy")})
        fresh = materialize(alone.select("kind", likely(ratio(F.col("p")), ratio(F.col("p"))).alias("own"), "accuracy"), "sources")
        believed = shared.join(posterior.select("v", "posterior"), "v").groupBy("a", "b").agg(F.sum("posterior").alias("kt"))
        of = lambda c, name: fresh.select(F.col("kind").alias(c), F.col("accuracy").alias(name))
        weighed_pairs = overlap.join(believed, ["a", "b"]).join(of("a", "p"), "a").join(of("b", "q"), "b")
        found = materialize(weighed_pairs.select("a", "b", likely(ratio(F.col("p")) + apart, ratio(F.col("q")) + apart).alias("dep")), "dependence")
        for old in (sources, dependence, posterior):
            release(old)
        sources, dependence = fresh, found
    for old in (before, shared, ballots, overlap, sources, dependence):
        release(old)
    best = posterior.groupBy("g").agg(F.max("posterior").alias("posterior"))
    named = posterior.join(best, ["g", "posterior"]).withColumnRenamed("v", "first").join(stands, "first").join(names.drop("g"), "v")
    return named.groupBy("object", "field", "posterior").agg(F.min(F.struct("value", "n_sources")).alias("b")).select("object", "field", "b.value", "posterior", "b.n_sources")
