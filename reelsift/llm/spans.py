"""Long exact spans shared between records.

Seeds are k-mers chosen by content (the least hash of every window of k-mers), so that two texts with a common span
choose the same seeds inside it.  Only seeds are shuffled at first; texts keep those that they share with another text.

For exact spans, of a window of the wanted length the hash is taken only if all its seeds are shared, which leaves few windows; equal windows say which
two texts to compare, each text with the first one that has the window.  For passages with edits, all texts with a common seed are
compared.  In either case the seeds that two texts share are chained collinearly with gap costs, and the chains are
extended and aligned on the texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsift.shared import materialize, release

K = 32
WINNOW = 64
PASSAGE = "d bigint, other bigint, from_at int, to_at int, other_from int, other_to int, matched int, longest int"
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_TURN = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(29))


def gram_hashes(points: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """64-bit hashes of all substrings of ``length`` code points, built by doubling; position i is the i-th substring."""
    level, n = _mix(points.astype(np.uint64) + _TURN[family]), len(points)
    size, out, done = 1, None, 0
    while True:
        if length & size:
            # Blocks are appended from the left in rising size; the start of each is where the earlier ones end.
            piece = level[done : n - length + 1 + done] if n >= length else level[:0]
            out = piece.copy() if out is None else _mix(out * _MULT[family] + piece)
            done += size
        size *= 2
        if size > length:
            return out
        level = _mix(level[: len(level) - size // 2] * _MULT[family] + (level[size // 2 :] ^ _TURN[family])) if len(level) > size // 2 else level[:0]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum over each window of ``width`` values."""
    size, level = 1, x
    while size * 2 <= width:
        level = pick(level[:-size], level[size:])
        size *= 2
    return pick(level[: len(x) - width + 1], level[width - size : len(x) - size + 1]) if size < width else level


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """True where a hash is the least of some window of ``width`` hashes; all of a shorter text's least ones."""
    if not len(hashes):
        return np.zeros(0, bool)
    width = min(width, len(hashes))
    least = _slide(hashes, width, np.minimum)
    pad = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return _slide(pad, width, np.maximum) == hashes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _heads(batches: Iterator[pd.DataFrame], k: int, width: int) -> Iterator[pd.DataFrame]:
    """(d, k1, k2, n_chars, seeds): each text's 128-bit key, length and seeds with their places, in order."""
    for pdf in batches:
        # A few hundred texts at a time, fewer if they are long.
        for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(pdf["t"].str.len().to_numpy()) // 4_000_000)) + 1):
            out = []
            for d, t in zip(pdf["d"].iloc[part].tolist(), pdf["t"].iloc[part].tolist()):
                p = code_points(t)
                h = gram_hashes(p, k)
                key = np.frombuffer(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")), np.int64)
                at = np.flatnonzero(winnowed(h, width))
                out.append((d, key[0], key[1], len(p), h[at].view(np.int64), at.astype(np.int32)))
            yield pd.DataFrame(out, columns=["d", "k1", "k2", "n_chars", "seeds", "places"])


def _anchors(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """(d, at, h1, h2): the windows of ``span`` code points that begin within the ``ranges`` of a text; the rest isn't hashed."""
    for pdf in batches:
        out, held = [], 0
        for d, t, ranges in zip(pdf["d"].tolist(), pdf["t"].tolist(), pdf["ranges"].tolist()):
            p = code_points(t)
            for r in ranges:
                piece = p[r["a"] : r["b"] + span]
                one, two = (gram_hashes(piece, span, f).view(np.int64) for f in (0, 1))
                out.append((np.full(len(one), d), np.arange(r["a"], r["b"] + 1), one, two))
                held += len(one)
            if held > 200_000:
                yield _columns(out, ("d", "at", "h1", "h2"))
                out, held = [], 0
        if out:
            yield _columns(out, ("d", "at", "h1", "h2"))


def _columns(out: list, names: tuple) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out)))))


class _Best:
    """Segment tree of the greatest (score, index) over ranges of leaves; a leaf can be emptied again."""

    NONE = (float("-inf"), -1)

    def __init__(self, n: int):
        self.n, self.cells = n, [self.NONE] * (2 * n)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += self.n
        self.cells[i] = value
        while i > 1:
            i //= 2
            self.cells[i] = max(self.cells[2 * i], self.cells[2 * i + 1])

    def between(self, low: int, high: int) -> tuple[float, int]:
        best, low, high = self.NONE, low + self.n, high + self.n
        while low < high:
            if low & 1:
                best, low = max(best, self.cells[low]), low + 1
            if high & 1:
                high -= 1
                best = max(best, self.cells[high])
            low, high = low // 2, high // 2
        return best


def runs_of(x: np.ndarray, y: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal exact matches (x, y, length) of anchors of ``length`` at (x, y): those that touch on a diagonal are one."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(x - y) != 0) | (np.diff(x) > length)]))
    last = np.concatenate([new[1:], [len(x)]]) - 1
    return sorted(zip(x[new].tolist(), y[new].tolist(), (x[last] - x[new] + length).tolist()))


def chains_of(runs: list[tuple[int, int, int]], gap_cost: float, most_gap: int) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of exact matches, best first, each match in one chain.

    A chain scores its matched length less ``gap_cost`` for each code point between matches, in either text.  A match
    continues the best chain that ends before it in both texts, at most ``most_gap`` away in each: a sweep over the first text puts
    ended matches into a tree over the ends in the second and takes those out that are too far behind.
    """
    x_end, y_end = [x + n for x, _, n in runs], [y + n for _, y, n in runs]
    by_y = sorted(range(len(runs)), key=lambda i: y_end[i])
    ends, leaf = [y_end[i] for i in by_y], {i: at for at, i in enumerate(by_y)}
    tree, score, before, waiting = _Best(len(runs)), [0.0] * len(runs), [-1] * len(runs), sorted(range(len(runs)), key=lambda i: x_end[i])
    done = gone = 0
    for j, (x, y, n) in enumerate(runs):
        while done < len(waiting) and x_end[waiting[done]] <= x:
            i = waiting[done]
            tree.put(leaf[i], (score[i] + gap_cost * (x_end[i] + y_end[i]), i))
            done += 1
        while gone < done and x_end[waiting[gone]] < x - most_gap:
            tree.put(leaf[waiting[gone]], tree.NONE)
            gone += 1
        best, i = tree.between(bisect_left(ends, y - most_gap), bisect_left(ends, y + 1))
        score[j] = n
        linked = n + best - gap_cost * (x + y)
        if i >= 0 and linked > n:
            score[j], before[j] = linked, i
    taken, out = set(), []
    for j in sorted(range(len(runs)), key=lambda j: -score[j]):
        chain = []
        while j >= 0 and j not in taken:
            taken.add(j)
            chain.append(runs[j])
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _seeds_in_windows(batches: Iterator[pd.DataFrame], k: int, width: int, span: int) -> Iterator[pd.DataFrame]:
    """Pairs of texts with equal windows (xs, ys) given the places of the seeds inside those windows instead."""
    for pdf in batches:
        xs, ys = [], []
        for x, y, t in zip(pdf["xs"].tolist(), pdf["ys"].tolist(), pdf["t"].tolist()):
            at = np.flatnonzero(winnowed(gram_hashes(code_points(t), k), width))
            mine, theirs = [], []
            for a, b, n in runs_of(np.asarray(x, np.int64), np.asarray(y, np.int64), span):
                here = at[np.searchsorted(at, a) : np.searchsorted(at, a + n - k, "right")]
                mine.append(here)
                theirs.append(here - a + b)
            xs.append(np.concatenate(mine))
            ys.append(np.concatenate(theirs))
        yield pdf.assign(xs=xs, ys=ys)


class SharedSpans:
    """Spans shared by different documents.

    ``documents``: ids are unique BIGINTs; rows with a null id or text, and texts shorter than ``span`` code points, share
    nothing.  Documents of identical text are one text, whose members all share it whole.  Every length of text is
    read whole.  ``seed`` and ``winnow`` only set the work: with seed + 3 * winnow <= span + 3 every window has an inner seed.
    """

    def __init__(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 300, seed: int = K, winnow: int = WINNOW, gap_cost: float = 0.1, most_gap: int = 200):
        if seed + 3 * winnow > span + 3:
            raise ValueError("seed + 3 * winnow must not exceed span + 3")
        self.span, self.seed, self.winnow, self.gap_cost, self.most_gap = span, seed, winnow, gap_cost, most_gap
        self.docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
        self._kept: dict[int, tuple[DataFrame, DataFrame]] = {}

    def _texts(self, least: int) -> tuple[DataFrame, DataFrame]:
        """Of the documents with ``least`` code points or more: (d, k1, k2, n_chars, seeds, places), and (k1, k2, lead, n) with the least document of
        each text and the number of its documents.  Texts themselves aren't shuffled for this."""
        if least not in self._kept:
            k, width = self.seed, self.winnow
            heads = self.docs.where(F.length("t") >= least).mapInPandas(lambda b: _heads(b, k, width), "d bigint, k1 bigint, k2 bigint, n_chars int, seeds array<bigint>, places array<int>")
            heads = materialize(heads, "heads")
            self._kept[least] = heads, materialize(heads.groupBy("k1", "k2").agg(F.min("d").alias("lead"), F.count(F.lit(1)).alias("n")), "texts")
        return self._kept[least]

    def _seeds(self, least: int) -> tuple[DataFrame, DataFrame]:
        """(d, n_chars, seed, at) of each text, by its least document, and (seed) of more than one text."""
        heads, texts = self._texts(least)
        leads = heads.join(texts, ["k1", "k2"]).where("d = lead").select("d", "n_chars", F.inline(F.arrays_zip("seeds", "places"))).withColumnsRenamed({"seeds": "seed", "places": "at"})
        return leads, leads.groupBy("seed").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("seed")

    def _ranges(self) -> DataFrame:
        """(d, ranges): where windows of ``span`` begin whose inner seeds are all shared; texts without any are left out.

        A seed at least ``winnow`` k-mers from both ends of a window is chosen by the window's own content, so that every text
        with the window chose it; those nearer to the ends may be chosen by what stands outside.
        """
        low, high, span = self.winnow - 1, self.span - self.seed + 2 - self.winnow, self.span
        seeds, both = self._seeds(span)
        marked = seeds.join(both.withColumn("both", F.lit(True)), "seed", "left")
        lonely = marked.groupBy("d").agg(F.max("n_chars").alias("n"), F.array_sort(F.collect_list(F.when(F.col("both").isNull(), F.col("at")))).alias("l"))
        # From behind one lonely seed up to the next one.
        between = F.zip_with(F.concat(F.array(F.lit(-1)), "l"), F.concat("l", F.array(F.lit((1 << 31) - 1))), lambda p, q: F.struct(F.greatest(F.when(p < 0, 0).otherwise(p - low + 1), F.lit(0)).alias("a"), F.least(F.col("n") - span, q - high).alias("b")))
        return lonely.select("d", F.filter(between, lambda r: r["a"] <= r["b"]).alias("ranges")).where(F.size("ranges") > 0)

    def copies(self, least: int = 100) -> DataFrame:
        """(doc_id, text_id): each document of ``least`` code points or more whose text another one repeats, with the least such document."""
        heads, texts = self._texts(least)
        return heads.select("k1", "k2", "d").join(texts.where("n > 1"), ["k1", "k2"]).select(F.col("d").alias("doc_id"), F.col("lead").alias("text_id"))

    @cached_property
    def live(self) -> DataFrame:
        """(d, t, ranges): the texts that may hold a shared span.  They are shuffled once, for this; all later joins take them from here."""
        return materialize(self.docs.join(self._ranges(), "d"), "live")

    @cached_property
    def anchors(self) -> DataFrame:
        """(d, at, other, other_at): windows of ``span`` code points that stand in different texts, with the first text and place."""
        span = self.span
        windows = self.live.mapInPandas(lambda b: _anchors(b, span), "d bigint, at int, h1 bigint, h2 bigint")
        anchors = materialize(windows, "anchors")
        lead = anchors.groupBy("h1", "h2").agg(F.min(F.struct("d", "at")).alias("lead"), F.max("d").alias("last")).where(F.col("lead.d") < F.col("last"))
        matches = materialize(anchors.join(lead.select("h1", "h2", "lead"), ["h1", "h2"]).select("d", "at", F.col("lead.d").alias("other"), F.col("lead.at").alias("other_at")), "matches")
        release(anchors)
        return matches

    def passages(self) -> DataFrame:
        """(d, other, from_at, to_at, other_from, other_to, matched, longest): chains of seeds, extended and aligned, between two texts with an equal window.

        Each text is compared with the first text that has the same window, so a group of n texts with a span gives
        n - 1 pairs.  matched: code points that are equal in the alignment, longest: those of the longest exact run, compared point by
        point, at least ``span`` unless two windows have the same two hashes by chance.
        """
        pairs = self.anchors.where("d <> other").groupBy("d", "other").agg(F.collect_list("at").alias("xs"), F.collect_list("other_at").alias("ys"))
        pairs = pairs.join(self.live.select("d", "t"), "d").join(self.live.select(F.col("d").alias("other"), F.col("t").alias("u")), "other")
        seed, winnow, span, gap_cost, most_gap = self.seed, self.winnow, self.span, self.gap_cost, self.most_gap
        return pairs.mapInPandas(lambda b: _aligned(_seeds_in_windows(b, seed, winnow, span), seed, gap_cost, most_gap, span), PASSAGE)

    def _each(self, per_text: DataFrame) -> DataFrame:
        """Rows of texts (by ``d``) given to every document of that text, as ``doc_id``, with its ``n_chars``."""
        heads, texts = self._texts(self.span)
        mine = per_text.withColumnRenamed("d", "lead").join(texts.select("lead", "k1", "k2"), "lead").drop("lead")
        return heads.select("k1", "k2", F.col("d").alias("doc_id"), "n_chars").join(mine, ["k1", "k2"]).drop("k1", "k2")

    def found(self) -> DataFrame:
        """(doc_id): documents with an aligned passage that holds an exact run of ``span``, and those whose whole text another one repeats."""
        p = self.passages().where(F.col("longest") >= self.span)
        ends = p.select(F.explode(F.array("d", "other")).alias("d"))
        return self._each(ends.unionByName(self._texts(self.span)[1].where("n > 1").select(F.col("lead").alias("d"))).distinct()).select("doc_id")

    def coverage(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars, share): code points of each document inside a shared span.

        Documents without any are left out; those whose text another document repeats are covered whole.
        """
        order = Window.partitionBy("d").orderBy("at")
        step = F.least(F.coalesce(F.lead("at").over(order) - F.col("at"), F.lit(self.span)), F.lit(self.span))
        spans = self.anchors.select("d", "at").distinct().withColumn("step", step).groupBy("d").agg(F.sum("step").alias("covered"))
        texts = self._texts(self.span)[1].select(F.col("lead").alias("d"), "n").join(spans, "d", "left").where("n > 1 OR covered IS NOT NULL")
        shared = F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.col("covered")).cast("bigint")
        return self._each(texts).select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), shared.alias("shared_chars")).withColumn("share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))

    def fuzzy_passages(self, least: int = 100) -> DataFrame:
        """As :meth:`passages`, but with edits in them: chains of seeds, extended and aligned, that match in ``least`` points.

        Any two texts of ``least`` points or more that share seeds are compared, on all places of all seeds they share;
        an exact stretch of seed + winnow - 1 points always holds one.  Chains are extended at both ends and into their gaps
        (see :func:`extended`); matched: points of the alignment that are equal, longest: those of the longest exact match.
        A passage inside another one in both texts is that one.  Identical texts are compared once; :meth:`copies` has their members.

        Before texts are joined, each seed match is extended over ``CONTEXT`` points kept beside the seed: pairs whose
        matches, all added up, stay under three quarters of ``least`` are left out.
        """
        k, width = self.seed, self.winnow
        seeds, both = self._seeds(least)
        shared = seeds.join(both, "seed", "left_semi").groupBy("d").agg(F.collect_set("seed").alias("shared"))
        placed = materialize(self.docs.join(shared, "d").mapInPandas(lambda b: _places(b, k, width), "d bigint, seed bigint, at int, ctx binary"), "places")
        rows = _seed_pairs(placed).select("d", "other", "at", "other_at", "ctx", "other_ctx")
        hopeful = rows.mapInArrow(lambda b: _hopes(b, k, least), "d bigint, other bigint, at int, other_at int, hope int")
        pairs = hopeful.groupBy("d", "other").agg(F.sum("hope").alias("hope"), F.collect_list("at").alias("xs"), F.collect_list("other_at").alias("ys")).where(F.col("hope") * 4 >= 3 * least)
        pairs = materialize(pairs.drop("hope"), "pairs")
        release(placed)
        live = materialize(self.docs.join(pairs.select(F.explode(F.array("d", "other")).alias("d")).distinct(), "d"), "live")
        pairs = pairs.join(live, "d").join(live.select(F.col("d").alias("other"), F.col("t").alias("u")), "other")
        gap_cost, most_gap = self.gap_cost, self.most_gap
        return pairs.mapInPandas(lambda b: _aligned(b, k, gap_cost, most_gap, least), PASSAGE)


CONTEXT = 100
_PENALTY, _DROP, _BAND, _PAD = 2, 12, 8, -1


def _padded(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pieces], np.int64)
    out = np.full((len(pieces), int(lengths.max(initial=0))), _PAD, np.int32)
    for row, p in zip(out, pieces):
        row[: len(p)] = p
    return out, lengths


def extended(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(matched, in a, in b, whole): how far the rows of a and b, padded, can be aligned from their starts, all rows at once.

    An equal point scores 1, an inserted, deleted or replaced one costs ``_PENALTY``; the alignment ends at its greatest score, and
    is given up ``_DROP`` below it or ``_BAND`` points off the diagonal.  whole: it was not given up before the end of a row.
    """
    n, width = len(a), 2 * _BAND + 1
    one, fee, none = (1 << 16) + 1, _PENALTY << 16, -(1 << 40)
    shift = np.arange(-_BAND, _BAND + 1)
    matched, in_a, in_b, whole = (np.zeros(n, np.int64) for _ in range(4))
    if not n:
        return matched, in_a, in_b, whole
    ends = np.full((n, _BAND), _PAD - 1, np.int32)
    b = np.concatenate([ends, b, np.full((n, max(0, a.shape[1] - b.shape[1]) + _BAND + 1), _PAD - 1, np.int32)], 1)
    row, v, best = np.arange(n), np.where((shift >= 0) & (shift <= b_len[:, None]), -fee * shift, none), np.zeros(n, np.int64)
    whole[:] = (a_len == 0) | (b_len == 0)
    live = (a_len > 0) & (b_len > 0)
    row, v, best, a, b, la, lb = row[live], v[live], best[live], a[live], b[live], a_len[live], b_len[live]
    i = 0
    while len(row):
        v[:, :-1], v[:, -1] = np.maximum(v[:, :-1] + np.where(a[:, i, None] == b[:, i : i + width - 1], one, -fee), v[:, 1:] - fee), v[:, -1] + np.where(a[:, i] == b[:, i + width - 1], one, -fee)
        v = np.maximum.accumulate(v + fee * np.arange(width), 1) - fee * np.arange(width)
        y = i + 1 + shift
        v[(y < 0) | (y > lb[:, None])] = none
        at = v.argmax(1)
        top = v[np.arange(len(v)), at]
        up = top >> 16 > best >> 16
        best = np.where(up, top, best)
        matched[row[up]], in_a[row[up]], in_b[row[up]] = top[up] & 0xFFFF, i + 1, y[at[up]]
        i += 1
        held = (top >> 16) > (best >> 16) - _DROP
        ended = held & ((i >= la) | (i - _BAND >= lb) | (y[at] >= lb))
        whole[row[ended]] = 1
        keep = held & (i < la)
        if not keep.all():
            row, v, best, a, b, la, lb = row[keep], v[keep], best[keep], a[keep], b[keep], la[keep], lb[keep]
    return matched, in_a, in_b, whole


def _hopes(batches, k: int, least: int):
    """Each seed match with the most points it can match by its context; ``least`` if the context ends first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sides = []
        for name in ("ctx", "other_ctx"):
            column = batch.column(name)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), 2 * CONTEXT)
            sides.append(data)
        hope = np.full(batch.num_rows, k, np.int64)
        for part in (slice(0, CONTEXT), slice(CONTEXT, 2 * CONTEXT)):
            a, b = (np.ascontiguousarray(x[:, part]) for x in sides)
            # Code 0 stands behind the ends of a text.
            a_len, b_len = ((x != 0).sum(1) for x in (a, b))
            matched, in_a, in_b, whole = extended(a.astype(np.int32), a_len, b.astype(np.int32), b_len)
            hope += np.where((whole > 0) & ((a_len == CONTEXT) | (b_len == CONTEXT)) , np.maximum(matched, least), matched)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "other", "at", "other_at")), pa.array(np.minimum(hope, 1 << 20).astype(np.int32))], names=["d", "other", "at", "other_at", "hope"])


def _aligned(batches: Iterator[pd.DataFrame], k: int, gap_cost: float, most_gap: int, least: int) -> Iterator[pd.DataFrame]:
    """Chains of the seed matches of each pair of texts, extended on the texts."""
    columns = ["d", "other", "from_at", "to_at", "other_from", "other_to", "matched", "longest"]
    for pdf in batches:
        for first in range(0, len(pdf), 500):
            out = []
            chains = []
            for d, o, xs, ys, t, u in zip(*(pdf[c].iloc[first : first + 500].tolist() for c in ("d", "other", "xs", "ys", "t", "u"))):
                p, q = code_points(t).astype(np.int32), code_points(u).astype(np.int32)
                for c in chains_of(runs_of(np.asarray(xs, np.int64), np.asarray(ys, np.int64), k), gap_cost, most_gap):
                    chains.append((d, o, p, q, c))
            # Backward from the first match, forward from each match up to the next one, then backward into what is left of the gaps.
            jobs = [(p[: c[0][0]][::-1], q[: c[0][1]][::-1]) for _, _, p, q, c in chains]
            for _, _, p, q, c in chains:
                for (x, y, n), (x2, y2, _) in zip(c, [*c[1:], (len(p), len(q), 0)]):
                    jobs.append((p[x + n : x2], q[y + n : y2]))
            forward = _jobs(jobs)
            rest, at = [], len(chains)
            for _, _, p, q, c in chains:
                for (x, y, n), (x2, y2, _) in zip(c, c[1:]):
                    _, da, db = forward[at]
                    rest.append((p[x + n + da : x2][::-1], q[y + n + db : y2][::-1]))
                    at += 1
                at += 1
            back = iter(_jobs(rest))
            at, last = len(chains), {}
            for (d, o, p, q, c), (m, da, db) in zip(chains, forward):
                matched, longest = m + sum(n for *_, n in c), max(_exact(p, q, *r) for r in c)
                for _ in c[1:]:
                    matched += forward[at][0] + next(back)[0]
                    at += 1
                matched += forward[at][0]
                if matched >= least:
                    last.setdefault((d, o), []).append((c[0][0] - da, c[-1][0] + c[-1][2] + forward[at][1], c[0][1] - db, c[-1][1] + c[-1][2] + forward[at][2], matched, longest))
                at += 1
            for (d, o), found in last.items():
                kept = []
                for r in sorted(set(found), key=lambda r: (-r[4], r)):
                    if not any(z[0] <= r[0] and r[1] <= z[1] and z[2] <= r[2] and r[3] <= z[3] for z in kept):
                        kept.append(r)
                out += [(d, o, *r) for r in kept]
            yield pd.DataFrame(out, columns=columns)


def _jobs(jobs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(matched, in the first, in the second) of each pair of pieces, those of like length together."""
    out = [(0, 0, 0)] * len(jobs)
    order = sorted((i for i, (a, b) in enumerate(jobs) if len(a) and len(b)), key=lambda i: min(map(len, jobs[i])))
    start = 0
    while start < len(order):
        stop = start
        while stop < len(order) and (stop == start or (stop - start + 1) * min(map(len, jobs[order[stop]])) <= 1_000_000):
            stop += 1
        part = order[start:stop]
        # Beyond the band the longer piece can't be reached.
        a, a_len = _padded([jobs[i][0][: len(jobs[i][1]) + _BAND] for i in part])
        b, b_len = _padded([jobs[i][1][: len(jobs[i][0]) + _BAND] for i in part])
        for i, *r in zip(part, *(z.tolist() for z in extended(a, a_len, b, b_len)[:3])):
            out[i] = tuple(r)
        start = stop
    return out


def _exact(p: np.ndarray, q: np.ndarray, x: int, y: int, n: int) -> int:
    """Length of the exact match around (x, y, n)."""
    left, right = min(x, y), min(len(p) - x - n, len(q) - y - n)
    before = np.flatnonzero(p[x - left : x][::-1] != q[y - left : y][::-1])
    after = np.flatnonzero(p[x + n : x + n + right] != q[y + n : y + n + right])
    return n + (int(before[0]) if len(before) else left) + (int(after[0]) if len(after) else right)


def _seed_pairs(placed: DataFrame, block: int = 256) -> DataFrame:
    """(d, at, other, other_at, ...): each place of a seed with each place of it in a text of a lesser number.

    A seed of many places is salted: one side is cut into parts of about ``block`` places, the other repeated for each part.
    """
    many = placed.groupBy("seed").agg(F.count(F.lit(1)).alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi")
    salts = placed.join(many.select("seed", F.ceil(F.col("c") / block).cast("int").alias("salts")), "seed")
    extra = [c for c in placed.columns if c not in ("d", "seed", "at")]
    left = salts.withColumn("salt", F.pmod(F.xxhash64("d", "at"), F.col("salts")).cast("int")).drop("salts")
    right = salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("seed", "salt", F.col("d").alias("other"), F.col("at").alias("other_at"), *[F.col(c).alias(f"other_{c}") for c in extra])
    return left.join(right, ["seed", "salt"]).where("d > other").drop("seed", "salt")


def _places(batches: Iterator[pd.DataFrame], k: int, width: int) -> Iterator[pd.DataFrame]:
    """(d, seed, at, ctx): the shared seeds of each text with all their places and bytes of the points to the left, backward, and to the right."""
    for pdf in batches:
        out, held = [], 0
        for d, t, shared in zip(pdf["d"].tolist(), pdf["t"].tolist(), pdf["shared"].tolist()):
            p = code_points(t)
            h = gram_hashes(p, k)
            at = np.flatnonzero(winnowed(h, width) & np.isin(h.view(np.int64), np.asarray(shared, np.int64)))
            near = np.zeros(len(p) + 2 * CONTEXT, np.uint8)
            near[CONTEXT : CONTEXT + len(p)] = _mix(p.astype(np.uint64) + _TURN[0]) % np.uint64(255) + np.uint64(1)
            step = np.arange(CONTEXT)
            ctx = np.concatenate([near[at[:, None] + CONTEXT - 1 - step], near[at[:, None] + CONTEXT + k + step]], 1)
            out.append((np.full(len(at), d), h[at].view(np.int64), at.astype(np.int32), np.array([r.tobytes() for r in ctx] + [None], object)[:-1]))
            held += len(at)
            if held > 100_000:
                yield _columns(out, ("d", "seed", "at", "ctx"))
                out, held = [], 0
        if out:
            yield _columns(out, ("d", "seed", "at", "ctx"))
