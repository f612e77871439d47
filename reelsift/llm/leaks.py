"""Evaluation texts that leaked into training texts.

Texts are cut into windows of as many words as a passage must share.  A CGK walk embeds each window: it copies the
word under a pointer and moves on or not by a random bit of (step, word), so that windows few edits apart agree in
most places; a fixed random sample of places is the window's signature.  Windows whose signatures are equal in
one of the repetitions are candidates, which an exact comparison verifies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASCII = re.compile(r"[a-z0-9]+")
_ANY = regex.compile(r"[\p{L}\p{Nd}]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    """Unbroken runs of Unicode letters and digits in lower case."""
    if not text:
        return []
    low = text.lower()
    return _ASCII.findall(low) if low.isascii() else _ANY.findall(low)


class _Codes(dict):
    """64-bit codes of words, computed once each; forgotten when there are very many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def walk_signatures(codes: np.ndarray, starts: np.ndarray, width: int, repetitions: int, sample: int, seed: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Signatures (repetitions x windows) of the windows of ``width`` words, or up to ``ends``, that begin at ``starts`` in ``codes``."""
    out = np.empty((repetitions, len(starts)), np.uint64)
    steps = 3 * width
    for r in range(repetitions):
        random = np.random.default_rng((seed, r, width))
        coins = random.integers(0, 2**64, steps, np.uint64)
        # A window of n words ends the walk after n moves, on average at step 2n: places are sampled before it.
        places = np.sort(random.choice(2 * width, min(sample, 2 * width), replace=False))
        taken = np.zeros(steps, bool)
        taken[places] = True
        at = starts.astype(np.int64)
        stop = at + width if ends is None else np.minimum(at + width, ends)
        sig = np.full(len(starts), np.uint64(r + 1))
        for step in range(int(places[-1]) + 1):
            inside = at < stop
            word = np.where(inside, codes[np.minimum(at, stop - 1)], np.uint64(0))
            if taken[step]:
                sig = (sig ^ word) * _M1
                sig ^= sig >> np.uint64(29)
            at = at + (((word ^ coins[step]) * _M2 >> np.uint64(63)).astype(np.int64) & inside)
        out[r] = sig
    return out


def edits(a: list[str], b: list[str], most: int) -> int:
    """Edit distance in words, or most + 1 where it is greater."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _edit_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of ``a`` to every beginning of the rows of ``b`` (pairs x (words + 1)), all pairs at once."""
    (n, height), width = a.shape, b.shape[1]
    row = np.broadcast_to(np.arange(width + 1, dtype=np.int8), (n, width + 1)).copy()
    for i in range(height):
        last, row[:, 0] = row[:, 0].copy(), i + 1
        differ = (a[:, i, None] != b).astype(np.int8)
        for j in range(width):
            cost = np.minimum(np.minimum(row[:, j + 1], row[:, j]) + np.int8(1), last + differ[:, j])
            last, row[:, j + 1] = row[:, j + 1].copy(), cost
    return row


def edits_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of two arrays of word codes (pairs x words), all pairs at once."""
    return _edit_rows(a, b)[:, -1]


def edits_to_best_end(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, words): least edit distance of the rows of ``a`` to beginnings of the rows of ``b``, at most ``most`` words shorter
    or longer, and the words of that beginning; of equally near ones the one of like length, then the shorter."""
    width = a.shape[1]
    words = np.array(sorted(range(max(1, width - most), width + most + 1), key=lambda n: (abs(n - width), n)))
    rows = _edit_rows(a, b)[:, words]
    best = rows.argmin(1)
    return rows[np.arange(len(rows)), best], words[best]


def repetitions_for(width: int, most_edits: int, sample: int, recall: float) -> int:
    """Repetitions after which a window at most ``most_edits`` away is found with probability ``recall``.

    An edit disturbs the walks for a number of steps that is about quadratic in the edits; within ``width`` words the
    places still agree with a share of about 1 - 3 * edits / (2 * width) (measured in tests, on the safe side).
    """
    if most_edits == 0:
        return 1
    agree = max(0.05, 1 - 3 * most_edits / (2 * width))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**sample)))


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    window: int = 12,
    most_edits: int = 0,
    sample: int = 6,
    recall: float = 0.95,
    seed: int = 7,
    whole_short: bool = False,
    block_bytes: int = 128_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_windows, longest, edits): documents that hold a window of ``window`` words of an item.

    A stretch of the document counts if it is at most ``most_edits`` edits (of words) away from a window of the item, so that it
    has up to as many words less or more than the window; at 0 this is exact: equal windows have equal signatures, so
    none is missed.  For more, enough repetitions are made to reach ``recall``: signatures are of ``window`` words, and the
    exact comparison tries every end within the edits.  n_windows: words of the document where a match begins, longest: words of
    the longest run of matches, edits: the least distance.  Items of fewer words than the window match nothing, or with ``whole_short``
    documents in which all their words stand in a row, without edits.  Texts that are null or without words and documents of
    fewer words than the window less the edits match nothing else; repeated documents or items give one row per pair of ids; rows with
    a null id are left out.

    Windows are compared by 64-bit codes of their words, all candidates of a slice at once.

    Items are sent to the workers in blocks, one pass over the documents per block, so that what is sent never grows with the items:
    a block's codes, signatures and orders take at most about ``block_bytes``.  Documents are never shuffled; whole texts are read.
    """
    spark = documents.sparkSession
    reps = repetitions_for(window, most_edits, sample, recall)
    items = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t")).distinct()
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    # A word has a character and another between it and the next; for each, a code, a place, and a signature and its order per repetition.
    blocks = max(1, math.ceil((total / 2 + 1) * (16 * reps + 24) / block_bytes))
    dtype, itype = dict(docs.dtypes)["d"], dict(items.dtypes)["i"]
    schema = f"d {dtype}, i {itype}, n_windows int, longest int, edits int"
    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        rows = [(r["i"], words_of(r["t"])) for r in part.toLocalIterator()]
        sent = spark.sparkContext.broadcast([x for x in [_item_windows([r for r in rows if len(r[1]) >= window], window, reps, sample, seed, most_edits)] + [_item_windows([r for r in rows if len(r[1]) == n], n, 1, sample, seed, 0) for n in range(1, window if whole_short else 1)] if x])

        def match(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known = _Codes()
            for pdf in batches:
                # A few hundred documents at a time, fewer if they are long, bound the memory.
                sizes = pdf["t"].str.len().to_numpy()
                for chunk in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(sizes) // 400_000)) + 1):
                    words = [words_of(t) for t in pdf["t"].iloc[chunk].tolist()]
                    codes = np.fromiter((known[x] for w in words for x in w), np.uint64, sum(map(len, words)))
                    found = [r for group in sent.value for r in _match_chunk(pdf["d"].iloc[chunk].tolist(), words, codes, sample, seed, *group)]
                    if found:
                        yield pd.DataFrame(found, columns=["d", "i", "n_windows", "longest", "edits"])

        found = docs.mapInPandas(match, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy(F.col("d").alias(doc_id), F.col("i").alias(item_id)).agg(F.max("n_windows").alias("n_windows"), F.max("longest").alias("longest"), F.min("edits").alias("edits"))


def _item_windows(rows: list[tuple], window: int, reps: int, sample: int, seed: int, most_edits: int) -> tuple | None:
    """All windows of ``window`` words of items (id, words), with their sorted signatures; None without any."""
    if not rows:
        return None
    known = _Codes()
    codes = np.fromiter((known[x] for _, w in rows for x in w), np.uint64)
    firsts = np.cumsum([0] + [len(w) for _, w in rows])[:-1]
    starts = np.concatenate([f + np.arange(len(w) - window + 1) for f, (_, w) in zip(firsts, rows)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(w) - window + 1 for _, w in rows]).astype(np.int64)
    sigs = walk_signatures(codes, starts, window, reps, sample, seed)
    order = [np.argsort(s, kind="stable") for s in sigs]
    return [i for i, _ in rows], owner, (codes, starts), [s[o] for s, o in zip(sigs, order)], order, window, reps, most_edits


def _match_chunk(ids, words, codes, sample, seed, rows, owner, items, sorted_sigs, order, window, reps, most_edits) -> list[tuple]:
    """(id, item, n_windows, longest, edits) of the documents in ``ids``, whose ``words`` have ``codes``."""
    counts = np.array([max(0, len(w) - max(1, window - most_edits) + 1) for w in words], np.int64)
    if not counts.sum():
        return []
    firsts = np.cumsum([0] + [len(w) for w in words])[:-1]
    doc = np.repeat(np.arange(len(words)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    place_of, end_of = firsts[doc] + at, (firsts + [len(w) for w in words])[doc]
    item_codes, item_starts = items
    step, ahead = np.arange(window), np.arange(window + most_edits)
    best: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    # Slices of windows bound the memory that a very long text takes.
    for first in range(0, len(doc), 400_000):
        sigs, seen = walk_signatures(codes, place_of[first : first + 400_000], window, reps, sample, seed, end_of[first : first + 400_000]), np.empty(0, np.int64)
        for sig, table, place in zip(sigs, sorted_sigs, order):
            lo = np.searchsorted(table, sig, "left")
            hit = np.flatnonzero((lo < len(table)) & (table[np.minimum(lo, len(table) - 1)] == sig))
            n = np.searchsorted(table, sig[hit], "right") - lo[hit]
            # Slices of candidates, each pair of windows compared once over all repetitions.
            for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(n) // 200_000)) + 1):
                h, k = hit[part], n[part]
                mine = first + np.repeat(h, k)
                theirs = place[np.repeat(lo[h], k) + np.arange(len(mine)) - np.repeat(np.cumsum(k) - k, k)]
                if reps > 1:
                    key = mine * len(owner) + theirs
                    fresh = ~np.isin(key, seen)
                    mine, theirs, seen = mine[fresh], theirs[fresh], np.union1d(seen, key[fresh])
                a = item_codes[item_starts[theirs][:, None] + step]
                if most_edits:
                    # Behind its end a document has words that equal none.
                    places = place_of[mine][:, None] + ahead
                    b = np.where(places < end_of[mine][:, None], codes[np.minimum(places, len(codes) - 1)], np.uint64(0))
                    e, n = edits_to_best_end(a, b, most_edits)
                else:
                    e, n = np.where((a == codes[place_of[mine][:, None] + step]).all(1), 0, 1), np.full(len(mine), window)
                ok = np.flatnonzero(e <= most_edits)
                ends = np.minimum(at[mine[ok]] + n[ok], at[mine[ok]] + end_of[mine[ok]] - place_of[mine[ok]])
                for d, o, p, x, end in zip(doc[mine[ok]].tolist(), owner[theirs[ok]].tolist(), at[mine[ok]].tolist(), e[ok].tolist(), ends.tolist()):
                    places = best.setdefault((d, o), {})
                    places[p] = min((x, -end), places.get(p, (x, -end)))
    out = []
    for (d, o), found in best.items():
        places, longest, start = sorted(found), 0, 0
        for k, p in enumerate(places):
            start = start if k and places[k - 1] == p - 1 else p
            longest = max(longest, -found[p][1] - start)
        out.append((ids[d], rows[o], len(places), longest, min(found.values())[0]))
    return out
