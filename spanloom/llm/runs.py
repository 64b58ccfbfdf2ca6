"""Periodic runs of words in each text, by descending-LCP Kruskal.

The suffixes of a text's word sequence are sorted and the longest common
prefixes (LCP) of neighbours computed.  Neighbours are united by decreasing
LCP: a union-find holds the classes, each class an ordered set of positions.
Positions that become adjacent in a class at a distance of at most the LCP of
that union are one period apart, so they seed a run; a seed that no word to
its left extends is the run's start.  Each run is found exactly once, with its
smallest period (see ``runs_of``).

Texts are independent: nothing is shuffled, and a task holds one slice of
texts, or one text, at a time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import byte_sizes, slices, texts, tidy

SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_PIECE = 1 << 20
_BLOCK = 512


def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as numbers into the distinct words, read in pieces of about 1 MB."""
    index: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = at + _PIECE
        # a piece ends at white space
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        found = text[at:end].split()
        for w in found:
            index.setdefault(w, len(index))
        parts.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), list(index)


def _repeated(ids: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each position may occur elsewhere too: equal hashes, so never wrongly false."""
    n = len(ids) - size + 1
    out = np.zeros(len(ids), bool)
    if n < 2:
        return out
    x, h = ids.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``ids`` and each suffix's rank: prefix doubling over the suffixes that are not told apart yet."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    places = np.arange(n)
    fresh = np.r_[True, ids[order[1:]] != ids[order[:-1]]]
    start = np.maximum.accumulate(np.where(fresh, places, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    step = 1
    while True:
        tied = start[1:] == start[:-1]
        at = np.flatnonzero(np.r_[tied, False] | np.r_[False, tied])
        if not len(at):
            return order, rank
        pos = order[at]
        after = pos + step
        key = start[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        heads = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        order[at], start[at] = pos, heads
        rank[pos] = heads
        step *= 2


def common_prefixes(ids: np.ndarray, order: np.ndarray, rank: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """LCP of the suffix at each place of ``order`` and the one before it; 0 where the suffix is not ``wanted``.

    In text order, an LCP is at least the one before it less one.
    """
    n = len(ids)
    out = np.zeros(n, np.int64)
    x, sa, at, lcp = memoryview(np.ascontiguousarray(ids)), memoryview(order), memoryview(rank), memoryview(out)
    h, last = 0, -2
    for i in np.flatnonzero(wanted).tolist():
        if i != last + 1:
            h = 0
        last = i
        r = at[i]
        if not r:
            h = 0
            continue
        j = sa[r - 1]
        most = n - max(i, j)
        while h < most and x[i + h] == x[j + h]:
            h += 1
        lcp[r] = h
        if h:
            h -= 1
    return out


class _Positions:
    """An ordered set of positions in sorted blocks: an insertion moves at most one block."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def insert(self, p: int) -> tuple[int, int]:
        """Add ``p``; its neighbours before and after it, -1 where there is none."""
        k = max(0, bisect_left(self.heads, p) - 1)
        block = self.blocks[k]
        i = bisect_left(block, p)
        before = block[i - 1] if i else -1
        after = block[i] if i < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else -1
        block.insert(i, p)
        self.size += 1
        if not i:
            self.heads[k] = p
        if len(block) > 2 * _BLOCK:
            self.blocks[k : k + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.heads.insert(k + 1, block[_BLOCK])
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def runs_of(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start and period.

    A run is a stretch with smallest period ``q`` and at least
    ``max(least, times * q)`` words that no neighbouring word extends with that
    period; ``times`` is at least 2.

    Why a union's seeds suffice: a run's start ``i`` and ``i + q`` have an LCP
    of ``length - q``, at least ``q``.  A class member between them would give
    the run a smaller period, so they become adjacent in the union that joins
    them, whose LCP is theirs.  And a seed's distance ``d`` is the smallest
    period of its stretch: a smaller one divides ``d``, and its next period's
    start would have joined the class of ``i`` before.
    """
    if times < 2:
        raise ValueError("times must be at least 2")
    # a run of period q has an LCP of at least max(least - q, (times - 1) * q), so shorter ones need no union
    floor = max(1, min(max(least - q, (times - 1) * q) for q in range(1, max(1, least) + 1)))
    wanted = _repeated(ids, floor)
    if not wanted.any():
        return []
    n = len(ids)
    order, rank = suffix_order(ids)
    lcp = common_prefixes(ids, order, rank, wanted)
    edges = np.flatnonzero(lcp >= floor)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    sa, x = memoryview(order), memoryview(np.ascontiguousarray(ids))
    parent: dict[int, int] = {}
    classes: dict[int, _Positions] = {}

    def find(a: int) -> int:
        while (up := parent.get(a, a)) != a:
            parent[a] = a = parent.get(up, up)
        return a

    out = []
    for r, level in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = find(r - 1), find(r)
        large, small = classes.pop(a, None) or _Positions(sa[a]), classes.pop(b, None) or _Positions(sa[b])
        if large.size < small.size:
            large, small, a, b = small, large, b, a
        last = -1
        for p, following in pairwise(chain(small, (n,))):
            before, after = large.insert(p)
            # only pairs that end up adjacent, of one position from each class
            for i, j in ((before if before != last else -1, p), (p, after if after < following else -1)):
                d = j - i
                if i >= 0 and d > 0 and (times - 1) * d <= level and d + level >= least and (not i or x[i - 1] != x[j - 1]):
                    out.append((i, level + d, d))
            last = p
        parent[b] = a
        classes[a] = large
    return sorted(out, key=lambda run: (run[0], run[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words stays: of a run only the first period does, and nothing that another run drops."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _joined(ids: np.ndarray, vocabulary: list[bytes]) -> str:
    steps = range(0, len(ids), _PIECE)
    return b" ".join(b" ".join(vocabulary[i] for i in ids[k : k + _PIECE].tolist()) for k in steps).decode()


def _find(least: int, times: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, byte_sizes(whole.column(1)), 4 << 20):
                found, collapsed = [], []
                for text in texts(batch.column(1)):
                    ids, vocabulary = word_numbers(text)
                    runs = runs_of(ids, least, times)
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    collapsed.append(_joined(ids[kept_words(len(ids), runs)] if runs else ids, vocabulary))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """``doc_id, runs, collapsed`` for every row of ``docs`` (``doc_id``, ``text``; further columns are not read).

    ``runs``: start, length and period, in words, of every run of at least
    ``least`` words and ``times`` periods, by start and period.  ``collapsed``:
    the words without those that lie in a run after its first period, joined by
    one space.  A null or empty text, or one of white space, has no runs and
    collapses to an empty text.  Repeated rows and null ids are rows like any
    other; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_find(least, times), SCHEMA)


def greatest_run(runs: Column) -> Column:
    """The run with the greatest exact length by period; ties: smallest start, then period.  Null without a run."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, runs[0], lambda best, r: F.when(better(r, best), r).otherwise(best)))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the greatest run and digests of what ``periodic_runs`` found."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", greatest_run(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
