"""Benchmark decontamination by suffix arrays over shards of the training text.

Each shard (a run of documents in one task) gets a suffix array over its
words, sorted to the end.  Every suffix of every test item that can hold a
window is binary-searched in it: first its window, whose interval holds all
verbatim occurrences, then, where there are any, the whole suffix, whose place
among each document's own suffixes gives the longest match there.  No two
lists of places are ever paired.  Words outside the test vocabulary end a match
wherever they stand, so only runs of known words that are long enough to hold a
window enter the array: a pruning that loses nothing.

Longer agreement than a window is found by binary search over prefix hashes;
what is reported is compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import alnum_words, byte_sizes, slices, texts, tidy
from spanloom.llm.repeats import PrefixHashes
from spanloom.llm.runs import suffix_order

SCHEMA_OF_HITS = "n_words long, spans array<struct<start:int,length:int>>, matches array<struct<item:string,item_start:int,start:int,length:int>>, items array<string>"


class Words:
    """Word ids with a 0 after each run of words."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.hashes = ids, PrefixHashes(ids)
        end = np.flatnonzero(ids == 0)
        #: How many words there are from each place to the end of its run.
        self.left = end[np.searchsorted(end, np.arange(len(ids)))] - np.arange(len(ids))


def common_words(one: Words, a: np.ndarray, two: Words, b: np.ndarray) -> np.ndarray:
    """How many words from ``a`` and from ``b`` on agree, by hashes: never too few."""
    lo, hi = np.zeros(len(a), np.int64), np.minimum(one.left[a], two.left[b])
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = one.hashes.of(a, mid) == two.hashes.of(b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


@dataclass
class Block:
    """Part of the test set: its words' ids, windows and suffixes."""

    word_ids: dict[bytes, int]
    items: list[str]
    #: All items' word ids, a 0 after each.
    text: np.ndarray
    #: By window length: distinct windows (one a row), where each one's suffixes begin in the last array, and the suffixes' positions.
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    item_of: np.ndarray
    item_start: np.ndarray

    @cached_property
    def words(self) -> Words:
        return Words(self.text)


def build_block(rows: list[tuple[str, str | None]], window: int) -> Block:
    word_ids: dict[bytes, int] = {}
    items, text, owner, starts = [], [], [], []
    occurrences: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for item, body in rows:
        ids = [word_ids.setdefault(w, len(word_ids) + 1) for w in alnum_words((body or "").encode())]
        if not ids:
            continue
        k, base = len(items), len(text)
        items.append(item)
        size = min(window, len(ids))
        seen = occurrences.setdefault(size, {})
        for at in range(len(ids) - size + 1):
            seen.setdefault(tuple(ids[at : at + size]), []).append(base + at)
        text += [*ids, 0]
        owner += [k] * (len(ids) + 1)
        starts += [*range(len(ids)), -1]
    windows = {}
    for size, seen in occurrences.items():
        rows_of = np.array(list(seen), np.int32).reshape(-1, size)
        windows[size] = (rows_of, np.cumsum([0, *map(len, seen.values())]), np.array([p for ps in seen.values() for p in ps], np.int64))
    return Block(word_ids, items, np.array([*text, 0], np.int32), windows, np.array([*owner, -1]), np.array([*starts, -1]))


def bounds(text: np.ndarray, order: np.ndarray, rows: np.ndarray, right: bool) -> np.ndarray:
    """For each row of word ids, how many suffixes in ``order`` are smaller (``right``: or begin with it)."""
    size = rows.shape[1]
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
    along = np.arange(size)
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        found = text[np.minimum(order[mid][:, None] + along, len(text) - 1)]
        differs = found != rows[live]
        first = differs.argmax(axis=1)
        some = differs.any(axis=1)
        at = np.arange(len(live))
        less = np.where(some, found[at, first] < rows[live][at, first], right)
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
    return lo


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts, each row's number as often as it counts, and its place in that: ``[2, 0, 1]`` gives ``[0, 0, 2], [0, 1, 0]``."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _insertion(text: Words, order: np.ndarray, block: Words, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where each ``suffix`` of the block belongs in ``order`` between ``lo`` and ``hi``."""
    lo, hi = lo.copy(), hi.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        x, y = order[mid], suffix[live]
        n = common_words(text, x, block, y)
        less = text.ids[x + n] < block.ids[y + n]
        lo[live], hi[live] = np.where(less, mid + 1, lo[live]), np.where(less, hi[live], mid)
    return lo


def _best(found: list[np.ndarray]) -> list[np.ndarray]:
    """Of rows (document, item, length, ...) those with the greatest length of their document and item."""
    order = np.lexsort((-found[2], found[1], found[0]))
    doc, item, length = (c[order] for c in found[:3])
    new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))[: len(order)]
    top = length[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else length
    return [c[order[length == top]] for c in found]


def _longest_plainly(text: Words, at: np.ndarray, block: Words, suffix: np.ndarray) -> tuple[int, int, int]:
    """(length, place, suffix) of the longest common run of words, every pair compared word by word."""
    out = (0, 0, 0)
    for x in at.tolist():
        for y in suffix.tolist():
            n = int(min(text.left[x], block.left[y]))
            differs = np.flatnonzero(text.ids[x : x + n] != block.ids[y : y + n])
            n = int(differs[0]) if len(differs) else n
            out = max(out, (n, -x, -y))
    return out[0], -out[1], -out[2]


def _longest_matches(text: Words, order: np.ndarray, block: Block, size: int, lo: np.ndarray, hi: np.ndarray, doc_of: np.ndarray, most: int) -> list[np.ndarray]:
    """(document, item, place in the block, place in the text, length) of the longest match of each document and item.

    Of equal ones the first in the document, then in the item.
    """
    _, begin, positions = block.windows[size]
    words = block.words
    hit = np.flatnonzero(hi > lo)
    which, k = _spread(hi[hit] - lo[hit])
    rank = lo[hit][which] + k
    doc = doc_of[order[rank]]
    by = np.lexsort((rank, doc, which))
    which, rank, doc = which[by], rank[by], doc[by]
    # a group: one window's places in one document, in order of their suffixes
    new = np.append(True, (which[1:] != which[:-1]) | (doc[1:] != doc[:-1]))
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    end = np.append(first[1:], len(rank))
    keys = group * (len(order) + 1) + rank
    groups = np.bincount(which[first], minlength=len(hit))
    group_begin = np.cumsum(groups) - groups
    own, k = _spread((begin[1:] - begin[:-1])[hit])
    suffix = positions[begin[hit][own] + k]
    at = _insertion(text, order, words, suffix, lo[hit][own], hi[hit][own])
    found: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(6)]
    upto, start = np.cumsum(groups[own]), 0
    while start < len(own):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
        row, k = _spread(groups[own[start:stop]])
        row += start
        g = group_begin[own[row]] + k
        near = np.searchsorted(keys, g * (len(order) + 1) + at[row])
        length = np.zeros(len(row), np.int64)
        for side in (near - 1, near):
            fits = (side >= first[g]) & (side < end[g])
            length[fits] = np.maximum(length[fits], common_words(text, order[rank[side[fits]]], words, suffix[row[fits]]))
        some = [doc[first[g]], block.item_of[suffix[row]], length, suffix[row], g, near]
        found = _best([np.concatenate(c) for c in zip(found, some, strict=True)])
        start = stop
    doc_, item, length, suffix, g, near = found
    # of equal strings of an item one stands for all, so that no place is counted twice
    by = np.lexsort((suffix, words.hashes.of(suffix, length), g, item, doc_))
    code = words.hashes.of(suffix, length)[by]
    a, b = by[1:], by[:-1]
    fresh = np.append(True, (doc_[a] != doc_[b]) | (item[a] != item[b]) | (g[a] != g[b]) | (code[1:] != code[:-1]))[: len(by)]
    doc_, item, length, suffix, g, near = (c[by[fresh]] for c in found)
    ends = []
    for low in (True, False):  # how far the places that agree as long reach on either side
        x, y = (first[g], near.copy()) if low else (near.copy(), end[g])
        while (live := np.flatnonzero(x < y)).size:
            mid = (x[live] + y[live]) // 2
            enough = common_words(text, order[rank[mid]], words, suffix[live]) >= length[live]
            if low:
                x[live], y[live] = np.where(enough, x[live], mid + 1), np.where(enough, mid, y[live])
            else:
                x[live], y[live] = np.where(enough, mid + 1, x[live]), np.where(enough, y[live], mid)
        ends.append(x)
    row, k = _spread(ends[1] - ends[0])
    place = order[rank[ends[0][row] + k]]
    by = np.lexsort((suffix[row], place, item[row], doc_[row]))
    row, place = row[by], place[by]
    new = np.append(True, (doc_[row[1:]] != doc_[row[:-1]]) | (item[row[1:]] != item[row[:-1]]))[: len(row)]
    row, place = row[new], place[new]
    out = [doc_[row], item[row], suffix[row], place, length[row]]
    for i, (x, y, n) in enumerate(zip(*(c.tolist() for c in (out[3], out[2], out[4])), strict=True)):
        if not (text.ids[x : x + n] == words.ids[y : y + n]).all():  # a hash collision
            mine = np.flatnonzero(doc == out[0][i])
            n, x, y = _longest_plainly(text, np.unique(order[rank[mine]]), words, np.flatnonzero(block.item_of == out[1][i]))
            out[2][i], out[3][i], out[4][i] = y, x, n
    return out


def _search(block: Block, shard: list[list[bytes]], most: int = 1_000_000) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Windows that occur in ``shard``, (document, word, length), and the longest match of each document and item, (document, item, item's word, word, length)."""
    none = [np.empty(0, np.int64) for _ in range(5)]
    get = block.word_ids.get
    least = min(block.windows)
    counts = np.fromiter(map(len, shard), np.int64, len(shard))
    ids = np.fromiter((get(w, 0) for words in shard for w in [*words, b""]), np.int32, int(counts.sum()) + len(shard))
    zero = np.flatnonzero(ids == 0)
    run = np.diff(np.append(zero, len(ids))) - 1  # known words after each unknown one or document's end
    begins = np.append(0, zero + 1) if len(zero) and zero[0] > 0 else zero + 1
    sizes = np.append(zero[0], run) if len(zero) and zero[0] > 0 else run
    long = sizes >= least
    begins, sizes = begins[long], sizes[long]
    if not len(begins):
        return none[:3], none
    # text of the runs kept, each closed by a 0; place: where each word stood
    total = int((sizes + 1).sum())
    at = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.repeat(begins - at, sizes + 1) + np.arange(total)
    text = Words(np.where(np.arange(total) == np.repeat(at + sizes, sizes + 1), 0, ids[np.minimum(place, len(ids) - 1)]))
    doc_start = np.cumsum(counts + 1) - (counts + 1)
    doc_of = np.searchsorted(doc_start, place, side="right") - 1
    order = suffix_order(text.ids)[0]
    order = order[text.left[order] >= least]
    spans, longest = [none[:3]], [none]
    for size, (windows, _, _) in block.windows.items():
        lo, hi = bounds(text.ids, order, windows, False), bounds(text.ids, order, windows, True)
        if not (hi > lo).any():
            continue
        w, k = _spread(hi - lo)
        p = order[lo[w] + k]
        spans.append([doc_of[p], place[p] - doc_start[doc_of[p]], np.full(len(p), size)])
        doc, item, suffix, p, length = _longest_matches(text, order, block, size, lo, hi, doc_of, most)
        longest.append([doc, item, block.item_start[suffix], place[p] - doc_start[doc], length])
    return [np.concatenate(c) for c in zip(*spans, strict=True)], [np.concatenate(c) for c in zip(*longest, strict=True)]


def _scan(spark_block, shard_bytes: int, text_at: int, before: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = spark_block.value
        for whole in batches:
            for batch in slices(whole, byte_sizes(whole.column(text_at)), shard_bytes):
                shard = [alnum_words(t) for t in texts(batch.column(text_at))]
                spans: list[list[tuple[int, int]]] = [[] for _ in shard]
                matches: list[dict] = [{} for _ in shard]
                occurring, longest = _search(block, shard) if block.windows else ((), ())
                for doc, word, size in zip(*(c.tolist() for c in occurring), strict=True):
                    spans[doc].append((word, size))
                for doc, item, item_word, word, length in zip(*(c.tolist() for c in longest), strict=True):
                    matches[doc][item] = (item_word, word, length)
                columns = []
                for k in range(len(shard)):
                    columns.append((len(shard[k]), _union(spans[k]), [{"item": block.items[i], "item_start": a, "start": b, "length": n} for i, (a, b, n) in sorted(matches[k].items())], sorted({block.items[i] for i in matches[k]})))
                if before:  # earlier blocks of the test set have been searched
                    names = batch.schema.names
                    old = [batch.column(names.index(c)).to_pylist() for c in ("spans", "matches", "items")]
                    columns = [(n, _union([(s["start"], s["length"]) for s in o[0]] + list(sp)), o[1] + m, sorted({*o[2], *it})) for (n, sp, m, it), *o in zip(columns, *old, strict=True)]
                kept = [c for c in batch.schema.names if c not in ("n_words", "spans", "matches", "items") and not (last and c == "__text")]
                arrays = [batch.column(batch.schema.names.index(c)) for c in kept]
                arrays += [
                    pa.array([c[0] for c in columns], pa.int64()),
                    pa.array([[{"start": s, "length": n} for s, n in c[1]] for c in columns], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                    pa.array([c[2] for c in columns], pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))),
                    pa.array([c[3] for c in columns], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, "n_words", "spans", "matches", "items"])

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint (start, length) that cover the same words, in order."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(set(spans)):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + n - out[-1][0]))
        else:
            out.append((start, n))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int, most_bytes: int) -> list[DataFrame]:
    """The test set, of at most ``most_bytes`` of text, in blocks of about ``block_bytes``, so that each block can be sent to every task."""
    mine = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull())
    total = mine.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total > most_bytes:
        raise ValueError(f"the test set has {total} bytes of text, more than {most_bytes}: search its parts one after the other, or raise most_bytes")
    blocks = max(1, -(-int(total) // block_bytes))
    return [mine.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = 8 << 20, most_bytes: int = 256 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """For each row of ``docs``: ``keep``, ``n_words, spans, matches, items``.

    ``spans``: the words of the document inside any occurrence of a window of
    an item, disjoint and in order.  A window is ``window`` consecutive words
    of an item, or all of an item with fewer.  ``items``: ids (as strings,
    sorted) of items with a window here; ``matches``: for each, its longest
    verbatim match of at least a window (of equal ones the first in the
    document, then in the item) and where it lies.  The test set goes to the
    tasks in blocks of about ``block_bytes``, each block in one pass without a
    shuffle; one of more than ``most_bytes`` of text is an error, as the driver
    holds the blocks.  A null or empty text has no words; items without words or id
    match nothing; repeated rows are judged each for itself; an empty table
    gives no rows, an empty test set no hits.  Columns beside ``keep`` and
    ``text`` are not read.
    """
    spark = docs.sparkSession
    carried = "text" in keep
    out = docs.select(*keep) if carried else docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != "__text")
    blocks = item_blocks(benchmark, block_bytes, most_bytes)
    for k, rows in enumerate(blocks):
        last = k == len(blocks) - 1
        block = spark.sparkContext.broadcast(build_block(sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1] or "")), window))
        out = out.mapInArrow(_scan(block, shard_bytes, keep.index("text") if carried else len(keep), k > 0, last), kinds + (", " if last or carried else ", __text string, ") + SCHEMA_OF_HITS)
    return out


def digest(found: DataFrame) -> DataFrame:
    """The figures of ``contamination`` for each document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, most: float = 0.0) -> DataFrame:
    """``docs`` without the documents of whose words over a share ``most`` lie in occurrences of test windows."""
    rest = [c for c in docs.columns if c != "text"]
    found = contamination(docs.select(F.struct(*rest).alias("__own"), "text"), benchmark, window=window, keep=("__own", "text"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.where(hit <= F.lit(most) * F.col("n_words")).select(*(F.col("text") if c == "text" else F.col("__own")[c].alias(c) for c in docs.columns))
