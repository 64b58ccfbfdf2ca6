"""Removal of byte strings that occur more than once, by hash-compared suffix sorting.

A string of ``size`` bytes has an anchor: the leftmost of its substrings of
``gram`` bytes with the smallest hash.  Equal strings have equal anchors in the
same place, so only anchors travel: about one in ``(size - gram) / 2`` bytes.
Anchors that occur once settle all their strings.  For the rest the
surroundings travel to a group for each anchor; there what follows each anchor,
and what precedes it, are sorted by mergesort, two suffixes being compared by
the first byte after their common extension, which a binary search over prefix
polynomial hashes finds.  How far neighbours agree is then read off their
bytes, so a hash collision cannot remove anything.

Of equal texts (by SHA-256) one stands for all, and of equal surroundings of an
anchor in one text one travels.  An anchor of very many places is thinned in
parts first, equal surroundings being found by their bytes; those of the most
frequent anchors are then dealt into groups by further bytes next to the anchor,
so that a group's strings have almost all of their bytes in common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import byte_sizes, kept_between_tasks, slices, texts, tidy, whole_groups
from spanloom.operators.components import durable

SIZE, GRAM = 200, 80
_BASE = 0x9E3779B97F4A7C15
_MAX_SLICE = 1 << 20


class PrefixHashes:
    """Polynomial hashes modulo 2**64 of all prefixes of ``data``; any substring's hash in a few operations."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = _BASE) -> None:
        power, self.inverse = self._powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._tables.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)

            def powers(b: int) -> np.ndarray:
                out = np.full(size, b, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            have = cls._tables[base] = (powers(base), powers(pow(base, -1, 1 << 64)))
            kept_between_tasks(__name__, cls._tables.clear)
        return have

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: by prefix and suffix minima of blocks of that width."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``size`` bytes inside the documents that ``ends`` delimits.

    Returns arrays (document, anchor, first string's start, last string's
    start, hash of the anchor): the strings that start between the two have
    this anchor; starts count from ``data``'s.
    """
    if len(data) < size:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    hashes = PrefixHashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = _mix(hashes.of(at, gram))
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    least = _sliding_min((grams >> bits << bits) | at.astype(np.uint64), size - gram + 1)
    start = np.arange(len(least))
    doc = np.searchsorted(ends, start, side="right")
    inside = start + size <= ends[np.minimum(doc, len(ends) - 1)]
    start, doc = start[inside], doc[inside]
    anchor = (least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(start):
        return anchors(data[:0], ends, size, gram)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a = anchor[first]
    return doc[first], a, start[first], start[last], grams[a]


def _emit_anchors(size: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, byte_sizes(whole.column(2)), _MAX_SLICE):
                body = [b for b in texts(batch.column(2))]
                key, tag = (batch.column(c).to_numpy() for c in (0, 1))
                long = len(body) == 1 and len(body[0]) > _MAX_SLICE
                # a long document goes in parts: each has the strings that start in its own stretch
                for cut in range(0, max(1, len(body[0]) - size + 1), _MAX_SLICE) if long else [0]:
                    part = [body[0][cut : cut + _MAX_SLICE + size - 1]] if long else body
                    ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
                    doc, a, p0, p1, ah = anchors(np.frombuffer(b"".join(part), np.uint8), ends, size, gram)
                    begin = np.append(0, ends)[:-1][doc] - cut
                    yield pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), pa.array(key[doc]), pa.array(tag[doc]), pa.array(_pack(a - begin, a - p0, a - p1))], ["ah", "k", "t", "at"])

    return run


def _pack(anchor: np.ndarray, far: np.ndarray, close: np.ndarray) -> np.ndarray:
    """An anchor's place, and how far before it its first and its last string start."""
    return anchor << 16 | far << 8 | close


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of an anchor's strings."""
    a = at >> 16
    return a - (at >> 8 & 255), a - (at & 255)


def _equal_surroundings(body: list[bytes], row: np.ndarray, ah: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For each anchor of a text the position of one with equal surroundings in it: of all equal ones the same one.

    Nothing is copied for a place: hashes of stretches of about 1 MB tell
    candidates, and the bytes are compared where they stand.
    """
    p0, p1 = _unpack(at)
    data = np.frombuffer(b"".join(body), np.uint8)
    sizes = np.fromiter(map(len, body), np.int64, len(body))
    start, length = (np.cumsum(sizes) - sizes)[row] + p0, p1 - p0 + size
    whole, by = np.empty(len(row), np.uint64), np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[by], np.arange(0, len(data) + _MAX_SLICE, _MAX_SLICE))
    for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if i < j:
            mine, cut = by[i:j], k * _MAX_SLICE
            whole[mine] = PrefixHashes(data[cut : cut + _MAX_SLICE + 255 + size]).of(start[mine] - cut, length[mine])
    order = np.lexsort((whole, at & 0xFFFF, ah, row))
    a, b = order[1:], order[:-1]
    new = np.append(True, (row[a] != row[b]) | (ah[a] != ah[b]) | (at[a] & 0xFFFF != at[b] & 0xFFFF) | (whole[a] != whole[b]))
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    others = np.flatnonzero(first != np.arange(len(first)))
    odd = [i for i, r, x, n, y in zip(others.tolist(), row[others].tolist(), p0[others].tolist(), length[others].tolist(), p0[first[others]].tolist(), strict=True) if body[r][x : x + n] != body[r][y : y + n]]
    first[odd] = odd  # a hash collision
    return first


def _contexts(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The surroundings of each anchor of ``hits``; ``part``: which part of the anchor's places, -1 where they are few."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, byte_sizes(whole.column(2)), _MAX_SLICE):
                key, tag = (batch.column(c).to_numpy() for c in (0, 1))
                hits = batch.column(3)
                counts = np.diff(hits.offsets.to_numpy())
                flat = hits.flatten()
                ah, at, parts = (flat.field(c).to_numpy() for c in ("ah", "at", "parts"))
                row = np.repeat(np.arange(len(counts)), counts)
                if not len(row):
                    continue
                p0, p1 = _unpack(at)
                body = list(texts(batch.column(2)))
                first = _equal_surroundings(body, row, ah, at, size)
                order = np.argsort(first, kind="stable")
                one, begin = np.unique(first[order], return_index=True)
                places = np.split(at[order], begin[1:])
                around = [body[r][a : b + size] for r, a, b in zip(row[one].tolist(), p0[one].tolist(), p1[one].tolist(), strict=True)]
                dealt = (_mix(_mix(key[row[one]].view(np.uint64)) ^ tag[row[one]].view(np.uint64)) >> np.uint64(1)).astype(np.int64) % np.maximum(parts[one], 1)
                yield _rows(ah[one], np.where(parts[one] > 1, dealt, -1), parts[one], key[row[one]], tag[row[one]], places, around, np.array([len(x) > 1 for x in places]))

    return run


#: ``g``: group; ``at``: places of the text with these surroundings, see ``_pack``; ``body``: the bytes from the first string's start to the last one's end; ``done``: its strings are known to occur again.
_ROWS = "g long, part long, parts long, k long, t long, at array<long>, body binary, done boolean"


def _rows(g: np.ndarray, part: np.ndarray, parts: np.ndarray, key: np.ndarray, tag: np.ndarray, at: list[list[int]], bodies: list[bytes], done: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(x.astype(np.int64)) for x in (g, part, parts, key, tag)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(at, pa.list_(pa.int64())), pa.array(bodies, pa.binary()), pa.array(done.astype(bool))], [c.split()[0] for c in _ROWS.split(", ")])


def _columns(table: pa.Table) -> tuple[list[np.ndarray], list[list[int]], list[bytes], np.ndarray]:
    numbers = [table.column(c).to_numpy() for c in ("g", "part", "parts", "k", "t")]
    return numbers, table.column("at").to_pylist(), [b for chunk in table.column("body").chunks for b in texts(chunk)], table.column("done").to_numpy().astype(bool)


def _thin(crowd: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows with equal surroundings one stays in its group, ``done``; the others are done and need no group."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 4_000):
            (g, part, parts, key, tag), at, bodies, done = _columns(table)
            first = equal_rows(bodies, g, np.array([x[0] for x in at]))
            mine = first == np.arange(len(first))
            copied = (np.bincount(first, minlength=len(first)) > 1)[first]
            alone = _mix(_mix(key.view(np.uint64)) ^ tag.view(np.uint64) ^ g.view(np.uint64)).view(np.int64)
            yield _rows(np.where(mine, g, alone), part // crowd, parts, key, tag, at, [b if m else b"" for b, m in zip(bodies, mine.tolist(), strict=True)], done | copied)

    return run


def _divide(size: int, gram: int, above: int, levels: int = 3) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deal the strings of anchors with over ``above`` parts into groups by further bytes.

    The rows of a group share, by hash, the bytes from ``left`` before their
    anchor to ``right`` after it.  A string reaches at least half of what is
    left of its length beyond that on one side: those before or, if these are
    not in it, those after become part of its group; so at each level.
    """

    def divided(group: int, far: int, close: int, body: bytes, left: int, right: int, level: int) -> Iterator[tuple[int, int, int, bytes]]:
        import xxhash

        half = (size - gram - left - right) // 2
        if level == levels or half < 1:
            yield group, far, close, body
            return
        for low, high, begin, side in ((max(close, left + half), far, far - left - half, 1), (close, min(far, left + half - 1), far + gram + right, 0)):
            if low <= high:
                deeper = xxhash.xxh64_intdigest(body[begin : begin + half], (group * 2 + side) & (1 << 64) - 1)
                yield from divided(deeper, high, low, body[far - high : far - low + size], left + side * half, right + (1 - side) * half, level + 1)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in (pa.Table.from_batches([b]) for b in batches if b.num_rows):
            (g, part, parts, key, tag), at, bodies, done = _columns(table)
            rows, groups, places, pieces = [], [], [], []
            for i, body in enumerate(bodies):
                code = at[i][0]
                split = divided(int(g[i]), code >> 8 & 255, code & 255, body, 0, 0, 0) if body and parts[i] > above else [(int(g[i]) & (1 << 64) - 1, code >> 8 & 255, code & 255, body)]
                for group, far, close, piece in split:
                    rows.append(i)
                    groups.append(group & (1 << 64) - 1)
                    places.append([x >> 16 << 16 | far << 8 | close for x in at[i]])
                    pieces.append(piece)
            yield _rows(np.array(groups, np.uint64).view(np.int64), part[rows], parts[rows], key[rows], tag[rows], places, pieces, done[rows])

    return run


def common_extension(hashes: PrefixHashes, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """How many bytes from ``x`` and from ``y`` agree, up to ``most``: a binary search over prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = hashes.of(x, mid) == hashes.of(y, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def sort_suffixes(data: np.ndarray, hashes: PrefixHashes, start: np.ndarray, klass: np.ndarray, size: int) -> np.ndarray:
    """An order of the suffixes at ``start``, by class and then by their first ``size`` bytes.

    ``klass`` must ascend.  A mergesort from the bottom up: all pairs of
    neighbouring runs of all classes are merged at once, each suffix finding
    its rank in the other run by binary search.
    """
    order = np.arange(len(start))
    first = np.append(True, klass[1:] != klass[:-1])
    begin = np.flatnonzero(first)[np.cumsum(first) - 1]
    count = np.diff(np.append(np.flatnonzero(first), len(klass)))[np.cumsum(first) - 1]
    rank = np.arange(len(start)) - begin
    width, most = 1, int(count.max()) if len(count) else 0
    while width < most:
        run = rank // width
        right = run % 2 == 1
        other = np.where(right, run - 1, run + 1) * width
        lo = np.minimum(other, count)
        begin_other = lo.copy()
        hi = np.minimum(other + width, count)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            x, y = start[order[live]], start[order[begin[live] + mid]]
            n = common_extension(hashes, x, y, size)
            equal = n >= size
            at = np.minimum(n, size - 1)
            less = np.where(equal, right[live], data[y + at] < data[x + at])
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        target = begin + (run // 2) * 2 * width + rank % width + (lo - begin_other)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def _padded(data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """A row for each run of ``length`` bytes from ``begin`` on (backwards: before it), zeros after its end."""
    along = np.arange(width)
    where = begin[:, None] + (along if step > 0 else -1 - along)
    return np.where(along < length[:, None], data[np.clip(where, 0, len(data) - 1)], 0).astype(np.uint8)


def sorted_rows(rows: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place in the order by class and bytes, and how far each place agrees with the one before (-1: another class).

    The order comes from ``sort_suffixes``.  The extensions are then read off
    the bytes themselves; should a hash collision have spoilt the order, the
    rows are sorted by their bytes.
    """
    n, width = rows.shape
    flat = np.ascontiguousarray(rows).ravel()
    order = sort_suffixes(flat, PrefixHashes(flat), np.arange(n) * width, klass, width)
    for _ in range(2):
        a, b = rows[order[:-1]], rows[order[1:]]
        differs = a != b
        some = differs.any(axis=1)
        first = differs.argmax(axis=1)
        at = np.arange(n - 1)
        same = klass[order[1:]] == klass[order[:-1]]
        if not (same & some & (a[at, first] > b[at, first])).any():
            break
        order = np.lexsort((*rows.T[::-1], klass))
    agree = np.append(-1, np.where(same, np.where(some, first, width), -1))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place, agree


def equal_rows(bodies: list[bytes], group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row the position of one with the same group, reach and bytes: of all equal rows the same one."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    length = np.fromiter(map(len, bodies), np.int64, len(bodies))
    whole = PrefixHashes(data).of(np.cumsum(length) - length, length)
    order = np.lexsort((whole, at & 0xFFFF, group))
    a, b = order[1:], order[:-1]
    new = np.append(True, (group[a] != group[b]) | (whole[a] != whole[b]) | (at[a] & 0xFFFF != at[b] & 0xFFFF))
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    odd = [i for i in np.flatnonzero(first != np.arange(len(first))).tolist() if bodies[i] != bodies[first[i]]]
    first[odd] = odd  # a hash collision
    return first


def repeated_starts(bodies: list[bytes], group: np.ndarray, at: np.ndarray, done: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings around each anchor, those that occur again in its group: (row, start in the document).

    All strings of ``done`` rows do.  Equal surroundings settle each other.  Of
    the different ones, what follows the anchor and (backwards) what precedes it
    are two suffixes, each sorted in its group; two strings that reach ``d``
    bytes before their anchors are equal if those before agree over ``d`` bytes
    and those after over ``size - d``.
    """
    p0, p1 = _unpack(at)
    a = at >> 16
    far, close = a - p0, a - p1  # the strings reach between ``far`` and ``close`` bytes before the anchor
    data = np.frombuffer(b"".join(bodies), np.uint8)
    length = np.fromiter(map(len, bodies), np.int64, len(bodies))
    base = np.cumsum(length) - length
    rep = equal_rows(bodies, group, at)
    copies = np.bincount(rep, minlength=len(rep))
    known = done | (copies[rep] > 1)
    settled = np.flatnonzero(known)
    n = (p1 - p0 + 1)[settled]
    rows = [np.repeat(settled, n)]
    starts = [p0[rows[0]] + np.arange(len(rows[0])) - np.repeat(np.cumsum(n) - n, n)]
    first = np.flatnonzero((rep == np.arange(len(rep))) & (length > 0))
    first = first[np.argsort(group[first], kind="stable")]
    if len(first):
        edge = np.append(True, group[first[1:]] != group[first[:-1]])
        first = first[~(edge & np.append(edge[1:], True))]
    if len(first):
        klass, reach, least = group[first], far[first], close[first]
        anchor = base[first] + reach
        after, upto = sorted_rows(_padded(data, anchor, size - least, size, 1), klass)
        before, back = sorted_rows(_padded(data, anchor, reach, max(1, int(reach.max())), -1), klass)
        for d in range(int(least.min()), int(reach.max()) + 1):
            mine = np.flatnonzero((least <= d) & (d <= reach))
            if len(mine) < 2:
                continue
            key = np.cumsum(upto < size - d)[after[mine]] << 32 | np.cumsum(back < d)[before[mine]]
            by = np.argsort(key, kind="stable")
            equal = key[by][1:] == key[by][:-1]
            hit = first[mine[by[np.append(equal, False) | np.append(False, equal)]]]
            hit = hit[~known[hit]]
            rows.append(hit)
            starts.append(a[hit] - d)
    return np.concatenate(rows), np.concatenate(starts)


def _joined_ranges(key: np.ndarray, tag: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> pa.RecordBatch:
    """Ranges of starts, those of one text that touch made one."""
    order = np.lexsort((p0, tag, key))
    key, tag, p0, p1 = key[order], tag[order], p0[order], p1[order]
    text = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])))
    # the farthest end so far in each text; a text's numbers lie above those of the text before
    width = int(p1.max()) + 2
    reach = np.maximum.accumulate(text * width + p1)
    first = np.flatnonzero(np.append(True, text[1:] * width + p0[1:] > reach[:-1] + 1))
    return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(tag[first]), pa.array(p0[first]), pa.array(reach[np.append(first[1:], len(p0)) - 1] - text[first] * width)], ["k", "t", "p0", "p1"])


def _resolve(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g", 4_000):
            (g, _, _, key, tag), places, bodies, done = _columns(table)
            at = np.array([x[0] for x in places])
            row, start = repeated_starts(bodies, g, at, done, size)
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            if len(row):
                new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(row)) - 1
                n = np.array([len(x) for x in places])[row[first]]
                each = np.repeat(np.arange(len(first)), n)  # all places of a row have the same strings
                shift = np.array([x - places[r][0] >> 16 for r in row[first].tolist() for x in places[r]])
                r = row[first][each]
                yield _joined_ranges(key[r], tag[r], start[first][each] + shift, start[last][each] + shift)

    return run


def _at_characters(body: bytes, runs: list[list[int]]) -> list[list[int]]:
    """The runs without the bytes of characters that they would cut in two."""
    out = []
    for a, b in runs:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append([a, b])
    return out


def _cut(size: int, extra: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, byte_sizes(big.column(0)), 4 << 20):
                kept, spans = [], []
                for body, copied, found in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    runs: list[list[int]] = []
                    pairs = [(0, len(body))] if copied and len(body) >= size else sorted((r["p0"], r["p1"] + size) for r in found or ())
                    for a, b in pairs:
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    if whole:
                        runs = _at_characters(body, runs)
                    parts, at = [], 0
                    for a, b in runs:
                        parts.append(body[at:a])
                        at = b
                    kept.append(b"".join([*parts, body[at:]]))
                    spans.append([{"start": a, "length": b - a} for a, b in runs])
                arrays = [batch.column(3 + c) for c in range(extra)]
                arrays += [pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[3 : 3 + extra], "kept", "spans"])

    return run


def _repeated_anchors(found: DataFrame, crowd: int) -> tuple[DataFrame, int]:
    """The rows of ``found`` (``ah, k, t, at``) whose anchor occurs again other than in equal texts, and the places of the most frequent one.

    ``parts``: 1, or how many parts the anchor's places are dealt into.
    """
    ends = [f("t").alias(f"t{k}") for k, f in enumerate((F.min, F.max))] + [f("at").alias(f"at{k}") for k, f in enumerate((F.min, F.max))]
    counts = durable(found.groupBy("ah").agg(F.count("*").alias("n"), *ends).where((F.col("t0") != F.col("t1")) | (F.col("at0") != F.col("at1"))).select("ah", "n"))
    total, top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    # at most 4096 anchors hold so many places each: they are broadcast, and their rows go over many tasks
    hot = counts.where(F.col("n") > F.lit(max(crowd, total // 4096)))
    spread = 64
    salted = found.join(F.broadcast(hot.select("ah", F.lit(True).alias("hot"))), "ah", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("k", "t", "at"), F.lit(spread)).cast("int")).otherwise(0))
    places = F.when(F.col("n") > F.lit(max(crowd, total // 4096)), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    parts = F.when(F.col("n") > crowd, F.ceil(F.col("n") / crowd)).otherwise(1).cast("long")
    return salted.join(counts.select("ah", parts.alias("parts"), F.explode(places).alias("salt")), ["ah", "salt"]).select("k", "t", "ah", "at", "parts"), top


def _thinned(around: DataFrame, size: int, gram: int, crowd: int, largest: int, top: int) -> DataFrame:
    """Rows of crowded anchors with few of equal surroundings, those of anchors with over ``largest`` places divided."""
    thin, divide = _thin(crowd), _divide(size, gram, largest // crowd)
    while top > crowd:
        top //= crowd
        step = thin if top > crowd else lambda batches: divide(thin(batches))  # in one worker
        around = around.withColumn("cell", F.xxhash64("g", "part")).repartition("cell").sortWithinPartitions("cell").mapInArrow(step, _ROWS)
    return around


def remove_repeats(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), size: int = SIZE, gram: int = GRAM, crowd: int = 2_000, largest: int = 50_000, whole_characters: bool = False) -> DataFrame:
    """For each row of ``docs`` (``doc_id``, ``text``): ``keep``, ``kept`` (binary), ``spans``.

    ``spans``: (start, length) of the maximal runs of bytes covered by strings
    of ``size`` bytes that also start anywhere else in the texts; ``kept``: the
    other bytes.  All occurrences are removed.  A null or empty text keeps
    nothing and loses nothing; texts shorter than ``size`` stay; repeated rows
    are occurrences of each other; an empty table gives no rows.  Columns
    beside ``keep`` are not read.  An anchor of over ``crowd`` places is dealt
    into parts of about so many, and one of over ``largest`` places is divided.
    ``whole_characters``: a character that a run would cut in two stays whole.
    """
    if size - gram > 255:
        raise ValueError("an anchor must lie within 255 bytes of its strings' starts")
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    tagged = docs.select(F.coalesce(doc, F.lit(-1)).alias("k"), F.xxhash64(doc.isNull(), text).alias("t"), text.alias("text"), F.struct(*keep).alias("own") if keep else F.lit(None).alias("own"))
    equal = tagged.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("k", "t")).alias("one"), (F.count("*") > 1).alias("copied"))
    found = tagged.select("k", "t", "text").mapInArrow(_emit_anchors(size, gram), "ah long, k long, t long, at long")
    hits, top = _repeated_anchors(found, crowd)
    lists = hits.groupBy("k", "t").agg(*(F.collect_set(F.when(is_few if name == "few" else ~is_few, F.struct("ah", "at", "parts"))).alias(name) for is_few in [F.col("parts") == 1] for name in ("few", "many")))
    stands = tagged.join(equal.select("one.*", "copied"), ["k", "t"], "left")  # null in ``copied``: another row stands for this one
    open_ = lambda name: stands.join(lists, ["k", "t"], "left").where(F.col("copied").isNotNull() & (F.size(name) > 0)).select("k", "t", "text", name, "own").mapInArrow(_contexts(size), _ROWS)  # noqa: E731  all columns of ``tagged`` each time, so that the texts travel once
    around = open_("few")
    if top > crowd:
        around = around.unionByName(_thinned(open_("many"), size, gram, crowd, largest, top))
    groups = around.repartition("g").sortWithinPartitions("g")
    ranges = groups.mapInArrow(_resolve(size), "k long, t long, p0 long, p1 long")
    more = ranges.groupBy("k", "t").agg(F.collect_set(F.struct("p0", "p1")).alias("found"))
    named = stands.join(more, ["k", "t"], "left").select(F.col("text").alias("__text"), F.coalesce("copied", F.lit(True)).alias("__copied"), F.col("found").alias("__found"), *(F.col("own")[c].alias(c) for c in keep))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["kept binary", "spans array<struct<start:bigint,length:bigint>>"])
    return named.mapInArrow(_cut(size, len(keep), whole_characters), schema)


def digest(cut: DataFrame) -> DataFrame:
    """The figures of ``remove_repeats`` for each document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return cut.select("doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, *, size: int = SIZE) -> DataFrame:
    """``docs`` with their texts cut (``n_chars``, if there, is counted anew); characters stay whole; no row goes."""
    rest = [c for c in docs.columns if c != "text"]
    wrapped = docs.select("doc_id", "text", F.struct(*rest, F.col("text").isNull().alias("text")).alias("__own"))
    cut = remove_repeats(wrapped, keep=("__own",), size=size, whole_characters=True)
    text = F.when(~F.col("__own")["text"], F.decode("kept", "UTF-8"))
    out = cut.select(*(text.alias("text") if c == "text" else F.col("__own")[c].alias(c) for c in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
