"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has a bit set where over half of its shingles' hashes
have it.  Fingerprints that differ in at most ``budget`` bits are linked.  The
64 bits are cut into blocks; of ``budget + clean`` blocks at least ``clean``
agree in any linked pair, so pairs meet under the key of those blocks.  Under a
key the fingerprints form a binary trie; pairs of its nodes are traversed
together from the root, differing bits add up, and a pair of nodes goes as soon
as they exceed the budget.  Only distinct fingerprints are joined, and a key
gives a spanning forest of its links, not all pairs.

``drop_near_duplicates`` asks for similar shingle sets instead of a few bits.
Two texts of similarity 0.8 differ in ten bits of 64 on average, so no block of
bits need agree; there pairs meet under keys of minimal shingle hashes, the
trie is traversed with a budget that such pairs keep to, and what it leaves is
compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import byte_sizes, slices, texts, tidy, whole_groups
from spanloom.operators.components import connected_components, durable

BITS = 64
#: The hash of a shingle is XXH64 with this seed.
HASH_SEED = 42


def simhash_of(text: bytes, words_each: int = 4, seed: int = HASH_SEED) -> int:
    """Fingerprint of UTF-8 text: A-Z lower-cased, words at ASCII white space; 0 without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    n = max(1, len(words) - words_each + 1)
    digest = xxhash.xxh64_intdigest
    last = (ends[words_each - 1 :] if len(words) >= words_each else ends[-1:]) - 1
    ones = np.zeros(BITS, np.int64)
    first, last = starts[:n].tolist(), last.tolist()
    for k in range(0, n, 8192):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[k : k + 8192], last[k : k + 8192], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(words_each: int, seeds: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            rows = []
            for text in texts(batch.column(1)):
                if (got := seen.get(text)) is None:
                    got = seen[text] = [simhash_of(text, words_each, s) for s in seeds]
                rows.append(got)
            prints = np.array(rows, np.uint64).reshape(-1, len(seeds)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, k]) for k in range(len(seeds)))], ["doc_id", *(f"fp{k}" for k in range(len(seeds)))])

    return run


def fingerprints(docs: DataFrame, words_each: int = 4, seeds: tuple[int, ...] = (HASH_SEED,)) -> DataFrame:
    """``(doc_id, fp0, fp1, ...)``: one signed 64-bit fingerprint for each seed; a null text has no words."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mine.mapInArrow(_fingerprints(words_each, seeds), "doc_id long, " + ", ".join(f"fp{k} long" for k in range(len(seeds))))


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the edges a-b join two trees of ``label`` (which is updated in place); each joins two, none closes a circle."""
    keep, n = np.zeros(len(a), bool), len(label)
    while True:
        la, lb = label[a], label[b]
        live = np.flatnonzero(la != lb)
        if not len(live):
            return keep
        hi, lo = np.maximum(la[live], lb[live]), np.minimum(la[live], lb[live])
        order = np.lexsort((lo, hi))
        first = order[np.append(True, hi[order][1:] != hi[order][:-1])]  # each root is hooked once, to a smaller one
        keep[live[first]] = True
        hook = np.arange(n)
        hook[hi[first]] = lo[first]
        while True:
            up = hook[hook]
            if (up == hook).all():
                break
            hook = up
        label[:] = hook[label]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(prints: np.ndarray, bounds: np.ndarray, budget: int, found: Callable[[np.ndarray, np.ndarray], None], *, every: bool = True, most: int = 50_000) -> None:
    """Give ``found`` the pairs of positions of one group whose prints differ in at most ``budget`` bits, part by part.

    ``prints``: unsigned, ascending inside each of the groups that ``bounds``
    delimits.  A trie node is a range of positions that share their leading
    bits.  The stack holds sets of node pairs of one depth, at most about
    ``most`` each, so memory stays bounded however many pairs are alive.
    Without ``every``, ranges of which all pairs are within the budget give a
    tree of pairs that connects them.
    """
    n = len(prints)
    ones = np.zeros((BITS, n + 1), np.int32)  # of each bit, how many positions before this one have it
    for d in range(BITS):
        np.cumsum((prints >> np.uint64(d)) & np.uint64(1), out=ones[d, 1:])

    def blocks(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, check: bool) -> None:
        """All pairs between the ranges, ``9 * most`` at a time."""
        width = bh - bl
        row = np.repeat(np.arange(len(al)), ah - al)  # a row for each left position
        left = al[row] + np.arange(len(row)) - np.repeat(np.cumsum(ah - al) - (ah - al), ah - al)
        upto = np.cumsum(width[row])
        begin = 0
        while begin < len(row):
            done = int(upto[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + 9 * most, side="right")))
            w = width[row[begin:end]]
            a = np.repeat(left[begin:end], w)
            b = np.repeat(bl[row[begin:end]], w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
            near = (a != b) if not check else (a != b) & (_popcount(prints[a] ^ prints[b]) <= budget)
            found(a[near], b[near])
            begin = end

    lo, hi = bounds[:-1], bounds[1:]
    wide = hi - lo > 1
    lo, hi = lo[wide], hi[wide]
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        d, al, ah, bl, bh, diff = stack.pop()
        if not len(al):
            continue
        if len(al) > most:
            for k in range(0, len(al), most):
                stack.append((d, *(x[k : k + most] for x in (al, ah, bl, bh, diff))))
            continue
        same = al == bl
        small = (ah - al) * (bh - bl) <= 9
        if d < 0:
            small[:] = True
        if small.any():  # few leaves: compare them
            blocks(al[small], ah[small], bl[small], bh[small], True)
        # all within reach: the bits below d cannot exceed what is left of the budget
        reach = ~small & (diff + d + 1 <= budget)
        if reach.any() and every:
            blocks(al[reach], ah[reach], bl[reach], bh[reach], False)
        elif reach.any():
            for x, y, p, q in zip(al[reach], ah[reach], bl[reach], bh[reach], strict=True):
                rest = np.concatenate([np.arange(x, y), np.arange(p, q)])
                found(np.full(len(rest), x), rest)
        go = ~small & ~reach
        if not go.any():
            continue
        al, ah, bl, bh, diff, same = al[go], ah[go], bl[go], bh[go], diff[go], same[go]
        am, bm = ah - (ones[d][ah] - ones[d][al]), bh - (ones[d][bh] - ones[d][bl])
        new = [(al, am, bl, bm, diff, slice(None)), (am, ah, bm, bh, diff, slice(None)), (al, am, bm, bh, diff + 1, slice(None)), (am, ah, bl, bm, diff + 1, ~same)]
        rows = []
        for w, x, y, z, e, which in new:
            w, x, y, z, e = w[which], x[which], y[which], z[which], e[which]
            ok = (x > w) & (z > y) & (e <= budget)
            ok &= ~((w == y) & (x - w == 1))
            rows.append((w[ok], x[ok], y[ok], z[ok], e[ok]))
        stack.append((d - 1, *(np.concatenate(c) for c in zip(*rows, strict=True))))


def trie_links(prints: np.ndarray, bounds: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group, as two arrays of positions; see ``trie_pairs``."""
    label = np.arange(len(prints))
    out: list[tuple[np.ndarray, np.ndarray]] = [(label[:0], label[:0])]

    def link(a: np.ndarray, b: np.ndarray) -> None:
        keep = _forest(a, b, label)
        out.append((a[keep], b[keep]))

    trie_pairs(prints, bounds, budget, link, every=False)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _join(budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket", 60_000):
            bucket, prints = table.column("bucket").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            order = np.lexsort((prints, bucket))
            bucket, prints = bucket[order], prints[order]
            fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (prints[1:] != prints[:-1]))
            bucket, prints = bucket[fresh], prints[fresh]
            bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            a, b = trie_links(prints, bounds, budget)
            x, y = prints[a].view(np.int64), prints[b].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    return run


def block_masks(budget: int, distinct: int, dense: int = 128) -> list[int]:
    """Masks of the bits that a pair must share under one key or another.

    With ``budget + clean`` blocks, ``budget`` of which may differ, each choice
    of ``clean`` blocks is a key.  ``clean`` grows with the number of distinct
    fingerprints until a key is expected to hold at most ``dense`` of them.
    """
    clean = 1
    while clean < 6 and distinct >> (BITS * clean // (budget + clean)) > dense and comb(budget + clean + 1, clean + 1) <= 2000:
        clean += 1
    blocks = budget + clean
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(one[k] for k in which) for which in combinations(range(blocks), clean)]


def parted(keyed: DataFrame, sizes: DataFrame, largest: int, *columns: str) -> DataFrame:
    """``bucket`` and ``columns`` of the rows of ``keyed`` whose ``key`` is in ``sizes`` (``key, n``).

    A key with over ``largest`` rows is parted: they are dealt into chunks, and
    each pair of chunks is a bucket of its own, so no bucket holds more than
    about two chunks and every two rows still meet.
    """
    chunks = F.ceil(F.col("n") / F.lit(largest)).cast("int")
    mine = F.pmod(F.xxhash64(columns[0], F.lit(7)), chunks).cast("int")
    cells = keyed.join(sizes, "key").select(*columns, "key", chunks.alias("c"), mine.alias("m")).select(*columns, "key", "m", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o"))
    return cells.select(*columns, F.xxhash64("key", F.least("m", "o"), F.greatest("m", "o")).alias("bucket"))


def fingerprint_links(prints: DataFrame, budget: int = 4, largest: int = 20_000) -> DataFrame:
    """``(a, b)``: links between distinct values of ``fp`` (long) that connect all that differ in at most ``budget`` bits.

    Keys with over ``largest`` fingerprints are parted.  Nulls are left out.
    """
    distinct = prints.select("fp").where(F.col("fp").isNotNull()).distinct()
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(budget, distinct.count())]
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("mask", "bits")).select("fp", F.xxhash64("mask", "bits").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    dealt = parted(keyed, sizes, largest, "fp").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_join(budget), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, words_each: int = 4, budget: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs`` (``doc_id`` long, ``text``).

    Documents whose fingerprints differ in at most ``budget`` bits are linked;
    ``component_id`` is the smallest ``doc_id`` reachable.  A null, empty or
    blank text has fingerprint zero and is linked like any other.  Repeated
    rows each stay; a component whose ids are all null has a null id; an empty
    table gives no rows; other columns are not read.
    """
    prints = durable(fingerprints(docs, words_each).withColumnRenamed("fp0", "fp"))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    class_of = connected_components(fingerprint_links(prints, budget)).select(F.col("node").alias("fp"), "component")
    classed = least.join(class_of, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classed.join(smallest, "component").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = self[word] = xxhash.xxh64_intdigest(word, HASH_SEED)
        return got


class Shingles:
    """Distinct runs of ``size`` words of a text as ascending 64-bit hashes; fewer words: one run of all; none: empty."""

    def __init__(self, size: int, known: int = 200_000) -> None:
        self.size, self.most, self.known = size, known, _WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.most:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        run = min(self.size, len(words))
        n = len(words) - run + 1
        total = np.full(n, run, np.uint64)
        for k in range(run):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        return np.unique(_mixed(total))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash_of_set(hashes: np.ndarray) -> int:
    """Fingerprint of a set of 64-bit hashes: bits that over half of them have."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` minima of the set under as many orders; an empty set has keys of its own."""
    salt = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))
    factor, shift = (salt | np.uint64(1)).astype(np.uint32)[:, None], (salt >> np.uint64(32)).astype(np.uint32)[:, None]
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(upper), 2048):
        least = np.minimum(least, (upper[k : k + 2048] * factor + shift).min(axis=1))
    key = np.arange(bands, dtype=np.uint64)
    for row in least.astype(np.uint64).reshape(bands, rows).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def _profiles(size: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fp`` and ``bands`` in place of ``text``, the last column."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in (part for whole in batches for part in slices(whole, byte_sizes(whole.column(whole.num_columns - 1)), 4 << 20)):
            names = batch.schema.names[:-1]
            seen: dict[bytes, tuple[int, np.ndarray]] = {}
            mine = []
            for text in texts(batch.column(len(names))):
                if (got := seen.get(text)) is None:
                    hashes = shingles(text)
                    got = seen[text] = simhash_of_set(hashes), band_keys(hashes, bands, rows)
                mine.append(got)
            prints = np.array([fp for fp, _ in mine], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(prints), pa.array([k for _, k in mine], pa.list_(pa.int64()))], [*names, "fp", "bands"])

    return run


def _shingle_sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``node`` and its shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in (part for whole in batches for part in slices(whole, byte_sizes(whole.column(1)), 4 << 20)):
            rows = [shingles(text).view(np.int64) for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def shared_counts(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members the sets ``a[k]`` and ``b[k]`` share; ``flat``: the sets end to end, each ascending."""
    out = np.zeros(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        one, two = flat[offsets[x] : offsets[x + 1]], flat[offsets[y] : offsets[y + 1]]
        if len(one) and len(two):
            out[k] = np.count_nonzero(one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two)
    return out


def parities(flat: np.ndarray, offsets: np.ndarray, bits: int = 2048) -> np.ndarray:
    """A row of 64-bit words for each set: of each bit, whether an odd number of members hash to it.

    Each member that two sets do not share turns one bit, so their rows differ
    in no more bits than the sets in members.
    """
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    odd = np.zeros((n, bits), np.uint8)
    for k in range(0, n, 512):
        part = slice(int(offsets[k]), int(offsets[min(n, k + 512)]))
        at = (row[part] - k) * bits + (flat[part] & np.uint64(bits - 1)).astype(np.int64)
        odd[k : k + 512] = (np.bincount(at, minlength=min(512, n - k) * bits) & 1).reshape(-1, bits)
    return np.packbits(odd, axis=1).view(np.uint64)


def similar_links(prints: np.ndarray, bounds: np.ndarray, label: np.ndarray, flat: np.ndarray, offsets: np.ndarray, similarity: float, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sets of at least ``similarity`` that connect all such pairs of a group, as two arrays of positions.

    ``label``: what is connected already; it is updated.  The trie gives the
    candidate pairs, part by part; those go whose parities differ in more bits
    than similar sets of their sizes can in members.  Of a part's pairs that are
    not connected yet a spanning forest is compared set by set; those that are
    similar connect, the others are struck off, and so on until no pair is left.
    """
    size, odd = np.diff(offsets), parities(flat, offsets)
    most = (1 - similarity) / (1 + similarity) + 1e-9
    out: list[tuple[np.ndarray, np.ndarray]] = [(label[:0], label[:0])]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        near = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
        a, b = a[near], b[near]
        near = np.empty(len(a), bool)
        for k in range(0, len(a), 16_384):
            x, y = a[k : k + 16_384], b[k : k + 16_384]
            near[k : k + 16_384] = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64) <= most * (size[x] + size[y])
        a, b = a[near], b[near]
        if not len(a):
            return
        order = np.argsort(_popcount(prints[a] ^ prints[b]), kind="stable")  # the likeliest first
        a, b = a[order], b[order]
        while len(a):
            tried = _forest(a, b, label.copy())
            x, y = a[tried], b[tried]
            shared = shared_counts(flat, offsets, x, y)
            union = size[x] + size[y] - shared
            ok = (union == 0) | (shared >= similarity * union)
            _forest(x[ok], y[ok], label)
            out.append((x[ok], y[ok]))
            left = ~tried & (label[a] != label[b])
            a, b = a[left], b[left]

    trie_pairs(prints, bounds, budget, compare)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _verify(similarity: float, budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(k, 1_000) for batch in batches for k in range(0, batch.num_rows, 1_000))
        for table in whole_groups(parts, "bucket", 2_000):
            bucket, prints = table.column("bucket").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            order = np.lexsort((prints, bucket))
            table = table.take(pa.array(order))
            bucket, prints = bucket[order], prints[order]
            bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            _, first, label = np.unique(np.stack([bucket, table.column("component").to_numpy()], axis=1), axis=0, return_index=True, return_inverse=True)
            sets = table.column("shingles").combine_chunks()
            a, b = similar_links(prints, bounds, first[label.ravel()], sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy().astype(np.int64), similarity, budget)
            node = table.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], ["a", "b"])

    return run


def similar_texts(keyed: DataFrame, sets: DataFrame, similarity: float, budget: int, largest: int = 4_000) -> DataFrame:
    """``(a, b)``: verified links that connect all nodes of one key whose sets are similar.

    ``keyed``: ``node, component`` (long), ``fp, key``; ``sets``: ``node, shingles``.  Keys
    whose nodes are all connected add nothing, keys with the same nodes count
    once, and keys with over ``largest`` nodes are parted.
    """
    print_of = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), print_of(0).alias("h0"), print_of(1).alias("h1"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    once = sizes.where(F.col("c0") != F.col("c1")).groupBy("n", "h0", "h1").agg(F.min("key").alias("key")).select("key", "n")
    dealt = parted(keyed, once, largest, "node", "component", "fp")
    placed = dealt.join(sets, "node").select("bucket", "node", "component", "fp", "shingles").repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(_verify(similarity, budget), "a string, b string").distinct()


def drop_near_duplicates(docs: DataFrame, *, similarity: float = 0.8, words_each: int = 5, bands: int = 20, rows: int = 3, budget: int = 27) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest ``doc_id``.

    Two documents are near duplicates if at least ``similarity`` of their
    distinct shingles of ``words_each`` words (A-Z lower-cased, between ASCII
    white space; fewer words: one of all) are shared; groups are what such
    links connect.  Documents meet where all ``rows`` minimal hashes of one of
    ``bands`` bands agree: a pair of similarity s meets nowhere with a chance
    of ``(1 - s**rows)**bands``, 6e-7 at 0.8.  There the trie self-join leaves
    pairs of fingerprints that differ in ``budget`` bits at most (ten on
    average at 0.8), and these are compared on their whole sets of shingles
    before any are left out as connected already.  The first bands are joined
    first: what they connect need not meet again in the others.

    Equal texts are one group, with null as the empty text; blank texts are
    near duplicates of each other.  Of repeated rows one stays.  A null
    ``doc_id`` is larger than any other.  Rows are told apart by ``doc_id`` and
    text alone, so ``docs`` may be read again in other splits; it may have any
    further columns.
    """
    # a row travels as one column, so its own columns may have any names
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    doc = F.col("row.doc_id").cast("long")
    own = ["__none", "__doc", "__node"]
    placed = docs.select(F.struct("*").alias("row")).select("row", doc.isNull().alias("__none"), F.coalesce(doc, F.lit(0)).alias("__doc"), F.md5(text.cast("binary")).alias("__node"))
    known = durable(placed.select(*own, text.alias("text")).mapInArrow(_profiles(words_each, bands, rows), "__none boolean, __doc long, __node string, fp long, bands array<long>"))
    firsts = durable(known.groupBy("__node").agg(F.min(F.struct("__none", "__doc")).alias("w"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).select("w.*", "__node", "fp", "bands"))
    met = firsts.select("__node", "fp", F.posexplode("bands").alias("band", "key"))
    shared = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    keyed = durable(met.join(shared, "key", "left_semi").select(F.col("__node").alias("node"), "fp", "band", "key"))
    wanted = firsts.select(*own).join(keyed.select(F.col("node").alias("__node")).distinct(), "__node", "left_semi").select(*own)
    bodies = placed.select(*own, text.alias("text")).join(wanted, own, "left_semi").select(F.col("__node").alias("node"), "text")
    sets = durable(bodies.mapInArrow(_shingle_sets(words_each), "node string, shingles array<long>").dropDuplicates(["node"]))
    groups = None
    for some in (F.col("band") < 2, F.col("band") >= 2):
        rows_of = keyed.where(some).withColumn("component", F.col("node")) if groups is None else keyed.where(some).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        links = similar_texts(rows_of.select("node", F.xxhash64("component").alias("component"), "fp", "key"), sets, similarity, budget)
        groups = connected_components(links if groups is None else links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    grouped = known.select(*own).join(groups.withColumnRenamed("node", "__node"), "__node", "left").select(*own, F.coalesce("component", "__node").alias("component"))
    stays = grouped.groupBy("component").agg(F.min(F.struct(*own)).alias("w")).select("w.*")
    kept = placed.join(stays, own, "left_semi")
    number = F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0)))
    return kept.withColumn("__number", number).where(F.col("__number") == 1).select("row.*")
