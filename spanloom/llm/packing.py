"""Packing token ids into training sequences.

Documents are tokenised where they are read; their ids travel once, in pieces
of at most one sequence, to randomised groups of a bounded size.  Each group is
packed by first-fit decreasing over a tournament tree of bin capacities: a
leaf is a bin's free room, an inner node the larger of its children, and the
leftmost bin with room is found on one path from the root.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import byte_sizes, drop_tables, kept_between_tasks, slices, texts, tidy

SEED = 17


_APART = "<\\||[\u0300-\u0345]"
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: How byte-level vocabularies write bytes that are no visible characters: the n-th of them as 256 + n.
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def _is_plain(word: str) -> bool:
    """One run of Latin letters that lower-case to letters: a single word to the tokenizer, whatever stands around."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and word.lower().isalpha()))


@dataclass
class _Chunks:
    """A worker's table of chunks: a chunk's number, and its ids between two of ``cuts`` in ``flat``."""

    tokenizer: object
    known: dict[str, int] = field(default_factory=dict)
    flat: array = field(default_factory=lambda: array("i"))
    cuts: array = field(default_factory=lambda: array("q", [0]))

    def keep(self, most: int) -> None:
        """Forget all but the ``most`` chunks that came first."""
        if len(self.known) > most:
            self.known = dict(islice(self.known.items(), most))
            del self.cuts[most + 1 :], self.flat[self.cuts[most] :]


@lru_cache(maxsize=1)
def _chunks(path: str) -> _Chunks:
    from tokenizers import Tokenizer

    kept_between_tasks(__name__, _chunks.cache_clear)
    return _Chunks(Tokenizer.from_file(path))


def token_ids(path: str, most: int = 1_000_000, stay: int = 300_000) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from an array of texts to (ids of all texts, number of ids of each).

    The ids are those that the tokenizer file at ``path`` gives the whole text
    with ``add_special_tokens=False``.  The tokenizer must drop white space and
    lower-case; so text between two ASCII white spaces has the same ids
    wherever it stands, and is tokenised once and then looked up; words of
    Latin letters go to the model of a byte-level vocabulary directly.  Texts with
    ``<|`` (which may spell a special token) or with combining marks (which
    may compose with a small letter only) go to the tokenizer whole.  A
    worker's table holds about ``most`` chunks, and the first ``stay`` of them
    from one task to the next.
    """
    table = _chunks(path)
    table.keep(stay)
    tokenizer, model = table.tokenizer, table.tokenizer.model

    def ids_of(chunk: str) -> array:
        stem = chunk.rstrip(_PUNCTUATION)
        if stem != chunk and _is_plain(stem):  # a word, then marks only: tokenised apart
            return sum((table.flat[table.cuts[n] : table.cuts[n + 1]] for n in (look(stem), look(chunk[len(stem) :]))), array("i"))
        if _is_plain(chunk):
            return array("i", [t.id for t in model.tokenize(chunk if chunk.isascii() else chunk.lower().encode().decode("latin-1").translate(_BYTE_LETTERS))])
        return array("i", tokenizer.encode(chunk, add_special_tokens=False).ids)

    def look(chunk: str) -> int:
        got = table.known.get(chunk)
        if got is None:
            table.flat.extend(ids_of(chunk))
            table.cuts.append(len(table.flat))
            got = table.known[chunk] = len(table.cuts) - 2
        return got

    def of_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = pc.fill_null(column, "")
        apart = pc.match_substring_regex(column, _APART)
        odd = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        plain = column if not len(odd) else pc.if_else(apart, "", column)
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        words = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        coded = chunks.flatten().dictionary_encode()
        if len(table.known) > most:
            table.keep(stay)
        number = np.fromiter(map(look, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        stored, at = np.array(table.flat, np.int32), np.array(table.cuts, np.int64)
        code = number[coded.indices.to_numpy(zero_copy_only=False)]
        n = at[code + 1] - at[code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = stored[np.repeat(at[code] - (ends - n), n) + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(upto)
        if len(odd):
            runs = np.split(ids, upto[1:-1])
            for i in odd.tolist():
                runs[i] = np.array(tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.int32)
            ids, counts = np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))
        return ids, counts

    return of_texts


def _tokenise(path: str, end_id: int, room: int, small: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = np.uint16 if small else np.uint32

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, row = token_ids(path), 0
        for whole in batches:
            for batch in slices(whole, byte_sizes(whole.column(1)), 4 << 20):
                ids, counts = ids_of(batch.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(kind)
                counts = counts + 1
                first = np.cumsum(counts) - counts
                pieces = -(-counts // room)
                doc = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * room
                length = np.minimum(room, counts[doc] - start)
                offsets = np.append(first[doc] + start, len(ids)) * ids.itemsize
                assert (np.diff(offsets) == length * ids.itemsize).all()
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(counts[doc], pa.int64()), pa.array(row + doc, pa.int64()), body], ["doc_id", "start", "doc_tokens", "row", "body"])
                row += len(counts)
        _chunks(path).keep(300_000)

    return run


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indices of ``sizes``, by first-fit decreasing over a tournament tree of free room."""
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n, at = sizes[i], 1
        while at < leaves:
            at += at
            if tree[at] < n:
                at += 1
        while at - leaves >= len(bins):
            bins.append([])
        bins[at - leaves].append(i)
        tree[at] -= n
        while at > 1:
            at >>= 1
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins


def fill_up(bins: list[list[tuple[int, int, int]]], room: int, least_cut: int) -> list[list[tuple[int, int, int]]]:
    """Fill gaps of ``least_cut`` or more in full bins with cuts from the emptiest ones; part the last bin into powers of two.

    A bin is a list of (item, start, length).  What is left at the end is one
    bin a group: cut into sequences whose lengths are powers of two, it needs
    no padding either.
    """
    bins = sorted(bins, key=lambda b: -sum(p[2] for p in b))
    i, j = 0, len(bins) - 1
    while i < j:
        gap = room - sum(p[2] for p in bins[i])
        while gap >= least_cut and i < j:
            item, start, n = bins[j].pop()
            take = min(gap, n)
            bins[i].append((item, start, take))
            gap -= take
            if take < n:
                bins[j].append((item, start + take, n - take))
            if not bins[j]:
                j -= 1
        i += 1
    bins = [b for b in bins[: j + 1] if b]
    if bins and room - (used := sum(p[2] for p in bins[-1])) >= least_cut:
        rest, parts = bins.pop()[::-1], []
        for bit in range(used.bit_length() - 1, -1, -1):
            if used >> bit & 1:
                need, part = 1 << bit, []
                while need:
                    item, start, n = rest.pop()
                    part.append((item, start, take := min(need, n)))
                    need -= take
                    if take < n:
                        rest.append((item, start + take, n - take))
                parts.append(part)
        bins += parts
    return bins


def _pack(room: int, least_cut: int, small: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    kind = np.uint16 if small else np.uint32

    def run(key: tuple, table: pa.Table) -> pa.Table:
        drop_tables()  # all documents are tokenised
        body = list(texts(table.column("body").combine_chunks()))
        width = np.dtype(kind).itemsize
        sizes = [len(b) // width for b in body]
        order = sorted(range(len(body)), key=lambda i: (-sizes[i], body[i]))  # whatever order the rows came in
        full = [i for i in order if sizes[i] == room]
        rest = [i for i in order if sizes[i] < room]
        packed = [[(rest[k], 0, sizes[rest[k]]) for k in b] for b in first_fit_decreasing([sizes[i] for i in rest], room)]
        bins = [[(i, 0, room)] for i in full] + fill_up(packed, room, least_cut)
        row, start, length, sequence, offset, ids = [], [], [], [], [], []
        base = int(key[0].as_py()) << 32
        for s, pieces in enumerate(bins):
            at = 0
            for i, begin, n in pieces:
                row.append(i)
                start.append(begin)
                length.append(n)
                sequence.append(base + s)
                offset.append(at)
                ids.append(np.frombuffer(body[i], kind)[begin : begin + n].astype("<u4").tobytes())
                at += n
        take = pa.array(row, pa.int64())
        begins = pc.add(table.column("start").take(take), pa.array(start, pa.int64()))
        return pa.table({"doc_id": table.column("doc_id").take(take), "start": begins, "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary()), "doc_tokens": table.column("doc_tokens").take(take), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, room: int = 4096, group_bytes: int = 4 << 20, least_cut: int = 8, seed: int = SEED, small_ids: bool = True) -> DataFrame:
    """Pack all documents (``doc_id`` long, ``text``) into sequences of at most ``room`` ids.

    Returns a row per piece: ``doc_id, start, length, ids`` (binary,
    little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.  A
    document is its text's ids and ``end_id``.  Groups hold about
    ``group_bytes`` of text each and are dealt by a hash of id, start and row,
    so neither repeated rows nor one long document fill a group.  A null or
    empty text is the one id ``end_id``; a null ``doc_id`` stays null; rows
    with equal ids are packed each for itself; an empty table gives no rows;
    other columns are not read.  ``small_ids``: all ids are below 65,536.
    """
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, rows = mine.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-(int(total) + 2 * int(rows)) // group_bytes))
    pieces = mine.mapInArrow(_tokenise(tokenizer_path, end_id, room, small_ids), "doc_id long, start long, doc_tokens long, row long, body binary")
    dealt = pieces.select("doc_id", "start", "doc_tokens", "body", F.pmod(F.xxhash64("doc_id", "start", "row", F.lit(seed)), F.lit(groups)).cast("int").alias("pack_group"))
    return dealt.groupBy("pack_group").applyInArrow(_pack(room, least_cut, small_ids), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
