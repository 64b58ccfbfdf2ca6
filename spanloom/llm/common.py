"""What several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end a word, and A-Z to a-z: for words of digits, letters and every byte from 0x80.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: By module: what drops the tables that it keeps in this process from one task to the next.
_DROPS: dict[str, Callable[[], None]] = {}


def kept_between_tasks(module: str, drop: Callable[[], None]) -> None:
    """``module`` has a table that its next task can use; ``drop`` is called when a task of another module begins."""
    _DROPS[module] = drop


def drop_tables(but_of: str | None = None) -> None:
    """Drop the tables that modules, other than ``but_of``, keep in this process."""
    if others := [m for m in _DROPS if m != but_of]:
        for m in others:
            _DROPS.pop(m)()
        give_back()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving the memory of its tables back when a task ends: Python workers live on for tasks of other stages.

    What other modules keep in the worker is dropped before it begins.
    """
    module = run.__module__

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        drop_tables(module)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Return freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(_ALNUM).split()


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, a null's as empty; one value at a time is copied."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in column:
        yield value.as_py() or b""


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` of at most ``most`` bytes, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def byte_sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from batches sorted by ``key``; no key's rows are parted."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        keys = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut == 0 and len(held) > 1:
            # the last key began in an earlier batch: cut there if another key precedes it
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                count = table.num_rows - cut
            continue
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held, count = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)
