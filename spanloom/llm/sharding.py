"""A reproducible shuffle into shards, computed row by row.

Rows get global numbers in a fixed order; a Feistel network permutes the
numbers.  The network works on the smallest even number of bits that holds the
count; a value beyond the count is permuted again until it falls inside (cycle
walking), so the numbers below the count are permuted among themselves.  Shard
and slot are the remainder and the quotient of the permuted number by the
number of shards: anyone can compute them, and invert them, from the number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.components import durable

ROUNDS = 6


def _mix(half: np.ndarray, key: int) -> np.ndarray:
    """Round function: a 64-bit finaliser of the half and the round's key."""
    x = half + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    step = 0x9E3779B97F4A7C15
    return [int(_mix(np.array([(seed + 1) * step % 2**64], np.uint64), (k + 1) * step % 2**64)[0]) for k in range(rounds)]


def permute(numbers: np.ndarray, count: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Where each number below ``count`` goes (``inverse``: comes from)."""
    bits = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    mask, shift, keys = np.uint64((1 << bits) - 1), np.uint64(bits), round_keys(seed)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        return left << shift | right

    out = network(numbers.astype(np.uint64))
    while (far := np.flatnonzero(out >= count)).size:
        out[far] = network(out[far])
    return out.astype(np.int64)


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` (from 0, gapless, in ``order``), and their count.

    Rows are sorted by range over many tasks; only the tasks' counts are
    gathered and added up (a row for each task).  Every column takes part in
    the order, so only equal rows are interchangeable.
    """
    full = order + [c for c in rows.columns if c not in order]
    parted = durable(rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in full)).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in parted.groupBy("__part").agg(F.count("*")).collect())
    total, begins = 0, {}
    for part, n in sizes:
        begins[part] = total
        total += n
    spark = rows.sparkSession
    offsets = spark.createDataFrame([(p, b) for p, b in begins.items()] or [(-1, 0)], "__part int, __begin long")
    within = Window.partitionBy("__part").orderBy(*(F.col(c).asc_nulls_first() for c in full))
    # a row for each task of the sort is broadcast
    numbered = parted.join(F.broadcast(offsets), "__part").withColumn("row_number", F.col("__begin") + F.row_number().over(within) - 1)
    return numbered.drop("__part", "__begin"), total


def shard_rows(rows: DataFrame, order: list[str], shards: int, *, seed: int = 0) -> DataFrame:
    """``rows`` with ``row_number, position, shard`` (int) and ``slot`` (long).

    ``position`` is the permuted row number; shard sizes differ by one row at
    most and slots run gaplessly from 0.  Nulls sort first; repeated rows get
    numbers of their own; an empty table gives no rows.  The columns added
    must not be there already.
    """
    numbered, total = number_rows(rows, order)

    at = F.pandas_udf(lambda s: pd.Series(permute(s.to_numpy(), total, seed)), "long")
    placed = numbered.withColumn("position", at("row_number"))
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.expr(f"position div {int(shards)}"))


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """Write rows with ``shard`` and ``slot`` as Parquet, a folder for each shard, rows in slot order."""
    sharded.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def size_and_checksum(docs: DataFrame) -> DataFrame:
    """``doc_id, size`` (UTF-8 bytes and 16), ``text_crc32`` of every row; a null text has no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
