"""The prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns, told by a 128-bit digest that a
running window of each conversation gives; its smallest member and its depth
name it.  Texts are hashed where they are read and travel nowhere.

Totals of whole subtrees come from the parent edges alone.  The forest is first
cut into components of bounded size at cluster scale: a node's weight (the
turns of its members from there on) is at hand for every node, and where it
falls below a multiple of ``width`` a component begins.  A component then is
either a whole subtree of less than ``width`` turns or a path of at most that
many nodes.  What hangs below a path is handed to it as totals, tier by tier,
``width`` times coarser each.  Inside a component the centroid decomposition
does the work: it is split at its centroid again and again, the parts' totals
are summed and added along the path from the centroid to the top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import tidy, whole_groups
from spanloom.operators.components import durable

_NODE = ["a", "b"]
_UP = ["pa", "pb"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _half(digest: Column, at: int) -> Column:
    """15 hexadecimal digits of ``digest`` as a long."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1)``, d1, d2, chars`` of each row of ``conv_id, turn, role, text``.

    A conversation's rows are ordered by turn (null first), then role, then a
    digest of role and text.  Null role or text counts as empty; rows without a
    conversation are left out; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    told = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.length(text).cast("long").alias("chars"), digest.alias("digest"))
    narrow = told.select("conv_id", "turn", "role", "chars", _half(F.col("digest"), 1).alias("d1"), _half(F.col("digest"), 17).alias("d2"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "d1", "d2")
    return narrow.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "d1", "d2", "chars")


def branched(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: ids (``conv_id``) and their turns (``conv_id, depth, d1, d2, chars``).

    Of conversation ``c`` the first ``h`` turns are those of ``c - c % block``
    (fewer if it has fewer, none if it is absent), then its own turns after its
    first ``h`` follow; ``h`` is the crc32 of the decimal id modulo ``most``.
    """
    turns = durable(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % block
    ids = turns.where("place = 1").select("conv_id", h.alias("h"), base.alias("base"))
    heads = turns.where((F.col("conv_id") == base) & (F.col("place") < most))
    # at most block ids on either side of 0 have one base
    lengths = heads.groupBy("conv_id").agg(F.max("place").alias("has")).withColumnRenamed("conv_id", "base")
    known = durable(ids.join(lengths, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("has", F.lit(0))).alias("m")))
    lent = known.where("m > 0").select("conv_id", "base", F.explode(F.expr("sequence(1L, m)")).alias("place"))
    first = lent.join(heads.withColumnRenamed("conv_id", "base"), ["base", "place"]).select("conv_id", F.col("place").alias("depth"), "d1", "d2", "chars")
    rest = turns.join(known.select("conv_id", "h", "m"), "conv_id").where("place > h").select("conv_id", F.expr("m + place - h").alias("depth"), "d1", "d2", "chars")
    return known.select("conv_id"), first.unionByName(rest)


def subtree_sums(parent: Sequence[int], values: Sequence[Sequence[int]]) -> list[list[int]]:
    """For each of several values, the sum over each node's subtree, by centroid decomposition.

    ``parent``: each node's parent among the nodes before it, or -1.
    """
    n = len(parent)
    up, size, part = list(parent), [1] * n, [0] * n
    out = [[0] * n for _ in values]
    trees: dict[int, list[int]] = {}
    for v, p in enumerate(up):
        part[v] = v if p < 0 else part[p]
        trees.setdefault(part[v], []).append(v)
    waiting = list(trees.values())
    while waiting:
        component = waiting.pop()
        if len(component) == 1:
            for sums, value in zip(out, values, strict=True):
                sums[component[0]] += value[component[0]]
            continue
        for v in component:
            size[v] = 1
        for v in reversed(component):
            if up[v] >= 0:
                size[up[v]] += size[v]
        # parents come first, so the last node with at least half of the component below it is the deepest
        centroid = next(v for v in reversed(component) if 2 * size[v] >= len(component))
        above, below = [], {}
        for v in component:
            p = up[v]
            if v == centroid:
                part[v] = -1
            elif p == centroid:
                part[v] = v
                below[v] = [v]
            elif p >= 0 and part[p] != -2:
                part[v] = part[p]
                below[part[v]].append(v)
            else:
                part[v] = -2
                above.append(v)
        for sums, value in zip(out, values, strict=True):
            total = value[centroid] + sum(sum(value[v] for v in below_it) for below_it in below.values())
            v = centroid
            while v >= 0:
                sums[v] += total
                v = up[v]
        for v in below:
            up[v] = -1
        waiting += [c for c in (above, *below.values()) if c]
    return out


@tidy
def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of whole components, which come sorted by component and depth."""
    for table in whole_groups(batches, "ca", 100_000):
        columns = {c: table.column(c).to_pylist() for c in ("ca", "cb", "a", "b", "pa", "pb", "leaves", "saved")}
        index: dict[tuple, int] = {}
        parent = []
        for k, node in enumerate(zip(columns["ca"], columns["cb"], columns["a"], columns["b"], strict=True)):
            parent.append(index.get((*node[:2], columns["pa"][k], columns["pb"][k]), -1))
            index[node] = k
        sums = subtree_sums(parent, (columns["leaves"], columns["saved"]))
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("a", "b", "pa", "pb")), pa.array([p < 0 for p in parent]), *(pa.array(s, pa.int64()) for s in sums)], ["a", "b", "pa", "pb", "top", "leaves", "saved"])


def _inside(nodes: DataFrame, tier: int) -> DataFrame:
    """Sums inside the components of ``tier``: each is bounded and goes to one task whole."""
    rows = nodes.select(F.col(f"t{tier}a").alias("ca"), F.col(f"t{tier}b").alias("cb"), *_NODE, *_UP, "depth", "leaves", "saved")
    return rows.repartition("ca", "cb").sortWithinPartitions("ca", "cb", "depth").mapInArrow(_roll, "a long, b long, pa long, pb long, top boolean, leaves long, saved long")


def _handed(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """``nodes`` with ``totals`` (by parent) added to their values."""
    summed = totals.groupBy(*_UP).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).select(F.col("pa").alias("a"), F.col("pb").alias("b"), "l", "s")
    added = nodes.join(summed, _NODE, "left")
    return added.withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s")


def _tier(nodes: DataFrame, tier: int, tiers: int, width: int) -> DataFrame:
    """``a, b, pa, pb, top, leaves, saved`` with sums over whole subtrees."""
    if tier == tiers - 1:
        return _inside(nodes, tier)
    bound = width ** (tier + 1)
    light = durable(_inside(nodes.where(F.col("weight") < bound), tier))
    heavy = durable(_handed(nodes.where(F.col("weight") >= bound), light.where("top")))
    is_top = (F.col("a") == F.col(f"t{tier}a")) & (F.col("b") == F.col(f"t{tier}b"))
    further = [f"{x}{k}{y}" for k in range(tier, tiers) for x in "tu" for y in "ab" if (x, k) != ("t", tier)]
    at_top = [F.max(F.when(is_top, F.col(c))).alias(c) for c in ("weight", "depth", *further)]
    paths = heavy.groupBy(f"t{tier}a", f"t{tier}b").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), *at_top)
    paths = paths.withColumnsRenamed({f"t{tier}a": "a", f"t{tier}b": "b", f"u{tier}a": "pa", f"u{tier}b": "pb"})
    whole = _tier(paths, tier + 1, tiers, width).select(*_NODE, "leaves", "saved")
    hung = heavy.where(is_top).select(*_NODE, *_UP).join(whole, _NODE)
    return light.unionByName(_inside(_handed(heavy, hung), tier))


@tidy
def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``a, b, conv_id``: the ids of a node comma-joined, in pieces of about 1 MB."""
    for table in batches:
        a, b, ids = (table.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(ids):
            continue
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        starts = np.r_[0, cuts]
        listed = [",".join(map(str, part.tolist())) for part in np.split(ids, cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(ids[starts]), pa.array(listed, pa.string())], ["a", "b", "first", "ids"])


@tidy
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``a, b, first, ids``: a node's SHA-256, a batch of pieces at a time."""
    now, state, done = None, None, []

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["a", "b", "ends_sha256"])

    for table in batches:
        for a, b, ids in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(3), strict=True):
            node = (a, b)
            if node == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256()
            state.update(ids.as_py().encode())
        if len(done) > 10_000:
            yield batch(done)
            done = []
    if now is not None:
        done.append((*now, state.hexdigest()))
    yield batch(done)


def digests_of_ids(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: SHA-256 of the ``conv_id`` of each node ``a, b``, ascending, comma-joined.

    A node's ids are sorted by range over many tasks, which join theirs; one
    task streams a node's joined pieces.
    """
    pieces = ends.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_listed, "a long, b long, first long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, turns: DataFrame, width: int = 20_000) -> DataFrame:
    """A row for each distinct sequence of first turns.

    ``conversations``: ``conv_id``, one row each, turnless ones included.
    ``turns``: ``conv_id, depth`` (1, 2, ...)``, d1, d2`` (digest of the turn),
    ``chars``.  Returns, all long but the digest: ``conv_id`` (smallest
    member), ``depth, parent_conv_id`` (null at the root), ``n_convs``
    (members)``, n_children, n_leaves`` (childless nodes of the subtree),
    ``saved_tokens`` (over the subtree, characters that members but the first
    share)``, ends_sha256`` (members that end here).

    Without conversations there is no node, not even the root; without turns
    the root is its only leaf.  ``width`` bounds what one task works on at once
    and changes no result.
    """
    spark = conversations.sparkSession
    alone = Window.partitionBy("conv_id").orderBy("depth")
    running = alone.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = [F.xxhash64("depth", "d1", "d2"), F.xxhash64(F.lit(1), "d2", "depth", "d1")]
    rows = turns.select("conv_id", "depth", "chars", *(F.bit_xor(m).over(running).alias(c) for m, c in zip(mixed, _NODE, strict=True)), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    rows = durable(rows.select("*", *(F.lag(c, 1, 0).over(alone).alias(p) for c, p in zip(_NODE, _UP, strict=True))))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    total = rows.count()
    if not root["n_convs"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    tiers = 1
    while width**tiers <= total:
        tiers += 1

    met = rows.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight"), *(F.max(c).alias(c) for c in ("depth", "chars", *_UP)))
    met = durable(met)
    children = met.groupBy(*_UP).agg(F.count("*").alias("n_children")).select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children")
    nodes = met.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = durable(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))

    # a node's path is that of its smallest member, whose rows know where each tier's component begins
    labels = rows.select("conv_id", "depth", *_NODE).join(nodes.select(*_NODE, F.col("conv_id").alias("owner"), "weight"), _NODE)
    for k in range(tiers):
        labels = labels.withColumn(f"g{k}", F.expr(f"weight div {width ** (k + 1)}"))
    begins = [F.coalesce(F.lag(f"g{k}").over(alone) != F.col(f"g{k}"), F.lit(True)) for k in range(tiers)]
    labels = labels.select("*", *(begin.alias(f"begin{k}") for k, begin in enumerate(begins)))
    labels = labels.select("*", *(F.last(F.when(F.col(f"begin{k}"), F.col(c)), ignorenulls=True).over(running).alias(f"t{k}{c}") for k in range(tiers) for c in _NODE))
    labels = labels.select("conv_id", "owner", *_NODE, *(f"t{k}{c}" for k in range(tiers) for c in _NODE), *(F.lag(f"t{k}{c}", 1, 0).over(alone).alias(f"u{k}{c}") for k in range(tiers) for c in _NODE))
    labels = labels.where("owner = conv_id").drop("owner", "conv_id")
    placed = durable(nodes.select(*_NODE, *_UP, "depth", "weight", "leaves", "saved").join(labels, _NODE))
    sums = durable(_tier(placed, 0, tiers, width).select(*_NODE, *_UP, "leaves", "saved"))

    without = conversations.select("conv_id").join(rows.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    ends = rows.where("depth = n").select(*_NODE, "conv_id").unionByName(without.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id"))
    hashes = durable(digests_of_ids(ends))

    parents = met.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    below = nodes.drop("leaves", "saved").join(sums.drop(*_UP), _NODE).join(hashes, _NODE, "left").join(parents, _UP, "left")
    out = below.select("conv_id", "depth", F.coalesce("above", F.lit(root["conv_id"])).alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    tops = sums.where("pa = 0 AND pb = 0").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("l"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    # one row each
    at_root = tops.join(hashes.where("a = 0 AND b = 0").agg(F.max("ends_sha256").alias("e")), how="cross")
    top = at_root.select(
        F.lit(root["conv_id"]).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(root["n_convs"]).cast("long").alias("n_convs"),
        "n_children",
        F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"),
        "saved_tokens",
        F.coalesce("e", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    return out.unionByName(top)
