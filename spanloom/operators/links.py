"""Pairs, antecedents, closure of links and quotient nodes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.columns import distance_bucket
from spanloom.operators.components import durable


def window_pairs(mentions: DataFrame, keys: Sequence[str] = ("doc_id", "win_id"), carry: Sequence[str] = (), order: str = "mention_idx") -> DataFrame:
    """All pairs ``i > j`` of one window: ``keys, i, j``, and ``carry`` of both with the suffixes ``_i`` and ``_j``.

    The window bounds the pairs; carry ids and labels, never vectors.
    """
    side = lambda s: mentions.select(*keys, F.col(order).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in carry))
    return side("i").join(side("j"), list(keys)).where(F.col("j") < F.col("i"))


def cross_window_pairs(nodes: DataFrame, carry: Sequence[str] = (), salt: int = 1) -> DataFrame:
    """Pairs of a document's nodes ``i > j`` in different windows; ``salt`` parts a long document over so many tasks."""
    cols = ["win_id", *carry]
    side = lambda s: nodes.select("doc_id", F.col("node_idx").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in cols))
    left = side("i").withColumn("__salt", F.pmod("i", F.lit(salt)))
    right = side("j").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, ["doc_id", "__salt"]).where((F.col("j") < F.col("i")) & (F.col("win_id_i") != F.col("win_id_j"))).drop("__salt")


def with_distance(pairs: DataFrame) -> DataFrame:
    """Add ``dist`` and ``bucket`` to pairs of ordinals."""
    return pairs.withColumn("dist", F.col("i") - F.col("j")).withColumn("bucket", distance_bucket(F.col("i") - F.col("j")))


def best_antecedent(pairs: DataFrame, keys: Sequence[str] = ("doc_id", "win_id")) -> DataFrame:
    """``keys, i, j, score``: for each ``i`` the ``j`` with the highest score, the lowest ``j`` on ties.

    An aggregate with map-side combining, not a sort of all pairs.
    """
    best = pairs.groupBy(*keys, "i").agg(F.max_by(F.struct("j", "score"), F.struct("score", (-F.col("j")).alias("n"))).alias("b"))
    return best.select(*keys, "i", F.col("b.j").alias("j"), F.col("b.score").alias("score"))


def accept(best: DataFrame, null_score: float = 0.0, offset: float = 0.0) -> DataFrame:
    """Links whose score is above the null antecedent's, plus an offset."""
    return best.where(F.col("score") > null_score + offset)


def close_forest(nodes: DataFrame, links: DataFrame, keys: Sequence[str] = ("doc_id", "win_id"), max_rounds: int = 40) -> DataFrame:
    """``keys, i, root`` for every node: the root its links lead to (each node has one parent at most, a smaller one).

    Pointer jumping: each round every node's parent becomes its parent's
    parent, so rounds grow with the logarithm of the longest chain.
    """
    keys = list(keys)
    now = durable(links.select(*keys, "i", F.col("j").alias("root")))  # nodes without a link are roots and take no part
    for _ in range(max_rounds):
        up = now.select(*keys, F.col("i").alias("root"), F.col("root").alias("__up"))
        new = durable(now.join(up, [*keys, "root"], "left").select(*keys, "i", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("__moved")))
        moved = new.agg(F.max("__moved")).first()[0]
        now = new.drop("__moved")
        if not moved:
            return nodes.select(*keys, "i").join(now, [*keys, "i"], "left").withColumn("root", F.coalesce("root", "i"))
    raise RuntimeError(f"links did not close in {max_rounds} rounds")


def roots_of(group: np.ndarray, i: np.ndarray, j: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, i, root)`` of each node, given a row for each node and one for each link (``linked``, from ``i`` to ``j``).

    All groups at once: parents become places in one sorted array, and places
    of places are taken until nothing moves.
    """
    order = np.lexsort((linked, i, group))
    group, i, j, linked = group[order], i[order], j[order], linked[order]
    last = np.r_[(group[1:] != group[:-1]) | (i[1:] != i[:-1]), True][: len(i)]
    group, i, j, linked = group[last], i[last], j[last], linked[last]
    values = np.unique(np.concatenate([i, j[linked]]))
    code = lambda g, x: g * len(values) + np.searchsorted(values, x)
    keys, wanted = code(group, i), code(group, np.where(linked, j, i))
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    known = keys[at] == wanted
    at, root = np.where(known, at, np.arange(len(at))), np.where(known, i, j)
    while (up := at[at]).tolist() != at.tolist():
        at = up
    return group, i, root[at]


def close_windows(nodes: DataFrame, links: DataFrame, keys: Sequence[str] = ("doc_id", "win_id")) -> DataFrame:
    """As ``close_forest`` where ``keys`` bound a group, as a window does: one shuffle of numbers, no rounds, no checkpoint.

    A group's nodes and links meet in one task, many groups in one batch.
    """
    keys = list(keys)
    rows = nodes.select(*keys, F.col("i").cast("long").alias("i"), F.lit(None).cast("long").alias("j")).unionByName(links.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")))

    def close(listed: pa.Array) -> pa.Array:
        sizes = listed.value_lengths().to_numpy(zero_copy_only=False)
        flat = listed.flatten()
        i, j = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1)
        group, i, root = roots_of(np.repeat(np.arange(len(sizes)), sizes), i, j.fill_null(0).to_numpy(zero_copy_only=False), j.is_valid().to_numpy(zero_copy_only=False))
        offsets = np.searchsorted(group, np.arange(len(sizes) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(i), pa.array(root)], ["i", "root"]))

    closed = F.arrow_udf(close, "array<struct<i:long,root:long>>")
    listed = rows.groupBy(*keys).agg(F.collect_list(F.struct("i", "j")).alias("__xs"))
    return listed.select(*keys, F.explode(closed("__xs")).alias("__x")).select(*keys, "__x.i", "__x.root")


def build_nodes(members: DataFrame) -> DataFrame:
    """Quotient nodes of ``doc_id, win_id, root, mention_idx, tok_pos, cluster_id``.

    ``doc_id, node_idx, win_id, root, gold_id, min_tok_pos, members``: the
    commonest entity (the smallest on ties), members in order, nodes in order
    of their first position, window and first member.
    """
    votes = members.groupBy("doc_id", "win_id", "root", "cluster_id").agg(F.count("*").alias("n"), F.min("tok_pos").alias("p"), F.collect_list("mention_idx").alias("m"))
    nodes = votes.groupBy("doc_id", "win_id", "root").agg(F.max_by("cluster_id", F.struct("n", -F.col("cluster_id"))).alias("gold_id"), F.min("p").alias("min_tok_pos"), F.array_sort(F.flatten(F.collect_list("m"))).alias("members"))
    return node_order(nodes)


def node_order(nodes: DataFrame) -> DataFrame:
    """Add ``node_idx``: discourse order of a document's nodes."""
    order = Window.partitionBy("doc_id").orderBy("min_tok_pos", "win_id", F.element_at("members", 1))
    return nodes.withColumn("node_idx", F.row_number().over(order) - 1)


def apply_merge(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, cluster, mention_idx`` of merged clusters: node classes (``doc_id, i, root``) lifted to mentions."""
    rooted = nodes.join(classes.select("doc_id", F.col("i").alias("node_idx"), F.col("root").alias("cluster")), ["doc_id", "node_idx"])
    return rooted.select("doc_id", "cluster", F.explode("members").alias("mention_idx"))


def merge_stats(best: DataFrame, nodes: DataFrame, gold_pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row: ``merges`` accepted, ``with_antecedent`` nodes that have a true one, ``nodes``."""
    one = accept(best, threshold).agg(F.count("*").alias("merges"))
    two = gold_pairs.select("doc_id", "i").distinct().agg(F.count("*").alias("with_antecedent"))
    return one.crossJoin(two).crossJoin(nodes.agg(F.count("*").alias("nodes")))  # one row each


def hard_negatives(candidates: DataFrame, ratio: int = 5, keys: Sequence[str] = ("doc_id", "win_id"), ties: Sequence[str] = ("start", "end")) -> DataFrame:
    """All gold candidates of a window and its ``ratio`` times as many highest-scoring others; windows without gold give none."""
    whole, kind = Window.partitionBy(*keys), Window.partitionBy(*keys, "is_gold").orderBy(F.desc("score"), *ties)
    ranked = candidates.withColumn("__p", F.sum(F.col("is_gold").cast("int")).over(whole)).withColumn("__r", F.row_number().over(kind))
    return ranked.where((F.col("__p") > 0) & (F.col("is_gold") | (F.col("__r") <= ratio * F.col("__p")))).drop("__p", "__r")


def sample_negatives(pairs: DataFrame, ratio: float = 5, seed: int = 0, keys: Sequence[str] = ("doc_id", "win_id")) -> DataFrame:
    """All gold antecedents of each ``i`` and, in order of a digest of the pair, ``max(int(ratio * max(gold, 1)), 4)`` others at most."""
    digest = F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in (*keys, "i", "j")), F.lit(str(seed))).cast("binary"))
    node, kind = Window.partitionBy(*keys, "i"), Window.partitionBy(*keys, "i", "is_gold").orderBy(digest, "j")
    many = F.greatest((F.lit(float(ratio)) * F.greatest(F.col("__g"), F.lit(1))).cast("int"), F.lit(4))
    ranked = pairs.withColumn("__g", F.sum(F.col("is_gold").cast("int")).over(node)).withColumn("__r", F.row_number().over(kind))
    return ranked.where(F.col("is_gold") | (F.col("__r") <= many)).drop("__g", "__r")


def training_pairs(mentions: DataFrame, ratio: float | None = None, seed: int = 0) -> DataFrame:
    """Labelled pairs in windows: ``doc_id, win_id, i, j, dist, bucket, is_gold``; ``ratio``: with that many sampled negatives."""
    pairs = with_distance(window_pairs(mentions, carry=("cluster_id",))).withColumn("is_gold", F.col("cluster_id_i") == F.col("cluster_id_j")).drop("cluster_id_i", "cluster_id_j")
    return pairs if ratio is None else sample_negatives(pairs, ratio, seed)


def training_nodes(nodes: DataFrame, ratio: float | None = None, seed: int = 0, salt: int = 1) -> DataFrame:
    """Labelled pairs of a document's nodes in different windows: ``doc_id, win_id_i, win_id_j, i, j, is_gold``.

    ``nodes``: ``doc_id, node_idx, win_id, gold_id``.  ``ratio``: all gold
    antecedents of each node and that many sampled others, four at least.
    """
    pairs = cross_window_pairs(nodes, carry=("gold_id",), salt=salt).withColumn("is_gold", F.col("gold_id_i") == F.col("gold_id_j")).drop("gold_id_i", "gold_id_j")
    return pairs if ratio is None else sample_negatives(pairs, ratio, seed, keys=("doc_id",))


def ranking_loss(pairs: DataFrame, mentions: DataFrame, null_score: float = 0.0) -> DataFrame:
    """One row ``loss``: half the mean over mentions with a gold antecedent and half that over those without.

    A mention's loss is the log of the summed exponentials of all candidates
    and the null, less that of its gold ones, or of the null.  The first
    mention of a window decides nothing.  ``pairs``: ``doc_id, win_id, i, j,
    score, is_gold``.
    """
    gold = F.when(F.col("is_gold"), F.col("score"))
    tops = pairs.groupBy("doc_id", "win_id", "i").agg(F.max("score").alias("m"), F.max(gold).alias("g"))
    joined = pairs.join(tops, ["doc_id", "win_id", "i"])
    m = F.greatest("m", F.lit(null_score))
    sums = joined.groupBy("doc_id", "win_id", "i").agg(F.first(m).alias("m"), F.first("g").alias("g"), F.sum(F.exp(F.col("score") - m)).alias("s"), F.sum(F.exp(gold - F.col("g"))).alias("t"))
    total = F.col("m") + F.log(F.col("s") + F.exp(F.lit(null_score) - F.col("m")))
    each = sums.select(F.col("g").isNotNull().alias("has"), (total - F.when(F.col("g").isNotNull(), F.col("g") + F.log("t")).otherwise(F.lit(null_score))).alias("l"))
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("l"))), F.lit(0.0))
    return each.agg(((mean(F.col("has")) + mean(~F.col("has"))) / 2).alias("loss"))


def link_outcomes(pairs: DataFrame, null_score: float = 0.0, keys: Sequence[str] = ("doc_id", "win_id")) -> DataFrame:
    """``keys, i, j, score, has_gold, outcome`` of each decision (``pairs``: also ``is_gold``)."""
    had = pairs.groupBy(*keys, "i").agg(F.bool_or("is_gold").alias("has_gold"), F.max_by(F.struct("j", "score", "is_gold"), F.struct("score", (-F.col("j")).alias("n"))).alias("b"))
    linked, right = F.col("b.score") > null_score, F.col("b.is_gold")
    outcome = F.when(linked & right, "TRUE_LINK").when(linked & F.col("has_gold"), "WRONG_LINK").when(linked, "FALSE_LINK").when(F.col("has_gold"), "MISSED_LINK").otherwise("TRUE_NULL")
    return had.select(*keys, "i", F.col("b.j").alias("j"), F.col("b.score").alias("score"), "has_gold", outcome.alias("outcome"))


def link_prf(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Link recall and precision by columns of ``outcomes``."""
    n = lambda *names: F.sum(F.col("outcome").isin(*names).cast("long"))
    counts = outcomes.groupBy(*by).agg(n("TRUE_LINK").alias("true_links"), n("TRUE_LINK", "WRONG_LINK", "MISSED_LINK").alias("wanted"), n("TRUE_LINK", "WRONG_LINK", "FALSE_LINK").alias("made"))
    return counts.withColumn("recall", ratio_of("true_links", "wanted")).withColumn("precision", ratio_of("true_links", "made"))


def ratio_of(a: str, b: str) -> Column:
    return F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))


def missed_by_head(pairs: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ("doc_id", "win_id")) -> DataFrame:
    """``head_shared, n``: missed links, by whether a gold antecedent has the mention's head (``pairs``: ``is_gold, head_i, head_j``)."""
    same = pairs.where("is_gold").groupBy(*keys, "i").agg(F.bool_or(F.col("head_i") == F.col("head_j")).alias("head_shared"))
    return outcomes.where(F.col("outcome") == "MISSED_LINK").join(same, [*keys, "i"]).groupBy("head_shared").agg(F.count("*").alias("n"))


def pair_conditions(pairs: DataFrame) -> DataFrame:
    """``condition, pairs, gold, share``: how often pairs corefer: all, those with one head, and those of one type, by type.

    ``pairs``: ``is_gold, head_i, head_j, type_i, type_j``; counted in one pass.
    """
    hold = F.array_compact(F.array(F.lit("all"), F.when(F.col("head_i") == F.col("head_j"), "same head"), F.when(F.col("type_i") == F.col("type_j"), F.concat(F.lit("both "), F.col("type_i")))))
    counts = pairs.select(F.explode(hold).alias("condition"), F.col("is_gold").cast("long").alias("g")).groupBy("condition").agg(F.count("*").alias("pairs"), F.sum("g").alias("gold"))
    return counts.withColumn("share", F.col("gold") / F.col("pairs"))


def running_before(rows: DataFrame, by: str, values: Sequence[str], keys: Sequence[str] = (), each: int = 1_000_000) -> DataFrame:
    """Add ``<value>_before`` for each of ``values``: the sum over the rows of ``keys`` that come earlier in order of ``by``.

    Rows are written, counted and dealt into as many ranges as it takes for
    about ``each`` rows; ranges are summed, their sums added up (a row for each
    range and key), and inside a range a window does the rest.  No task orders
    more than a range.
    """
    keys, names = list(keys), [f"{v}_before" for v in values]
    written = durable(rows)
    dealt = written.repartitionByRange(max(1, -(-written.count() // each)), *keys, by).withColumn("__part", F.spark_partition_id())
    sums = dealt.groupBy(*keys, "__part").agg(*(F.sum(v).alias(f"__{n}") for v, n in zip(values, names, strict=True)))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sums.select(*keys, "__part", *(F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in names))
    inside = Window.partitionBy(*keys, "__part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, n in zip(values, names, strict=True)})
    return near.join(base, [*keys, "__part"]).withColumns({n: F.col(n) + F.col(f"__{n}") for n in names}).drop("__part", *(f"__{n}" for n in names))


def similarity_separation(pairs: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ("doc_id", "win_id")) -> DataFrame:
    """Mean and exact median of the highest similarity to a gold antecedent, for resolved and for missed mentions.

    ``pairs``: ``keys, i, j, sim, is_gold``, of the antecedents to be considered.
    """
    top = pairs.where("is_gold").groupBy(*keys, "i").agg(F.max("sim").alias("sim"))
    kind = F.when(F.col("outcome") == "TRUE_LINK", "resolved").when(F.col("outcome") == "MISSED_LINK", "missed")
    told = outcomes.join(top, [*keys, "i"]).withColumn("kind", kind).where(F.col("kind").isNotNull())
    counts = running_before(told.groupBy("kind", "sim").agg(F.count("*").alias("times")), "sim", ["times"], ["kind"])
    sums = counts.groupBy("kind").agg(F.sum("times").alias("n"), F.sum(F.col("sim") * F.col("times")).alias("s"))  # two rows
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")  # places of the middle, from 0
    holds = lambda k: F.max(F.when((F.col("times_before") <= k) & (k < F.col("times_before") + F.col("times")), F.col("sim")))
    return counts.join(F.broadcast(sums), "kind").groupBy("kind").agg(F.first("n").alias("n"), (F.first("s") / F.first("n")).alias("mean_sim"), ((holds(low) + holds(high)) / 2).alias("median_sim"))


def separation_auc(pairs: DataFrame, score: str = "score", buckets: int | None = None) -> DataFrame:
    """One row ``auc``: how likely a coreferent pair scores higher than another, ties counting half.

    Scores are first counted, so ranks are over distinct scores; ``buckets``
    rounds them to such a grid before.
    """
    value = F.col(score) if buckets is None else F.floor(F.col(score) * buckets)
    counts = pairs.groupBy(value.alias("s")).agg(F.sum(F.col("is_gold").cast("long")).alias("p"), F.sum((~F.col("is_gold")).cast("long")).alias("n"))
    return running_before(counts, "s", ["n"]).agg((F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)) / (F.sum("p").cast("double") * F.sum("n"))).alias("auc"))


def cluster_purity(members: DataFrame) -> DataFrame:
    """One row: ``clusters``, ``over_merged`` (of two or more entities), ``mentions`` and ``in_over_merged``; ``doc_id, cluster, gold_id`` (null: not matched)."""
    each = members.groupBy("doc_id", "cluster").agg(F.countDistinct("gold_id").alias("k"), F.count("gold_id").alias("n"))
    bad = F.col("k") >= 2
    return each.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("over_merged"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.coalesce(F.sum(F.when(bad, F.col("n")).otherwise(0)), F.lit(0)).alias("in_over_merged"))


def compression_stats(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Means of mentions, nodes and entities a document, their ratios, and pair counts of either kind."""
    m = mentions.groupBy("doc_id").agg(F.count("*").alias("m"), F.countDistinct("cluster_id").alias("e"))
    c = nodes.groupBy("doc_id").agg(F.count("*").alias("c"), F.countDistinct("win_id").alias("w"))
    both = m.join(c, "doc_id")
    return both.agg(
        F.count("*").alias("docs"), F.avg("m").alias("mentions"), F.avg("c").alias("nodes"), F.avg("e").alias("entities"), (F.sum("m") / F.sum("c")).alias("mentions_per_node"), (F.sum("c") / F.sum("e")).alias("nodes_per_entity"),
        F.sum(F.expr("m * m")).alias("mention_pairs"), F.sum(F.expr("c * c")).alias("node_pairs"), F.sum(F.expr("w * (w - 1) div 2")).alias("window_pairs"),
    )
