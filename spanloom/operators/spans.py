"""Detected spans: matches, alignment, nesting, BIO labels, candidates, sweeps and errors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.columns import clip, f1, mention_type_eval, overlap, ratio
from spanloom.operators.components import durable

SPAN = ("sub_start", "sub_end")


def _blocks(df: DataFrame, width: int, start: str, end: str, name: str = "__block") -> DataFrame:
    """A row for each block of ``width`` positions that the inclusive span touches: the equal part of an overlap join."""
    return df.withColumn(name, F.explode(F.sequence(F.expr(f"cast({start} div {width} as int)"), F.expr(f"cast({end} div {width} as int)"))))


def overlapping(gold: DataFrame, pred: DataFrame, width: int = 32) -> DataFrame:
    """Distinct pairs of overlapping inclusive spans of a document: ``doc_id, g0, g1, p0, p1``."""
    g = _blocks(gold.select("doc_id", F.col("sub_start").alias("g0"), F.col("sub_end").alias("g1")).distinct(), width, "g0", "g1")
    p = _blocks(pred.select("doc_id", F.col("sub_start").alias("p0"), F.col("sub_end").alias("p1")).distinct(), width, "p0", "p1")
    # a pair meets in every block that both touch; it counts in the one where the later of the two begins
    first = F.expr(f"cast(greatest(g0, p0) div {width} as int)")
    return g.join(p, ["doc_id", "__block"]).where((F.col("p0") <= F.col("g1")) & (F.col("g0") <= F.col("p1")) & (F.col("__block") == first)).drop("__block")


def span_matches(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct gold and predicted spans with the flags ``exact``, ``overlap`` and ``same_end``.

    Spans that end alike overlap, so one table of overlapping pairs, written
    once, tells all three flags of both sides.
    """
    g, p = (durable(side.select("doc_id", *SPAN).distinct()) for side in (gold, pred))
    same_end = F.col("g1") == F.col("p1")
    met = durable(overlapping(g, p).select("*", (same_end & (F.col("g0") == F.col("p0"))).alias("exact"), same_end.alias("same_end")))

    def flag(one: DataFrame, a: str) -> DataFrame:
        found = met.groupBy("doc_id", F.col(f"{a}0").alias("sub_start"), F.col(f"{a}1").alias("sub_end")).agg(F.bool_or("exact").alias("exact"), F.lit(True).alias("overlap"), F.bool_or("same_end").alias("same_end"))
        return one.join(found, ["doc_id", *SPAN], "left").fillna(False)

    return flag(g, "g"), flag(p, "p")


def earlier_at_least(values: np.ndarray) -> np.ndarray:
    """For each value, how many of those before it are as large or larger: counted while halves are merged."""
    n = len(values)
    out = np.zeros(n, np.int64)
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    place, size, many = np.arange(n), 1, int(ranks.max()) + 1 if n else 1
    while size < n:
        key = place // (2 * size) * many + ranks
        right = place // size % 2 == 1
        left = np.sort(key[~right])
        # the left half's values from one's own up to the end of the pair of halves
        out[right] += np.searchsorted(left, (place[right] // (2 * size) + 1) * many) - np.searchsorted(left, key[right])
        size *= 2
    return out


def nesting_depth(spans: DataFrame, keys: Sequence[str] = ("doc_id", "sent_idx")) -> DataFrame:
    """Distinct ``keys, sub_start, sub_end`` and ``depth``: how many other spans contain the span. Spans do not leave their sentence, so ``keys`` may hold it.

    In order of start, and of falling end, what contains a span comes before it
    and ends no earlier; no pairs are made.
    """

    def depths(listed: pa.Array) -> pa.Array:
        sizes = listed.value_lengths().to_numpy(zero_copy_only=False)
        start, end = (listed.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        group = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((-end, start, group))
        width = int(end.max()) - int(end.min()) + 1 if len(end) else 1
        # an earlier group is below every value of a later one
        depth = np.empty(len(end), np.int64)
        depth[order] = earlier_at_least((group * width + end - (end.min() if len(end) else 0))[order])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(depth))

    kinds = dict(spans.dtypes)
    listed = spans.select(*keys, *SPAN).distinct().groupBy(*keys).agg(F.collect_list(F.struct(*SPAN)).alias("__s"))
    deep = listed.select(*keys, F.explode(F.arrays_zip(F.col("__s"), F.arrow_udf(depths, "array<long>")("__s").alias("__d"))).alias("__x"))
    return deep.select(*keys, *(F.col(f"__x.__s.{c}").cast(kinds[c]).alias(c) for c in SPAN), F.col("__x.__d").alias("depth"))


def prf_row(counts: DataFrame, tp_gold: str, tp_pred: str, n_gold: str, n_pred: str) -> DataFrame:
    r, p = ratio(F.col(tp_gold), F.col(n_gold)), ratio(F.col(tp_pred), F.col(n_pred))
    return counts.withColumn("recall", r).withColumn("precision", p).withColumn("f1", f1(p, r))


def span_prf(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``criterion, gold_hits, pred_hits, n_gold, n_pred, recall, precision, f1`` under exact, overlap and same_end."""
    g, p = span_matches(gold, pred)

    def side(df: DataFrame, hits: str, n: str) -> DataFrame:
        names = F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).alias("hit")) for c in ("exact", "overlap", "same_end")))
        return df.select(F.explode(names).alias("x")).groupBy("x.criterion").agg(F.sum(F.col("x.hit").cast("long")).alias(hits), F.count("*").alias(n))

    return prf_row(side(g, "gold_hits", "n_gold").join(side(p, "pred_hits", "n_pred"), "criterion"), "gold_hits", "pred_hits", "n_gold", "n_pred")


def false_positives(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: predictions that are no gold span, ``boundary`` (they touch one) and ``disjoint``."""
    _, p = span_matches(gold, pred)
    wrong = p.where(~F.col("exact"))
    return wrong.agg(F.coalesce(F.sum(F.col("overlap").cast("long")), F.lit(0)).alias("boundary"), F.coalesce(F.sum((~F.col("overlap")).cast("long")), F.lit(0)).alias("disjoint"))


def miss_analysis(gold: DataFrame, pred: DataFrame, deepest: int = 2) -> DataFrame:
    """Gold spans and those no prediction touches, by nesting depth, type and length in words: ``depth, type, length`` (one set in each row), ``n, missed``."""
    hit = overlapping(gold, pred).select("doc_id", F.col("g0").alias("sub_start"), F.col("g1").alias("sub_end")).distinct().withColumn("hit", F.lit(True))
    rows = gold.select("doc_id", "sent_idx", *SPAN, mention_type_eval(F.col("tokens")).alias("type"), clip(F.size("tokens"), 1, 6).cast("int").alias("length")).dropDuplicates(["doc_id", *SPAN])
    rows = rows.join(nesting_depth(gold), ["doc_id", "sent_idx", *SPAN]).join(hit, ["doc_id", *SPAN], "left").withColumn("depth", F.least("depth", F.lit(deepest)))
    counts = rows.groupingSets([[F.col("depth")], [F.col("type")], [F.col("length")]], F.col("depth"), F.col("type"), F.col("length"))
    return counts.agg(F.count("*").alias("n"), F.sum(F.col("hit").isNull().cast("long")).alias("missed"))


def nested_breakdown(gold: DataFrame, pred: DataFrame, heads: int = 2) -> DataFrame:
    """By depth of the gold span: found by its own depth's predictions or by any, exactly or by overlap; ``pred`` has ``head``."""
    deep = nesting_depth(gold).withColumn("depth", F.least("depth", F.lit(heads - 1)).cast("int"))
    keys = ["doc_id", *SPAN]
    exact = pred.select("doc_id", *SPAN, "head").distinct()
    touch = _blocks(deep, 32, "sub_start", "sub_end").join(_blocks(pred.select("doc_id", F.col("sub_start").alias("p0"), F.col("sub_end").alias("p1"), "head").distinct(), 32, "p0", "p1"), ["doc_id", "__block"])
    touch = touch.where((F.col("p0") <= F.col("sub_end")) & (F.col("sub_start") <= F.col("p1")))
    flags = lambda df, name: df.groupBy(*keys).agg(F.max((F.col("head") == F.col("depth")).cast("int")).alias(f"own_{name}"), F.lit(1).alias(f"any_{name}"))
    out = deep.join(flags(deep.join(exact, keys), "exact"), keys, "left").join(flags(touch, "overlap"), keys, "left")
    names = ("own_exact", "any_exact", "own_overlap", "any_overlap")
    return out.groupBy("depth").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names))


def align_to_gold(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """``doc_id, pred_idx, sent_idx, start, end, gold_cluster``: the entity of the equal gold span, else of the one that overlaps most, else a new one.

    Of equal overlaps the first gold mention (``mention_idx``) wins.  New ids
    follow the document's largest, in the order of ``pred_idx``.  Spans are
    half-open word ranges of a sentence; equal gold spans count as the last.
    """
    g = gold.groupBy("doc_id", "sent_idx", F.col("start").alias("g0"), F.col("end").alias("g1")).agg(F.max_by("cluster_id", "mention_idx").alias("c"), F.min("mention_idx").alias("o"))
    p = pred.select("doc_id", "pred_idx", "sent_idx", "start", "end")
    both = p.join(g, ["doc_id", "sent_idx"]).where((F.col("start") < F.col("g1")) & (F.col("g0") < F.col("end")))
    exact = (F.col("start") == F.col("g0")) & (F.col("end") == F.col("g1"))
    share = overlap(F.col("start"), F.col("end"), F.col("g0"), F.col("g1"))
    best = both.groupBy("doc_id", "pred_idx").agg(F.max_by("c", F.struct(exact.alias("x"), share.alias("s"), (-F.col("o")).alias("n"))).alias("found"))
    top = gold.groupBy("doc_id").agg(F.max("cluster_id").alias("top"))
    joined = p.join(best, ["doc_id", "pred_idx"], "left").join(top, "doc_id", "left")
    new = F.sum(F.col("found").isNull().cast("int")).over(Window.partitionBy("doc_id").orderBy("pred_idx"))
    return joined.select("doc_id", "pred_idx", "sent_idx", "start", "end", F.coalesce(F.col("found"), F.coalesce(F.col("top"), F.lit(-1)) + new).cast("int").alias("gold_cluster"))


def detected_gold(gold: DataFrame, pred: DataFrame, least: int = 2) -> DataFrame:
    """Gold mentions that a prediction of their sentence overlaps, of documents that keep at least ``least``."""
    p = pred.select("doc_id", "sent_idx", F.col("start").alias("__p0"), F.col("end").alias("__p1"))
    on = (gold["doc_id"] == p["doc_id"]) & (gold["sent_idx"] == p["sent_idx"]) & (gold["start"] < p["__p1"]) & (p["__p0"] < gold["end"])
    found = gold.join(p, on, "left_semi")
    return found.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("__n") >= least).drop("__n")


def matched_only(aligned: DataFrame, gold: DataFrame, spurious: bool = False) -> DataFrame:
    """Aligned predictions of a gold entity (``spurious``: the others)."""
    ids = gold.select("doc_id", F.col("cluster_id").alias("gold_cluster")).distinct()
    return aligned.join(ids, ["doc_id", "gold_cluster"], "left_anti" if spurious else "left_semi")


def boundary_errors(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions that touch gold, by offset of either end (clipped to 3) and side: ``left, right, side, n``."""
    g = gold.select("doc_id", "sent_idx", F.col("start").alias("g0"), F.col("end").alias("g1"), F.col("mention_idx").alias("o"))
    both = pred.join(g, ["doc_id", "sent_idx"]).where((F.col("start") < F.col("g1")) & (F.col("g0") < F.col("end")))
    share = overlap(F.col("start"), F.col("end"), F.col("g0"), F.col("g1"))
    best = both.groupBy("doc_id", "pred_idx").agg(F.max_by(F.struct((F.col("start") - F.col("g0")).alias("l"), (F.col("end") - F.col("g1")).alias("r")), F.struct(((F.col("start") == F.col("g0")) & (F.col("end") == F.col("g1"))).alias("x"), share.alias("s"), (-F.col("o")).alias("n"))).alias("b"))
    left, right = clip(F.col("b.l"), -3, 3).cast("int"), clip(F.col("b.r"), -3, 3).cast("int")
    side = F.when((F.col("b.l") == 0) & (F.col("b.r") == 0), "exact").when(F.col("b.r") == 0, "left").when(F.col("b.l") == 0, "right").otherwise("both")
    return best.groupBy(left.alias("left"), right.alias("right"), side.alias("side")).agg(F.count("*").alias("n"))


def exact_rates(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """``kind, value, n, exact``: predictions that touch gold and those that equal it, by mention type and by length in words (6: or more)."""
    g = gold.select("doc_id", "sent_idx", F.col("start").alias("g0"), F.col("end").alias("g1"))
    both = pred.join(g, ["doc_id", "sent_idx"]).where((F.col("start") < F.col("g1")) & (F.col("g0") < F.col("end")))
    hit = both.groupBy("doc_id", "pred_idx").agg(F.max(((F.col("start") == F.col("g0")) & (F.col("end") == F.col("g1"))).cast("long")).alias("x"), F.first("tokens").alias("t"))
    kinds = F.array(F.struct(F.lit("type").alias("kind"), mention_type_eval(F.col("t")).alias("value")), F.struct(F.lit("length").alias("kind"), F.least(F.size("t"), F.lit(6)).cast("string").alias("value")))
    return hit.select("x", F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"), F.sum("x").alias("exact"))


def word_to_sentence(words: DataFrame, sentences: DataFrame) -> DataFrame:
    """Add ``sent_idx, tok_idx`` to ``doc_id, word_idx``: the sentence (``word_offset, words``) that the word lies in.

    One pass in word order over words and sentence starts together; words past
    a sentence's end are left out.
    """
    starts = sentences.where(F.size("words") > 0).select("doc_id", F.col("word_offset").alias("word_idx"), F.struct("sent_idx", "word_offset", F.size("words").alias("n")).alias("__s"), F.lit(0).alias("__kind"))
    both = words.withColumn("__kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("word_idx", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__s", F.last("__s", True).over(order)).where(F.col("__kind") == 1)
    tok = F.col("word_idx") - F.col("__s.word_offset")
    return out.where(tok < F.col("__s.n")).withColumn("sent_idx", F.col("__s.sent_idx")).withColumn("tok_idx", tok.cast("int")).drop("__s", "__kind")


def snap_to_words(spans: DataFrame, pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """Piece spans to word spans: ``doc_id, pred_idx, sent_idx, start, end`` inside the sentence of the first piece.

    Ends outside the document are clamped; a span that leaves its sentence ends
    with it; one word at least.
    """
    owner = pieces.select("doc_id", "word_idx", F.explode(F.sequence(F.col("first_piece"), F.col("first_piece") + F.col("n_pieces") - 1)).alias("piece"))
    last = pieces.groupBy("doc_id").agg((F.max(F.col("first_piece") + F.col("n_pieces")) - 1).alias("last"))
    held = spans.join(last, "doc_id")
    put = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("last")))
    held = held.select("doc_id", "pred_idx", put("sub_start").alias("a"), put("sub_end").alias("b"))
    where = owner.join(tokens.select("doc_id", "word_idx", "sent_idx", "tok_idx"), ["doc_id", "word_idx"])
    side = lambda s: where.select("doc_id", F.col("piece").alias(s), F.col("sent_idx").alias(f"s{s}"), F.col("tok_idx").alias(f"t{s}"))
    both = held.join(side("a"), ["doc_id", "a"]).join(side("b"), ["doc_id", "b"])
    size = tokens.groupBy("doc_id", F.col("sent_idx").alias("sa")).agg(F.max("tok_idx").alias("top"))
    out = both.join(size, ["doc_id", "sa"])
    end = F.when(F.col("sb") == F.col("sa"), F.col("tb")).otherwise(F.col("top"))
    return out.select("doc_id", "pred_idx", F.col("sa").alias("sent_idx"), F.col("ta").alias("start"), (F.greatest("ta", end) + 1).alias("end"))


def spans_in_window(spans: DataFrame, windows: DataFrame, width: int = 256) -> DataFrame:
    """Spans that lie wholly in a chunk, with ``win_id`` and local positions; others vanish.

    A span meets only the chunks that touch the block of ``width`` positions in
    which it starts, so a long document's pairs do not grow with its square.
    """
    at = _blocks(windows.where(F.col("chunk_end") > F.col("chunk_start")), width, "chunk_start", "(chunk_end - 1)")
    starts = spans.withColumn("__block", F.expr(f"cast(sub_start div {width} as int)"))
    joined = starts.join(at, ["doc_id", "__block"]).where((F.col("chunk_start") <= F.col("sub_start")) & (F.col("sub_end") < F.col("chunk_end"))).drop("__block")
    return joined.withColumn("local_start", F.col("sub_start") - F.col("chunk_start")).withColumn("local_end", F.col("sub_end") - F.col("chunk_start")).drop("chunk_start", "chunk_end")


def unreachable(spans: DataFrame, most: int) -> DataFrame:
    """One row: ``n`` spans, ``unreachable`` of them longer than ``most`` pieces, and the share."""
    far = F.coalesce(F.sum((F.col("sub_end") - F.col("sub_start") >= most).cast("long")), F.lit(0))
    return spans.agg(F.count("*").alias("n"), far.alias("unreachable"), ratio(far, F.count("*")).alias("share"))


def candidate_spans(windows: DataFrame, most: int) -> DataFrame:
    """All ``start <= end`` of a window of ``n`` positions with fewer than ``most`` between them."""
    one = windows.select("doc_id", "win_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    return one.select("doc_id", "win_id", "start", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + most - 1, F.col("n") - 1))).alias("end"))


def candidate_labels(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates with ``is_gold``: whether the span (``doc_id, sub_start, sub_end``) is a gold one."""
    right = gold.select("doc_id", *SPAN).distinct().withColumn("__g", F.lit(True))
    return candidates.join(right, ["doc_id", *SPAN], "left").withColumn("is_gold", F.coalesce("__g", F.lit(False))).drop("__g")


def threshold_sweep(candidates: DataFrame, n_gold: Column | int, grid: Sequence[float]) -> DataFrame:
    """``threshold, tp, n_pred, precision, recall, f1, best`` for each threshold (candidates count above it).

    Each score falls between two thresholds once; counts add up from the top.
    ``n_gold`` includes gold spans that are no candidates.  The first of equal
    best thresholds is marked.
    """
    grid = sorted(grid)
    steps = F.array(*(F.lit(float(t)) for t in grid))
    slot = F.size(F.filter(steps, lambda t: t < F.col("score")))
    counts = candidates.groupBy(slot.alias("slot")).agg(F.sum(F.col("is_gold").cast("long")).alias("g"), F.count("*").alias("n"))
    spark = candidates.sparkSession
    levels = spark.range(len(grid)).select((F.col("id") + 1).cast("int").alias("slot"), F.element_at(steps, (F.col("id") + 1).cast("int")).alias("threshold"))
    full = levels.join(counts, "slot", "left").fillna(0, ["g", "n"])
    above = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = full.withColumn("tp", F.sum("g").over(above)).withColumn("n_pred", F.sum("n").over(above))
    gold = n_gold if isinstance(n_gold, Column) else F.lit(n_gold)
    p, r = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), gold)
    scored = summed.select("threshold", "tp", "n_pred", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))
    first = F.row_number().over(Window.orderBy(F.desc("f1"), "threshold"))  # a row for each threshold
    return scored.withColumn("best", first == 1)


def recall_by_length(candidates: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """``length`` in words (6: or more), ``n`` gold spans and ``found`` with a score above the threshold."""
    hit = candidates.where((F.col("score") > threshold)).select("doc_id", *SPAN).distinct().withColumn("__h", F.lit(1))
    rows = gold.select("doc_id", *SPAN, F.least(F.size("tokens"), F.lit(6)).alias("length")).dropDuplicates(["doc_id", *SPAN])
    return rows.join(hit, ["doc_id", *SPAN], "left").groupBy("length").agg(F.count("*").alias("n"), F.coalesce(F.sum("__h"), F.lit(0)).cast("long").alias("found"))


def bio_encode(spans: DataFrame, lengths: DataFrame, heads: int = 2, keys: Sequence[str] = ("doc_id",), within: Sequence[str] = ()) -> DataFrame:
    """``keys, head, pos, label``: B, I or O at each position, a head for each nesting depth below ``heads``.

    ``lengths``: ``keys, n``.  Where spans of one depth meet, B wins.
    ``within``: columns of ``spans`` that no nesting crosses, such as the
    sentence; only spans that share them are compared.
    """
    deep = nesting_depth(spans, [*keys, *within]).where(F.col("depth") < heads)
    marks = deep.select(*keys, F.col("depth").cast("int").alias("head"), "sub_start", F.explode(F.sequence("sub_start", "sub_end")).alias("pos"))
    own = marks.groupBy(*keys, "head", "pos").agg(F.min(F.when(F.col("pos") == F.col("sub_start"), "B").otherwise("I")).alias("label"))
    # a row before the first position of each head; what lies between two rows is outside, so only marks travel
    top = lengths.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"), F.lit(-1).cast("long").alias("pos"), F.col("n").cast("long").alias("n"))
    both = top.unionByName(own.where(F.col("pos") >= 0).withColumn("pos", F.col("pos").cast("long")), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "head").orderBy("pos")
    size = F.max("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = both.withColumn("n", size).withColumn("until", F.least(F.coalesce(F.lead("pos").over(order), F.col("n")), F.col("n"))).where(F.col("n").isNotNull() & (F.col("until") > F.col("pos")))
    every = placed.select(*keys, "head", F.col("pos").alias("at"), "label", F.explode(F.sequence("pos", F.col("until") - 1)).alias("pos")).where(F.col("pos") >= 0)
    return every.select(*keys, "head", "pos", F.when(F.col("pos") == F.col("at"), F.col("label")).otherwise("O").alias("label"))


def bio_decode(labels: DataFrame, keys: Sequence[str] = ("doc_id", "head")) -> DataFrame:
    """``keys, sub_start, sub_end`` of the runs: B starts one, I goes on, or starts one after O."""
    order = Window.partitionBy(*keys).orderBy("pos")
    opens = (F.col("label") == "B") | ((F.col("label") == "I") & (F.coalesce(F.lag("label").over(order), F.lit("O")) == "O"))
    runs = labels.withColumn("run", F.sum(opens.cast("int")).over(order)).where(F.col("label") != "O")
    return runs.groupBy(*keys, "run").agg(F.min("pos").alias("sub_start"), F.max("pos").alias("sub_end")).drop("run")


def bio_class_weights(labels: DataFrame) -> DataFrame:
    """``head, label, n, weight``: square root of total over three times the count (each plus one), over the head's mean, in 0.2 to 30."""
    counts = labels.groupBy("head", "label").agg(F.count("*").alias("n"))
    every = counts.select("head").distinct().withColumn("label", F.explode(F.array(F.lit("O"), F.lit("B"), F.lit("I"))))
    full = every.join(counts, ["head", "label"], "left").fillna(0, ["n"])
    head = Window.partitionBy("head")
    smooth = F.col("n") + 1
    raw = full.withColumn("w", F.sqrt(F.sum(smooth).over(head) / (3 * smooth)))
    return raw.select("head", "label", "n", clip(F.col("w") / F.avg("w").over(head), 0.2, 30.0).alias("weight"))


def dedupe_first(spans: DataFrame, keys: Sequence[str] = ("doc_id", "sub_start", "sub_end"), order: str = "pred_idx") -> DataFrame:
    """Of equal spans the first."""
    return spans.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__r") == 1).drop("__r")


def union_heads(spans: DataFrame) -> DataFrame:
    """Distinct spans of all heads."""
    return spans.select("doc_id", *SPAN).distinct()
