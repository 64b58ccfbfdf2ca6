"""Mention tables: validation, offsets, order, windows, corpus selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.columns import span_range


def word_offsets(sentences: DataFrame) -> DataFrame:
    """Add ``word_offset``: the words of a document's earlier sentences (``doc_id, sent_idx, words``)."""
    before = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    return sentences.withColumn("word_offset", F.coalesce(F.sum(F.size("words")).over(before), F.lit(0)).cast("long"))


def valid_spans(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Mentions whose sentence exists and holds their start; the end is clamped to it."""
    sized = sentences.select("doc_id", "sent_idx", F.size("words").alias("__n"))
    return mentions.join(sized, ["doc_id", "sent_idx"]).where(F.col("start") < F.col("__n")).withColumn("end", F.least("end", "__n")).drop("__n")


def from_clusters(documents: DataFrame, clusters: str, inclusive: bool) -> DataFrame:
    """``doc_id, cluster_id, pos, sent_idx, start, end`` from nested ``[sentence, start, end]`` clusters; ends become exclusive."""
    one = documents.select("doc_id", F.posexplode(clusters).alias("cluster_id", "cluster"))
    two = one.select("doc_id", "cluster_id", F.posexplode("cluster").alias("pos", "span"))
    at = lambda k: F.element_at("span", k).cast("int")
    return two.select("doc_id", "cluster_id", "pos", at(1).alias("sent_idx"), at(2).alias("start"), (at(3) + int(inclusive)).alias("end"))


def from_span_strings(documents: DataFrame, sentences: str = "sentences", entities: str = "entities") -> DataFrame:
    """Mentions of entities whose spans are texts ``"a-b"`` of named sentences.

    Spans of unknown sentences go, then entities with fewer than two spans;
    the others are numbered densely in their old order.
    """
    known = documents.select("doc_id", F.posexplode(sentences).alias("sent_idx", "s")).select("doc_id", "sent_idx", F.col("s.sent_id").alias("sent_id"))
    spans = documents.select("doc_id", F.posexplode(entities).alias("entity", "e")).select("doc_id", "entity", F.posexplode("e").alias("pos", "m"))
    start, end = span_range(F.col("m.span"))
    found = spans.select("doc_id", "entity", "pos", F.col("m.sent_id").alias("sent_id"), start.alias("start"), end.alias("end")).join(known, ["doc_id", "sent_id"])
    enough = found.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id", "entity"))).where(F.col("__n") >= 2)
    return enough.withColumn("cluster_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("entity")) - 1).select("doc_id", "cluster_id", "pos", "sent_idx", "start", "end")


def min_mentions(mentions: DataFrame, least: int = 2) -> DataFrame:
    """Mentions of documents that have at least ``least``."""
    return mentions.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("__n") >= least).drop("__n")


def drop_singletons(partition: DataFrame, keys: Sequence[str] = ("doc_id", "cluster_id"), least: int = 2) -> DataFrame:
    """Rows of clusters that have at least ``least``."""
    return partition.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") >= least).drop("__n")


def mention_order(mentions: DataFrame, ties: Sequence[str] = ("cluster_id", "pos")) -> DataFrame:
    """Add ``mention_idx``: the place in the document by ``sub_start, sub_end``, then ``ties``."""
    return mentions.withColumn("mention_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("sub_start", "sub_end", *ties)) - 1)


def word_to_pieces(mentions: DataFrame, pieces: DataFrame) -> DataFrame:
    """Add ``sub_start, sub_end`` (inclusive) to mentions with ``w0, w1`` (first and last word of the document).

    ``pieces``: ``doc_id, word_idx, first_piece, n_pieces``; words may be
    missing.  The start is the first word's first piece, or that word's number
    if it has none, the last piece at most; the end is the piece before the
    next word's, or the last.
    """
    last = pieces.groupBy("doc_id").agg((F.max(F.col("first_piece") + F.col("n_pieces")) - 1).alias("__last"))
    first = pieces.select("doc_id", F.col("word_idx").alias("w0"), F.col("first_piece").alias("__s"))
    after = pieces.select("doc_id", (F.col("word_idx") - 1).alias("w1"), F.col("first_piece").alias("__e"))
    joined = mentions.join(last, "doc_id").join(first, ["doc_id", "w0"], "left").join(after, ["doc_id", "w1"], "left")
    start = F.coalesce("__s", F.least("w0", "__last"))
    end = F.greatest(start, F.least(F.coalesce(F.col("__e") - 1, F.col("__last")), F.col("__last")))
    return joined.withColumn("sub_start", start).withColumn("sub_end", end).drop("__s", "__e", "__last")


def sentence_extents(sentences: DataFrame, pieces: DataFrame) -> DataFrame:
    """``doc_id, sent_idx, sub_offset, sub_length`` (1 at least) of sentences with ``word_offset`` and ``words``."""
    spans = sentences.where(F.size("words") > 0).select("doc_id", "sent_idx", F.col("word_offset").alias("w0"), (F.col("word_offset") + F.size("words") - 1).alias("w1"))
    found = word_to_pieces(spans, pieces)
    return found.select("doc_id", "sent_idx", F.col("sub_start").alias("sub_offset"), F.greatest(F.lit(1), F.col("sub_end") - F.col("sub_start") + 1).cast("long").alias("sub_length"))


def retokenize(mentions: DataFrame, pieces: DataFrame, ties: Sequence[str] = ("cluster_id", "pos")) -> DataFrame:
    """The same mentions over another tokenizer's pieces: spans and order anew."""
    return mention_order(word_to_pieces(mentions.drop("sub_start", "sub_end", "mention_idx"), pieces), ties)


def fixed_windows(mentions: DataFrame, size: int, position: str = "tok_pos") -> DataFrame:
    """Add ``win_id``: which block of ``size`` pieces the position lies in."""
    return mentions.withColumn("win_id", F.expr(f"cast({position} div {int(size)} as int)"))


def pack_sentences(extents: DataFrame, size: int) -> DataFrame:
    """``doc_id, win_id, chunk_start, chunk_end``: whole sentences packed greedily into chunks of at most ``size`` pieces.

    A chunk reaches from its first sentence's start to its last one's end, gaps
    included; a sentence longer than ``size`` is cut by itself.  ``extents``:
    ``doc_id, sub_offset, sub_length``; equal rows count once.  A document's
    sentences stream by in order; only the open chunk is held.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, begin, end, number = object(), None, None, 0
        docs, wins, starts, ends = [], [], [], []

        def close(a: int, b: int) -> None:
            nonlocal number
            docs.append(doc)
            wins.append(number)
            starts.append(a)
            ends.append(b)
            number += 1

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(wins, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "win_id", "chunk_start", "chunk_end"])
            for column in (docs, wins, starts, ends):
                column.clear()
            return out

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for d, o, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if d != doc:
                    if begin is not None:
                        close(begin, end)
                    doc, begin, number = d, None, 0
                if begin is not None and (n > size or o + n - begin > size):
                    close(begin, end)
                    begin = None
                if n > size:
                    for k in range(0, n, size):
                        close(o + k, min(o + k + size, o + n))
                        if len(docs) > 100_000:
                            yield made()
                    continue
                begin, end = o if begin is None else begin, o + n
            yield made()
        if begin is not None:
            close(begin, end)
            yield made()

    rows = extents.select("doc_id", F.col("sub_offset").cast("long").alias("o"), F.col("sub_length").cast("long").alias("n")).distinct()
    kind = dict(extents.dtypes)["doc_id"]
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "o", "n").mapInArrow(pack, f"doc_id {kind}, win_id int, chunk_start long, chunk_end long")


def assign_window(mentions: DataFrame, windows: DataFrame, position: str = "tok_pos") -> DataFrame:
    """Add ``win_id``: the last chunk of the document that starts at or before the position (-1 before the first).

    One pass in position order over mentions and chunk starts together.
    """
    kinds = dict(mentions.dtypes)
    starts = windows.select("doc_id", F.col("chunk_start").cast(kinds[position]).alias("__at"), F.col("win_id").alias("__win"), F.lit(0).alias("__kind"))
    both = mentions.withColumn("__at", F.col(position)).withColumn("__kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("win_id", F.coalesce(F.last("__win", True).over(order), F.lit(-1))).where(F.col("__kind") == 1)
    return out.drop("__at", "__win", "__kind")


def window_ordinal(mentions: DataFrame) -> DataFrame:
    """Add ``i``: the place of a mention in its window."""
    return mentions.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "win_id").orderBy("mention_idx")) - 1)


def select_subset(docs: DataFrame, subset: str = "all", only_train: Sequence[str] = (), without: Sequence[str] = (), caps: dict[str, int] | None = None) -> DataFrame:
    """Documents of a training subset (``corpus, split, doc_order``).

    ``all``; ``prefix:x``: corpora whose name starts with x; ``without``:
    corpora left out; ``only_train``: training documents come from these alone;
    ``caps``: at most so many training documents of a corpus, in order.
    """
    out = docs.where(~F.col("corpus").isin(list(without))) if without else docs
    if subset.startswith("prefix:"):
        out = out.where(F.startswith(F.col("corpus"), F.lit(subset[7:])))
    if only_train:
        out = out.where((F.col("split") != "train") | F.col("corpus").isin(list(only_train)))
    if caps:
        limit = F.element_at(F.create_map(*(F.lit(x) for pair in caps.items() for x in pair)), F.col("corpus"))
        capped = F.coalesce((F.col("split") == "train") & F.col("corpus").isin(list(caps)), F.lit(False))
        place = F.row_number().over(Window.partitionBy("corpus").orderBy("doc_order"))
        # the largest cap is a plain number, so every task keeps only so many rows of a corpus before the shuffle
        first = out.where(capped).withColumn("__n", place).where(F.col("__n") <= max(caps.values())).where(F.col("__n") <= limit).drop("__n")
        out = out.where(~capped).unionByName(first)
    return out


def eval_sets(docs: DataFrame, split: str, transfer: str | None = None) -> DataFrame:
    """Documents of ``split`` with ``eval_set``, their corpus; ``transfer``: validate on that corpus' training documents instead."""
    if transfer is not None and split == "validation":
        return docs.where((F.col("corpus") == transfer) & (F.col("split") == "train")).withColumn("eval_set", F.concat(F.lit("transfer-"), F.col("corpus")))
    return docs.where(F.col("split") == split).withColumn("eval_set", F.col("corpus"))


def sample_docs(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` documents that come first in a shuffle: in order of a digest of id and seed."""
    return docs.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"-{seed}")).cast("binary")), "doc_id").limit(n)


def pending(docs: DataFrame, done: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Documents that a stored result does not have yet."""
    return docs.join(done.select(*key).distinct(), list(key), "left_anti")


def surfaces(mentions: DataFrame) -> DataFrame:
    """The distinct ``surface`` texts (tokens joined by spaces)."""
    return mentions.select(F.array_join("tokens", " ").alias("surface")).distinct()


def attach_surface_vectors(mentions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mentions with the vector of their surface (``surface, vec``); frequent surfaces are left to the adaptive skew join."""
    return mentions.withColumn("surface", F.array_join("tokens", " ")).join(vectors, "surface")


def gather_endpoints(mentions: DataFrame, token_vectors: DataFrame, dim: int) -> DataFrame:
    """Add ``ctx_start, ctx_end``: token vectors at both ends (``doc_id, pos, vec``), zeros where there is none.

    Both ends look the vectors up in one join.  Over a store of
    ``corpora.read_vectors`` the vectors are read once and stay where they are:
    only mentions move, by document.
    """
    own = mentions.columns
    # the number only has to tell the rows of one document apart, which one join task gets from a task in one piece
    rows = mentions.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in own)).alias("__m"), F.monotonically_increasing_id().alias("__row"))
    ends = rows.select("*", F.posexplode(F.array("__m.sub_start", "__m.sub_end")).alias("__end", "pos"))
    met = ends.join(token_vectors.select("doc_id", "pos", "vec"), ["doc_id", "pos"], "left")
    at = lambda k: F.coalesce(F.first(F.when(F.col("__end") == k, F.col("vec")), True), F.array_repeat(F.lit(0.0), dim))
    both = met.groupBy("doc_id", "__row").agg(F.first("__m").alias("__m"), at(0).alias("__s"), at(1).alias("__e"))
    return both.select(*(F.col("__m")[c].alias(c) for c in own), F.col("__s").alias("ctx_start"), F.col("__e").alias("ctx_end"))


def split_stats(mentions: DataFrame, extents: DataFrame, windows: DataFrame, weight: str = "mention") -> DataFrame:
    """How windows cut sentences: ``sentences, cut_sentences, pairs, cut_pairs``.

    A sentence counts once for each of its mentions, or once (``weight =
    "sentence"``); pairs are coreferent mentions of one sentence.
    """
    ends = extents.withColumn("last", F.col("sub_offset") + F.col("sub_length") - 1)
    first = assign_window(ends, windows, "sub_offset").withColumnRenamed("win_id", "__a")
    both = assign_window(first, windows, "last")
    counted = mentions.groupBy("doc_id", "sent_idx").agg(F.count("*").alias("m"))
    times = F.col("m") if weight == "mention" else F.lit(1).cast("long")
    sents = both.join(counted, ["doc_id", "sent_idx"]).agg(F.coalesce(F.sum(times), F.lit(0)).alias("sentences"), F.coalesce(F.sum(F.when(F.col("__a") != F.col("win_id"), times).otherwise(0)), F.lit(0)).alias("cut_sentences"))
    placed = assign_window(mentions, windows)
    a, b = placed.alias("a"), placed.alias("b")
    same: Column = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.sent_idx") == F.col("b.sent_idx")) & (F.col("a.cluster_id") == F.col("b.cluster_id"))
    pairs = a.join(b, same & (F.col("b.mention_idx") < F.col("a.mention_idx"))).agg(F.count("*").alias("pairs"), F.coalesce(F.sum((F.col("a.win_id") != F.col("b.win_id")).cast("long")), F.lit(0)).alias("cut_pairs"))
    return sents.crossJoin(pairs)  # one row each
