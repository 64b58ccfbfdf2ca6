"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch is the ``SIZE`` smallest distinct hashes of a text's shingles, in
order.  Sketches of parts merge to the sketch of the whole; from two of them
come resemblance and containment, from one the number of distinct shingles.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.components import durable

#: Hashes kept, words in a shingle, bits of a hash.
SIZE, SHINGLE, BITS = 128, 5, 48


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A hash of each run of ``size`` words (lower-cased, between white space), repeats included; fewer words: one of all; none: none."""
    words = F.split(F.trim(F.lower(F.regexp_replace(text, r"\s+", " "))), " ")

    def of(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(hashes, i, size)), 64 - BITS))

    hashed = bind(F.transform(words, lambda w: F.xxhash64(w)), of)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\S"), hashed).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column, size: int = SIZE) -> Column:
    """The ``size`` smallest distinct shingle hashes of a text, ascending; a null text has none."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def merge_groups(df: DataFrame, key: str, column: str, size: int = SIZE) -> DataFrame:
    """``key`` and the merged sketch of all its rows: each hash counts once, and only the smallest travel on."""
    hashes = df.select(key, F.explode(column).alias("__h")).distinct()
    ranked = hashes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__h"))).where(F.col("__n") <= size)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias(column))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; 1 for two empty sketches."""
    both = merge(a, b, size)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact below ``size``."""
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) * F.lit(2.0**BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the first text's shingles that the second has, 0 to 1."""
    union = distinct_shingles(merge(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, size) * union / distinct_shingles(a, size)))


def as_text(a: Column) -> Column:
    """A sketch as hex digits, 12 a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, k, t, text``: ``(k, t)`` tells different documents apart; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(0)).alias("k"), F.xxhash64(doc.isNull(), text).alias("t"), text.alias("text"))


def successors(keys: DataFrame) -> DataFrame:
    """``doc_id, k, t, n, nk, nt``: for each distinct document the next in ascending ``doc_id`` (after the last: the first).

    Documents are sorted by range over many tasks; a task's last document is
    followed by the first of the next task that has any.  Only those first
    ones, one a task, meet in one place.
    """
    parted = durable(keys.distinct().repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("t")).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "t")
    inside = parted.withColumn("next", F.lead(F.struct("k", "t")).over(own))
    heads = parted.groupBy("part").agg(F.min_by(F.struct("k", "t"), F.struct("doc_id", "t")).alias("head"))
    over_parts = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(over_parts), F.first("head").over(over_parts)).alias("head"))
    linked = inside.join(after, "part").withColumn("next", F.coalesce("next", "head"))
    return linked.select("doc_id", "k", "t", "n", F.col("next.k").alias("nk"), F.col("next.t").alias("nt"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Sketches of every text of ``docs`` (``doc_id`` long, ``text``) and of its edited text.

    In the edited text the last ``floor(n_chars / 4)`` code points are replaced
    by the first as many (or all) of the next document's.  Returns ``doc_id,
    n_chars, edited, sketch, edited_sketch, next_sketch``.  A null text is
    empty; a null ``doc_id`` comes first; documents with one id are ordered by
    a hash of the text; repeated rows (one id and text) are one document in
    that order, and each gets its row; an empty table gives no rows; other
    columns are not read.  Texts travel once; of the next document only what
    is used.
    """
    # both joins take the same columns of ``base``, so that the texts travel once
    base = keyed(docs).select("k", "t", "text", sketch(F.col("text")).alias("sketch"))
    links = successors(keyed(docs).select("doc_id", "k", "t", F.length("text").alias("n")))
    quarter = F.floor(F.col("n") / 4).cast("int")
    asked = links.select(F.col("nk").alias("k"), F.col("nt").alias("t"), F.col("k").alias("pk"), F.col("t").alias("pt"), "doc_id", quarter.alias("q"))
    sent = base.join(asked, ["k", "t"]).select(F.col("pk").alias("k"), F.col("pt").alias("t"), "doc_id", F.expr("substring(text, 1, q)").alias("lead"), F.col("sketch").alias("next_sketch"))
    once = sent.groupBy("k", "t").agg(F.first("doc_id").alias("doc_id"), F.first("lead").alias("lead"), F.first("next_sketch").alias("next_sketch"))
    n = F.length("text")
    joined = base.join(once, ["k", "t"]).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.col("lead")))
    return joined.select("doc_id", n.cast("long").alias("n_chars"), "edited", "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
