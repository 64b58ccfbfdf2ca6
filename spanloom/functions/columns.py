"""Column functions: words, mention types, spans, scores and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pronouns of the mention types used in evaluation.
PRONOUNS_EVAL = (
    "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves who whom whose which that this these those there"
).split()
#: Pronouns of the mention types used in diagnostics and of the content test.
PRONOUNS_DIAG = (
    "i you he she it we they me him her us them my your his its our their mine yours hers ours theirs myself yourself himself herself itself ourselves yourselves themselves this that these those who whom whose which what there here"
).split()
#: Upper bounds of the distance buckets, right-closed.
DISTANCE_BOUNDS = (2, 3, 4, 5, 8, 16, 32, 64)
#: Names of the type buckets of clusters, by the types in them.
TYPE_BUCKETS = {"PRON": "PRON-only", "PROPN": "PROPN-only", "NOUN": "NOUN-only", "NOUN,PRON": "PRON+NOUN", "PRON,PROPN": "PRON+PROPN", "NOUN,PROPN": "NOUN+PROPN", "NOUN,PRON,PROPN": "all-mixed"}


def surface(words: Column, start: Column, end: Column) -> Column:
    """Words ``[start, end)`` joined by a space."""
    return F.array_join(F.slice(words, start + 1, end - start), " ")


def head(tokens: Column) -> Column:
    """The last token, lower-cased; null without tokens."""
    return F.lower(F.try_element_at(tokens, F.lit(-1)))


def mention_type_eval(words: Column) -> Column:
    """PRON if the first word is a pronoun; PROPN if it starts upper-case and there are five words at most; else NOUN."""
    first = F.try_element_at(words, F.lit(1))
    return F.when(F.lower(first).isin(PRONOUNS_EVAL), "PRON").when(first.rlike(r"^\p{Lu}") & (F.size(words) <= 5), "PROPN").otherwise("NOUN")


def mention_type_diag(words: Column) -> Column:
    """PRON for one pronoun alone; PROPN with any word that starts upper-case; else NOUN."""
    alone = (F.size(words) == 1) & F.lower(F.try_element_at(words, F.lit(1))).isin(PRONOUNS_DIAG)
    return F.when(alone, "PRON").when(F.exists(words, lambda w: w.rlike(r"^\p{Lu}")), "PROPN").otherwise("NOUN")


def type_bucket(types: Column) -> Column:
    """Bucket of a cluster from the array of its mentions' types."""
    joined = F.array_join(F.array_sort(F.array_distinct(types)), ",")
    out = F.lit(None).cast("string")
    for key, name in TYPE_BUCKETS.items():
        out = F.when(joined == key, name).otherwise(out)
    return out


def is_content(tokens: Column) -> Column:
    """Not one pronoun alone (tokens are lower-case)."""
    return ~((F.size(tokens) == 1) & F.coalesce(F.try_element_at(tokens, F.lit(1)).isin(PRONOUNS_DIAG), F.lit(False)))


def contains_run(a: Column, b: Column) -> Column:
    """Whether ``a`` is a contiguous run of ``b``'s tokens; false for an empty or longer ``a``."""
    starts = F.sequence(F.lit(1), F.size(b) - F.size(a) + 1)
    return F.when((F.size(a) == 0) | (F.size(a) > F.size(b)), False).otherwise(F.exists(starts, lambda k: F.slice(b, k, F.size(a)) == a))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two half-open spans share."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two inclusive spans share a position."""
    return (a0 <= b1) & (b0 <= a1)


def span_range(text: Column) -> tuple[Column, Column]:
    """Half-open range of a 1-based inclusive span text ``"a-b"`` or ``"a"``."""
    parts = F.split(text, "-")
    return F.element_at(parts, 1).cast("int") - 1, F.element_at(parts, -1).cast("int")


def strip_brackets(label: Column) -> Column:
    """An annotation cell without leading and trailing brackets and stars."""
    return F.regexp_replace(label, r"^[()*]+|[()*]+$", "")


def coref_segments(cell: Column) -> Column:
    """``array<struct<cluster, opens, closes>>`` of a coreference cell, in order; ``-`` gives none."""
    parts = F.filter(F.split(cell, r"\|"), lambda p: p.rlike(r"\d"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("cluster"), F.startswith(p, F.lit("(")).alias("opens"), F.endswith(p, F.lit(")")).alias("closes")))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, zero where ``b`` is."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, floor: float = 1e-4) -> Column:
    """``a`` divided by its length, or by ``floor`` if that is larger."""
    return F.transform(F.arrays_zip(a.alias("v"), F.array_repeat(F.greatest(norm(a), F.lit(floor)), F.size(a)).alias("n")), lambda s: s["v"] / s["n"])


def cosine(a: Column, b: Column, floor: float = 1e-4) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bio_from_probs(p_o: Column, p_b: Column, p_i: Column, threshold: float | None = None) -> Column:
    """O, B or I: the likeliest (first on ties), or inside from ``1 - p_o >= threshold`` on, B if it is not less likely than I."""
    if threshold is None:
        return F.when((p_o >= p_b) & (p_o >= p_i), "O").when(p_b >= p_i, "B").otherwise("I")
    return F.when(1 - p_o < threshold, "O").when(p_b >= p_i, "B").otherwise("I")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def distance_bucket(distance: Column, bounds: Sequence[int] = DISTANCE_BOUNDS) -> Column:
    """How many bounds the distance reaches."""
    return sum((F.when(distance >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def pair_features(a: Column, b: Column, extra: Column | None = None) -> Column:
    """``a``, ``b``, their products and absolute differences, then ``extra``, in one array."""
    parts = [a, b, F.zip_with(a, b, lambda x, y: x * y), F.zip_with(a, b, lambda x, y: F.abs(x - y))]
    return F.concat(*parts, *([extra] if extra is not None else []))
