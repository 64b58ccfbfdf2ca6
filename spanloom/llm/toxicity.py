"""Toxicity by weak supervision.

Voters are lexicons and word patterns: a fixed list of insults, and words and
word beginnings whose presence goes with the label on training rows.  A
generative label model treats each voter, and the given label itself, as a
noisy report of a hidden class: it estimates their accuracies, finds voters
that agree beyond what the class explains and lets such voters share one say.
Its posterior is the target of a linear classifier on the voters' counts, which
scores every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import alnum_words, give_back, texts, tidy
from spanloom.operators.components import durable

#: Insults in several languages.
INSULTS = frozenset(
    "idiot idiots moron morons loser losers scum clown clowns stupid disgusting worthless pathetic trash garbage dumb imbecile fool vermin filth bastard bitch asshole jerk creep retard "
    "abruti connard salaud crétin débile ordure dummkopf trottel arschloch abschaum depp blödmann estúpido imbécil basura escoria cabrón gilipollas".split()
)
LEXICON = "lexicon"
#: Letters of a word's beginning that make a pattern; the word must go on.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def patterns_of(word: bytes) -> list[str]:
    """The patterns that a word (UTF-8) matches: the lexicon, itself, its beginnings."""
    w = word.decode("utf-8", "replace").lower()
    return ([LEXICON] if w in INSULTS else []) + ["=" + w] + [w[:n] + "*" for n in BEGINNINGS if len(w) > n]


def is_training(doc_id: Column) -> Column:
    """Rows that labels may be learned from: CRC-32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, list[str]] = {}
    counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][p] for p in names], pa.int64()) for k in (1, 0))], ["pattern", "toxic", "clean"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            mine: set[str] = set()
            for w in set(alnum_words(text)):
                if (got := known.get(w)) is None:
                    if len(known) > 50_000:
                        known.clear()
                    got = known[w] = patterns_of(w)
                mine.update(got)
            counts[int(label)].update(mine)
            if len(counts[0]) > 200_000:
                yield flush()
    yield flush()


def counter(patterns: list[str]) -> Callable[[bytes], np.ndarray]:
    """A function from a text to the number of its distinct words that match each pattern."""
    at = {p: k for k, p in enumerate(patterns)}
    known: dict[bytes, tuple[int, ...]] = {}

    def count(text: bytes) -> np.ndarray:
        out = np.zeros(len(patterns), np.int64)
        for w in set(alnum_words(text)):
            if (got := known.get(w)) is None:
                if len(known) > 200_000:
                    known.clear()
                got = known[w] = tuple(at[p] for p in patterns_of(w) if p in at)
            for k in got:
                out[k] += 1
        return out

    return count


@dataclass
class LabelModel:
    """Accuracies and correlations of voters over a hidden class, by expectation maximisation."""

    prior: float = 0.5
    fires: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))  # by class: how often each voter fires
    say: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def fit(self, votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> np.ndarray:
        """Posterior of class 1 for each row of ``votes`` (0/1); ``given`` is a noisy label, one more voter."""
        x = np.column_stack([votes, given]).astype(np.float64)
        q = 0.9 * given + 0.05
        for _ in range(rounds):
            self.prior = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
            self.fires = np.stack([((1 - q) @ x + 0.5) / ((1 - q).sum() + 1), (q @ x + 0.5) / (q.sum() + 1)])
            rest = x - ((1 - q)[:, None] * self.fires[0] + q[:, None] * self.fires[1])
            scale = np.sqrt((rest * rest).mean(axis=0)) + 1e-9
            self.correlation = (rest.T @ rest) / len(x) / np.outer(scale, scale)
            tied = np.clip(self.correlation, 0, 1) ** 2
            self.say = 1 / tied.sum(axis=1)
            self.say[-1] = 1.0
            q = self.posterior(x)
        return q

    def posterior(self, x: np.ndarray) -> np.ndarray:
        on, off = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        return _logistic(np.log(self.prior / (1 - self.prior)) + x @ (self.say * on) + (1 - x) @ (self.say * off))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on soft targets, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (target - p) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    patterns: list[str]
    weights: np.ndarray

    def scorer(self) -> Callable[[bytes], float]:
        count = counter(self.patterns)
        return lambda text: float(_logistic(np.log1p(count(text)) @ self.weights[:-1] + self.weights[-1]))


def _votes(patterns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(patterns)
        for batch in batches:
            rows = [count(t).astype("<i4").tobytes() for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["votes", "label"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, most: int = 16_000, voters: int = 200, support: int = 5) -> Model:
    """Learn from at most ``most`` labelled training rows (the smallest by a hash of ``doc_id``), 0/1 in ``toxic``.

    Voters: the insult lexicon, and the ``voters`` patterns that go best with
    the label, of those on ``support`` toxic rows or more that are more often
    toxic than not.  A document with several labels takes the largest; of the
    texts of a repeated id one is taken (the smallest by a hash).  Without a
    toxic and a clean row the lexicon alone decides.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & is_training(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``most`` pairs of numbers are broadcast
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("row"))
    rows = durable(one.select("row.text", "row.label"))  # read three times
    counted = rows.mapInArrow(_count, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (size.get(0) and size.get(1)):
        return Model([LEXICON], np.array([8.0, -3.0]))
    on = (F.col("toxic") + 0.5) / (size[1] + 1)
    off = (F.col("clean") + 0.5) / (size[0] + 1)
    gain = F.col("toxic") * F.log(on / off)
    good = counted.where((F.col("toxic") >= support) & (F.col("toxic") > F.col("clean")) & (F.col("pattern") != LEXICON))
    patterns = [LEXICON, *(r["pattern"] for r in good.orderBy(gain.desc(), "pattern").limit(voters).collect())]
    table = rows.mapInArrow(_votes(patterns), "votes binary, label int").toArrow()
    counts = np.frombuffer(b"".join(v.as_py() for v in table.column("votes")), "<i4").reshape(-1, len(patterns))
    given = table.column("label").to_numpy().astype(np.float64)
    target = LabelModel().fit(counts > 0, given)
    model = Model(patterns, fit_linear(np.log1p(counts.astype(np.float64)), target))
    give_back()
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``__score`` (0 to 1, higher: likelier toxic) for every row of ``docs``, without a shuffle.

    A null or empty text has no words and scores the intercept; repeated rows
    score alike; an empty table gives no rows; columns beside ``keep`` and
    ``text`` are not read.
    """

    @tidy
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for column in columns:
            yield pa.array([of(t) for t in texts(column)], pa.float64())

    # only the texts go to Python, and only numbers come back
    return docs.select(*keep, F.arrow_udf(run, "double")(F.col("text").cast("string")).alias("__score"))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; a row travels as one column, so columns may have any names."""
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.text").alias("text"))
    return score(rows, model, ("row",)).where(F.col("__score") < threshold).select("row.*")
