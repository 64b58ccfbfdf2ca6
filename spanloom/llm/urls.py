"""URL filtering: host word segmentation and a naive Bayes judge, under fixed rules.

Names in hosts are often words run together.  A unigram model over the words
that stand alone in all urls (and the fixed words below) splits them by
Viterbi; multinomial naive Bayes scores the words of host and path.  There are
no labels for urls: a fixed word list gives weak ones, and words that go with
the list's words gain weight beside them.  A rule that fits decides first.

Both models keep all words.  The most frequent ones are sent to the tasks; the
others are joined to the hosts and urls in which they occur.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.components import durable

#: Words whose presence in a host marks a url as unwanted for training.
UNWANTED = ("ads", "adult", "bets", "betting", "bingo", "casino", "escort", "gambling", "jackpot", "loans", "lottery", "payday", "pharmacy", "phishing", "pills", "poker", "porn", "replica", "slots", "spam", "torrent", "viagra", "warez", "xxx")
#: Further words that names are often made of.
COMMON = ("best", "blog", "book", "buy", "cheap", "city", "click", "club", "data", "deal", "deals", "farm", "forum", "free", "fun", "game", "games", "health", "home", "house", "info", "life", "live", "love", "mail", "market", "media", "mobile", "money", "music", "net", "news", "now", "online", "page", "photo", "play", "prize", "sale", "school", "search", "shop", "site", "sport", "store", "tech", "top", "track", "travel", "video", "web", "win", "work", "world", "www")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``action`` (block or allow) for urls of ``host`` and its subdomains whose path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def rule_index(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Position in ``rules`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: (len(rules[k].name), rules[k].name)):
        r = rules[k]
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


#: A host label has at most so many characters.
LONGEST = 63


def segmenter(counts: dict[str, int], total: int | None = None, longest: int = LONGEST) -> Callable[..., list[str]]:
    """Viterbi over a unigram model: the likeliest split of a run of letters into words.

    ``total``: the counts of all words, if ``counts`` has some of them; the
    others that can occur in a run are given with it.
    """
    total = total or sum(counts.values()) or 1
    score = {w: math.log(n / total) for w, n in counts.items()}
    unknown = [0.0] + [math.log(10 / total) - n * math.log(10) for n in range(1, longest + 1)]
    known: dict[str, list[str]] = {}

    def split(run: str, more: dict[str, int] | None = None) -> list[str]:
        if not more and (got := known.get(run)) is not None:
            return got
        extra = {w: math.log(n / total) for w, n in (more or {}).items()}
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            top = max((best[begin] + score.get(run[begin:end], extra.get(run[begin:end], unknown[end - begin])), begin) for begin in range(max(0, end - longest), end))
            best.append(top[0])
            back.append(top[1])
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        words.reverse()
        if not more:
            if len(known) > 200_000:
                known.clear()
            known[run] = words
        return words

    return split


def unigram_counts(urls: DataFrame) -> DataFrame:
    """``word, n``: how often each word stands alone in all paths and hyphenated host labels.

    A host label without a hyphen may be several words, so it tells nothing of
    where they end.  ``urls``: ``host, path``.  Each fixed word counts as often
    as words do on average, and as it is found.
    """
    labels = F.filter(F.split("host", "\\."), lambda s: F.contains(s, F.lit("-")))
    words = urls.select(F.explode(F.split(F.lower(F.concat_ws("/", F.array_join(labels, "/"), "path")), "[^a-z]+")).alias("word")).where(F.length("word").between(2, LONGEST))
    counts = durable(words.groupBy("word").agg(F.count("*").alias("n")))
    total, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    fixed = urls.sparkSession.createDataFrame([(w, max(2, total // max(1, size))) for w in sorted({*COMMON, *UNWANTED})], "word string, n long")
    return counts.unionByName(fixed).groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(table: DataFrame, most: int) -> tuple[list, DataFrame | None]:
    """The ``most`` rows of largest ``n`` (ties by word), and a table of the others if there are any."""
    top = table.orderBy(F.desc("n"), "word").limit(most + 1).collect()
    if len(top) <= most:
        return top, None
    last = top[most - 1]
    return top[:most], table.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))


def _words_udf(counts: dict[str, int], total: int):
    @F.pandas_udf("array<string>")
    def words(host: pd.Series, path: pd.Series, more: pd.Series) -> pd.Series:
        import re

        split, letters = segmenter(counts, total), re.compile("[a-z]+")
        seen: dict[str, list[str]] = {}
        out = []
        for h, p, m in zip(host, path, more, strict=True):
            if (head := seen.get(h)) is None:
                extra = {x["word"]: x["n"] for x in m} if m is not None else None
                head = seen[h] = ["h:" + w for run in letters.findall(h) for w in split(run, extra)]
            out.append(head + ["p:" + run for run in letters.findall(p.lower())])
        return pd.Series(out, index=host.index)

    return words


def with_words(urls: DataFrame, most: int = 50_000) -> DataFrame:
    """Add ``words``: those of the host, split, with ``h:`` before each, and those of the path with ``p:``."""
    counts = durable(unigram_counts(urls))
    total = counts.agg(F.sum("n")).first()[0]
    top, rest = _frequent(counts, most)
    none = F.lit(None).cast("array<struct<word:string,n:bigint>>")
    if rest is None:
        known = urls.withColumn("__more", none)
    else:  # the rarer words that are somewhere in a host
        run = F.explode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("run")
        begins = F.sequence(F.lit(1), F.length("run"))
        parts = F.flatten(F.transform(begins, lambda b: F.transform(F.sequence(F.lit(1), F.least(F.length("run") - b + 1, F.lit(LONGEST))), lambda n: F.substring("run", b, n))))
        pieces = urls.select("host").distinct().select("host", run).select("host", F.explode(parts).alias("word")).distinct()
        more = pieces.join(rest, "word").groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("__more"))
        known = urls.join(more, "host", "left").select(*urls.columns, "__more")
    words = _words_udf({r["word"]: int(r["n"]) for r in top}, int(total))
    return known.withColumn("words", words("host", "path", "__more")).drop("__more")


def train(worded: DataFrame, unwanted: Sequence[str] = UNWANTED) -> tuple[DataFrame, float]:
    """``word, odds, n``: log-odds of each word for an unwanted url; and those of the classes; from all rows of ``worded`` (``words``).

    A url trains the class "unwanted" if its host holds one of ``unwanted``,
    else the other.  Counts get one added each.
    """
    marks = F.array(*(F.lit("h:" + w) for w in unwanted))
    labelled = worded.select("words", F.arrays_overlap("words", marks).cast("int").alias("bad"))
    counted = durable(labelled.select("bad", F.explode("words").alias("word")).groupBy("word").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")))
    bad, n = labelled.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    all_bad, all_n, size = counted.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    odds = F.log((F.col("bad") + 1) / (all_bad + max(1, size))) - F.log((F.col("n") - F.col("bad") + 1) / (all_n - all_bad + max(1, size)))
    return counted.select("word", odds.alias("odds"), "n"), math.log((bad + 1) / (n - bad + 1))


def with_odds(worded: DataFrame, odds: DataFrame, prior: float, most: int = 100_000) -> DataFrame:
    """Add ``unwanted``: the probability of that class; 0 without words."""
    top, rest = _frequent(odds, most)
    known = {r["word"]: r["odds"] for r in top}

    @F.pandas_udf("double")
    def summed(rows: pd.Series) -> pd.Series:
        return pd.Series([sum(known.get(w, 0.0) for w in ws) for ws in rows], index=rows.index)

    total = F.lit(prior) + summed("words")
    if rest is not None:  # the rarer words of each url, repeats included
        urls = worded.select("host", "path", "words").dropDuplicates(["host", "path"])
        more = urls.select("host", "path", F.explode("words").alias("word")).join(rest, "word").groupBy("host", "path").agg(F.sum("odds").alias("__rare"))
        worded, total = worded.join(more, ["host", "path"], "left"), total + F.coalesce("__rare", F.lit(0.0))
    scored = worded.withColumn("__odds", F.greatest(F.lit(-700.0), F.least(F.lit(700.0), total)))
    return scored.withColumn("unwanted", F.when(F.size("words") > 0, 1 / (1 + F.exp(-F.col("__odds")))).otherwise(0.0)).drop("__odds", "__rare")


def judge(pages: DataFrame, rules: Sequence[Rule], *, words: int = 50_000, odds: int = 100_000) -> DataFrame:
    """``page_id, host, path, rule, verdict, words, unwanted`` for every row of ``pages`` (``page_id, url``).

    ``verdict`` is the action of the longest rule that fits; without one,
    ``block`` where the odds for unwanted (``unwanted``, a probability) are
    over one half, else ``allow``.  A null url, one without ``://`` and one
    without letters have no words and are allowed unless a rule fits.  The
    ``words`` and ``odds`` most frequent entries of the two models are sent to
    the tasks, the others are joined.  Hot hosts are split once a batch; the model is gathered by counts with map-side
    sums, so a host that holds a third of all rows is a few counts.  Repeated
    rows are judged each for itself; an empty table gives no rows; other
    columns are not read.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    worded = with_words(urls, words)
    scored = with_odds(worded, *train(worded), odds)
    at = rule_index(F.col("host"), F.col("path"), rules)
    chosen = scored.withColumn("at", at + 1)
    names = F.array(*(F.lit(r.name) for r in rules)) if rules else F.array().cast("array<string>")
    actions = F.array(*(F.lit(r.action) for r in rules)) if rules else F.array().cast("array<string>")
    verdict = F.when(F.col("at").isNotNull(), F.try_element_at(actions, F.col("at"))).when(F.col("unwanted") > 0.5, "block").otherwise("allow")
    return chosen.select("page_id", "host", "path", F.try_element_at(names, F.col("at")).alias("rule"), verdict.alias("verdict"), "words", "unwanted")
