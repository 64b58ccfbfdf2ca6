"""Periodic runs against every period tried, and on odd rows."""

import random

import numpy as np
import pytest

from spanloom.llm.queries import QUERIES
from spanloom.llm.runs import digest, periodic_runs, runs_of, word_numbers
from tests.llm import brute

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 2), (5, 2), (10, 3)])
def test_runs_equal_every_period_tried(least, times):
    rng = random.Random(least)
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 9])
        x = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            part = [rng.randrange(letters + 1) for _ in range(rng.randint(1, 8))]
            at = rng.randint(0, len(x))
            x = x[:at] + (part * 30)[: rng.randint(1, 60)] + x[at:]
        assert runs_of(np.array(x, np.int64), least, times) == brute.runs(x, least, times)


def test_long_repetitive_texts():
    for x, run in ((np.zeros(200_000, np.int64), (0, 200_000, 1)), (np.arange(200_000) % 2, (0, 200_000, 2)), (np.arange(200_000) % 999, (0, 200_000, 999))):
        assert runs_of(x) == [run]
    with pytest.raises(ValueError):
        runs_of(np.zeros(9, np.int64), times=1)


def test_words_are_read_in_pieces(monkeypatch):
    text = " a b\u3000c\x1cd \té\n\x0bf  ".encode() * 5
    want = text.split()
    for piece in (1, 3, 7, 1000):
        monkeypatch.setattr("spanloom.llm.runs._PIECE", piece)
        ids, vocabulary = word_numbers(text)
        assert [vocabulary[i] for i in ids] == want


def test_odd_rows(spark):
    same = "x y " * 12
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, same), (5, same), (5, same), (6, "a " * 30_000), (7, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "u", 3) for i, t in rows], "doc_id long, text string, runs string, collapsed int")
    found = {(r["doc_id"]): r for r in periodic_runs(docs).collect()}
    assert found[6]["collapsed"] == "a" and found[None]["collapsed"] == "x y" and found[7]["collapsed"] == "a b c d e f"
    assert [found[i]["collapsed"] for i in (1, 2, 3, 4)] == ["", "", "", "one"] and not found[1]["runs"]
    assert digest(periodic_runs(docs)).count() == len(rows)
    assert digest(periodic_runs(docs.where("false"))).count() == 0


def test_query_equals_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_runs"](spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    # every period is tried, so only the texts of up to 2,000 words
    want = sorted(brute.periodic(*r) for r in docs if len((r[1] or "").split()) <= 2000)
    kept = {w[0] for w in want}
    assert [g for g in got if g[0] in kept] == want and len(got) == len(docs) and any(w[1] for w in want)
