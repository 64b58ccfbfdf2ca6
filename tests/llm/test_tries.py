"""The prefix trie against a plain one, its SQL, and odd rows."""

import random

import duckdb
import pytest

from spanloom.llm import tries
from spanloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def found(frame):
    assert sorted(frame.columns) == sorted(COLUMNS)
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=lambda r: (r[0], r[1]))


def made(spark, conversations):
    rows = [(c, k, role, text) for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def some(rng, n, letters, most):
    return {c: [("user", rng.choice(letters) * rng.randint(1, 2)) for _ in range(rng.randint(1, most))] for c in rng.sample(range(-250, 900), n)}


def test_centroid_sums_equal_plain_sums():
    rng = random.Random(5)
    for kind in ("path", "star", "random", "forest"):
        for n in (1, 2, 3, 50, 300):
            parent = [-1] + [{"path": v - 1, "star": 0, "random": rng.randrange(v), "forest": rng.randrange(-1, v)}[kind] for v in range(1, n)]
            values = [[rng.randint(-5, 9) for _ in range(n)] for _ in range(2)]
            want = [list(v) for v in values]
            for w in want:
                for v in range(n - 1, 0, -1):
                    if parent[v] >= 0:
                        w[parent[v]] += w[v]
            assert tries.subtree_sums(parent, values) == want


@pytest.mark.parametrize("width", [2, 7, 20_000])
def test_trie_equals_plain_trie(spark, width):
    rng = random.Random(width)
    talks = some(rng, 120, "ab", 9) | {5000: [("user", "a")] * 60, 5001: [("user", "a")] * 60, 5002: [("user", "a")] * 45 + [("user", "b")] * 9}
    ids, turns = tries.branched(tries.ordered_turns(made(spark, talks)))
    assert found(tries.prefix_trie(ids, turns, width=width)) == brute.trie(brute.rebuilt(talks))


def test_query_equals_sql_and_plain_version(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_trie']})").fetchall(), key=lambda r: (r[0], r[1]))
    talks = {}
    for c, _, role, text in sorted(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()):
        talks.setdefault(c, []).append((role, text))
    assert found(QUERIES["op11_trie"](spark, SF)) == want == brute.trie(brute.rebuilt(talks))


def test_odd_rows(spark):
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 0, "user", "y"), (202, 0, "user", "dropped"), (7, 3, "b", "q"), (7, 3, "a", "r")]
    more = spark.createDataFrame([(*r, "u", 9) for r in rows], SCHEMA + ", a string, depth int")
    talks = {1: [("user", ""), ("", "x"), ("", "x")], 202: [("user", "dropped")], 7: [("a", "r"), ("b", "q")]}
    ids, turns = tries.branched(tries.ordered_turns(more))
    got = found(tries.prefix_trie(ids, turns))
    assert got == brute.trie(brute.rebuilt(talks))
    # a conversation without a turn of its own left ends at the root
    assert got[0][:2] == (1, 0) and any(not t for t in brute.rebuilt(talks).values())
    ids, turns = tries.branched(tries.ordered_turns(more.where("false")))
    assert tries.prefix_trie(ids, turns).count() == 0


def test_ids_of_a_node_cross_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        ends = spark.range(-40, 60).selectExpr("IF(id % 3 = 0, 1L, 2L) AS a", "5L AS b", "id AS conv_id")
        import hashlib

        want = {a: hashlib.sha256(",".join(str(i) for i in range(-40, 60) if (i % 3 == 0) == (a == 1)).encode()).hexdigest() for a in (1, 2)}
        assert {r["a"]: r["ends_sha256"] for r in tries.digests_of_ids(ends).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
