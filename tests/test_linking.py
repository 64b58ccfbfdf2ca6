"""The linking operators on hand-worked cases and properties."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators import components, lexical, links, mentions, metrics, spans, vectors


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def partition(spark, clusters, doc=1):
    data = [(doc, k, 0, m, m + 1) for k, c in enumerate(clusters) for m in c]
    return spark.createDataFrame(data, "doc_id int, cluster_id int, sent_idx int, start int, end int")


def test_published_metric_example(spark):
    key, response = partition(spark, [[1, 2, 3], [4, 5, 6, 7]]), partition(spark, [[1, 2], [3, 4], [6, 7, 8, 9]])
    m, b, c = (f(key, response).first() for f in (metrics.muc, metrics.b_cubed, metrics.ceaf_e))
    assert (m["recall"], m["precision"]) == (0.4, 0.4) and m["f1"] == pytest.approx(0.4)
    assert b["recall"] == pytest.approx(0.416667, abs=1e-6) and b["precision"] == 0.5 and b["f1"] == pytest.approx(0.454545, abs=1e-6)
    assert c["recall"] == pytest.approx(0.65) and c["precision"] == pytest.approx(0.433333, abs=1e-6) and c["f1"] == pytest.approx(0.52)
    assert metrics.conll_f1(key, response).first()["conll"] == pytest.approx(0.458182, abs=1e-6)


def test_identity_scores_one_and_swap_swaps(spark):
    a, b = partition(spark, [[1, 2], [3, 4, 5]]), partition(spark, [[1, 3], [4, 5, 9]])
    assert metrics.conll_f1(a, a).first()["conll"] == pytest.approx(1.0)
    for f in (metrics.muc, metrics.b_cubed, metrics.ceaf_e):
        x, y = f(a, b).first(), f(b, a).first()
        assert (x["recall"], x["precision"]) == (pytest.approx(y["precision"]), pytest.approx(y["recall"]))


def test_empty_response_scores_zero(spark):
    key = partition(spark, [[1, 2]])
    got = metrics.conll_f1(key, key.limit(0)).first()
    assert (got["muc"], got["b_cubed"], got["ceaf_e"]) == (0, 0, 0)


@pytest.mark.parametrize("seed", range(20))
def test_assignment_is_best(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    gain = np.round(rng.random((n, m)) * (rng.random((n, m)) < 0.7), 2)
    got = sum(gain[a, b] for a, b in metrics.assignment(gain))
    wide = gain if n <= m else gain.T
    best = max(sum(wide[i, p[i]] for i in range(wide.shape[0])) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    assert got == pytest.approx(best)


def test_packing_case(spark):
    ext = spark.createDataFrame([(1, 0, 4), (1, 4, 5), (1, 9, 3), (1, 12, 25), (1, 37, 2), (2, 0, 4), (2, 9, 3)], "doc_id int, sub_offset long, sub_length long")
    win = mentions.pack_sentences(ext, 10)
    assert rows(win.where("doc_id = 1").select("win_id", "chunk_start", "chunk_end")) == [(0, 0, 9), (1, 9, 12), (2, 12, 22), (3, 22, 32), (4, 32, 37), (5, 37, 39)]
    assert rows(win.where("doc_id = 2").select("chunk_start", "chunk_end")) == [(0, 4), (9, 12)]
    at = spark.createDataFrame([(1, p) for p in (0, 8, 9, 25, 38)], "doc_id int, tok_pos long")
    assert rows(mentions.assign_window(at, win).select("tok_pos", "win_id")) == [(0, 0), (8, 0), (9, 1), (25, 3), (38, 5)]


def test_decoding_case(spark):
    def classes(scores):
        pairs = spark.createDataFrame([(1, 0, i, j, s) for (i, j), s in scores.items()], "doc_id int, win_id int, i int, j int, score double")
        best = links.accept(links.best_antecedent(pairs))
        nodes = spark.createDataFrame([(1, 0, i) for i in range(4)], "doc_id int, win_id int, i int")
        return {r["i"]: r["root"] for r in links.close_forest(nodes, best).collect()}

    scores = {(1, 0): 0.5, (2, 0): -1.0, (2, 1): -2.0, (3, 0): 0.2, (3, 1): 0.2, (3, 2): 0.9}
    assert classes(scores) == {0: 0, 1: 0, 2: 2, 3: 2}
    assert classes({**scores, (3, 2): 0.2}) == {0: 0, 1: 0, 2: 2, 3: 0}
    assert classes({(1, 0): 0.0}) == {0: 0, 1: 1, 2: 2, 3: 3}


def test_distance_buckets(spark):
    df = spark.createDataFrame([(d,) for d in (1, 2, 3, 4, 5, 7, 8, 15, 16, 31, 32, 63, 64)], "d int")
    assert [r[0] for r in df.orderBy("d").select(C.distance_bucket(F.col("d"))).collect()] == [0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8]


def test_lexical_case(spark):
    men = spark.createDataFrame([(1, 0, ["bill", "smith"], 0, 0, 0, 0), (1, 1, ["he"], 0, 0, 3, 0), (1, 2, ["smith"], 1, 2, 9, 0)], "doc_id int, mention_idx int, tokens array<string>, win_id int, root int, tok_pos int, cluster_id int")
    idf = {r["token"]: r["idf"] for r in lexical.doc_idf(men).collect()}
    assert idf == pytest.approx({"bill": 1.405465, "he": 1.405465, "smith": 1.0}, abs=1e-6)
    nodes = links.build_nodes(men)
    got = lexical.lexical_pair_features(lexical.node_tokens(nodes, men), lexical.doc_idf(men)).first()
    assert (got["i"], got["j"], got["containment"], got["exact_match"]) == (1, 0, 1, 0) and got["idf_jaccard"] == pytest.approx(0.262403, abs=1e-6)


def test_alignment_case(spark):
    gold = spark.createDataFrame([(1, 0, 0, 0, 2, 5), (1, 1, 0, 1, 4, 7)], "doc_id int, mention_idx int, sent_idx int, start int, end int, cluster_id int")
    pred = spark.createDataFrame([(1, k, *s) for k, s in enumerate([(0, 0, 2), (0, 1, 2), (0, 3, 5), (1, 0, 1), (1, 2, 3)])], "doc_id int, pred_idx int, sent_idx int, start int, end int")
    got = [r["gold_cluster"] for r in spans.align_to_gold(pred, gold).orderBy("pred_idx").collect()]
    assert got == [5, 5, 7, 8, 9]
    assert [r["pred_idx"] for r in spans.matched_only(spans.align_to_gold(pred, gold), gold, spurious=True).orderBy("pred_idx").collect()] == [3, 4]


def test_bio_case(spark):
    gold = spark.createDataFrame([(1, 0, 5), (1, 1, 2), (1, 4, 4)], "doc_id int, sub_start long, sub_end long")
    lengths = spark.createDataFrame([(1, 6)], "doc_id int, n int")
    labels = {h: "".join(r["label"] for r in spans.bio_encode(gold, lengths).where(F.col("head") == h).orderBy("pos").collect()) for h in (0, 1)}
    assert labels == {0: "BIIIII", 1: "OBIOBO"}
    back = spans.bio_decode(spans.bio_encode(gold, lengths)).select("sub_start", "sub_end")
    assert rows(back) == [(0, 5), (1, 2), (4, 4)]
    loose = spark.createDataFrame([(1, 0, k, x) for k, x in enumerate("IIOBB")], "doc_id int, head int, pos int, label string")
    assert rows(spans.bio_decode(loose).select("sub_start", "sub_end")) == [(0, 1), (3, 3), (4, 4)]


def test_sweep_case(spark):
    cand = spark.createDataFrame([(0.9, True), (0.8, False), (0.3, True)], "score double, is_gold boolean")
    got = {r["threshold"]: r for r in spans.threshold_sweep(cand, 3, [0.05, 0.1, 0.5]).collect()}
    assert got[0.5]["precision"] == 0.5 and got[0.5]["recall"] == pytest.approx(1 / 3) and got[0.5]["f1"] == pytest.approx(0.4)
    assert got[0.05]["f1"] == pytest.approx(2 / 3) and got[0.05]["best"] and not got[0.1]["best"]


def test_functions(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "a", "b"], "2-4", "3", "((NP*")], "a array<string>, b array<string>, s string, t string, l string")
    got = df.select(C.contains_run(F.col("a"), F.col("b")), C.contains_run(F.col("b"), F.col("a")), *C.span_range(F.col("s")), *C.span_range(F.col("t")), C.strip_brackets(F.col("l"))).first()
    assert tuple(got) == (True, False, 1, 4, 2, 3, "NP")


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_long_chain_closes(spark):
    n = 200
    chain = spark.createDataFrame([(1, 0, i, i - 1) for i in range(1, n)], "doc_id int, win_id int, i int, j int")
    nodes = spark.createDataFrame([(1, 0, i) for i in range(n)], "doc_id int, win_id int, i int")
    assert {r["root"] for r in links.close_forest(nodes, chain).collect()} == {0}


def test_pooling(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(5, 3))
    df = spark.createDataFrame([(1, 0, x.tolist()) for x in v], "doc_id int, node_idx int, vec array<double>")
    want = {"mean": v.mean(0), "max": v.max(0), "lse": np.log(np.exp(v).mean(0))}
    for how, w in want.items():
        assert np.allclose(vectors.pool_members(df, how).first()["vec"], w)
    q = np.array([0.3, -1.0, 2.0])
    soft = np.exp(v @ q - (v @ q).max())
    assert np.allclose(vectors.pool_members(df, "attention", query=q).first()["vec"], (soft[:, None] * v).sum(0) / soft.sum())
    assert np.allclose(df.groupBy("doc_id").agg(vectors.lse_pool("vec").alias("v")).first()["v"], want["lse"])


def test_average_overlapping_and_encoders(spark):
    chunks = spark.createDataFrame([(1, 0, [3.0, 0.0]), (1, 0, [1.0, 0.0]), (1, 2, [0.0, 2.0])], "doc_id int, pos int, vec array<double>")
    got = {r["pos"]: r["vec"] for r in vectors.average_overlapping(chunks, spark.createDataFrame([(1, 3)], "doc_id int, n int"), 2).collect()}
    assert got == {0: [1.0, 0.0], 1: [0.0, 0.0], 2: [0.0, 1.0]}
    win = spark.createDataFrame([(1, 10, ["aa", "bb", "cc"], [11])], "doc_id long, chunk_start long, pieces array<string>, used array<long>")
    assert [r["pos"] for r in vectors.encode_windows(win, wanted="used").collect()] == [11]
    assert vectors.tokenize_words(spark.createDataFrame([("abcde",)], "word string"), lambda ws: [len(w) for w in ws]).first()["n_pieces"] == 5


def test_negatives_and_training(spark):
    cand = spark.createDataFrame([(1, 0, k, k, 1.0 - k / 10, k == 9) for k in range(10)] + [(1, 1, 0, 0, 0.5, False)], "doc_id int, win_id int, start int, end int, score double, is_gold boolean")
    assert rows(links.hard_negatives(cand, 3).select("win_id", "start")) == [(0, 0), (0, 1), (0, 2), (0, 9)]
    men = spark.createDataFrame([(1, 0, k, k % 2) for k in range(12)], "doc_id int, win_id int, mention_idx int, cluster_id int")
    every, some = links.training_pairs(men), links.training_pairs(men, ratio=0.5, seed=1)
    assert every.count() == 66 and some.where("is_gold").count() == every.where("is_gold").count() and some.count() < 66


def test_calibration_marks_the_first_best(spark):
    key = partition(spark, [[1, 2, 3, 4], [5, 6]])
    nodes = spark.createDataFrame([(1, k, 0, m, m + 1) for k, ms in enumerate([[1, 2], [3, 4], [5, 6]]) for m in ms], "doc_id int, node_idx int, sent_idx int, start int, end int")
    best = spark.createDataFrame([(1, 1, 0, 0.4), (1, 2, 0, 0.1)], "doc_id int, i int, j int, score double")
    got = {r["offset"]: (round(r["conll"], 4), r["best"]) for r in metrics.calibrate(best, nodes, key, [0.0, 0.2, 0.3, 0.5]).collect()}
    assert got[0.2] == (1.0, True) and got[0.3] == (1.0, False) and got[0.0][0] < 1 and got[0.5][0] < 1


def test_cross_window_pairs_are_salted_alike(spark):
    nodes = spark.createDataFrame([(1, k, k % 3) for k in range(9)], "doc_id int, node_idx int, win_id int")
    assert rows(links.cross_window_pairs(nodes).select("i", "j")) == rows(links.cross_window_pairs(nodes, salt=5).select("i", "j"))


@pytest.mark.parametrize("how", ["mean", "max", "lse", "attention"])
def test_pooling_in_small_parts(spark, how):
    rng = np.random.default_rng(1)
    v, node = rng.normal(size=(300, 4)), np.where(np.arange(300) % 3 == 0, 0, np.arange(300) % 41)
    df = spark.createDataFrame([(1, int(n), x.tolist()) for n, x in zip(node, v)] + [(2, 0, None), (2, 1, [])], "doc_id int, node_idx int, vec array<double>").repartition(7)
    q = [0.5, -1.0, 0.0, 2.0]
    got = {r["node_idx"]: r["vec"] for r in vectors.pool_members(df, how, query=q, held=5).collect()}
    soft = lambda x: np.exp(x @ q) / np.exp(x @ q).sum()
    plain = {"mean": lambda x: x.mean(0), "max": lambda x: x.max(0), "lse": lambda x: np.log(np.exp(x).mean(0)), "attention": lambda x: soft(x) @ x}[how]
    assert set(got) == set(node.tolist())
    assert all(np.allclose(got[n], plain(v[node == n])) for n in got)


def test_running_sums_auc_and_median(spark):
    rng = random.Random(4)
    scored = [(rng.randint(0, 30) / 10, rng.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(scored, "score double, is_gold boolean")
    yes, no = [s for s, g in scored if g], [s for s, g in scored if not g]
    want = sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))
    assert links.separation_auc(df).first()["auc"] == pytest.approx(want)
    sums = {r["score"]: r["n_before"] for r in links.running_before(df.groupBy("score").agg(F.count("*").alias("n")), "score", ["n"], each=4).collect()}
    assert sums == {s: sum(x < s for x, _ in scored) for s, _ in scored}
    pairs = spark.createDataFrame([(1, 0, i, 0, s, True) for i, (s, _) in enumerate(scored, 1)], "doc_id int, win_id int, i int, j int, sim double, is_gold boolean")
    told = spark.createDataFrame([(1, 0, i, "TRUE_LINK" if g else "MISSED_LINK") for i, (_, g) in enumerate(scored, 1)], "doc_id int, win_id int, i int, outcome string")
    got = {r["kind"]: r for r in links.similarity_separation(pairs, told).collect()}
    for kind, values in (("resolved", yes), ("missed", no)):
        assert (got[kind]["n"], got[kind]["median_sim"]) == (len(values), pytest.approx(np.median(values)))
        assert got[kind]["mean_sim"] == pytest.approx(np.mean(values))


def test_spans_meet_overlapping_windows(spark):
    gold = spark.createDataFrame([(1, 0, 2), (1, 299, 300), (1, 511, 512), (1, 600, 900)], "doc_id int, sub_start long, sub_end long")
    windows = spark.createDataFrame([(1, 0, 0, 300), (1, 1, 200, 600), (1, 2, 590, 1000), (1, 3, 5, 5)], "doc_id int, win_id int, chunk_start long, chunk_end long")
    got = spans.spans_in_window(gold, windows).select("win_id", "sub_start", "local_start", "local_end")
    assert rows(got) == [(0, 0, 0, 2), (1, 299, 99, 100), (1, 511, 311, 312), (2, 600, 10, 310)]


def test_caps_count_training_documents_only(spark):
    docs = spark.createDataFrame([(k, "a" if k % 2 else "b", "train" if k < 8 else "test", k) for k in range(10)] + [(10, None, "train", 10)], "doc_id int, corpus string, split string, doc_order int")
    got = mentions.select_subset(docs, caps={"a": 1, "b": 3})
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 4, 8, 9, 10]


def test_window_positions_and_channels(spark):
    rng = np.random.default_rng(3)
    v, at = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    weights = {"w1": rng.normal(size=(11, 4)), "b1": rng.normal(size=4), "w2": rng.normal(size=(4, 3)), "b2": rng.normal(size=3), "w3": rng.normal(size=(3, 1)), "b3": rng.normal(size=1)}
    nodes = spark.createDataFrame([(1, k, k, x.tolist()) for k, x in enumerate(v)], "doc_id int, node_idx int, win_id int, vec array<double>")
    none = spark.createDataFrame([], "doc_id int, i int, j int, idf_jaccard double, containment int, exact_match int")
    got = {(r["i"], r["j"]): r["score"] for r in vectors.score_node_pairs(nodes, none, weights, windows=at).collect()}
    h = v + at[[0, 1, 1, 1]]
    for i in range(4):
        for j in range(i):
            x = np.concatenate([h[i], h[j], h[i] * h[j], abs(h[i] - h[j]), np.zeros(3)])
            for k in (1, 2):
                x = np.maximum(x @ weights[f"w{k}"] + weights[f"b{k}"], 0)
            assert got[i, j] == pytest.approx((x @ weights["w3"] + weights["b3"]).item())
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1.0]), (None, [2.0])], "ctx array<array<double>>, surface array<double>")
    out = vectors.project_channels(df, {"ctx": (np.ones((4, 1)), np.array([0.5])), "surface": (np.array([[1.0, -1.0]]), np.zeros(2))})
    assert [list(r["vec"]) for r in out.collect()] == [[10.5, 1.0, -1.0], [0.5, 2.0, -2.0]]


def test_closing_windows_equals_pointer_jumping(spark):
    rng = random.Random(6)
    nodes, best = [], []
    for win in range(40):
        ids = sorted(rng.sample(range(500), rng.randint(1, 60)))
        nodes += [(1, win, i) for i in ids]
        best += [(1, win, i, rng.choice(ids[:k]) if rng.random() < 0.95 else -1) for k, i in enumerate(ids) if k and rng.random() < 0.7]
    nodes = spark.createDataFrame(nodes, "doc_id long, win_id int, i long").repartition(3)
    best = spark.createDataFrame(best, "doc_id long, win_id int, i long, j long")
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "win_id", "i", "root").collect())
    assert rows(links.close_windows(nodes, best)) == rows(links.close_forest(nodes, best))
    assert rows(links.close_windows(nodes, best.where("false"))) == [(r[0], r[1], r[2], r[2]) for r in sorted(nodes.collect())]
    assert links.close_windows(nodes.where("false"), best.where("false")).count() == 0


def test_nesting_is_counted_without_pairs(spark):
    rng = random.Random(7)
    rows = set()
    for sent in range(30):
        for _ in range(rng.randint(1, 60)):
            a = rng.randrange(30)
            rows.add((1, sent, a, a + rng.randrange(12)))
    df = spark.createDataFrame([*rows, *list(rows)[:9]], "doc_id long, sent_idx int, sub_start long, sub_end long")
    got = {tuple(r)[:4]: r["depth"] for r in spans.nesting_depth(df).collect()}
    assert got == {r: sum(o[:2] == r[:2] and o[2] <= r[2] and r[3] <= o[3] for o in rows) - 1 for r in rows}
    # a sentence of 20,000 spans, each inside all that were before
    deep = spark.range(20_000).selectExpr("1L AS doc_id", "0 AS sent_idx", "id AS sub_start", "60000 - id AS sub_end")
    assert [r["depth"] for r in spans.nesting_depth(deep).orderBy("sub_start").collect()] == list(range(20_000))
    assert spans.nesting_depth(df.where("false")).count() == 0


def test_tiles_of_a_document_score_as_one(spark):
    rng = np.random.default_rng(9)
    weights = {"w1": rng.normal(size=(11, 4)), "b1": rng.normal(size=4), "w2": rng.normal(size=(4, 3)), "b2": rng.normal(size=3), "w3": rng.normal(size=(3, 1)), "b3": rng.normal(size=1)}
    data = [(doc, k, int(w), x.tolist()) for doc, n in ((1, 37), (2, 1), (3, 12)) for k, (w, x) in enumerate(zip(rng.integers(0, 6, n), rng.normal(size=(n, 2)).round(1), strict=True))]
    nodes = spark.createDataFrame(data, "doc_id long, node_idx int, win_id int, vec array<double>")
    pairs = [(1, i, j) for i in range(37) for j in range(i) if rng.random() < 0.3]
    known = spark.createDataFrame([(*p, float(rng.random()), 1, int(rng.integers(0, 2))) for p in pairs], "doc_id long, i int, j int, idf_jaccard double, containment int, exact_match int")
    scored = lambda **more: {(r["doc_id"], r["i"], r["j"]): r["score"] for r in vectors.score_node_pairs(nodes, known, weights, **more).collect()}
    whole = scored()
    win = {(d, k): w for d, k, w, _ in data}
    assert whole.keys() == {(d, i, j) for d, i in win for e, j in win if d == e and j < i and win[d, i] != win[d, j]}
    for tile, step in ((1, 8192), (5, 3), (16, 100)):
        some = scored(tile=tile, step=step)
        assert some.keys() == whole.keys() and all(abs(some[k] - whole[k]) < 1e-12 for k in whole)
    mixed = lambda v: v - v.mean(axis=0)
    assert scored(context=mixed, tile=5) == pytest.approx(scored(context=mixed))
    best = lambda df: {(r["doc_id"], r["i"]): (r["j"], round(r["score"], 9)) for r in links.best_antecedent(df, ("doc_id",)).collect()}
    few = vectors.score_node_pairs(nodes, known, weights, tile=5, best=True)
    assert few.count() < len(whole) and best(few) == best(vectors.score_node_pairs(nodes, known, weights))
    assert vectors.score_node_pairs(nodes.where("false"), known, weights).count() == 0


def test_newton_steps_reach_the_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-x @ [1.0, -2.0, 0.5]))).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y, strict=True)], "features array<double>, label double").repartition(5)
    w = vectors.fit_logistic(rows, 3, ridge=0.1)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (y - p) - 0.1 * w).max() < 1e-8
    assert vectors.fit_logistic(rows.where("false"), 3).tolist() == [0, 0, 0]


def test_packing_streams_long_documents(spark):
    def plain(sents, size):
        out, begin, end = [], None, None
        for o, n in sorted(set(sents)):
            if begin is not None and (n > size or o + n - begin > size):
                out.append((begin, end))
                begin = None
            if n > size:
                out += [(o + k, min(o + k + size, o + n)) for k in range(0, n, size)]
            else:
                begin, end = o if begin is None else begin, o + n
        return out + ([(begin, end)] if begin is not None else [])

    rng = random.Random(11)
    docs = {}
    for name in ("a", "b", "c", "d"):
        at, sents = 0, []
        for _ in range(rng.randint(1, 60)):
            n = rng.choice([1, 3, 9, 25])
            sents.append((at, n))
            at += n + rng.choice([0, 0, 5])
        docs[name] = sents + sents[:2]
    df = spark.createDataFrame([(d, *x) for d, xs in docs.items() for x in xs], "doc_id string, sub_offset int, sub_length long")
    got = rows(mentions.pack_sentences(df, 10))
    assert got == sorted((d, k, *c) for d, xs in docs.items() for k, c in enumerate(plain(xs, 10)))
    assert mentions.pack_sentences(df.where("false"), 10).count() == 0
    long = spark.range(1_000_000).selectExpr("7L AS doc_id", "id * 3 AS sub_offset", "3L AS sub_length")
    last = mentions.pack_sentences(long, 10).agg(F.count("*"), F.max("win_id"), F.max("chunk_end")).first()
    assert tuple(last) == (333_334, 333_333, 3_000_000)


def test_frequent_tokens_are_parted(spark):
    index = spark.createDataFrame([(1, k, k % 3, "the", 50, 0.5) for k in range(40)] + [(1, 2, 2, "x", 1, 2.0), (1, 9, 0, "x", 2, 2.0)], "doc_id long, node_idx int, win_id int, token string, df long, idf double")
    want = sorted([(1, i, j, "the", 0.5) for i in range(40) for j in range(i) if i % 3 != j % 3] + [(1, 9, 2, "x", 2.0)])
    for each in (1000, 7, 1):
        assert rows(lexical.shared_token_pairs(index.where("token = 'the'").unionByName(index.where("token = 'x'").withColumn("df", F.lit(2).cast("long"))), each)) == want


def test_blocks_of_overlapping_clusters():
    rng = random.Random(12)
    for _ in range(50):
        pairs = [(rng.randrange(3), rng.randrange(8), rng.randrange(8)) for _ in range(rng.randint(1, 25))]
        got = metrics.blocks_of(*zip(*pairs, strict=True))
        near = lambda a, b: a[0] == b[0] and (a[1] == b[1] or a[2] == b[2])
        want = list(range(len(pairs)))
        for _ in pairs:
            want = [min(want[m] for m, q in enumerate(pairs) if near(p, q)) for p in pairs]
        assert got == want


def test_alignment_of_a_long_document_is_many_groups(spark):
    # a chain of blocks: key cluster c has mentions 4c to 4c + 3, response clusters cut it in two unequal parts
    key = spark.range(8000).selectExpr("1L AS doc_id", "id div 4 AS cluster_id", "id AS sent_idx", "0 AS start", "1 AS end")
    response = spark.range(8000).selectExpr("1L AS doc_id", "IF(id % 4 = 0, 10000 + id div 4, id div 4) AS cluster_id", "id AS sent_idx", "0 AS start", "1 AS end")
    row = metrics.ceaf_e(key, response).first()
    assert (row["rec_num"], row["rec_den"], row["prec_den"]) == (pytest.approx(2000 * 6 / 7), 2000, 4000)


def test_bio_encode_shuffles_marks_not_positions(spark):
    rows = [(1, 0, 2, 3), (1, 0, 2, 2), (1, 0, 4, 9), (2, 0, 0, 0), (4, 0, 0, 1)]
    found = spark.createDataFrame(rows, "doc_id long, sent_idx int, sub_start long, sub_end long")
    lengths = spark.createDataFrame([(1, 7), (2, 1), (3, 2)], "doc_id long, n long")
    got = spans.bio_encode(found, lengths, 2, ("doc_id",), within=("sent_idx",))
    text = {}
    for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["head"], r["pos"])):
        text[r["doc_id"], r["head"]] = text.get((r["doc_id"], r["head"]), "") + r["label"]
    assert text == {(1, 0): "OOBIBII", (1, 1): "OOBOOOO", (2, 0): "B", (2, 1): "O", (3, 0): "OO", (3, 1): "OO"}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
