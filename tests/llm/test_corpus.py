"""Packing, near-duplicates, toxicity and the pipeline against plain versions and on odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import packing, repeats, simhash, toxicity
from spanloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "<|endoftext|> A<|startoftext|>b", "Ünïcode É́ ΣΑΣ. don't I'LL", "x" * 300, "12,345.67", "a b c\x1cd", "Word. Word, word.. (word)", "日本語 テキスト", "\n\n\t"]


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_ids_equal_the_tokenizer(spark, whole):
    rng = random.Random(1)
    texts = ODD + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [prose(rng, 50).title()]
    for most, stay in ((1_000_000, 300_000), (3, 2), (50, 0)):
        of = packing.token_ids(tokenizer_file(), most, stay)
        for _ in range(2):
            ids, counts = of(pa.array(texts, pa.string()))
            got = np.split(ids, np.cumsum(counts)[:-1])
            assert [list(g) + [2] for g in got] == [whole(t) for t in texts]


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        free, plain = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
            if k is None:
                free.append(100)
                plain.append([])
                k = len(free) - 1
            free[k] -= sizes[i]
            plain[k].append(i)
        assert packing.first_fit_decreasing(sizes, 100) == plain


@pytest.mark.parametrize("group_bytes", [2000, 1 << 24])
def test_packing_covers_each_id_once(spark, whole, group_bytes):
    rng = random.Random(3)
    texts = ODD + [prose(rng, rng.choice([3, 40, 200, 900])) for _ in range(60)] + ["same text"] * 20
    ids = [None if k == 5 else k // 2 if k < 6 else k for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int, ids string")
    room = 256
    got = packing.pack(docs, tokenizer_file(), room=room, group_bytes=group_bytes).collect()
    want = sorted((i if i is not None else -1, tuple(whole(t))) for i, t in zip(ids, texts, strict=True))
    pieces = {}
    for r in got:
        pieces.setdefault((-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(np.frombuffer(r["ids"], "<u4"))))
        assert r["length"] == len(r["ids"]) // 4 and 0 < r["length"] <= room
    assert sum(r["length"] for r in got) == sum(len(w) for _, w in want)
    for i, tokens in want:
        mine = pieces[i, len(tokens)]
        for start, part in mine:
            assert any(w[start : start + len(part)] == part for j, w in want if j == i and len(w) == len(tokens))
        assert sorted(s for s, _ in mine)[0] == 0
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    used = []
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        used.append(at)
    assert max(used) <= room
    padding = sum(0 if u & (u - 1) == 0 else room - u for u in used)
    assert padding <= 0.03 * sum(used)
    assert packing.pack(docs.limit(0), tokenizer_file()).count() == 0


def plain_components(prints, budget):
    n = len(prints)
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for i in range(n):
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= budget)
            low = min(label[j] for j in near)
            for j in near:
                label[j] = min(label[j], low)
        if label == before:
            return label


@pytest.mark.parametrize(("seed", "budget", "largest"), [(0, 4, 20_000), (1, 4, 20), (2, 2, 20_000), (3, 5, 15)])
def test_links_connect_what_brute_force_connects(spark, seed, budget, largest):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64) * np.uint64(2)
    prints = np.concatenate([base, *(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, 12), dtype=np.uint64), axis=0) for _ in range(10)), np.array([0, 1, 3, 2**64 - 1], np.uint64)])
    prints = np.unique(prints)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)] + [(None,)] + [(0,)] * 50, "fp long")
    pairs = simhash.fingerprint_links(df, budget, largest=largest).collect()
    at = {int(x): k for k, x in enumerate(prints.view(np.int64))}
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        assert int(prints[at[a]] ^ prints[at[b]]).bit_count() <= budget
        x, y = find(at[a]), find(at[b])
        label[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(prints))] == plain_components(prints, budget)


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = np.array([simhash.simhash_of((t or "").encode()) for _, t in docs], np.uint64)
    label = plain_components(prints, 4)
    least = {}
    for (i, _), c in zip(docs, label, strict=True):
        least[c] = min(least.get(c, i), i)
    want = {i: (f"{int(p):016x}", least[c]) for (i, _), p, c in zip(docs, prints, label, strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op2_simhash"](spark, SF).collect()}
    assert got == want and len(set(v[1] for v in want.values())) < len(want)


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(3, None, 1), (2, "", 1), (None, " \t", 1), (9, "a b", 1), (8, "A  b", 1), (8, "A  b", 1)], "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    zero = "0" * 16
    assert [g for g in got if g[1] == zero] == [(2, zero, 2), (3, zero, 2), (None, zero, 2)]
    assert {g[2] for g in got if g[1] != zero} == {8} and len(got) == 6
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_trie_gives_every_pair_within_the_budget():
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.concatenate([prints, prints ^ np.uint64(5), prints[:20], np.zeros(30, np.uint64)])
    group = rng.integers(0, 3, len(prints))
    order = np.lexsort((prints, group))
    prints, group = prints[order], group[order]
    bounds = np.searchsorted(group, [0, 1, 2, 3])
    for budget in (0, 2, 27):
        for most in (7, 50_000):
            got = set()
            simhash.trie_pairs(prints, bounds, budget, lambda a, b: got.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)), most=most)
            n = len(prints)
            assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and int(prints[i] ^ prints[j]).bit_count() <= budget}


def test_similar_links_connect_what_all_pairs_connect():
    rng = random.Random(8)
    sets = []
    for _ in range(30):
        base = [rng.getrandbits(64) for _ in range(rng.choice([5, 40, 300]))]
        sets += [set(base), set(base[: int(len(base) * 0.8)]), set(base[: int(len(base) * 0.78)]), set(base[len(base) // 10 :]) | {rng.getrandbits(64)}]
    sets += [set(), set()]
    arrays = [np.array(sorted(x), np.uint64) for x in sets]
    prints = np.array([simhash.simhash_of_set(x) for x in arrays], np.uint64)
    order = np.argsort(prints, kind="stable")
    arrays, prints = [arrays[i] for i in order], prints[order]
    offsets = np.cumsum([0, *map(len, arrays)])
    n = len(arrays)
    label = np.arange(n)
    a, b = simhash.similar_links(prints, np.array([0, n]), label, np.concatenate(arrays), offsets, 0.8, 27)
    like = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    mine = [set(x.tolist()) for x in arrays]
    assert all(like(mine[i], mine[j]) for i, j in zip(a, b, strict=True))
    want = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(i):
                if like(mine[i], mine[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert len({(x, y) for x, y in zip(label.tolist(), want, strict=True)}) == len(set(want)) == len(set(label.tolist()))


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_near_duplicates_go_and_others_stay(spark, tmp_path):
    rng = random.Random(4)
    rows, kept = [], set()
    for g in range(12):
        words = prose(rng, 150).split()
        rows.append((g * 100, " ".join(words)))
        kept.add(g * 100)
        for c in range(1, 6):  # one changed word costs five of about 146 shingles
            edited = list(words)
            for k in rng.sample(range(150), c % 3):
                edited[k] = f"new{g}x{c}"
            rows.append((g * 100 + c, " ".join(edited)))
    rows += [(7, None), (5, ""), (6, "  "), (None, "alone here"), (50_000, "alone here"), (50_000, "alone here")]
    kept |= {5, 50_000}
    spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, node string, a int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(kept)
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_filters_keep_columns_of_any_name(spark):
    names = ["__none", "__doc", "__node", "__number", "__score", "row", "w", "component"]
    rows = [(k, t, *range(len(names))) for k, t in enumerate(["a b c d e f g", "a b c d e f g", "something else that is said here"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in names))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
    clean = toxicity.reject_toxic(docs, toxicity.Model([toxicity.LEXICON], np.array([8.0, -3.0])))
    assert clean.columns == docs.columns and sorted(tuple(r) for r in clean.collect()) == rows


def test_near_duplicates_of_any_edit(spark, tmp_path):
    rng = random.Random(11)
    long = lambda n: [f"word{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, kept = [], set()
    for g in range(60):  # similarity about 0.81
        words = long(200)
        rows += [(g * 10, " ".join(words)), (g * 10 + 1, " ".join(words + long(45))), (g * 10 + 2, " ".join(words[:164]))]
        kept.add(g * 10)
    vocabulary = long(120)
    for g in range(12):  # the same words in other orders, each with one near copy
        words = rng.sample(vocabulary, 120)
        rows += [(1000 + g * 2, " ".join(words)), (1001 + g * 2, " ".join(words[:110]))]
        kept.add(1000 + g * 2)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    # of a cut text and a longer one both are like the first alone
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()} == kept


def test_a_worker_drops_the_tables_of_other_operators():
    body = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], ["doc_id", "text"])
    tokenise = packing._tokenise(tokenizer_file(), 2, 4096, True)
    packing._chunks.cache_clear()
    for _ in range(2):
        list(tokenise(iter([body])))
    assert packing._chunks.cache_info().misses == 1  # the next task of the same operator uses the table
    list(repeats._emit_anchors(200, 80)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["ab" * 300])], ["k", "t", "text"])])))
    assert packing._chunks.cache_info().currsize == 0 and repeats.PrefixHashes._tables
    (out,) = simhash._profiles(5, 20, 3)(iter([body]))
    assert out.num_rows == 1 and not repeats.PrefixHashes._tables


def test_texts_of_many_small_keys_are_compared_in_small_tables(monkeypatch):
    n, seen = 9_000, []
    sets = [np.arange(k // 3 * 10, k // 3 * 10 + 10) for k in range(n)]
    columns = [np.arange(n) // 3, [str(k) for k in range(n)], np.arange(n), np.zeros(n, np.int64)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(sets, pa.list_(pa.int64()))], ["bucket", "node", "component", "fp", "shingles"])
    plain = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda prints, *rest: seen.append(len(prints)) or plain(prints, *rest))
    got = [(a, b) for out in simhash._verify(0.8, 27)(iter([batch])) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
    assert sum(seen) == n and max(seen) <= 3_000
    assert len(got) == n // 3 * 2 and all(int(a) // 3 == int(b) // 3 for a, b in got)


def test_near_duplicates_of_files_split_anew(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(40)]
    rows = [(i, texts[i % 40]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "d"))
    plain = simhash.durable

    def durable(df):
        out = plain(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        return out

    monkeypatch.setattr(simhash, "durable", durable)
    try:
        assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        text = prose(rng, 60) + (" " + " ".join(rng.choice(["zorblatting", "zorblatted", "idiot", "quxfoo"]) for _ in range(3)) if bad else "")
        docs.append((i, text, "x"))
        labels.append((i, int(bad) if i % 37 else 1 - int(bad)))
    docs += [(-1, None, "x"), (-2, "", "x"), (None, "plain words", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, label string")
    la = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, la)
    got = {r["doc_id"]: r["__score"] for r in toxicity.score(d, model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    found = {i for i in range(900) if got[i] >= 0.7}
    planted = set(range(0, 900, 5))
    assert len(found & planted) >= 0.95 * len(planted) and len(found - planted) <= 5, (len(found & planted), len(found - planted))
    assert got[-1] == got[-2] < 0.5
    assert toxicity.reject_toxic(d, model).count() == 903 - len(found)
    assert toxicity.score(d.limit(0), model).count() == 0
    bare = toxicity.train(d, la.limit(0))
    assert toxicity.score(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), bare).where("__score >= 0.7").count() == 1


def test_toxicity_counts_all_words_and_bounds_rows(spark):
    words = " ".join(f"zorb{k:x}" for k in range(70_000)).encode()
    assert toxicity.counter(["zorb*", "=zorb1"])(words).tolist() == [70_000, 1]
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, "zorb zorba" if k % 3 else "fine") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(1, 60)] * 2, "doc_id long, toxic int")
    seen = []
    plain = toxicity.LabelModel.fit
    toxicity.LabelModel.fit = lambda self, votes, given, **kw: (seen.append(votes.shape[0]), plain(self, votes, given, **kw))[1]
    try:
        toxicity.train(docs, labels, most=30, support=1)
    finally:
        toxicity.LabelModel.fit = plain
    assert seen and seen[0] <= 30


def test_toxicity_query_columns(spark):
    import zlib

    rows = QUERIES["op8_toxicity"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == docs
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)


def test_label_model_finds_accuracies_and_shared_votes():
    rng = np.random.default_rng(6)
    y = (rng.random(4000) < 0.3).astype(float)
    votes = np.stack([np.where(y == 1, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.9, 0.05), (0.6, 0.1), (0.5, 0.5))], axis=1)
    votes = np.column_stack([votes, votes[:, 1]])  # a voter twice
    given = np.where(rng.random(4000) < 0.9, y, 1 - y)
    model = toxicity.LabelModel()
    q = model.fit(votes, given)
    assert ((q > 0.5) == y).mean() > 0.95
    assert abs(model.fires[1][0] - 0.9) < 0.05 and abs(model.fires[0][0] - 0.05) < 0.05
    assert model.correlation[1, 3] > 0.9 and model.say[1] < 0.6 and model.say[0] > 0.8


def test_held_out_scores_rank_well(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op8_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    rank = rows["score"].rank()
    pos = rows["toxic"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.85


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "no id", "en", "s", 5)], docs.schema)
    docs.unionByName(odd).withColumn("kept", F.lit(1)).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] <= counts[3]
    assert counts[1] > 0.8 * counts[0]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 1000


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
