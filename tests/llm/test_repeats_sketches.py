"""Byte repeats and sketches against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import repeats, sketches
from tests.llm import brute


def cut(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in enumerate(texts)], "doc_id long, text string, k int, spans string")
    rows = repeats.remove_repeats(docs, **options).collect()
    got = {r["doc_id"]: (len(r["kept"]) + sum(s["length"] for s in r["spans"]), sum(s["length"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in rows}
    assert len(rows) == len(texts)
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "crowd"), [(0, 2000), (1, 2), (2, 3)])
def test_repeats_equal_brute_force(spark, seed, crowd):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéè🙂 ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(15, 120)) for _ in range(6)]
    texts = [None, "", "short", "a" * 1500, "ab" * 400, "a" * 199, "xyz" * 100, shared[0], shared[0]]
    for _ in range(40):
        texts.append(" ".join(rng.choice(shared) if rng.random() < 0.4 else prose(rng.randint(1, 60)) for _ in range(rng.randint(1, 5))))
    base = prose(200)
    texts += [base, base, base[:300] + "Q" + base[300:], base[:150], base[100:320]]
    # one passage in many surroundings
    texts += [prose(3 + k % 5) + shared[1][:150] + prose(3 + k % 7) + shared[2][: 120 + k] for k in range(50)]
    assert cut(spark, texts, crowd=crowd, largest=4 * crowd) == brute.repeats(texts)


def test_repetitive_texts(spark):
    line = "the same line again and again, of some sixty bytes or so\n"
    texts = ["a" * 60_000, "ab" * 30_000, line * 1000, "x" + "a" * 500 + "y" + "a" * 700, line[:30]]
    assert cut(spark, texts) == brute.repeats(texts)


def test_equal_surroundings_of_a_long_text(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(repeats, "_MAX_SLICE", 50_000)
    body = [b"ab" * 100_000, b"q" * 300 + b"ab" * 200]
    data = np.frombuffer(b"".join(body), np.uint8)
    doc, a, p0, p1, ah = repeats.anchors(data, np.cumsum([len(b) for b in body]))
    base = np.array([0, len(body[0])])[doc]
    at = repeats._pack(a - base, a - p0, a - p1)
    tracemalloc.start()
    first = repeats._equal_surroundings(body, doc, ah.view(np.int64), at, 200)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    around = [body[d][x : y + 200] for d, x, y in zip(doc.tolist(), (p0 - base).tolist(), (p1 - base).tolist(), strict=True)]
    seen = {}
    for k, key in enumerate(zip(doc.tolist(), ah.tolist(), (at & 0xFFFF).tolist(), around, strict=True)):
        assert first[k] in seen.setdefault(key, {int(first[k])})
    assert len({int(f) for f in first}) == len(seen)


def test_repeats_do_not_rest_on_hashes():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(6)]
    texts += [texts[0][:220] + texts[1][100:330] + texts[2], texts[3][5:206]]
    rows = []  # all places of all texts in one group, as if every hash collided
    for d, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        _, a, p0, p1, _ = repeats.anchors(data, np.array([len(data)]))
        rows += [(d, at, text.encode()[x : y + 200]) for at, x, y in zip(repeats._pack(a, a - p0, a - p1).tolist(), p0.tolist(), p1.tolist(), strict=True)]
    at = np.array([r[1] for r in rows])
    row, start = repeats.repeated_starts([r[2] for r in rows], np.zeros(len(rows), np.int64), at, np.zeros(len(rows), bool))
    got = {(rows[r][0], s) for r, s in zip(row.tolist(), start.tolist(), strict=True)}
    seen = {}
    for d, text in enumerate(texts):
        for i in range(len(text) - 199):
            seen.setdefault(text[i : i + 200], []).append((d, i))
    assert got == {p for places in seen.values() if len(places) > 1 for p in places}


def test_repeats_in_a_long_document(spark, monkeypatch):
    rng = np.random.default_rng(3)
    part = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    one = part(500)
    monkeypatch.setattr(repeats, "_MAX_SLICE", 4096)
    body = part(5000) + one + part(7000) + one + part(3300)
    import pyarrow as pa

    def emitted():
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([body])], ["k", "t", "text"])
        return [r for b in repeats._emit_anchors(200, 80)(iter([batch])) for r in b.to_pylist()]

    parts = emitted()
    covered = np.zeros(len(body), int)
    for r in parts:
        a, b = repeats._unpack(np.array([r["at"]]))
        covered[a[0] : b[0] + 1] += 1
    assert (covered[: len(body) - 199] == 1).all() and not covered[len(body) - 199 :].any()
    assert cut(spark, [body, None]) == brute.repeats([body, None])


def test_repeats_end_inside_a_character(spark):
    passage = "".join(chr(97 + k * k % 23) for k in range(230))
    texts = [f"one {passage}é first", f"two {passage}è second", f"ß{passage[:210]}", f"ş{passage[:210]}"]
    got = cut(spark, texts)
    assert got == brute.repeats(texts)
    assert got[0][1] == 232 and cut(spark, texts[:2], whole_characters=True)[0][1] == 231


def test_repeats_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).count() == 0


def test_suffix_sort_orders_like_bytes():
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab") for _ in range(600)) + b"ab" * 200
    start = np.array(rng.sample(range(700), 300))
    klass = np.sort(np.array([rng.randint(0, 5) for _ in start]))
    array = np.frombuffer(data, np.uint8)
    order = repeats.sort_suffixes(array, repeats.PrefixHashes(array), start, klass, 200)
    got = [(klass[i], data[start[i] : start[i] + 200]) for i in order]
    assert got == sorted(got)


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_sketches_estimate(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 9))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(n) for n in (0, 1, 4, 5, 6, 100, 900, 2000, 700)] + [None, "", " \n ", "same one", "same one", "é" * 9]
    ids = [3, 1, None, 7, 7, 20, 21, 22, 5, 40, 41, 42, 43, 44, 2]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)] + [(44, "same one", "x")] * 3, "doc_id long, text string, k string")
    rows = sketches.edited_fingerprints(docs).collect()
    assert len(rows) == len(texts) + 3
    plain = sorted({(i, t or "") for i, t in zip(ids, texts, strict=True)}, key=lambda x: (x[0] is not None, x[0] or 0))
    order = {}
    for k, (i, t) in enumerate(plain):
        order[i, t] = k
    for r in rows:
        candidates = [t for i, t in plain if i == r["doc_id"]]
        edits = set()
        for t in candidates:
            nxt = [plain[(order[r["doc_id"], t] + 1) % len(plain)][1]] if r["doc_id"] != 7 and plain[(order[r["doc_id"], t] + 1) % len(plain)][0] != 7 else [x[1] for x in plain if x[0] in (7, 20, 5)]
            edits |= {t[: len(t) - len(t) // 4] + n[: len(t) // 4] for n in nxt}
        assert r["edited"] in edits
        assert r["n_chars"] in {len(t) for t in candidates}
    by = {(r["doc_id"], r["n_chars"]): r for r in rows}
    big = by[22, len(texts[7])]
    frame = spark.createDataFrame([(big["sketch"], big["edited_sketch"])], "a array<bigint>, b array<bigint>")
    a, b = frame.select(sketches.resemblance(F.col("a"), F.col("b")), sketches.distinct_shingles(F.col("a"))).first()
    s, e = shingles(texts[7]), shingles(big["edited"])
    assert abs(a - len(s & e) / len(s | e)) < 0.15 and abs(b - len(s)) < 0.3 * len(s)
    assert by[43, 8]["sketch"] == by[44, 8]["sketch"]
    assert sketches.edited_fingerprints(docs.limit(0)).count() == 0


def test_edited_text_on_documents(spark):
    from spanloom.llm.queries import op4_fingerprints

    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in op4_fingerprints(spark, sf).collect()}
    worst = []
    for k, (i, t) in enumerate(docs):
        n = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        true = lambda a, b: len(a & b) / max(1, len(a | b))
        worst.append(abs(got[i]["near_edited"] - true(shingles(t), shingles(e))))
        worst.append(abs(got[i]["near_next"] - true(shingles(t), shingles(n))))
    assert np.mean(worst) < 0.02 and max(worst) < 0.2


def test_sketches_merge(spark):
    rows = [("a", list(range(0, 300, 3))), ("a", list(range(1, 300, 3))), ("b", [5]), ("c", [])]
    df = spark.createDataFrame(rows, "g string, s array<bigint>")
    got = {r[0]: list(r[1]) for r in sketches.merge_groups(df, "g", "s", 128).collect()}
    assert got == {"a": sorted([*range(0, 300, 3), *range(1, 300, 3)])[:128], "b": [5]}
