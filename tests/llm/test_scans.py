"""Decontamination, sharding, url rules, chat formatting and licence scans against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, licenses, sharding, urls
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def small_docs(spark, texts, ids=None):
    data = [(i if ids is None else ids[i], t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, items string, n_words int")


def test_contamination_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    got = rows(decontaminate.digest(decontaminate.contamination(docs, bench)))
    want = sorted(brute.contaminated(docs.collect(), bench.collect()), key=str)
    assert got == want
    assert any(r[5] for r in got) and not all(r[5] for r in got)
    many = rows(decontaminate.digest(decontaminate.contamination(docs, bench, block_bytes=1500, shard_bytes=20_000)))
    assert many == want


@pytest.mark.parametrize("seed", range(3))
def test_contamination_on_few_words(spark, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("a b c Ü".split()) for _ in range(n))
    texts = [text(rng.randint(0, 60)) for _ in range(30)] + [None, "", "a-b_C", "a " * 500]
    bench = [(1, text(12)), (2, text(3)), (3, None), (4, ""), (5, text(10)), (5, text(11)), (None, text(4)), (7, "a " * 12)]
    got = rows(decontaminate.digest(decontaminate.contamination(small_docs(spark, texts), spark.createDataFrame(bench, "item_id long, text string"))))
    assert got == sorted(brute.contaminated(list(enumerate(texts)), [b for b in bench if b[0] is not None]), key=str)


def test_longest_matches_equal_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c".split()) for _ in range(n))
    shared = "s1 s2 s3 s4 s5 s6 s7 s8 s9 s10"
    items = ["aa bb cc " + shared + " tail1", shared + " tailb tailc taild", "a " * 12, text(11), text(14), text(3)]
    docs = ["zz " + shared + " tailb tailc taild", "bb cc " + shared + " x " + shared + " tail1", "b " + "a " * 30, *(text(60) for _ in range(12)), text(400)]
    bench = spark.createDataFrame([(str(k), t) for k, t in enumerate(items)], "item_id string, text string")
    rows_of = decontaminate.contamination(small_docs(spark, docs), bench, shard_bytes=500).collect()
    got = {(r["doc_id"], m["item"]): (m["item_start"], m["start"], m["length"]) for r in rows_of for m in r["matches"]}
    want = {(d, str(k)): m for d, t in enumerate(docs) for k, item in enumerate(items) if (m := brute.longest_match(t, item))}
    assert got == want and got[0, "1"] == (0, 1, 13)
    shard = [brute.words(t) for t in docs]
    block = decontaminate.build_block([(str(k), t) for k, t in enumerate(items)], 10)
    few, many = (decontaminate._search(block, shard, most) for most in (3, 10**6))
    assert all((a == b).all() for x, y in zip(few, many, strict=True) for a, b in zip(x, y, strict=True))


def test_longest_matches_in_periodic_and_frequent_text():
    rng = random.Random(7)
    for _ in range(60):
        letters = rng.choice(["a", "a b", "a b c"]).split()
        text = lambda n: " ".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        part = text(12)
        items = [text(rng.randint(1, 30)) for _ in range(4)] + [f"{part} x {part} y {part}", f"{part} y {text(5)}"]
        docs = [text(rng.randint(0, 60)) for _ in range(4)] + [f"{part} y {part} x {part} {text(9)}", "", f"q {part} z {part}"]
        block = decontaminate.build_block([(str(k), t) for k, t in enumerate(items)], 10)
        for most in (3, 10**6):
            _, found = decontaminate._search(block, [brute.words(t) for t in docs], most)
            got = {(d, block.items[i]): (a, b, n) for d, i, a, b, n in zip(*(c.tolist() for c in found), strict=True)}
            assert got == {(d, str(k)): m for d, t in enumerate(docs) for k, item in enumerate(items) if (m := brute.longest_match(t, item))}


def test_one_word_again_and_again_on_both_sides():
    import time

    words = [b"a"] * 20_000
    block = decontaminate.build_block([("1", "a " * 20_000), ("2", "a " * 5000 + "b")], 10)
    began = time.time()
    spans, found = decontaminate._search(block, [words, [b"c", *words[:8000], b"b"]])
    assert time.time() - began < 20
    assert [tuple(int(c[k]) for c in found) for k in range(4)] == [(0, 0, 0, 0, 20_000), (0, 1, 0, 0, 5000), (1, 0, 0, 1, 8000), (1, 1, 0, 3001, 5001)]
    assert len(spans[0]) == 20_000 - 9 + 8000 - 9 + 1


def test_hash_collisions_are_found_out(monkeypatch):
    rng = random.Random(3)
    items, docs = [[" ".join(rng.choice("abc") for _ in range(n)) for n in sizes] for sizes in ((30, 25, 12), (60, 50, 0, 40))]
    block = decontaminate.build_block([(str(k), t) for k, t in enumerate(items)], 10)
    monkeypatch.setattr(decontaminate, "common_words", lambda one, a, two, b: np.minimum(one.left[a], two.left[b]))  # all agree
    _, found = decontaminate._search(block, [brute.words(t) for t in docs])
    got = {(d, block.items[i]): n for d, i, _, _, n in zip(*(c.tolist() for c in found), strict=True)}
    assert got == {(d, str(k)): m[2] for d, t in enumerate(docs) for k, item in enumerate(items) if (m := brute.longest_match(t, item))}


def test_a_test_set_beyond_the_bound_is_an_error(spark):
    docs = small_docs(spark, ["one two three"])
    bench = spark.createDataFrame([(1, "two three " * 20)], "item_id long, text string")
    with pytest.raises(ValueError, match="most_bytes"):
        decontaminate.contamination(docs, bench, most_bytes=100)


def test_contamination_keeps_columns_and_empty_tables(spark):
    docs = small_docs(spark, ["one two three", None])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_contaminated(docs.select("doc_id", "text"), none).count() == 2
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    kept = decontaminate.remove_contaminated(docs.select("doc_id", "text"), bench)
    assert [tuple(r) for r in kept.collect()] == [(1, None)]
    assert decontaminate.contamination(docs.limit(0).select("doc_id", "text"), bench).count() == 0


def test_permutation_is_a_bijection_and_inverts():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        at = np.arange(n)
        out = sharding.permute(at, n, 9)
        assert sorted(out.tolist()) == at.tolist()
        assert (sharding.permute(out, n, 9, inverse=True) == at).all()
    assert (sharding.permute(np.arange(1000), 1000, 1) != sharding.permute(np.arange(1000), 1000, 2)).mean() > 0.9


def test_shards_are_even_gapless_and_reproducible(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sized = sharding.size_and_checksum(docs.union(docs.limit(30)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))))
    a = sharding.shard_rows(sized, ["doc_id"], 7, seed=5).collect()
    b = sharding.shard_rows(sized.repartition(3), ["doc_id"], 7, seed=5).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    by = {}
    for r in a:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 7
    assert sharding.shard_rows(sized.limit(0), ["doc_id"], 7).count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text_crc32"] == brute.crc(texts[r["doc_id"]]) and r["size"] == len((texts[r["doc_id"]]).encode()) + 16 for r in a if r["doc_id"] is not None)


def test_rules_longest_wins(spark):
    rules = [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]
    data = [
        (1, "http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "https://a.net", "a.net", "", None, "allow"),
        (3, "https://b.a.net/?q=/en/", "b.a.net", "/", "net/", "block"),
        (4, "x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        (5, "x://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme/net/", "", "", None, "allow"),
        (8, "http://p.org/fr/x://y", "p.org", "/fr/x://y", "org/fr/", "allow"),
        (9, "http://cheapcasinopills.example.org/a", "cheapcasinopills.example.org", "/a", None, "block"),
        (10, "http://cheap-casino.example.org/a", "cheap-casino.example.org", "/a", None, "block"),
    ] + [(100 + k, f"http://good{w}.example.org/en/{k}", f"good{w}.example.org", f"/en/{k}", None, "allow") for k, w in enumerate(["garden", "house", "river", "stone"] * 5)]
    pages = spark.createDataFrame([(i, u) for i, u, *_ in data], "page_id long, url string").withColumn("host", F.lit(3)).withColumn("words", F.lit("z"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert got == {i: tuple(rest) for i, _, *rest in data}
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_rare_words_are_joined(spark):
    rng = random.Random(6)
    names = ["garden", "river", "stone", "market", "casino", "pills", "lantern"]
    pages = spark.createDataFrame([(k, f"http://www.{rng.choice(names)}{rng.choice(['', '-'])}{rng.choice(names)}{k % 9}.example.org/{rng.choice(names)}/x{k % 50}") for k in range(200)] + [(0, None)], "page_id long, url string")
    rules = [urls.Rule("block", "river.net")]
    whole, few = (sorted(map(str, urls.judge(pages, rules, **o).withColumn("unwanted", F.round("unwanted", 9)).collect())) for o in ({}, {"words": 5, "odds": 3}))
    assert whole == few and len(whole) == 201


def test_odds_equal_brute_force(spark):
    import math

    data = [["h:casino", "h:win", "p:en"], ["h:garden", "p:en", "p:en"], ["h:win", "p:de"], []]
    worded = spark.createDataFrame([(str(k), "", w) for k, w in enumerate(data)], "host string, path string, words array<string>")
    odds, prior = urls.train(worded)
    got = {r["host"]: r["unwanted"] for r in urls.with_odds(worded, odds, prior).collect()}
    bad, good = data[0], data[1] + data[2]
    size = len({*bad, *good})
    for k, ws in enumerate(data):
        z = math.log(2 / 4) + sum(math.log((bad.count(w) + 1) / (len(bad) + size)) - math.log((good.count(w) + 1) / (len(good) + size)) for w in ws)
        assert abs(got[str(k)] - (1 / (1 + math.exp(-z)) if ws else 0.0)) < 1e-12


def test_segmentation_is_the_likeliest_split():
    import math

    rng = random.Random(7)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
    total = sum(counts.values())

    def cost(word):
        return math.log(counts[word] / total) if word in counts else math.log(10 / total) - len(word) * math.log(10)

    for _ in range(50):
        run = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        splits = ([run[i:j] for i, j in zip((0, *cuts), (*cuts, len(run)), strict=True)] for n in range(len(run)) for cuts in __import__("itertools").combinations(range(1, len(run)), n))
        best = max(sum(map(cost, s)) for s in splits)
        assert abs(sum(map(cost, urls.segmenter(counts)(run))) - best) < 1e-9


def test_segmentation_splits_names():
    split = urls.segmenter({"cheap": 50, "pills": 30, "the": 100, "free": 30, "bets": 20})
    assert split("cheappills") == ["cheap", "pills"] and split("thefreebets") == ["the", "free", "bets"] and split("") == []
    assert "".join(split("x" * 100)) == "x" * 100


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "[\\INST]", "", None, "<<s>>[[INST]]", "a\nb", " [/INST]", "é漢🙂</s>", "[/INST]\\[/INST]"]
    data = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)] + [(2, None, None, "x"), (2, 0, "</s>", "y"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    formatted = chat.format_turns(chat.turns_of_rows(df))
    got = {r["conv_id"]: r for r in formatted.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in (1, 2, 3):
        want = [(r or "", t or "") for c, n, r, t in sorted((d for d in data if d[0] == conv), key=lambda d: (d[1] is not None, d[1] or 0))]
        assert [(t["role"], t["text"]) for t in got[conv]["back"]] == want
        assert got[conv]["loss"] == "".join(t for r, t in want if r == "assistant")
    assert chat.format_turns(chat.turns_of_rows(df.limit(0))).count() == 0


def test_chat_row_layouts(spark):
    plain = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    renamed = plain.withColumnsRenamed({"role": "speaker", "text": "content"})
    both = plain.withColumn("content", F.lit(7)).withColumn("speaker", F.array(F.lit(1)))
    for df in (plain, renamed, both):
        assert [tuple(t) for t in chat.turns_of_rows(df).first()["turns"]] == [("user", "a"), ("assistant", "b")]
    with pytest.raises(ValueError, match="no layout"):
        chat.turns_of_rows(plain.drop("text"))


def test_chat_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"ho"}]}', "messages", [("user", "hi"), ("assistant", "ho")]),
        (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":null}]}', "conversations", [("user", "hi"), ("assistant", "")]),
        (3, '{"output":"c","instruction":"a","input":""}', "instruction_input", [("user", "a"), ("assistant", "c")]),
        (4, '{"prompt":"a","completion":"b"}', "prompt_completion", [("user", "a"), ("assistant", "b")]),
        (5, '{"prompt":"a","response":"b","system":"s"}', "prompt_response", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        (6, '{"other":1}', None, []),
        (7, "not json", None, []),
        (8, None, None, []),
        (9, "", None, []),
    ]
    df = spark.createDataFrame([(i, j) for i, j, *_ in records], "record_id long, record string")
    got = {r[0]: (r[1], [tuple(t) for t in r[2]]) for r in chat.turns_of_records(df).collect()}
    assert got == {i: (name, turns) for i, _, name, turns in records}


def test_formatting_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "x", "y", 5, [("user", "a"), ("assistant", "b")])], "conv_id long, shaped string, formatted string, made int, turns array<struct<role:string,text:string>>")
    got = chat.format_turns(rows).collect()[0].asDict(recursive=True)
    assert (got["conv_id"], got["shaped"], got["made"]) == (1, "x", 5)
    assert got["formatted"] == "<s>[INST] user [/INST]a</s><s>[INST] assistant [/INST]b</s>" and len(got["loss_spans"]) == 1


def test_licences_of_several_notices(spark):
    notices = [" ".join(t) for t in ((licenses.TEMPLATES[6][1], licenses.TEMPLATES[7][1], "licensed under cc by sa 4 0"), tuple(t[1] for t in licenses.TEMPLATES))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*notices, *["plain words"] * 30, *[licenses.TEMPLATES[11][1]] * 60])], "doc_id long, text string")
    got = {r["doc_id"]: {f["label"] for f in r["found"]} for r in licenses.scan_licences(docs).collect()}
    assert got[0] == {"mit-text", "bsd", "cc-by-sa-4.0"}
    assert got[1] == {t[0] for t in licenses.TEMPLATES}


def test_template_labels_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()}) + ["foo", "bar"]
    texts = []
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(0, 6)):
            body = rng.choice(licenses.TEMPLATES)[1].split()
            cut = body[rng.randint(0, 4) : len(body) - rng.randint(0, 4)]
            if rng.random() < 0.5 and cut:
                cut[rng.randrange(len(cut))] = rng.choice(vocabulary)
            parts += [*cut, *rng.choices(vocabulary, k=rng.randint(0, 5))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: sorted(tuple(f) for f in r["found"]) for r in licenses.scan_licences(docs).collect()}
    assert got == {k: brute.notices(t, licenses.TEMPLATES) for k, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 100
    # any weights give the same places: they order the work
    index = licenses.build_index()
    for _ in range(3):
        lookup = licenses.by_rarity(index, {w: rng.random() for w in index.postings})
        assert all(sorted(licenses.match(brute.words(t), lookup)) == got[k] for k, t in enumerate(texts))


def test_licences_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = small_docs(spark, [None, "", "CC  by, cc-by MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "gnu " * 50], ids=[-1, -2, -3, -4, -5]).select("doc_id", "text")
    both = docs.select("doc_id", "text").union(extra)
    texts = {r[0]: r[1] for r in both.collect()}
    got = {r["doc_id"]: r for r in licenses.scan_licences(both).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licences(t)
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[-4]["labels"] == "mit-text" and got[-4]["n_base"] == 0
    assert licenses.scan_licences(docs.limit(0)).count() == 0


def test_chat_query_digest(spark):
    from spanloom.llm.queries import op9_chat_format

    got = {r["conv_id"]: r for r in op9_chat_format(spark, SF).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(said)
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    convs = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs.setdefault(r["conv_id"], []).append(r)
    for c, turns in convs.items():
        turns.sort(key=lambda r: r["turn"])
        spoken = "".join(f"{r['role']}\n{r['text'] or ''}\n" for r in turns)
        loss = "".join(r["text"] or "" for r in turns if r["role"] == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("name", ["op3_decontamination", "op9_chat_format"])
def test_query_equals_sql(spark, name):
    import duckdb

    from spanloom.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))
