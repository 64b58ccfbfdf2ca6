"""Reading and writing annotated text."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import mentions
from spanloom.sources import conll, corpora

TEXT = """#begin document (bc/x/0001); part 000
bc/x/0001 0 0 John NNP (TOP(S(NP*) -   -  - Spk1 (PERSON) (ARG0*) (0)
bc/x/0001 0 1 saw  VBD (VP*        see 01 1 Spk1 *        (V*)    -
bc/x/0001 0 2 his  PRP$ (NP*       -   -  - Spk1 *        (ARG1*  (1|(0)
bc/x/0001 0 3 dog  NN  *))))       -   -  - Spk1 *        *)      1)

#end document
#begin document (bc/x/0001); part 001
bc/x/0001 1 0 XX XX (TOP* - - - - * (5
bc/x/0001 1 1 b NN * - - - - * (5)
bc/x/0001 1 2 c NN *) - - - - * 5)|7)

bc/x/0001 1 0 ( ( (TOP* - - - - * (5
bc/x/0001 1 1 b NN * - - - - * (5
bc/x/0001 1 2 c NN * - - - - * 5)
bc/x/0001 1 3 d NN *) - - - - * 5)|(8
#end document
bc/x/0001 2 0 late NN (TOP*) - - - - * -
"""


@pytest.fixture(scope="module")
def tokens(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("conll") / "v4" / "train" / "english"
    folder.mkdir(parents=True)
    (folder / "a.v4_gold_conll").write_text(TEXT)
    (folder / "a.v4_auto_conll").write_text("nothing")
    lines = conll.with_split(conll.read_conll(spark, str(folder.parents[2])))
    assert lines.select("split").distinct().collect()[0][0] == "train"
    return conll.parse_token_lines(conll.token_lines(lines)).cache()


def plain_tokens(text):
    """(document, sentence, place, line) line by line."""
    out, doc, sent, place, fresh = [], 0, -1, 0, True
    for line in text.split("\n"):
        bare = line.strip(" ")
        if bare == "" or bare.startswith("#"):
            fresh = True
            if bare.startswith("#end document"):
                doc, sent = doc + 1, -1
            continue
        if fresh:
            sent, place, fresh = sent + 1, 0, False
        out.append((doc, sent, place, line))
        place += 1
    return out


def test_one_large_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    texts = []
    for d in range(2000):
        body = "\n".join("" if rng.random() < 0.2 else "  # note" if rng.random() < 0.05 else f" d{d} 0 {k} w{k}\tNN" for k in range(rng.randint(0, 30)))
        texts.append(f"#begin document (d{d}); part 000\n{body}\n" + ("  #end document x\n" if rng.random() < 0.9 else ""))
    whole = "stray 0 0 a\n" + "".join(texts) + "last 0 0 z"
    (tmp_path / "a.gold_conll").write_text(whole)
    (tmp_path / "b.gold_conll").write_text(texts[0])
    (tmp_path / "empty.gold_conll").write_text("")
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in old:
            spark.conf.set(c, "32k")
        records = conll.read_conll(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 10 and records.where("block > 0").count() > 1000
        got = sorted((r["doc_no"], r["sent_idx"], r["tok_idx"], r["value"]) for r in conll.token_lines(records).where("file like '%a.gold_conll'").collect())
        assert got == plain_tokens(whole)
        few = conll.token_lines(records).where("file like '%b.gold_conll'").collect()
        assert sorted((r["doc_no"], r["sent_idx"], r["tok_idx"], r["value"]) for r in few) == plain_tokens(texts[0])
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        conll.read_conll(spark, str(tmp_path))


def test_sentences(tokens):
    got = conll.assemble_sentences(tokens).orderBy("doc_no", "sent_idx").collect()
    assert [(r["doc_no"], r["sent_idx"], list(r["word"])) for r in got] == [(0, 0, ["John", "saw", "his", "dog"]), (1, 0, ["XX", "b", "c"]), (1, 1, ["(", "b", "c", "d"]), (2, 0, ["late"])]
    assert list(got[0]["lemma"]) == [None, "see", None, None] and list(got[0]["sense"]) == [None, 1.0, None, None]


def test_labels(tokens):
    ner = conll.bracket_bio(tokens).where("doc_no = 0 and column = 0").orderBy("tok_idx")
    assert [r["label"] for r in ner.collect()] == ["B-PERSON", "O", "O", "O"]
    frames = conll.srl_frames(tokens).collect()
    assert [(r["verb"], list(r["labels"])) for r in frames] == [("saw", ["B-ARG0", "B-V", "B-ARG1", "I-ARG1"])]


def test_brackets(tokens):
    found, rejects = conll.match_coref_brackets(tokens)
    got = sorted((r["doc_no"], r["sent_idx"], r["cluster"], r["start"], r["end"]) for r in found.collect())
    assert got == [(0, 0, 0, 0, 0), (0, 0, 0, 2, 2), (0, 0, 1, 2, 3), (1, 0, 5, 0, 2), (1, 0, 5, 1, 1), (1, 1, 5, 0, 3), (1, 1, 5, 1, 2)]
    assert [(r["cluster"], r["end"]) for r in rejects.collect()] == [(7, 2)]
    clusters = conll.collect_clusters(found).orderBy("doc_no").collect()
    assert [[list(m) for m in c] for c in clusters[0]["clusters"]] == [[[0, 0, 1], [0, 2, 3]], [[0, 2, 4]]]
    assert conll.collect_clusters(found, merge_parts=True).count() == 1


def test_parse(tokens):
    got = {(r["doc_no"], r["sent_idx"]): r["parse"] for r in conll.parse_string(tokens).collect()}
    assert got[0, 0] == "(TOP(S(NP (NNP John) )(VP (VBD saw) (NP (PRP$ his)  (NN dog) ))))"
    assert got[1, 0] is None and got[1, 1].startswith("(TOP (-LRB- -LRB-) ")


def test_write_and_read_back(spark, tmp_path):
    tokens = spark.createDataFrame([("d", 0, k, w) for k, w in enumerate("a b c d e".split())] + [("d", 1, 0, "f")], "doc_id string, sent_idx int, tok_idx int, word string")
    spans = spark.createDataFrame([("d", 0, 0, 0, 5), ("d", 1, 0, 0, 2), ("d", 1, 0, 1, 2), ("d", 2, 0, 4, 5), ("d", 0, 1, 0, 1)], "doc_id string, cluster_id int, sent_idx int, start int, end int")
    conll.write_conll(tokens, spans, str(tmp_path / "out"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0] == "#begin document (d); part 000" and lines[-1] == "#end document"
    assert lines[1].split("\t") == ["d", "0", "0", "a", "(0|(1"] and lines[2].split("\t")[-1] == "(1)|1)" and lines[5].split("\t")[-1] == "(2)|0)"
    found, _ = conll.match_coref_brackets(conll.coref_column(tokens, spans), ("doc_id", "sent_idx"))
    got = sorted((r["cluster"], r["sent_idx"], r["start"], r["end"] + 1) for r in found.collect())
    assert got == sorted((r["cluster_id"], r["sent_idx"], r["start"], r["end"]) for r in spans.collect())


def test_corpora(spark, tmp_path):
    lit = spark.createDataFrame([("a", "train", [["x", "y"]], [[[0, 0, 1], [0, 1, 1]]])], corpora.SCHEMAS["litbank"])
    ud = spark.createDataFrame([("u", "test", [("s1", [("p",), ("q",)])], [[("s1", "1-2"), ("s1", "2")], [("s1", "1"), ("zz", "1")]])], corpora.SCHEMAS["corefud"])
    lit.write.partitionBy("split").parquet(str(tmp_path / "lit"))
    back = corpora.read_corpus(spark, str(tmp_path / "lit"), "litbank")
    both = corpora.union_corpora(corpora.normalize(back, "litbank"), corpora.normalize(ud, "corefud"))
    got = sorted(tuple(r) for r in both.collect())
    assert got == [("corefud", "test", "u", 0, 0, 0, 0, 2), ("corefud", "test", "u", 0, 1, 0, 1, 2), ("litbank", "train", "a", 0, 0, 0, 0, 2), ("litbank", "train", "a", 0, 1, 0, 1, 2)]
    assert [list(r["words"]) for r in corpora.sentences_of(ud, "corefud").collect()] == [["p", "q"]]
    corpora.write_documents(both, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).where("corpus = 'litbank'").count() == 2
    corpora.write_table(both, corpora.variant_path(str(tmp_path / "t"), window=256))
    assert corpora.read_table(spark, str(tmp_path / "t")).where("window = 256").count() == 4
    corpora.write_metrics(both.agg(F.count("*").alias("n")), str(tmp_path / "m"), seed=3)
    corpora.write_metrics(both.agg(F.count("*").alias("n")), str(tmp_path / "m"), seed=4)
    assert not corpora.write_metrics(both.agg(F.count("*").alias("n")), str(tmp_path / "m"), seed=4)
    assert sorted(r["seed"] for r in corpora.read_metrics(spark, str(tmp_path / "m")).collect()) == [3, 4]


def test_a_killed_write_is_resumed_without_doubles(spark, tmp_path):
    store = corpora.Parts(spark, str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError):
        store.read()
    rows = spark.range(100, numPartitions=4).withColumn("x", F.col("id") % 7)
    dies = rows.withColumn("x", F.when(F.col("id") < 60, F.col("x")).otherwise(F.raise_error(F.lit("killed")).cast("long")))
    assert store.write("a", rows)
    with pytest.raises(Exception, match="killed"):
        store.write("b", dies)
    # an attempt that wrote all its rows but not its marker
    rows.write.parquet(str(tmp_path / "p" / "data" / "unmarked"))
    assert sorted(store.done()) == ["a"] and store.read().count() == 100
    again = corpora.Parts(spark, str(tmp_path / "p"))
    assert [again.write(part, rows) for part in ("a", "b", "c")] == [False, True, True]
    assert sorted((r["part"], r["count"]) for r in again.read().groupBy("part").count().collect()) == [("a", 100), ("b", 100), ("c", 100)]
    # two jobs that wrote one part: one counts
    spark.createDataFrame([("c", "unmarked")], "part string, attempt string").write.mode("append").json(str(tmp_path / "p" / "manifest"))
    assert again.read().count() == 300


def test_vector_store_is_read_once_where_it_lies(spark, tmp_path):
    rng = random.Random(1)
    vecs = spark.createDataFrame([(d, p, [float(d), float(p)]) for d in range(20) for p in range(0, 50, 2)], "doc_id long, pos long, vec array<double>")
    name = "vectors_" + tmp_path.name.replace("-", "_")
    corpora.write_vectors(vecs, name, str(tmp_path / "v"), 4)
    rows = [(rng.randrange(22), k, a := rng.randrange(50), a + rng.randrange(4)) for k in range(200)]
    men = spark.createDataFrame([*rows, rows[0]], "doc_id long, mention_idx int, sub_start long, sub_end long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = mentions.gather_endpoints(men, corpora.read_vectors(spark, name), 2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 1 and plan.count("Exchange hashpartitioning") == 1
        at = lambda d, p: [float(d), float(p)] if d < 20 and p < 50 and p % 2 == 0 else [0.0, 0.0]
        got = sorted((r["doc_id"], r["mention_idx"], r["sub_start"], r["sub_end"], list(r["ctx_start"]), list(r["ctx_end"])) for r in out.collect())
        assert got == sorted((d, k, a, b, at(d, a), at(d, b)) for d, k, a, b in [*rows, rows[0]])
        few = corpora.read_vectors(spark, name, [3])
        assert few.count() == 25 and few.select(F.input_file_name()).distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_document_text_has_the_rendered_lines(spark):
    words = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "c"), (1, 1, 0, "d"), (2, 0, 0, "e")]
    found = [(1, 3, 0, 0, 3), (1, 12, 0, 0, 2), (1, 4, 0, 1, 2), (1, 5, 0, 1, 2), (1, 3, 0, 1, 3), (1, 6, 1, 0, 1)]
    tokens = spark.createDataFrame(words, "doc_id long, sent_idx int, tok_idx int, word string")
    spans = spark.createDataFrame(found, "doc_id long, cluster_id int, sent_idx int, start int, end int")
    lines = conll.render_conll(tokens, spans).collect()
    want = {d: "\n".join(r["value"] for r in sorted((r for r in lines if r["doc_id"] == d), key=lambda r: (r["sent_idx"], r["tok_idx"]))) for d in (1, 2)}
    kind = "array<struct<cluster_id:int,sent_idx:int,start:int,end:int>>"
    nested = spark.createDataFrame([(d, [w[1:] for w in words if w[0] == d], [m[1:] for m in found if m[0] == d]) for d in (1, 2)], f"doc_id long, tokens array<struct<sent_idx:int,tok_idx:int,word:string>>, mentions {kind}")
    got = nested.select("doc_id", conll.document_text(F.col("doc_id"), F.col("tokens"), F.col("mentions")).alias("value"))
    assert {r["doc_id"]: r["value"] for r in got.collect()} == want


@pytest.mark.parametrize("name", ["conll_tokens", "conll_sentences", "conll_parses", "conll_frames", "conll_clusters"])
def test_texts_are_shuffled_once(spark, name):
    from spanloom.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_text_of_repeated_documents(spark, tmp_path):
    import duckdb

    from spanloom.plans import catalog

    rows = [(0, "Mention one mention\n two"), (0, "Mention one mention\n two"), (1, None), (2, " \n"), (3, "ab  cd\tef\n\nlonger longer")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(rows[1:], "doc_id long, text string").write.parquet(str(tmp_path / "once" / "documents.parquet"))
    for folder in (tmp_path, tmp_path / "once"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        got = [tuple(r) for r in catalog.QUERIES["conll_tokens"](spark, str(folder)).select("doc_no", "document", "word").collect()]
        want = con.execute(f"SELECT doc_no, document, word FROM ({catalog.ORACLE_SQL['conll_tokens']})").fetchall()
        assert sorted(got) == sorted(want)


def test_files_are_written_without_lines_of_tokens(spark, tmp_path, monkeypatch):
    from spanloom.plans import catalog

    monkeypatch.setattr(catalog, "shared_folder", lambda spark: str(tmp_path))
    assert catalog.QUERIES["conll_files_read_back"](spark, "/root/testdata/sf0.001").count() > 0
    files = [f for f in tmp_path.rglob("part-*") if f.is_file()]
    plain = sum(r["n"] for r in conll.read_conll(spark, str(tmp_path), "part-*").select(F.octet_length("value").alias("n")).collect())
    assert files and sum(f.stat().st_size for f in files) < plain / 4
