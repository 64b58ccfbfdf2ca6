"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.packing import pack

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, tokenizer_file(), end_id=2, room=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words_each=4, budget=4)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.decontaminate import contamination, digest

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digest(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.sketches import as_text, edited_fingerprints, resemblance

    found = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    near = [resemblance(F.col("sketch"), F.col(c)).alias(n) for c, n in (("edited_sketch", "near_edited"), ("next_sketch", "near_next"))]
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), *near)


def op5_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    from spanloom.llm.sharding import shard_rows, size_and_checksum

    rows = size_and_checksum(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    placed = shard_rows(rows, ["doc_id"], shards, seed=5)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.urls import Rule, judge

    rules = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).select("page_id", "host", "path", "rule", "verdict", "unwanted")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.repeats import digest, remove_repeats

    return digest(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=200))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.toxicity import is_training, score, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (~F.coalesce(is_training(F.col("doc_id")), F.lit(True))).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.chat import format_turns, loss_text, read_back, turns_of_rows

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turns = spark.range(2).withColumnRenamed("id", "turn")
    more = turns.select(F.lit(-7).cast("long").alias("conv_id"), "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = format_turns(turns_of_rows(rows.unionByName(more)))
    read = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.licenses import scan_licences

    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.tries import branched, ordered_turns, prefix_trie

    return prefix_trie(*branched(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), block=100, most=6))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.pages import main_text

    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


def repeated_from(text: Column, doc_id: Column) -> Column:
    """The words of ``text``, one space between, where crc32 of the decimal id ends in 0: from word ``a`` on its ``p`` words again and again; other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def again(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = F.floor((n - a) / (F.lit(3) + g % 8)).cast("int") + 1
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise("")

    # a list of one gives the words a name, so they are split once
    words = F.array(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return F.when(h % 10 == 0, F.transform(words, again)[0]).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.runs import digest, periodic_runs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return digest(periodic_runs(docs.withColumn("text", repeated_from(F.col("text"), F.col("doc_id")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_decontamination": op3_decontamination,
    "op4_fingerprints": op4_fingerprints,
    "op5_sharding": op5_sharding,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_chat_format": op9_chat_format,
    "op10_licenses": op10_licenses,
    "op11_trie": op11_trie,
    "op12_main_text": op12_main_text,
    "op13_runs": op13_runs,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESCAPED = r"regexp_replace(replace(coalesce({c}, ''), '\', '\\'), '([<\[])(/?s>|INST\]|/INST\])', '\1\\\2', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM items WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        occ AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, k, n, item FROM occ JOIN win USING (n, g)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY 1),
        found AS (SELECT doc_id, count(DISTINCT item) AS i, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h, 0)::BIGINT AS n_hit, coalesce(i, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
        sum(length('<s>[INST] ') + length({_ESCAPED.format(c="role")}) + length(' [/INST]') + length({_ESCAPED.format(c="text")}) + length('</s>'))::BIGINT AS formatted_chars FROM t GROUP BY 1)
        SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c""",
    "op11_trie": r"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT c, c - c % 100 AS base FROM t),
        crc AS (SELECT c, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
            lambda v, byte: list_reduce([xor(v, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 6 AS h FROM ids),
        known AS (SELECT crc.c, base, h, least(h, coalesce(n, 0)) AS m FROM crc LEFT JOIN (SELECT c AS base, count(*) AS n FROM t GROUP BY 1) USING (base)),
        b AS (SELECT known.c, t.k AS d, r, x FROM known JOIN t ON t.c = known.base AND t.k <= known.m UNION ALL SELECT known.c, m + k - h, r, x FROM known JOIN t USING (c) WHERE k > h),
        p AS (SELECT c, d, length(x) AS chars, md5(string_agg(length(r) || ':' || r || length(x) || ':' || x, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS p FROM b UNION ALL SELECT c, 0, 0, '' FROM known),
        q AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
        n AS (SELECT p, max(up) AS up, min(c) AS conv_id, max(d) AS depth, count(*) AS n_convs, max(chars) AS chars, coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends)), sha256('')) AS ends_sha256 FROM q GROUP BY p),
        k AS (SELECT up AS p, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
        v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
        s AS (SELECT q.p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * v.chars)::BIGINT AS saved_tokens FROM v JOIN q ON q.c = v.conv_id AND q.d <= v.depth GROUP BY 1)
        SELECT v.conv_id, v.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256 FROM v JOIN s USING (p) LEFT JOIN n AS o ON o.p = v.up""",
}
