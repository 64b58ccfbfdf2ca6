"""Corpus views on the given tables: sentences, tokens, gold and predicted mentions, vectors.

``SQL`` says the same in DuckDB, as common table expressions that build on each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.mentions import word_offsets


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, sent_idx, words``: lines that are not blank, split at single spaces."""
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    out = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("sent_idx", "line"))
    return out.select("doc_id", "sent_idx", F.filter(F.split("line", " "), lambda w: w != "").alias("words"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, sent_idx, tok_idx, word_idx, word, norm, n_pieces, first_piece, prev_word, prev_piece, prev_norm``."""
    offset = word_offsets(sentences(spark, sf_dir))
    rows = offset.select("doc_id", "sent_idx", "word_offset", F.posexplode("words").alias("tok_idx", "word"))
    rows = rows.select("doc_id", "sent_idx", "tok_idx", (F.col("word_offset") + F.col("tok_idx")).cast("long").alias("word_idx"), "word")
    rows = rows.withColumn("norm", F.lower(F.regexp_replace("word", r"[^\p{L}]", ""))).withColumn("n_pieces", F.ceil(F.length("word") / 4).cast("long"))
    by_doc = Window.partitionBy("doc_id").orderBy("word_idx")
    rows = rows.withColumn("first_piece", F.coalesce(F.sum("n_pieces").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = lambda c: F.when(F.col("tok_idx") > 0, F.lag(c).over(by_doc))
    return rows.withColumns({"prev_word": before("word"), "prev_piece": before("first_piece"), "prev_norm": before("norm")})


def _span(rows: DataFrame, wider: Column) -> DataFrame:
    """Mention columns: the token, and the one before where ``wider``."""
    wide = wider & (F.col("tok_idx") > 0)
    return rows.withColumns(
        {
            "start": F.col("tok_idx") - F.when(wide, 1).otherwise(0),
            "end": F.col("tok_idx") + 1,
            "sub_start": F.when(wide, F.col("prev_piece")).otherwise(F.col("first_piece")),
            "sub_end": F.col("first_piece") + F.col("n_pieces") - 1,
            "tokens": F.when(wide, F.array("prev_word", "word")).otherwise(F.array("word")),
        }
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold mentions: long norms that recur in their document; the norm is the entity."""
    long = tokens(spark, sf_dir).where(F.length("norm") >= 6)
    often = long.withColumn("times", F.count("*").over(Window.partitionBy("doc_id", "norm"))).where(F.col("times") >= 2)
    spans = _span(often, F.col("word_idx") % 5 == 0)
    ranked = spans.withColumn("cluster_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("norm")) - 1)
    order = Window.partitionBy("doc_id").orderBy("sub_start", "sub_end", "cluster_id", "word_idx")
    out = ranked.withColumn("mention_idx", F.row_number().over(order) - 1)
    return out.select("doc_id", "mention_idx", "sent_idx", "start", "end", "word_idx", "norm", "sub_start", "sub_end", F.col("sub_start").alias("tok_pos"), "cluster_id", "tokens")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted mentions: long norms, some one token too wide, and some spurious ones."""
    rows = tokens(spark, sf_dir).where((F.length("norm") >= 7) | ((F.length("norm") == 5) & (F.col("word_idx") % 7 == 0)))
    spans = _span(rows, (F.length("norm") >= 7) & (F.col("word_idx") % 3 == 0))
    order = Window.partitionBy("doc_id").orderBy("sub_start", "sub_end", "word_idx")
    return spans.withColumn("pred_idx", F.row_number().over(order) - 1).select("doc_id", "pred_idx", "sent_idx", "start", "end", "word_idx", "norm", "sub_start", "sub_end", "tokens")


def ids_differ(documents: DataFrame) -> bool:
    """Whether every row has a ``doc_id`` of its own, so that what concerns a document can be made inside its row."""
    return documents.groupBy("doc_id").count().where("count > 1").isEmpty()


def entities(norms: Column) -> Column:
    """Of each row's norms those that stand there twice: their place (``at``) and the number of their entity, in Arrow batches; null norms are none."""

    @F.arrow_udf("array<struct<at: int, cluster_id: int>>")
    def marked(listed: pa.Array) -> pa.Array:
        sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.cumsum(sizes)]
        flat = listed.flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        here = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
        coded = flat.take(pa.array(here)).dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        many = max(1, len(place))
        kinds, own, times = np.unique(row[here] * many + place[coded.indices.to_numpy()], return_inverse=True, return_counts=True)
        often = times >= 2
        # numbers run through the batch; a row's first is taken off
        rank = np.cumsum(often) - often
        rank = rank - rank[np.searchsorted(kinds // many, kinds // many)]
        kept = often[own]
        told = pa.StructArray.from_arrays([pa.array((here - starts[row[here]])[kept].astype(np.int32)), pa.array(rank[own][kept].astype(np.int32))], ["at", "cluster_id"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[here][kept], minlength=len(sizes)))].astype(np.int32)), told)

    return marked(norms)


def annotated(texts: DataFrame, key: str) -> DataFrame:
    """``key, doc_id, tokens, mentions``: a row for each row of ``doc_id, text`` with a token.

    ``tokens`` are structs ``sent_idx, tok_idx, n, word`` in order (``n``:
    words of the sentence), ``mentions`` the gold ones, ``cluster_id, sent_idx,
    start, end``.  The texts are dealt out by ``key`` with the places of the
    mentions; nothing else travels, and no token is a row.
    """
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    words = F.transform(lines, lambda line: F.filter(F.split(line, " "), lambda w: w != ""))
    norm = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", ""))
    long = F.transform(words, lambda ws: F.transform(ws, lambda w: F.when(F.length(norm(w)) >= 6, norm(w))))
    # a line that is not blank has a word
    some = texts.where(F.col("text").rlike(r"[^ \n]")).select(key, "doc_id", "text", entities(F.flatten(long)).alias("marks")).repartition(key)
    token = lambda w, t, s, ws: F.struct(s.alias("sent_idx"), t.alias("tok_idx"), F.size(ws).alias("n"), w.alias("word"))
    tokens = F.flatten(F.transform(words, lambda ws, s: F.transform(ws, lambda w, t: token(w, t, s, ws))))

    def mention(m: Column, xs: Column) -> Column:
        x = F.get(xs, m["at"])
        start = x["tok_idx"] - F.when((m["at"] % 5 == 0) & (x["tok_idx"] > 0), 1).otherwise(0)
        return F.struct(m["cluster_id"].alias("cluster_id"), x["sent_idx"].alias("sent_idx"), start.alias("start"), (x["tok_idx"] + 1).alias("end"))

    # as the element of an array the tokens are made once, not at each use
    both = F.transform(F.array(tokens), lambda xs: F.struct(xs.alias("tokens"), F.transform(F.col("marks"), lambda m: mention(m, xs)).alias("mentions")))
    return some.select(key, "doc_id", F.inline_outer(both))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as mentions: fifty a document, the label is the entity."""
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id div 50 doc_id", "cast(vec_id % 50 as int) mention_idx", "cast(7 * (vec_id % 50) as int) tok_pos", "label cluster_id", "embedding vec")


def docmeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, corpus, split, doc_order``."""
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "validation").otherwise("test")
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("corpus"), split.alias("split"), F.col("doc_id").alias("doc_order"))


SQL = {
    "v_sentences": """SELECT doc_id, unnest(generate_series(0, len(l) - 1))::INT AS sent_idx, unnest(l) AS line FROM
        (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') <> '') AS l FROM documents)""",
    "v_words": """SELECT doc_id, sent_idx, list_filter(string_split(line, ' '), lambda w: w <> '') AS words FROM v_sentences""",
    "v_offsets": """SELECT *, COALESCE(SUM(len(words)) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_offset FROM v_words""",
    "v_raw": """SELECT doc_id, sent_idx, word_offset, unnest(generate_series(0, len(words) - 1))::INT AS tok_idx, unnest(words) AS word FROM v_offsets""",
    "v_tokens": """SELECT doc_id, sent_idx, tok_idx, word_idx, word, norm, n_pieces,
        COALESCE(SUM(n_pieces) OVER (PARTITION BY doc_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_piece FROM
        (SELECT doc_id, sent_idx, tok_idx, word_offset + tok_idx AS word_idx, word, lower(regexp_replace(word, '[^\\p{L}]', '', 'g')) AS norm, ceil(length(word) / 4)::BIGINT AS n_pieces FROM v_raw)""",
    "v_prev": """SELECT *, CASE WHEN tok_idx > 0 THEN lag(word) OVER w END AS prev_word, CASE WHEN tok_idx > 0 THEN lag(first_piece) OVER w END AS prev_piece, CASE WHEN tok_idx > 0 THEN lag(norm) OVER w END AS prev_norm
        FROM v_tokens WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)""",
    "v_often": """SELECT *, (word_idx % 5 = 0 AND tok_idx > 0) AS wide FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS times FROM v_prev WHERE length(norm) >= 6) WHERE times >= 2""",
    "v_gold": """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sub_start, sub_end, cluster_id, word_idx) - 1)::INT AS mention_idx, sent_idx, "start", "end", word_idx, norm, sub_start, sub_end, sub_start AS tok_pos, cluster_id, tokens FROM
        (SELECT *, (dense_rank() OVER (PARTITION BY doc_id ORDER BY norm) - 1)::INT AS cluster_id, tok_idx - CASE WHEN wide THEN 1 ELSE 0 END AS "start", tok_idx + 1 AS "end",
         CASE WHEN wide THEN prev_piece ELSE first_piece END AS sub_start, first_piece + n_pieces - 1 AS sub_end, CASE WHEN wide THEN [prev_word, word] ELSE [word] END AS tokens FROM v_often)""",
    "v_pred": """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sub_start, sub_end, word_idx) - 1)::INT AS pred_idx, sent_idx, "start", "end", word_idx, norm, sub_start, sub_end, tokens FROM
        (SELECT *, tok_idx - CASE WHEN wide THEN 1 ELSE 0 END AS "start", tok_idx + 1 AS "end", CASE WHEN wide THEN prev_piece ELSE first_piece END AS sub_start, first_piece + n_pieces - 1 AS sub_end,
         CASE WHEN wide THEN [prev_word, word] ELSE [word] END AS tokens FROM
         (SELECT *, (length(norm) >= 7 AND word_idx % 3 = 0 AND tok_idx > 0) AS wide FROM v_prev WHERE length(norm) >= 7 OR (length(norm) = 5 AND word_idx % 7 = 0)))""",
    "v_vec": """SELECT vec_id // 50 AS doc_id, (vec_id % 50)::INT AS mention_idx, (7 * (vec_id % 50))::INT AS tok_pos, label AS cluster_id, embedding AS vec FROM embeddings""",
    "v_docmeta": """SELECT doc_id, source AS corpus, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split, doc_id AS doc_order FROM documents""",
}
_NEEDS = {
    "v_words": "v_sentences",
    "v_offsets": "v_words",
    "v_raw": "v_offsets",
    "v_tokens": "v_raw",
    "v_prev": "v_tokens",
    "v_often": "v_prev",
    "v_gold": "v_often",
    "v_pred": "v_prev",
}


def with_views(query: str, *names: str, **more: str) -> str:
    """``query`` after common table expressions for the named views, what they need, and ``more`` in order."""
    order: list[str] = []
    for name in names:
        chain = [name]
        while chain[-1] in _NEEDS:
            chain.append(_NEEDS[chain[-1]])
        order += [n for n in reversed(chain) if n not in order]
    parts = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {query}" if parts else query
