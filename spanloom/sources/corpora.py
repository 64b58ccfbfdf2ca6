"""Saved corpora, mention tables, vectors and metrics; schemas are fixed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.mentions import from_clusters, from_span_strings

_WORDS = "array<array<string>>"
_CLUSTERS = "array<array<array<int>>>"
#: Schema of each kind of corpus.
SCHEMAS = {
    "conll2012": f"doc_id string, split string, sentences {_WORDS}, mention_clusters {_CLUSTERS}",
    "litbank": f"doc_name string, split string, sentences {_WORDS}, coref_chains {_CLUSTERS}",
    "preco": f"id string, split string, sentences {_WORDS}, mention_clusters {_CLUSTERS}",
    "corefud": "doc_id string, split string, sentences array<struct<sent_id:string,tokens:array<struct<form:string>>>>, coref_entities array<array<struct<sent_id:string,span:string>>>",
}


def read_corpus(spark: SparkSession, path: str, kind: str, form: str = "parquet") -> DataFrame:
    """A saved corpus of a known ``kind``: Parquet (splits may be partitions) or JSON lines of the same schema."""
    return spark.read.schema(SCHEMAS[kind]).format(form).load(path)


def normalize(corpus: DataFrame, kind: str) -> DataFrame:
    """``corpus, split, doc_id, cluster_id, pos, sent_idx, start, end``: mentions of any kind, ends exclusive."""
    name = {"litbank": "doc_name", "preco": "id"}.get(kind, "doc_id")
    docs = corpus.withColumnRenamed(name, "doc_id") if name != "doc_id" else corpus
    if kind == "corefud":
        found = from_span_strings(docs, "sentences", "coref_entities")
    else:
        found = from_clusters(docs, "coref_chains" if kind == "litbank" else "mention_clusters", inclusive=kind == "litbank")
    return found.join(docs.select("doc_id", "split"), "doc_id").select(F.lit(kind).alias("corpus"), "split", "doc_id", "cluster_id", "pos", "sent_idx", "start", "end")


def sentences_of(corpus: DataFrame, kind: str) -> DataFrame:
    """``doc_id, sent_idx, words`` of a corpus of any kind."""
    name = {"litbank": "doc_name", "preco": "id"}.get(kind, "doc_id")
    rows = corpus.select(F.col(name).alias("doc_id"), F.posexplode("sentences").alias("sent_idx", "s"))
    return rows.select("doc_id", "sent_idx", (F.transform("s.tokens", lambda t: t["form"]) if kind == "corefud" else F.col("s")).alias("words"))


def union_corpora(*parts: DataFrame) -> DataFrame:
    """One mention table of several."""
    return reduce(DataFrame.unionByName, parts)


def variant_path(base: str, *, window: int, subset: str = "all", channel: str = "both", aligned: bool = True) -> str:
    """Where results of one configuration lie: partitions, so that variants never meet and are read together."""
    return f"{base}/window={window}/subset={subset}/channel={channel}/aligned={str(aligned).lower()}"


def write_documents(df: DataFrame, path: str, mode: str = "error") -> None:
    """Records as Parquet, parted by ``corpus`` and ``split``."""
    df.write.mode(mode).partitionBy("corpus", "split").parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """A mention or vector table as Parquet, a document's rows together and in order so that later joins by document read little."""
    order = [c for c in ("doc_id", "mention_idx", "pos") if c in df.columns]
    df.repartition("doc_id").sortWithinPartitions(*order).write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_vectors(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """A table ``name`` of vectors (``doc_id, pos, vec``) at ``path``: one sorted file for each bucket of documents.

    ``buckets``: so many tasks a later join has; a document lies in one bucket.
    """
    dealt = df.repartition(buckets, "doc_id").sortWithinPartitions("doc_id", "pos")
    dealt.write.bucketBy(buckets, "doc_id").sortBy("doc_id", "pos").option("path", path).saveAsTable(name)


def read_vectors(spark: SparkSession, name: str, doc_ids: Sequence[object] | None = None) -> DataFrame:
    """The vectors of a store, or those of some documents, for which only their buckets are read.

    Lets this session's joins by document and more columns use buckets of
    documents as they are, so that the store is not shuffled.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = spark.table(name)
    return table if doc_ids is None else table.where(F.col("doc_id").isin(list(doc_ids)))


class Parts:
    """Results written part by part, each with a marker that is written last.

    A part lies in a folder of its attempt; the manifest names the attempt that
    counts.  What a job that died half-way has left has no marker: it is not
    read, and the part is written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self) -> dict[str, str]:
        """The committed parts, a few each, with the attempt that counts: the first by name, should two jobs have written one."""
        try:
            rows = self.spark.read.schema("part string, attempt string").json(f"{self.path}/manifest").groupBy("part").agg(F.min("attempt").alias("attempt")).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r["part"]: r["attempt"] for r in rows}

    def write(self, part: str, df: DataFrame) -> bool:
        """Write a part unless it is committed; whether it was written."""
        if part in self.done():
            return False
        attempt = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{attempt}")
        self.spark.createDataFrame([(part, attempt)], "part string, attempt string").coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return True

    def read(self) -> DataFrame:
        """The rows of all committed parts, with ``part``."""
        done = sorted(self.done().items())
        if not done:
            raise FileNotFoundError(f"no part below {self.path} is committed")
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/data/{attempt}").withColumn("part", F.lit(part)) for part, attempt in done))


def write_metrics(df: DataFrame, path: str, **setting: object) -> bool:
    """Metrics with the ``setting`` they belong to, once for each setting; whether they were written."""
    part = json.dumps(setting, sort_keys=True, default=str)
    return Parts(df.sparkSession, path).write(part, df.withColumns({k: F.lit(v) for k, v in setting.items()}))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All metrics written below ``path``."""
    return Parts(spark, path).read().drop("part")
