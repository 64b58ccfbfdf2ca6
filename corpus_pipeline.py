"""The corpus pipeline: whole documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.decontaminate import remove_contaminated
from spanloom.llm.packing import pack
from spanloom.llm.queries import tokenizer_file
from spanloom.llm.repeats import without_repeats
from spanloom.llm.simhash import drop_near_duplicates
from spanloom.llm.toxicity import reject_toxic, train
from spanloom.operators.components import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go."""
    return reject_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, similarity=0.8, words_each=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again are cut out of the texts."""
    return without_repeats(docs, size=200)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return pack(docs, tokenizer_file(), end_id=2, room=4096)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeats), ("benchmark_decontamination", decontamination), ("packing", packing)]

#: Training, fingerprints and tokenising cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them lies in the folder that the cluster shares."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
