"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept, and returns a DataFrame. ``run`` writes each stage's rows as Parquet to the
shared folder and reads them back as the next stage's docs, so a lost executor
costs a part of one stage. All stages but the last keep the columns of
``documents``.

1. quality rules: rows that the rules reject go. Labels are looked up in sf_dir.
2. toxicity: rows that score at or above the threshold go.
3. near-duplicates: one document of each SimHash component stays, the one of
   the least doc_id.
4. substring removal: repeated 50-word passages are cut out of later documents;
   documents that lose all their words go.
5. packing: the pieces of the documents in sequences of 1024 tokens.

Rows with a null doc_id pass stages 3 and 4 untouched. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.common import materialised
from lumenframe.llm.fm_dedup import remove_repeated
from lumenframe.llm.packing import pack
from lumenframe.llm.quality_rules import filter_quality
from lumenframe.llm.simhash_vptree import keep_one_each
from lumenframe.llm.tokens import vocabulary_path
from lumenframe.llm.toxicity_gbt import filter_toxic


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs, _labels(spark, sf_dir))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_toxic(docs, _labels(spark, sf_dir))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: Fingerprints, learnt scores and tokens have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
