"""The training-data pipeline: filter by quality and toxicity, drop near-duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``, further ones included, whatever
their names: rows travel as structs.

Defined results: empty and null texts pass the filters where the models' scores say so, are one group of
near-duplicates, have size 0 in the mix (never taken where a source has words) and pack as a closing token; rows
whose id is null or repeats are documents of their own; an empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankline.llm import mixing, packing, quality, simhash, toxicity
from flankline.llm.shared import dropped, new_path, scratch, table

#: Documents with a lower probability of being good are rejected.
LEAST_QUALITY = 0.5
#: Documents with this toxicity score or a higher one are rejected.
MOST_TOXICITY = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang", "n_chars")
    scores = quality.quality_scores(rows, table(spark, sf_dir, "labels"), ["row"])
    return scores.where(f"quality_score >= {LEAST_QUALITY}").select("row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    scores = toxicity.toxicity_scores(rows, table(spark, sf_dir, "labels"), ["row"])
    return scores.where(f"toxic_score < {MOST_TOXICITY}").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emitted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.public_vocabulary())


STAGES = [
    ("quality classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Models and tokens are beyond SQL; tests compare the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, path = docs, new_path(spark, "stage")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
