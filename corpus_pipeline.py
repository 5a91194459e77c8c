"""A corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm import decontaminate, jaccard_join, langid, mixing, sharding
from packetloom.llm._store import Workspace

#: Near copies share 80 % of their 5-word shingles; op9_ngram_jaccard_join alone takes the operator's 4 words and 85 %.
WORDS, PERCENT = 5, 80
PLACE = "__pl_place"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without any letter, or without text, go. Without labels to learn from, those with letters stay."""
    model = langid.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    named = langid.identify(docs, model)
    return named.filter(F.col("lang_pred") != langid.UND).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs, WORDS, PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source has an equal share of the bytes, in random order."""
    return mixing.mix(docs).select(docs.columns)


def sharding_by_hash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard. The copies that mixing made are dealt apart: by doc_id and the row's place in the stage's table."""
    if docs.inputFiles():
        part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1)
        place = F.concat_ws(":", F.col("doc_id").cast("string"), part, F.col("_metadata.row_index").cast("string"))
    else:
        place = F.col("doc_id").cast("string")
    return sharding.shard(docs.withColumn(PLACE, place), key=PLACE).drop(PLACE)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("sharding", sharding_by_hash),
]

#: SQL has no suffix automata or fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            ws.drop(f"stage-{i - 1}")
    return docs
