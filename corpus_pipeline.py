"""A corpus pipeline over `documents`: quality rules, line dedup, near-dedup, mixing, BPE.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and reread as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, linedup, minhash, mixing, rules
from folioflow.llm.common import drop_rows, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts among them. Rows that are alike stay or go together; an empty table stays empty."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut from all but their first document; a document of which nothing is left goes. n_chars, if there, follows the text.

    Null and empty texts stay as they are; rows that repeat one are cut alike; an empty table stays empty.
    """
    cut = linedup.dedup_lines(docs).filter("n_lines_removed = 0 or n_lines_left > 0")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cut.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays, and rows that repeat it. Null and empty texts stay; an empty table stays empty."""
    found = staged(minhash.near_duplicates(docs).filter("not kept").select("doc_id", "key"), "near-verdict")
    return drop_rows(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and empty texts never, repeated rows each for itself. An empty table stays empty."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to. A null text has no ids; a row gives a row."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Robust distances, seeded choices and merges are not for SQL. tests/llm holds the operators of the stages against brute force, and the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
