"""A corpus for training from the table of documents, in five stages.

Quality rules take out bad lines and documents; of near-duplicates one
document stays; documents that hold benchmark items go; sources are mixed to
target weights (every document is used at least once); what is left is
written as token ids, in blocks that hold the sources by their weights, and
read back.

Every stage takes null ids, texts, languages and sources, empty and very long
texts, repeated rows, empty tables and further columns: null and empty texts
fail the quality rules, of repeated rows one stays after near_duplicates, a
null source is a source of its own, an empty table gives an empty one, and
further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackframe.llm import bm25_decontaminate, line_quality, mixing, similar_shingles, token_planes
from trackframe.llm.queries import tokenizer_path
from trackframe.llm.storage import new_path, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cleaned texts of the documents that the line rules keep."""
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with similar 5-word shingles."""
    return similar_shingles.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return bm25_decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources uses them, at least once and at most about twice."""
    return mixing.mixed(docs, mixing.Mix(repetitions=2.0))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files of token ids, which follow the mixture's blocks and slots."""
    path = new_path(spark, "corpus-ids")
    token_planes.write(mixing.texts_in_order(docs), path, tokenizer_path(), order=("block", "slot"))
    return token_planes.read(spark, path)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Min-hashes, BM25 and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
