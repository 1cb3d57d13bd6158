"""One query for each operator of this folder, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.llm import arc_to_warc, bm25_decontaminate, chat_snapshots, line_quality, mixing, reversed_search, secret_index, simhash_planes, substring_dedup, token_alignment, token_planes, toxic_ngrams, url_templates
from trackframe.llm.storage import new_path


def tokenizer_path() -> str:
    """The vocabulary file of the query on token ids."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arc_to_warc.through_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.figures(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_templates.judge(pages, url_templates.document_labels(pages, labels))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.order(mixing.blocks(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_index.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s.kind.isin(*secret_index.BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in secret_index.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_decontaminate.leaks(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ).drop("row")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_planes.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", simhash_planes.hex16("fingerprint").alias("fingerprint"), "component_id")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    token_planes.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path())
    return token_planes.read(spark, path)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxic_ngrams.score(docs, toxic_ngrams.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_substring_dedup, op2_warc, op3_quality_rules, op4_url_filter, op5_chat, op6_mixing, op7_secret_scan, op8_decontaminate, op9_simhash, op10_token_ids, op11_token_alignment, op12_toxicity, op13_lexical_search]
    return {f.__name__: f for f in own}
