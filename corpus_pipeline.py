"""From documents to token counts: five stages, each written as Parquet and read again by the next.

quality      documents that the classifier finds poor or toxic go
lines        later copies of repeated line runs go; a document with no line left goes too
near         of each group of near-duplicates (SIMILAR percent of their word shingles) the least doc_id stays
benchmark    documents contaminated by benchmark items go, and all that hold 13 consecutive words of an item, however long they are
tokens       byte-level BPE: number of ids and digests of what is left

All stages but the last return the columns of documents, whatever others there are. n_chars, where there is one, follows the text
where lines go.

Defined results: a null text is an empty one to the classifier, and goes or stays by its verdict; it has no lines, copies or
benchmark words, and no tokens at the end; empty texts alike. Rows repeated are judged alike, and stay or go together, but for near
copies, where a document that is a row repeated stays once more for each row. A null doc_id is never a copy, and its lines come
last. Of equal lines and near copies the smallest doc_id stays, ties by a hash of the text. Very long texts are whole rows in every
stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from terrane.llm.scratch import stash

SIMILAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = "_" * (1 + max(map(len, docs.columns)))  # no column of docs
    left = line_dedup.delete_later_copies(docs, figures=told)
    n_lines, n_removed = F.col(f"{told}.n_lines"), F.col(f"{told}.n_removed")
    left = left.where((n_removed == 0) | (n_removed < n_lines))
    if "n_chars" in docs.columns:
        n_chars = F.when(n_removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", n_chars)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, similar=SIMILAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("tokens", token_stage)]

#: No SQL expresses the classifier, the signatures or the merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
