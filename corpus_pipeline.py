"""A training corpus from documents: language ID, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's result as
Parquet in the shared folder and reads it again, so that a lost executor never repeats more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbase.llm import decontam, langid, mixing, neardup, tokens
from cairnbase.llm.common import small_batches, stored

#: Bounds on what a worker of the token stage holds; the ids don't depend on them.
KEPT_PIECES = 100_000
GROUP_CHARS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; lang becomes the predicted one. Null and letterless texts go."""
    small_batches(spark)
    model = langid.train(docs.where(langid.in_training(F.col("doc_id"))))
    return langid.keep_accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark. Null and empty texts stay; rows of one doc_id go together."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and empty texts, of no words, as mixing.mix_sources() says."""
    return mixing.repeat_documents(docs, mixing.mix_sources(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token-id files of the mix; returns what is read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; repeated rows, and rows without a doc_id, are documents of their own.
    Workers hold fewer pieces than the operator alone does, as the stages before have filled the executors' memory.
    """
    import public_tokenizers

    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.read_token_files(tokens.write_token_files(docs, path, end_id=2, kept=KEPT_PIECES, group_chars=GROUP_CHARS))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_files", token_files)]

#: Models, signatures and token ids have no SQL form; tests/llm holds their operators against brute force and run() against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
