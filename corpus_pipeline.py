"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, BPE.

Each stage takes what the one before kept, written as Parquet. A stage's decisions take effect
on the documents themselves; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrid.llm import bpe, decontaminate, language, line_dedup, ngram_join
from voxelgrid.llm._store import written

#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.5
#: The vocabulary file of the last stage, by its public name.
VOCABULARY = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or no language ahead of the others."""
    columns = docs.columns
    model = language.fit(docs)
    found = language.identify(docs, model, lang_out="_lang", score_out="_score")
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines out of the texts; a document of which nothing is left goes."""
    cut = line_dedup.remove_repeated_lines(docs, removed_col="_removed")
    cut = cut.where((F.col("_removed") == 0) | (F.length(F.trim("text")) > 0))
    return cut.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays, and all rows without words."""
    return ngram_join.keep_one_of_similar(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_overlaps(docs, benchmark, out="_overlaps")
    return found.where(F.size("_overlaps") == 0).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts and the digest of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    found = bpe.encode_and_decode(docs.select("doc_id", "text"), path)
    return found.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", remove_benchmark),
    ("BPE encoding and decoding", encode_tokens),
]

#: The stages are not expressible in SQL as a whole; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
