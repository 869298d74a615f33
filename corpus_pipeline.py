"""A corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result and reads it again as the next
stage's documents. The last stage adds token ids; all others return the columns of documents.

Rows with a null id pass all stages but those that look at their text. Rows that repeat an id are one document in the
stages of lines and near duplicates, where one row of them stays. Other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontam, jaccard, langid, line_dedup
from quern.llm.common import Work


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (no letters at all, so null and empty texts too) go."""
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, and documents that consist of nothing else."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, Jaccard 0.8) the smallest doc_id stays, of its rows one."""
    return jaccard.keep_first(docs, n=5, least=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and the sha256 of what they decode to, beside all other columns but the text.

    Columns that this stage adds replace those of their names.
    """
    added = ("n_tokens", "ids", "decoded_sha256")
    coded = bpe.encode(docs, F.struct(*(F.col(c) for c in docs.columns if c not in ("text", *added))))
    return coded.select("row.*", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: Language identification and token ids can't be stated in SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Work(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = work.save(name, stage(spark, docs, sf_dir))
        if before:
            work.drop(before)
        before = name
    return docs
