"""A corpus pipeline of five stages over documents, each one of the training-data operators.

Language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing. Every stage works on all rows its predecessor
kept; all but the last return the columns of documents, as a table that they wrote. Stages run one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import TEXT_ROWS, discard, materialize, table
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.langid import predict, train
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.packing import harmonic_pack

#: A prediction below this probability is rejected, as are texts without a letter.
LEAST_SCORE = 0.5


def written(docs: DataFrame, name: str) -> DataFrame:
    """docs as a table, written by a job that hands Python TEXT_ROWS texts at once, whatever the session's limit and whoever runs the stage."""
    return materialize(docs, name, TEXT_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told. Null and empty texts and texts without letters go."""
    columns = docs.columns
    model = train(docs.select("doc_id", "text", "lang"), F.lit(True))
    return written(predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*columns), "language_id")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand in ten documents or more; no document goes. n_chars is counted anew."""
    return written(line_dedup(docs, min_docs=10, min_chars=1).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns), "line_dedup")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the least doc_id. Documents without words have no links and stay."""
    found = jaccard_components(docs.select("doc_id", "text"), percent=80)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return written(docs.join(gone, "doc_id", "left_anti").select(*docs.columns), "jaccard_join")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item, or an edited copy of one."""
    return written(find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*docs.columns), "decontamination")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens; ids are little-endian unsigned 32-bit numbers."""
    import public_tokenizers

    return harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, cache_words=100_000)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the alignment and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            discard(before)
    return docs
