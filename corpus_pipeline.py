"""A corpus pipeline: stages that each apply one operator to whatever the stage before kept.

Each stage takes (spark, docs, folder) and returns a DataFrame. All but the last return the columns of
``documents``; the last gives token numbers in place of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import linededup, minhash, mixing, sentencepiece_fst, toxicity
from codequarry.sources.store import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, by a model trained on the labelled ones among them."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without runs of lines, and single lines of three words or more, that an earlier place has too."""
    return linededup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of documents with a shingle similarity of 0.8 or more, the one with the smallest id."""
    return minhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Whole documents of each source up to its target; a document can be taken up to three times."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, lang, source, n_chars, token_ids``."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
