"""A corpus pipeline of five stages over documents(doc_id, text, lang, source, n_chars).

language ID -> n-gram Jaccard join -> substring dedup -> benchmark decontamination -> SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of their input. Rows with a null id pass the stages that compare
documents by id; an empty table stays empty. Extra columns are carried along.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, jaccard, language, pieces, substrings
from pairloom.llm.tables import one_row_per_id, split_by_ids
from pairloom.session import ensure_checkpoint_dir

# Near copies: shingles of five words, similarity of 0.8 or more.
SHINGLE = 5
PER_CENT = 80
# Executors come to the encoder with the memory of the stages before, so it takes less text at a time than on its own.
ENCODER_SLICE = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject."""
    return language.keep_identified(docs, language.fit_language_model(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Repeated rows of it count once."""
    groups = jaccard.similar_documents(docs, SHINGLE, PER_CENT)
    return one_row_per_id(split_by_ids(docs, groups.where("doc_id <> component_id").select("doc_id"), "left_anti"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that also stand in a document with a smaller id; n_chars follows the text."""
    kept = substrings.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids): every document as piece ids."""
    encoded = pieces.encode_documents(docs, pieces.load_model(), slice_bytes=ENCODER_SLICE)
    return encoded.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", remove_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

# Training the language model can't be written in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's output is a table in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = posixpath.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
