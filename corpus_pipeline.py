"""A corpus pipeline: languages, near copies, repeated passages, source mix, sampled segmentations.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame;
all but the last return the columns of documents. run() writes every stage as Parquet into the shared
folder and reads it again.

For every stage: rows without an id stay (the language stage decides on them by their text; the others take
them for documents of their own), repeated rows stay or go together, texts count whole, an empty table stays
empty, and further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readflow.llm import jaccard_join, langid, mixing, sentence_pieces, substring_dedup
from readflow.llm.common import shared_checkpoints, small_batches

#: A document stays if its language has at least this confidence.
LEAST_CONFIDENCE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters (null and empty texts too) or without a likely language go."""
    small_batches(spark)
    model = langid.fit(docs)
    return langid.told(docs, model, LEAST_CONFIDENCE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: five-word shingles, a similarity of 0.8."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs, percent=80, width=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that one of a smaller id has; those of which nothing is left go. n_chars follows the text."""
    small_batches(spark)
    cut = substring_dedup.dedup_substrings(docs)
    emptied = (F.size("removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    sized = cut.filter(~emptied).withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return sized.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix_documents(docs, labels)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document; a text with one segmentation alone has one, an empty one an empty one."""
    small_batches(spark)
    return sentence_pieces.sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2, chars=400_000)


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("passages", passages),
    ("source_mix", source_mix),
    ("segmentations", segmentations),
]

#: The sampled segmentations and the classifier can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
