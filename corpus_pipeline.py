"""From raw documents to encoded training text, in five stages over the whole corpus.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and
read as the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import line_dedup, mixing, near_dedup, quality, queries, sentencepiece
from codesift.session import checkpoint_dir


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; fitted on this stage's documents and the labels."""
    return quality.select(docs, quality.fit(docs, queries.table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages; a document of which nothing is left goes."""
    cut = line_dedup.dedup_lines(docs)
    left = cut.where((F.col("n_deleted") == 0) | F.col("text").rlike(line_dedup.WORD))
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return left.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every document of the mix."""
    coded = sentencepiece.encode(docs, queries.sentencepiece_model())
    return queries.digests(coded)


STAGES = [
    ("quality", select_quality),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: The draws, links and ids of the stages have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``; what they pass on lies in the checkpoint folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, at: int) -> DataFrame:
        name, stage = STAGES[at]
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return reduce(step, range(len(STAGES)), spark.read.parquet(f"{sf_dir}/documents.parquet"))
