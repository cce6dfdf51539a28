"""A corpus pipeline of five stages over `documents`; each stage is one of the numbered operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of `documents`; `run` writes what each returns as Parquet in the session's shared folder and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.llm import bpe_dropout, decontaminate, jaccard_join, language_id, line_dedup
from seawake.llm.words import shared_folder


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """`docs` with its columns of these names renamed, as an operator adds columns of its own by them."""
    return docs.withColumnsRenamed({n: f"{n} of docs" for n in names if n in docs.columns})


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` under their own names."""
    return df.select(*(F.col(f"`{n} of docs`").alias(n) if f"{n} of docs" in df.columns else F.col(f"`{n}`") for n in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near no language's centroids go, those without a letter among them."""
    model = language_id.fit(docs, ~language_id.held_out())
    found = language_id.identify(_aside(docs, "lang_pred", "score", "rejected"), model)
    return _back(found.filter(~F.col("rejected")), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut; documents of which nothing is left go."""
    cut = line_dedup.dedup_lines(_aside(docs, "line_runs"))
    return _back(cut.filter(F.col("line_runs").isNull() | F.col("text").rlike(r"\S")), docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text by seeded merge-dropout, and whether they decode to it."""
    return bpe_dropout.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

#: Trained centroids and merge-dropout cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
