"""Training-data pipeline over ``documents``: five stages of ``tractlens.llm`` operators.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it
kept.  All but the last return the columns of ``docs``; the last returns one row per
document with its piece ids' and decoded text's digests.

Edge cases, by the stages' operators: null and empty texts fail the quality rules and go; a null
language is one of its own; rows without an id are never learned from and are nobody's copy;
of repeated rows and near copies the smallest id stays; texts of any length pass whole; an empty
table passes as an empty table; columns of any name are carried along untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tractlens.llm import decontaminate, fertility, jaccard_join, toxicity, viterbi_pieces
from tractlens.llm.common import read_table, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a fertility band reject go."""
    return fertility.keep_rows(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labelled documents among ``docs``."""
    return toxicity.keep_rows(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, that of the smallest id stays."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in benchmark windows go."""
    return decontaminate.keep_rows(docs, read_table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_crc32, exact)`` of every document."""
    return viterbi_pieces.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: The stages use tokenizers and a trained model, which SQL can't express; the tests
#: compare ``run`` with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
