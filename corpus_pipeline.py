"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, tokens.

Each stage takes all that the one before it kept and is written to the folder that driver and executors share, so a lost
executor repeats no earlier stage. As the result of the stage before is written when a stage begins, the tables that it
needed on the way are dropped then. They are noted by folder of the input, so runs over other inputs lose nothing.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import bpe, minhash, mixing, quality, suffix
from gazette.llm.common import drop, keeping, shared_path
from gazette.llm.queries import vocabulary


_TABLES: dict[str, list[str]] = {}


@contextmanager
def _stage(sf_dir: str):
    """Tables made within belong to this stage of the run over ``sf_dir``; those of its stage before go."""
    paths = _TABLES.setdefault(sf_dir, [])
    drop(paths)
    with keeping(paths):
        yield


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cascade."""
    with _stage(sf_dir):
        return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that shares four fifths of its five-word shingles."""
    with _stage(sf_dir):
        return minhash.kept_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a smaller document has."""
    with _stage(sf_dir):
        return suffix.cleaned(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them."""
    with _stage(sf_dir):
        return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of ids and of the decoded bytes."""
    with _stage(sf_dir):
        coded = bpe.round_trip(docs.select("doc_id", "source", "text"), *vocabulary())
    return coded.select(
        "doc_id",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("tokens", tokens),
]

#: Mixing and tokens can't be said in SQL; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
