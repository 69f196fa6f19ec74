"""From documents to packed training sequences: each stage works on what the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rolesift.llm.dart_minhash import keep_one
from rolesift.llm.packing import pack, tokenizer_json
from rolesift.llm.surrogates import anonymise
from rolesift.llm.template_leaks import drop_leaks
from rolesift.llm.weak_quality import keep_good
from rolesift.session import shared_folder

# of an Arrow batch; Spark's own bounds are 10,000 rows and 64 MB
BATCH_BYTES = 4 << 20


def bounded(stage: Callable) -> Callable:
    """A stage whose Arrow batches are bounded in this session by bytes too, as whole texts lie in them.

    Each running task holds its batch in the JVM and again in its worker; a stage is lazy,
    so the bound stays set."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return anonymise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return pack(docs, tokenizer_json())


STAGES = [
    ("quality", bounded(quality)),
    ("near_duplicates", bounded(near_duplicates)),
    ("decontamination", bounded(decontamination)),
    ("personal_data", bounded(personal_data)),
    ("packing", bounded(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written to the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# signatures, expectation maximisation, keyed surrogates and the genetic algorithm are beyond SQL
ORACLE_SQL = None
