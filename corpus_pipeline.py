"""A training-data pipeline over `documents`: each stage works on what the one before kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm import decontaminate, jaccard_join, language, mixture, secret_scan
from quiltframe.llm.batches import bound_batches
from quiltframe.operators.scratch import store


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, whose language is undetermined."""
    bound_batches(spark)
    model = language.train(docs)
    if not model["nodes"][""]:  # nothing could be learned, which says nothing about the texts
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = language.identify(docs, model, keep=tuple(docs.columns))
    return found.where(F.col("lang_pred") != language.UNKNOWN).select("kept.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles connect, the one with the smallest id stays; unlike texts of one id both do."""
    bound_batches(spark)
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in every text; no document goes."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with how many of their words it takes, repeats counted.

    A column that `documents` has already is added under its name with `mix_` before it.
    """
    found = mixture.mix(docs, keep=tuple(docs.columns)).where("taken > 0")
    held, added = {c.lower() for c in docs.columns}, []
    for name in ("size", "source_size", "target", "taken"):
        free = name
        while free in held:
            free = "mix_" + free
        held.add(free)
        added.append(found[name].alias(free))
    return found.select("kept.*", *added)


STAGES = [
    ("language", known_language),
    ("near copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("mixture", mixed),
]
# The stages fit models, which SQL cannot express; tests/llm checks the operators one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
