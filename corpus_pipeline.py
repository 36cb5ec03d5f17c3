"""The corpus pipeline: five stages over documents, each of which works on all that the one before kept.

ORACLE_SQL is None: of the stages only the last can be said in SQL. Null and empty texts are
rejected by the first stage (no language). Repeated rows leave at the second. All stages but the
last return the columns of documents; the last adds `mix_size` and `mix_taken`, the words of a
document and those that the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import decontam, langid, mixing, secret_grammar, simhash
from labelweave.llm.common import fresh, remove, shared_folder, table

#: Least posterior probability of a text's language.
SURE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or whose most likely language isn't likely enough."""
    name = fresh(docs, "_language")
    scored = langid.identify(docs, docs, into=name)
    return scored.where((F.col(f"{name}.lang_pred") != langid.UNKNOWN) & (F.col(f"{name}.score") >= SURE)).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; `n_chars` follows."""
    masked = secret_grammar.redact(docs, secret_grammar.learn(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, and how many."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", hide_secrets),
    ("mixing", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over documents; each but the last is written to the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
