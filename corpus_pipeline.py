"""A corpus pipeline of five stages over ``documents``; each takes the rows that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilum.llm import decontam, mix, pii, quality, simhash
from veilum.llm._store import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of these documents.

    Null and blank texts are scored like others (by statistics of 0), ties at the threshold are accepted, repeated rows fare
    alike, rows without a doc_id are scored but never learned from; without labels all rows stay. Other columns stay as they are.
    """
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id.

    Null and blank texts share a fingerprint and so are one component; of repeated rows and of rows that share a doc_id in a
    component one stays; a null doc_id is larger than any other. An empty table stays empty, other columns stay as they are.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, at a containment of 0.8 or more.

    Null and blank texts hold nothing and stay; repeated rows fare alike; an empty benchmark drops nothing.
    """
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; where that changed a text, n_chars (if there) is the new length.

    Null and blank texts stay as they are, equal values get equal pseudonyms in all rows, an input column private_kinds is
    kept as it was.
    """
    out = pii.pseudonymize(docs.select("*", *([F.col("private_kinds").alias("__v_own")] if "private_kinds" in docs.columns else [])))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("private_kinds") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    if "private_kinds" in docs.columns:
        out = out.withColumn("private_kinds", F.col("__v_own"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each copy taken, numbered by ``copy`` (an input column of that name is replaced).

    Each row is drawn for itself, repeated ones and those without a doc_id or source too; null and blank texts have no words
    and are drawn at their source's rate; an empty table stays empty.
    """
    return mix.mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_private),
    ("mixing sources to target weights", mix_sources),
]

#: The classifier is a trained model, which SQL can't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
